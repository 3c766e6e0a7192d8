"""textloom: corpus-scale text checking and preparation on Spark DataFrames."""
