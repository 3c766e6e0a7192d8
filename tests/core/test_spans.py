"""Spans against re, on texts of few and of very many matches."""

import re

from pyspark.sql import functions as F

from textloom.functions import spans


def test_spans_match_brute_force(spark):
    texts = ["", "a", "b1", "1", "12a3", "x1" * 63, "1x" * 64, "1xyz" * 65, "é12 ក3 " * 20000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    for r in got:
        want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", texts[r["i"]] or "")]
        assert list(map(tuple, r["s"])) == want
