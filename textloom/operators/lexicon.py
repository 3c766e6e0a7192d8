"""The lexicon as a table (key, f flags, n frequency, p parts of speech) and what is asked of it.

A key is a word in storage order without zero-width characters. Flags say which sources have the word. All of it
is DataFrame work; only distances go through Arrow, on pairs that share a blocking key.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import distance, normalize

# Bits of the sources, best source first in RANK, and bits of the parts of speech.
SOURCES = {"headword": 1, "attested": 2, "wordlist": 4, "modern": 8, "legal": 16, "name": 32, "approved": 64, "function": 128, "user": 256, "misspelling": 512, "colloquial": 1024}
RANK = ("approved", "user", "headword", "legal", "modern", "name", "function", "attested", "colloquial", "wordlist")
AUTHORITATIVE = sum(SOURCES[s] for s in ("headword", "approved", "legal", "modern", "name", "function", "user", "colloquial"))
MISSPELLING = SOURCES["misspelling"]
POS = {"N": 1, "V": 2, "ADJ": 4, "ADV": 8, "PRON": 16, "PART": 32, "NUM": 64, "CLF": 128, "PREP": 256, "CONJ": 512, "INTJ": 1024}
LEXICON = "key string, f int, n int, p int"


def bits(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask)) != 0


def entries(words: DataFrame, source: str, word: str = "word", frequency: Column | None = None, pos: Column | None = None) -> DataFrame:
    """Lexicon rows of one source."""
    zero = F.lit(0)
    rows = words.select(normalize.word_key(F.col(word)).alias("key"), F.lit(SOURCES[source]).alias("f"), (zero if frequency is None else frequency).cast("int").alias("n"), (zero if pos is None else pos).cast("int").alias("p"))
    return rows.filter("key <> ''")


def pos_bits(names: Column) -> Column:
    """Bits of comma-separated names; unknown names count nothing."""
    out = F.lit(0)
    for name, bit in POS.items():
        out = out.bitwiseOR(F.when(F.array_contains(F.transform(F.split(names, ","), F.trim), name), bit).otherwise(0))
    return out


def marked_misspellings(lexicon: DataFrame, wrong: DataFrame, word: str = "wrong") -> DataFrame:
    """The lexicon with the misspelling bit on the keys of a list of wrong forms; new keys are added."""
    return merged(lexicon.unionByName(entries(wrong, "misspelling", word)))


def merged(rows: DataFrame) -> DataFrame:
    """One row a key: flags and parts of speech united, the greatest frequency."""
    return rows.groupBy("key").agg(F.bit_or("f").alias("f"), F.max("n").alias("n"), F.bit_or("p").alias("p"))


def with_words(lexicon: DataFrame, lists: DataFrame, column: str = "value", source: str = "user") -> DataFrame:
    """The lexicon with the Khmer words of a list of lines, split at white space and zero-width spaces."""
    word = F.explode(F.split(column, r"[\s\x{200B}]+"))
    words = lists.select(word.alias("word")).filter(F.col("word").rlike(r"\A[\x{1780}-\x{17D3}\x{17DD}]+\z"))
    return merged(lexicon.unionByName(entries(words, source)))


def known(f: Column) -> Column:
    """Whether a word counts as a word: it has a source other than the list of wrong forms."""
    return bits(F.coalesce(f, F.lit(0)), (1 << 30) - 1 - MISSPELLING)


def weak(f: Column, n: Column) -> Column:
    """Attested in a broad list only, and seldom."""
    return f.isNotNull() & ~bits(f, AUTHORITATIVE) & (F.coalesce(n, F.lit(0)) < 3)


def source_rank(f: Column) -> Column:
    """0 for the best source; len(RANK) where there is none."""
    out = F.lit(len(RANK))
    for k in range(len(RANK) - 1, -1, -1):
        out = F.when(bits(f, SOURCES[RANK[k]]), k).otherwise(out)
    return out


def primary_source(f: Column) -> Column:
    return F.get(F.array(*map(F.lit, RANK)), source_rank(f))


def with_inherited_pos(lexicon: DataFrame) -> DataFrame:
    """Words without parts of speech take those of the longest entry that they begin with (authoritative, with parts of
    speech, of two characters or more), if the rest is an entry too."""
    bare = lexicon.filter("p = 0").select("key", F.explode(F.sequence(F.lit(2), F.greatest(F.length("key") - 1, F.lit(2)))).alias("cut")).filter(F.col("cut") < F.length("key"))
    bare = bare.select("key", "cut", F.substring("key", F.lit(1), F.col("cut")).alias("head"), F.substring("key", F.col("cut") + 1, F.length("key")).alias("tail"))
    heads = lexicon.filter((F.col("p") != 0) & bits(F.col("f"), AUTHORITATIVE)).select(F.col("key").alias("head"), F.col("p").alias("head_p"))
    tails = lexicon.select(F.col("key").alias("tail"))
    found = bare.join(heads, "head").join(tails, "tail").groupBy("key").agg(F.max_by("head_p", "cut").alias("inherited"))
    return lexicon.join(found, "key", "left").select("key", "f", "n", F.coalesce(F.when(F.col("p") != 0, F.col("p")), "inherited", F.lit(0)).alias("p"))


def authoritative(lexicon: DataFrame) -> DataFrame:
    return lexicon.filter(bits(F.col("f"), AUTHORITATIVE))


def folded(column: str = "key") -> Column:
    return F.replace(F.replace(F.col(column), F.lit("្ដ"), F.lit("្ត")), F.lit("ឲ"), F.lit("ឱ"))


def variant_groups(lexicon: DataFrame) -> DataFrame:
    """(fold, forms): spellings of one folded key, two or more, of which one at least is authoritative, of three units or more."""
    rows = lexicon.filter(known(F.col("f"))).withColumn("fold", folded())
    groups = rows.groupBy("fold").agg(F.array_sort(F.collect_list("key")).alias("forms"), F.max(bits(F.col("f"), AUTHORITATIVE)).alias("sure"))
    return groups.filter("size(forms) >= 2 and sure").filter(F.size(normalize.units(F.get("forms", F.lit(0)))) >= 3).select("fold", "forms")


def variants(lexicon: DataFrame) -> DataFrame:
    """(key, variant, f): other known spellings with the same folded key."""
    rows = lexicon.withColumn("fold", folded())
    others = rows.filter(known(F.col("f"))).select("fold", F.col("key").alias("variant"), "f")
    return rows.select("key", "fold").join(others, "fold").filter("key <> variant").select("key", "variant", "f")


def _described(words: DataFrame) -> DataFrame:
    """words with units (how many), bucket and signature of key."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            parts = [distance.units_of(k) for k in keys]
            extra = [pa.array([len(u) for u in parts], pa.int32()), pa.array([distance.sound_bucket(k) for k in keys], pa.string()), pa.array([distance.signature(u) for u in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "units", "bucket", "signature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{schema}, units int, bucket string, signature long")


def most_distance(units: Column) -> Column:
    return F.when(units <= 2, 0.6).when(units <= 4, 1.0).when(units <= 7, 1.5).otherwise(2.0)


def candidates(words: DataFrame, lexicon: DataFrame, limit: int = 5, sure_only: bool = False, most: float | None = None, wide: bool = True) -> DataFrame:
    """(key, candidate, distance, f, n, place) of the distinct keys of words: lexicon entries within the allowed distance.

    Pairs share the sound bucket of the first letter and a band of lengths; the signatures leave most of them out before the
    distance is computed. Keys of four units or more without any candidate are compared with all buckets
    if ``wide`` (a length band then is the blocking key). Order: distance, source, frequency, length, word.
    """
    asked = _described(words.select("key").filter("key <> ''").distinct())
    asked = asked.withColumn("most", most_distance(F.col("units")) if most is None else F.lit(float(most)))
    span = F.ceil(F.col("most") / distance.LEAST_INDEL).cast("int")
    band = F.explode(F.sequence(F.greatest(F.col("units") - span, F.lit(1)), F.col("units") + span))
    asked = asked.select("key", "bucket", "signature", "units", "most", band.alias("length"))
    fits = known(F.col("f")) & ~bits(F.col("f"), MISSPELLING) & (bits(F.col("f"), AUTHORITATIVE) if sure_only else F.lit(True))
    forms = _described(lexicon.filter(fits).select("key", "f", "n")).select(F.col("key").alias("candidate"), "f", "n", F.col("units").alias("length"), F.col("bucket").alias("home"), F.col("signature").alias("other"))
    near = (F.ceil(F.bit_count(F.col("signature").bitwiseXOR(F.col("other"))) / 2) * 0.5 <= F.col("most")) & (F.col("key") != F.col("candidate"))

    def run(batches):
        units = {}
        for batch in batches:
            found = []
            for key, other, least in zip(*(batch.column(c).to_pylist() for c in ("key", "candidate", "most"))):
                if key not in units:
                    units.clear()  # rows of a key come together, or are few
                    units[key] = distance.units_of(key)
                found.append(distance.weighted_distance(units[key], distance.units_of(other), least))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x if math.isfinite(x) else None for x in found], pa.float64())], [*batch.schema.names, "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(near).select("key", "candidate", "f", "n", "most")
        found = pairs.mapInArrow(run, "key string, candidate string, f int, n int, most double, d double")
        return found.filter("d <= most and d > 0").select("key", "candidate", F.round("d", 2).alias("distance"), "f", "n")

    found = measured(asked.join(forms.withColumnRenamed("home", "bucket"), ["bucket", "length"]))
    if wide:
        rest = asked.filter("units >= 4").join(found.select("key").distinct(), "key", "left_anti")
        found = found.unionByName(measured(rest.join(forms.filter("true"), "length").filter(F.col("bucket") != F.col("home"))))
    order = Window.partitionBy("key").orderBy("distance", source_rank(F.col("f")), F.col("n").desc(), F.length("candidate").desc(), "candidate")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
