"""Scores of findings against expected ones, and texts with known errors put in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that are mistaken for one another, and the words that are swapped for real-word errors.
SWAPS = (("ិ", "ី"), ("ី", "ិ"), ("ុ", "ូ"), ("ូ", "ុ"), ("េ", "ែ"), ("ែ", "េ"), ("ោ", "ៅ"), ("់", "័"), ("ឹ", "ឺ"), ("ឺ", "ឹ"), ("ព", "ភ"), ("ត", "ថ"), ("ទ", "ធ"))
REAL_WORDS = (("និង", "នឹង"), ("នឹង", "និង"), ("ដែល", "ដែរ"), ("ដែរ", "ដែល"))
KINDS = ("confusable", "missing-subscript", "missing-mark", "disordered")


def matched(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n, found_at): for each expected span (doc_id, n, start, stop, categories array) in order of n, the first finding
    (doc_id, m, start, stop, category) that overlaps it, has one of its categories and matches none before; null if none.

    Greedy within a document; its expected spans and findings are gathered in one row.
    """
    e = expected.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "start", "stop", "categories"))).alias("e"))
    f = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("m", "start", "stop", "category"))).alias("f"))
    both = e.join(f, "doc_id", "left").withColumn("f", F.coalesce("f", F.array().cast("array<struct<m:bigint,start:bigint,stop:bigint,category:string>>")))
    none = F.array().cast("array<struct<n:bigint,m:bigint>>")

    def step(done, x):
        used = F.transform(done, lambda d: d["m"])
        fits = F.filter("f", lambda y: (y["start"] < x["stop"]) & (y["stop"] > x["start"]) & F.array_contains(x["categories"], y["category"]) & ~F.coalesce(F.array_contains(F.filter(used, lambda u: u.isNotNull()), y["m"]), F.lit(False)))
        return F.concat(done, F.array(F.struct(x["n"].cast("bigint").alias("n"), F.get(fits, F.lit(0))["m"].cast("bigint").alias("m"))))

    return both.select("doc_id", F.explode(F.aggregate("e", none, step)).alias("x")).select("doc_id", "x.n", F.col("x.m").alias("found_at"))


def scores(items: DataFrame, expected: DataFrame, found: DataFrame) -> DataFrame:
    """By group (and all together, group null): items, expected, hits, misses, false alarms, notes, precision, recall.

    items: (doc_id, group). Findings that overlap an expected span without being its match count neither way; others with
    severity info are notes, the rest false alarms.
    """
    hit = matched(expected, found)
    per = items.join(hit.groupBy("doc_id").agg(F.count("*").alias("expected"), F.count("found_at").alias("hits")), "doc_id", "left")
    used = hit.filter("found_at is not null").select("doc_id", F.col("found_at").alias("m"))
    e = expected.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("t"))
    rest = found.join(used, ["doc_id", "m"], "left_anti").join(e, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("t")) & (F.col("stop") > F.col("s")), "left_anti")
    rest = rest.groupBy("doc_id").agg(F.count_if(F.col("severity") == "info").alias("notes"), F.count_if(F.col("severity") != "info").alias("false_alarms"))
    per = per.join(rest, "doc_id", "left").fillna(0, ["expected", "hits", "notes", "false_alarms"])
    sums = per.rollup("group").agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in ("expected", "hits", "notes", "false_alarms")))
    share = lambda a, b: F.when(b > 0, a / b)
    return sums.withColumns({"misses": F.col("expected") - F.col("hits"), "precision": share(F.col("hits"), F.col("hits") + F.col("false_alarms")), "recall": share(F.col("hits"), F.col("expected"))})


def flag_rates(found: DataFrame, stats: DataFrame, left_out: tuple[str, ...] = ("punct.missing-final-khan",)) -> DataFrame:
    """One row: flags and notes in held-out texts, and both for 1,000 words (stats: doc_id, n_words)."""
    counts = found.filter(~F.col("rule_id").isin(*left_out)).agg(F.count_if(F.col("severity") != "info").alias("flags"), F.count_if(F.col("severity") == "info").alias("notes"))
    words = stats.agg(F.sum("n_words").alias("n_words"))
    return counts.join(words).withColumns({"flags_per_1000": 1000 * F.col("flags") / F.col("n_words"), "notes_per_1000": 1000 * F.col("notes") / F.col("n_words")})


def _generator(seed: int):
    """A 32-bit generator of numbers from 0 to 1 with equal streams for equal seeds (mulberry32)."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (1 | state)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    return draw


def corrupted(word: str, kind: str, seed: int) -> str | None:
    """The word with one error of a kind, or None where it has no place for it."""
    import re

    draw = _generator(seed)
    if kind == "confusable":
        options = [(a, b) for a, b in SWAPS if a in word]
        if not options:
            return None
        a, b = options[int(draw() * len(options))]
        return word.replace(a, b, 1)
    if kind == "disordered":
        return word.replace("ុំ", "ំុ", 1) if "ុំ" in word else None
    places = [m.span() for m in re.finditer("្[ក-អ]" if kind == "missing-subscript" else "[់័៍]", word)]
    if not places:
        return None
    start, stop = places[int(draw() * len(places)) if kind == "missing-subscript" else 0]
    return word[:start] + word[stop:]


def with_errors(words: DataFrame, seed: int = 20261009) -> DataFrame:
    """(doc_id, start, kind, word, bad) of words (doc_id, start, word): one row for each kind of error that fits; the draw
    depends on the seed and the row only, so a repeated task gives the same."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        for batch in batches:
            out = []
            for doc, start, word in zip(*(c.to_pylist() for c in batch.columns)):
                for k in KINDS:
                    bad = corrupted(word, k, seed ^ zlib.crc32(f"{doc}:{start}:{k}".encode()))
                    if bad is not None and bad != word:
                        out.append((doc, start, k, word, bad))
            columns = list(zip(*out)) or [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "kind", "word", "bad"])

    return words.select("doc_id", "start", "word").mapInArrow(run, f"doc_id {kind}, start long, kind string, word string, bad string")


def swapped(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, text): texts with the first use of a word replaced by one it is mistaken for, a row for each pair."""
    out = None
    for a, b in REAL_WORDS:
        at = F.instr("text", F.lit(a))
        one = docs.filter(at > 0).select("doc_id", F.lit(f"{a}>{b}").alias("kind"), (at - 1).cast("long").alias("start"), F.concat(F.substring("text", F.lit(1), at - 1), F.lit(b), F.substring("text", at + len(a), F.length("text"))).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def detection(trials: DataFrame, found: DataFrame, categories: tuple[str, ...] = ("spelling", "unicode")) -> DataFrame:
    """(kind, trials, detected, corrected) of trials (doc_id, kind, start, stop, word): a finding of a category overlaps the error;
    one of its suggestions, cut to the error's span, is the word."""
    f = found.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"), "category", "suggestions")
    meet = (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("stop") > F.col("s")) & F.col("category").isin(*categories)
    rows = trials.join(f, meet, "left")
    right = F.coalesce((F.col("s") == F.col("start")) & (F.col("e") == F.col("stop")) & F.array_contains("suggestions", F.col("word")), F.lit(False))
    per = rows.groupBy("doc_id", "kind", "start").agg(F.max(F.col("s").isNotNull()).alias("hit"), F.max(right).alias("right"))
    return per.groupBy("kind").agg(F.count("*").alias("trials"), F.count_if("hit").alias("detected"), F.count_if("right").alias("corrected"))
