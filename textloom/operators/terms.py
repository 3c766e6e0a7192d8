"""Terminology: user rules over documents, lexicon merging, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_term_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(preferred, variants) of lines 'preferred = v1, v2'; empty variants and lines without '=' go."""
    sides = F.split(column, "=", 2)
    variants = F.filter(F.transform(F.split(F.get(sides, F.lit(1)), "[,\\x{FF0C}\\x{3001}]"), lambda v: F.trim(v)), lambda v: v != "")
    return lines.filter(F.col(column).contains("=")).select(F.trim(F.get(sides, F.lit(0))).alias("preferred"), variants.alias("variants")).filter("preferred <> '' and size(variants) > 0")


#: Term rules are user input and become part of the plan; more are refused.
MAX_RULES = 5000


def term_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """How often each variant occurs in each document, without overlap; rules are a table of (preferred, variant).

    The rules are an array of at most MAX_RULES pairs (an error beyond), so the documents are scanned once, without a join.
    """
    pairs = [(r["preferred"], r["variant"]) for r in rules.select("preferred", "variant").distinct().limit(MAX_RULES + 1).collect()]
    if len(pairs) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} term rules")
    listed = F.array(*(F.struct(F.lit(p).alias("preferred"), F.lit(v).alias("variant")) for p, v in pairs if v)) if any(v for _, v in pairs) else F.array().cast("array<struct<preferred:string,variant:string>>")
    found = docs.select("doc_id", "text", F.explode(F.filter(listed, lambda r: F.col("text").contains(r["variant"]))).alias("r"))
    n = ((F.length("text") - F.length(F.replace("text", F.col("r.variant"), F.lit("")))) / F.length("r.variant")).cast("long")
    return found.select("doc_id", "r.preferred", "r.variant", n.alias("n"))


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """One row a key: flags and parts of speech united, the greatest frequency."""
    return entries.groupBy("key").agg(F.bit_or("f").alias("f"), F.max("n").alias("n"), F.bit_or("p").alias("p"))


def bigram_counts(sentences: DataFrame, least: int = 3) -> DataFrame:
    """Counts of neighbouring words in (doc_id, sent, words), ``least`` or more."""
    pairs = F.filter(F.transform("words", lambda w, i: F.struct(F.get("words", i - 1).alias("a"), w.alias("b"))), lambda x: x["a"].isNotNull())
    return sentences.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def latest_decisions(log: DataFrame, keys: tuple[str, ...], at: str, order: str) -> DataFrame:
    """The latest row of each key of an append-only log."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(order).desc()))
    return log.withColumn("_n", n).filter("_n = 1").drop("_n")


def fixed_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per user: windows of ``seconds`` from the epoch, with event counts."""
    start = F.floor(F.unix_timestamp("ts") / seconds) * seconds
    return events.groupBy("user_id", start.cast("long").alias("window_start")).agg(F.count("*").alias("n"))
