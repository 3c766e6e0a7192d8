"""Surface rules (punctuation, Unicode, legal wording) as patterns, and what follows from their spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.spans import findings, spans

#: Patterns, and below their levels.
RULES = {
    "punct.repeated-khan": r"\x{17D4}{2,}",
    "punct.repeated-mark": r"[!?]{2,}",
    "punct.space-before-lek-too": r"[ \t\x{200B}]+\x{17D7}",
    "punct.double-lek-too": r"\x{17D7}{2,}",
    "punct.space-before-comma": r"[ \t]+,",
    "unicode.deprecated": r"\x{17D8}",
    "unicode.zwsp-repeat": r"\x{200B}{2,}",
    "unicode.replacement-char": r"\x{FFFD}",
    "unicode.bidi-control": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]",
    "legal.and-or": r"\x{1793}\x{17B7}\x{1784}[ \t\n]*/[ \t\n]*\x{17AC}",
}
#: (severity, confidence)
LEVELS = {
    "punct.repeated-khan": ("warning", 0.9), "punct.repeated-mark": ("suggestion", 0.7), "punct.space-before-lek-too": ("warning", 0.85),
    "punct.double-lek-too": ("warning", 0.85), "punct.space-before-comma": ("suggestion", 0.6), "unicode.deprecated": ("warning", 0.9),
    "unicode.zwsp-repeat": ("suggestion", 0.8), "unicode.replacement-char": ("error", 0.95), "unicode.bidi-control": ("warning", 0.9), "legal.and-or": ("warning", 0.6),
}


def suggestion(rule: F.Column, original: F.Column) -> F.Column:
    """What a rule puts in place of a span; null where a human decides."""
    return (
        F.when(rule == "punct.repeated-khan", F.lit("។"))
        .when(rule == "punct.repeated-mark", F.substring(original, -1, 1))
        .when(rule.isin("punct.space-before-lek-too", "punct.double-lek-too"), F.lit("ៗ"))
        .when(rule == "punct.space-before-comma", F.lit(","))
        .when(rule == "unicode.deprecated", F.lit("។ល។"))
        .when(rule == "unicode.zwsp-repeat", F.lit("​"))
        .when(rule == "unicode.bidi-control", F.lit(""))
    )


def surface_findings(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    found = findings(docs, rules)
    return found.select("doc_id", "rule_id", "start", "stop", "original", suggestion(F.col("rule_id"), F.col("original")).alias("suggestion"))


def located(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Findings with line and column, both from 1; lines end at a line feed only.

    The places of the line feeds are found once a text; a finding looks its line up among them.
    """
    feeds = docs.filter(F.col("text").rlike("|".join(f"(?:{p})" for p in rules.values()))).withColumn("feeds", F.transform(spans(F.col("text"), "\n"), lambda s: s["stop"]))
    each = [F.transform(spans(F.col("text"), p), _named(r)) for r, p in rules.items()]
    found = feeds.select("doc_id", "feeds", F.explode(F.concat(*each)).alias("f"))
    before = F.filter("feeds", lambda x: x <= F.col("f.start"))
    return found.select("doc_id", "f.rule_id", "f.start", (F.size(before) + 1).cast("long").alias("line"), (F.col("f.start") - F.coalesce(F.get(before, F.size(before) - 1), F.lit(0)) + 1).cast("long").alias("col"))


def _named(rule: str):
    return lambda s: F.struct(F.lit(rule).alias("rule_id"), s["start"].alias("start"))


def unbalanced_quotes(docs: DataFrame, opening: str = "«", closing: str = "»") -> DataFrame:
    """Closing quotes without an opening one and opening ones left over, by running sums instead of a stack."""
    found = findings(docs, {"quote": rf"[{opening}{closing}]"}).withColumn("step", F.when(F.col("original") == opening, 1).otherwise(-1))
    forward, backward = Window.partitionBy("doc_id").orderBy("start"), Window.partitionBy("doc_id").orderBy(F.col("start").desc())
    found = found.withColumn("sum", F.sum("step").over(forward)).withColumn("back", F.sum(-F.col("step")).over(backward))
    low = F.coalesce(F.min("sum").over(forward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low_back = F.coalesce(F.min("back").over(backward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lone = ((F.col("step") == -1) & (F.col("sum") < F.least(low, F.lit(0)))) | ((F.col("step") == 1) & (F.col("back") < F.least(low_back, F.lit(0))))
    return found.withColumn("lone", lone).filter("lone").select("doc_id", "start", "original")


def mixed_digits(docs: DataFrame, most: int = 20) -> DataFrame:
    """Runs of the rarer digit system in texts that use both (a tie: the Arabic ones), the first ``most`` of each text."""
    found = findings(docs, {"khmer": r"[\x{17E0}-\x{17E9}]+", "arabic": r"[0-9]+"})
    of_doc = Window.partitionBy("doc_id")
    found = found.withColumn("k", F.count_if(F.col("rule_id") == "khmer").over(of_doc)).withColumn("a", F.count_if(F.col("rule_id") == "arabic").over(of_doc))
    minor = F.when(F.col("a") <= F.col("k"), "arabic").otherwise("khmer")
    found = found.filter((F.col("k") > 0) & (F.col("a") > 0)).filter(F.col("rule_id") == minor)
    return found.withColumn("n", F.row_number().over(of_doc.orderBy("start"))).filter(F.col("n") <= most).select("doc_id", "start", "original", F.col("rule_id").alias("system"))
