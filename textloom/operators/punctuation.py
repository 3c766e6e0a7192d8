"""Punctuation rules that need their surroundings, and findings about the storage order of clusters. One scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import chars, normalize
from textloom.functions.spans import spans

KHMER_END = r"[\x{1780}-\x{17D3}\x{17DD}]"
# Patterns of the rules; the last character of a match is what is flagged.
CONTEXT_RULES = {
    "punct.latin-period": r"(?<=[\x{1780}-\x{17DD}]{3})\.(?=[ \t]*(?:\n|\z|[\x{1780}-\x{17FF}]))",
    "punct.latin-colon": r"(?<=[\x{1780}-\x{17DD}]|[\x{1780}-\x{17DD}][ \t]):(?=[ \t]*(?:\n|\z|[\x{1780}-\x{17FF}]|[-\x{2022}]))",
    "punct.space-after-khan": r"(?<!\x{17D4}\x{179B})\x{17D4}(?=[\x{1780}-\x{17B3}])(?!\x{179B})",
    "punct.lek-too-without-word": r"(?:\A|[\n\x{17D4}\x{17D5}?!\x{00AB}(])[ \t]*\x{17D7}",
}
SUGGESTED = {"punct.latin-period": "។", "punct.latin-colon": "៖", "punct.space-after-khan": "។ "}
LIST_ITEM = r"\A\s*(?:[-\x{2022}*\x{2013}]|[0-9\x{17E0}-\x{17E9}]+[.)]|[\x{1780}-\x{17A2}][.)]|\x{1798}\x{17B6}\x{178F}\x{17D2}\x{179A}\x{17B6}|\x{1787}\x{17C6}\x{1796}\x{17BC}\x{1780}|\x{1795}\x{17D2}\x{1793}\x{17C2}\x{1780}|\x{1780}\x{1790}\x{17B6}\x{1781}\x{178E}\x{17D2}\x{178C})"
LEAST_CHARS, LEAST_RUNS = 60, 4


def _row(rule: str, start: Column, stop: Column, original: Column, given: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), start.alias("start"), stop.alias("stop"), original.alias("original"), given.cast("string").alias("suggestion"))


def unfinished_lines(text: Column) -> Column:
    """Long lines of Khmer prose, no list items, that end in a letter: their last cluster run and what it would be with a full stop."""
    trimmed = lambda s: F.regexp_replace(s["original"], r"[\s\x{A0}\x{200B}\x{3000}\x{FEFF}]+\z", "")
    lines = F.transform(spans(text, r"[^\n]+"), lambda s: F.struct(s["start"].alias("start"), trimmed(s).alias("t")))
    prose = lambda x: (F.length(x["t"]) >= LEAST_CHARS) & (F.regexp_count(x["t"], F.lit(rf"{chars.BASE}+")) >= LEAST_RUNS) & ~x["t"].rlike(LIST_ITEM) & x["t"].rlike(rf"{KHMER_END}\z")

    def one(x: Column) -> Column:
        last = F.regexp_extract(x["t"], rf"({KHMER_END}+)\z", 1)
        stop = x["start"] + F.length(x["t"])
        return _row("punct.missing-final-khan", stop - F.length(last), stop, last, F.concat(last, F.lit("។")))

    return F.transform(F.filter(lines, prose), one)


def reordered_clusters(text: Column) -> Column:
    """Clusters that are not in storage order, with the form that is; marks without a base are another rule's."""
    found = F.transform(spans(text, normalize.CLUSTER), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["original"].alias("o"), normalize.normalize_cluster(s["original"]).alias("n")))
    wrong = F.filter(found, lambda x: (x["o"] != x["n"]) & x["o"].rlike(rf"\A{chars.BASE}"))
    return F.transform(wrong, lambda x: _row("unicode.cluster-order", x["start"], x["stop"], x["o"], x["n"]))


def orphan_marks(text: Column) -> Column:
    found = F.filter(spans(text, normalize.CLUSTER), lambda s: ~s["original"].rlike(rf"\A{chars.BASE}"))
    return F.transform(found, lambda s: _row("unicode.orphan-mark", s["start"], s["stop"], s["original"], F.lit(None)))


def context_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule_id, start, stop, original, suggestion) of all rules of this module."""
    text = F.col("text")
    parts = [_flagged(text, r, p) for r, p in CONTEXT_RULES.items()]
    parts += [unfinished_lines(text), reordered_clusters(text), orphan_marks(text)]
    return docs.filter(text.rlike(r"[\x{1780}-\x{17FF}]")).select("doc_id", F.inline(F.concat(*parts)))


def _flagged(text: Column, rule: str, pattern: str) -> Column:
    return F.transform(spans(text, pattern), lambda s: _row(rule, s["stop"] - 1, s["stop"], F.substring(s["original"], -1, 1), F.lit(SUGGESTED.get(rule))))
