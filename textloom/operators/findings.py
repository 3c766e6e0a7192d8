"""What becomes of findings: levels, one per span, numbers and context, corrections, counts, reports, evaluation.

Findings are rows (doc_id, rule_id, start, stop, original, suggestion). Lists are gathered by document
or by span only, so a list is never longer than the findings of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.meaning import csv_cell, html_escape
from textloom.functions.spans import findings, spans
from textloom.operators.surface import LEVELS

#: Layers of rules by the first part of their name; of findings on one span the first layer wins.
LAYERS = ("unicode", "punct", "terminology", "legal")
CONTEXT = 40
#: White space of any kind.
BLANKS = tuple(map(chr, (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def _levels(rule: Column, at: int, default) -> Column:
    out = F.lit(default)
    for name, level in LEVELS.items():
        out = F.when(rule == name, F.lit(level[at])).otherwise(out)
    return out


def graded(found: DataFrame) -> DataFrame:
    """With category, severity and confidence; a rule without a level is a suggestion of 0.5."""
    rule = F.col("rule_id")
    return found.withColumns({"category": F.substring_index(rule, ".", 1), "severity": _levels(rule, 0, "suggestion"), "confidence": _levels(rule, 1, 0.5)})


def one_per_span(found: DataFrame) -> DataFrame:
    """(doc_id, start, stop, rule_id, also_flagged_by): first layer, then greatest confidence, then rule name."""
    layer = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LAYERS)), F.col("category")), F.lit(0)), F.lit(99))
    order = F.struct(layer.alias("l"), (-F.col("confidence")).alias("c"), F.col("rule_id").alias("r"))
    spans = graded(found).groupBy("doc_id", "start", "stop").agg(F.min(order).alias("first"), F.collect_set("rule_id").alias("all"))
    others = F.array_sort(F.array_remove("all", F.col("first.r")))
    return spans.select("doc_id", "start", "stop", F.col("first.r").alias("rule_id"), F.array_join(others, ",").alias("also_flagged_by"))


def numbered(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Findings in text order, named F001 and on, with up to CONTEXT characters on both sides."""
    order = Window.partitionBy("doc_id").orderBy("start", F.col("stop").desc(), "rule_id")
    begin = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    context = F.substring("text", (begin + 1).cast("int"), (F.col("stop") + CONTEXT - begin).cast("int"))
    # texts stay behind: only the context goes through the window's exchange
    found = findings(docs, rules).select("doc_id", "rule_id", "start", "stop", context.alias("context"), (F.col("start") - begin).alias("context_offset"))
    found = found.withColumn("n", F.row_number().over(order))
    name = F.concat(F.lit("F"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string")))
    return found.select("doc_id", name.alias("finding_id"), "rule_id", "start", "stop", "context", "context_offset")


def corrected(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with suggestions put in, from the left, overlapping ones left out; texts without any stay."""
    edit = F.struct("start", "stop", "suggestion")
    edits = found.filter("suggestion is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, e: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (e["start"] - acc["at"]).cast("int"))
        return F.when(e["start"] < acc["at"], acc).otherwise(F.struct(e["stop"].alias("at"), F.concat(acc["out"], gap, e["suggestion"]).alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", none, put, rest))
    return docs.select("doc_id", "text").join(edits, "doc_id", "left").select("doc_id", text.alias("text"))


def by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Findings of every document by severity, zero where there are none."""
    names = ("error", "warning", "suggestion")
    counts = graded(found).groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in names))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", *(F.coalesce(f"n_{s}", F.lit(0)).cast("long").alias(f"n_{s}") for s in names))


def by_category(found: DataFrame) -> DataFrame:
    """Counts by category and severity, with subtotals and the total (null names)."""
    return graded(found).rollup("category", "severity").agg(F.count("*").alias("n"))


def visible(found: DataFrame, rejected: DataFrame, least_confidence: float = 0.0, fixable_only: bool = False) -> DataFrame:
    """Findings that no decision (doc_id, rule_id, start) rejected, of some confidence, with a suggestion if asked."""
    found = graded(found).join(rejected.select("doc_id", "rule_id", "start").distinct(), ["doc_id", "rule_id", "start"], "left_anti")
    found = found.filter(F.col("confidence") >= least_confidence)
    return found.filter("suggestion is not null") if fixable_only else found


def csv_rows(found: DataFrame) -> DataFrame:
    """(doc_id, start, rule_id, csv_row): one CSV line a finding."""
    cells = ("doc_id", "start", "stop", "original", "category", "severity", "suggestion", "rule_id")
    return graded(found).select("doc_id", "start", "rule_id", F.concat_ws(",", *(csv_cell(F.col(c)) for c in cells)).alias("csv_row"))


def html_lists(found: DataFrame) -> DataFrame:
    """(doc_id, html): the findings of a document as a list, by place."""
    item = F.concat(F.lit("<li>"), F.col("rule_id"), F.lit(" <mark>"), html_escape(F.col("original")), F.lit("</mark></li>"))
    items = F.array_sort(F.collect_list(F.struct("start", "rule_id", item.alias("item"))))
    return found.groupBy("doc_id").agg(items.alias("i")).select("doc_id", F.concat(F.lit("<ul>"), F.array_join(F.transform("i", lambda x: x["item"]), ""), F.lit("</ul>")).alias("html"))


def nth_occurrence(docs: DataFrame, part: str, n: int) -> DataFrame:
    """(doc_id, start, stop) of the n-th occurrence of a string, counted from 1; occurrences may overlap."""
    # an empty match before each occurrence, so that the next search starts one character on
    found = F.get(spans(F.col("text"), rf"(?s).(?<={_quoted(part[:1])})(?={_quoted(part[1:])})"), F.lit(n - 1))
    return docs.select("doc_id", found["start"].alias("start")).filter("start is not null").select("doc_id", "start", (F.col("start") + len(part)).alias("stop"))


def _quoted(x: str) -> str:
    return "".join(rf"\x{{{ord(c):X}}}" for c in x)


def agreement(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: expected spans, those that a finding overlaps, findings, and findings that overlap none."""
    a = expected.select("doc_id", F.col("start").alias("s"), F.col("stop").alias("e"))
    meet = (a["doc_id"] == found["doc_id"]) & (found["start"] < F.col("e")) & (found["stop"] > F.col("s"))
    rows = [(a, "n_expected"), (a.join(found, meet, "left_semi"), "n_hit"), (found, "n_found"), (found.join(a, meet, "left_anti"), "n_false")]
    out = None
    for rows_of, name in rows:
        one = rows_of.select(F.lit(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.agg(*(F.count_if(F.col("name") == name).alias(name) for _, name in rows))


def wide_gaps(docs: DataFrame) -> DataFrame:
    """Two or more blanks between two characters that are no white space: (doc_id, start, stop)."""
    found = findings(docs, {"punct.multiple-spaces": " {2,}"})
    before = F.substring("text", F.col("start").cast("int"), F.lit(1))
    after = F.substring("text", (F.col("stop") + 1).cast("int"), F.lit(1))
    blank = [F.lit(x) for x in (*BLANKS, "")]
    return found.filter((F.col("start") > 0) & ~before.isin(*blank) & ~after.isin(*blank)).select("doc_id", "start", "stop")


def spaced_khan(docs: DataFrame) -> DataFrame:
    """Full stops after a blank, in texts that mostly write them without: (doc_id, start, stop)."""
    found = findings(docs, {"spaced": r"[\x{1780}-\x{17DD}] \x{17D4}", "tight": r"[\x{1780}-\x{17DD}]\x{17D4}"})
    of_doc = Window.partitionBy("doc_id")
    found = found.withColumns({f"n_{r}": F.count_if(F.col("rule_id") == r).over(of_doc) for r in ("spaced", "tight")})
    return found.filter("rule_id = 'spaced' and n_spaced < n_tight").select("doc_id", (F.col("start") + 1).alias("start"), "stop")


def legacy_font(docs: DataFrame) -> DataFrame:
    """Documents that look like text of a font without Unicode."""
    text = F.col("text")
    return docs.filter((F.length(text) > 40) & text.rlike(r"[A-Za-z\[\];'\\]{25,}") & ~text.rlike(r"[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]")).select("doc_id")
