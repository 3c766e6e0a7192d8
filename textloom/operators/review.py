"""What a reviewer gets: findings as full records, the legal guard, final order, the report model, and checks of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import chars
from textloom.functions.meaning import csv_cell, html_escape, meaning_signature

# Categories that only touch wording, ranks of severities, words of a decision.
WORDING = ("wording", "unnecessary", "structure", "clarity", "repetition", "missing")
SEVERITY_RANK = {"error": 0, "warning": 1, "suggestion": 2, "info": 3}
STATUS = {"open": "Open", "accepted": "Accepted", "rejected": "Rejected"}
HEADERS = ("No", "Status", "Paragraph", "Line", "Column", "Start", "End", "Original passage", "Flagged text", "Category", "Category (Khmer)", "Severity", "Explanation", "Suggested correction", "Confidence", "Confidence level", "Source reference", "Source (English)", "Source URL", "Rule", "Human review")
CATEGORY_OF = {"spelling": "spelling", "grammar": "grammar", "structure": "structure", "wording": "wording", "missing": "missing", "style": "unnecessary", "punct": "punctuation", "repetition": "repetition", "clarity": "clarity", "meaning": "clarity", "legal": "clarity", "terminology": "terminology", "unicode": "unicode"}


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.55, "medium").otherwise("low")


def record(found: DataFrame) -> DataFrame:
    """Findings (rule_id, start, stop, original, suggestions, severity, confidence, ...) as full records: category, confidence
    within 0.05 and 0.99 and its level, suggestions without repeats and nulls, whether a human must look."""
    first = F.substring_index("rule_id", ".", 1)
    category = F.when(F.col("rule_id") == "spelling.unknown", "unverified").otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_OF.items() for x in kv)), first), first))
    confidence = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("confidence"))), 2)
    given = F.array_distinct(F.filter(F.coalesce("suggestions", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return found.withColumns({"category": category, "confidence": confidence, "suggestions": given, "severity": F.coalesce("severity", F.lit("warning"))}).withColumns({"confidence_level": level(F.col("confidence")), "human_review": F.lit(False), "safe": (F.size("suggestions") > 0) & (F.col("confidence") >= 0.8)})


def legal_guard(records: DataFrame) -> DataFrame:
    """In legal texts a change of wording, or of a word that carries meaning, is never safe and always a human's to decide."""
    changes = F.exists("suggestions", lambda s: meaning_signature(s) != meaning_signature(F.col("original")))
    guarded = changes | F.col("category").isin(*WORDING)
    note = F.when(changes, "meaning").when(F.col("category").isin(*WORDING), "wording")
    return records.withColumns({"legal_note": note, "human_review": F.col("human_review") | guarded, "safe": F.col("safe") & ~guarded})


def ordered(records: DataFrame, docs: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """Records named F001 and on, by start, severity and length, with line, column and paragraph, and the sentence as context
    (40 characters on both sides where no sentence holds the finding).

    Places and context are cut in one join per document before any window, so texts are not carried through it.
    """
    rank = F.lit(9)
    for name, r in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    by = Window.partitionBy("doc_id").orderBy("start", rank, F.col("stop").desc(), "rule_id")
    # a line is a paragraph's first if it has something and the one before has not
    lines = F.split("text", "\n", -1)
    blank = lambda x: F.trim(F.regexp_replace(x, r"[\s\x{A0}\x{3000}\x{FEFF}]+", " ")) == ""
    starts = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (~blank(x) & ((i == 0) | blank(F.get(lines, i - 1)))).cast("int").alias("p")))
    places = docs.select("doc_id", F.posexplode(starts).alias("line", "x"))
    run = Window.partitionBy("doc_id").orderBy("line")
    places = places.select("doc_id", "line", (F.sum(F.col("x.n") + 1).over(run) - F.col("x.n") - 1).alias("from"), F.sum("x.n").over(run).alias("n"), F.sum("x.p").over(run).alias("paragraph"), F.col("x.n").alias("size"))
    p = places.select(F.col("doc_id").alias("d"), "line", "from", "paragraph", "size")
    located = records.join(p, (F.col("doc_id") == F.col("d")) & (F.col("start") >= F.col("from")) & (F.col("start") <= F.col("from") + F.col("size"))).drop("d", "size")
    begin = F.greatest(F.col("start") - 40, F.lit(0))
    text = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("whole"))
    located = located.join(text, F.col("doc_id") == F.col("d")).withColumn("near", F.substring("whole", (begin + 1).cast("int"), (F.col("stop") + 40 - begin).cast("int"))).withColumn("near_at", F.col("start") - begin).drop("d", "whole")
    if sentences is not None:
        s = sentences.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"), F.col("text").alias("sentence"))
        located = located.join(s, (F.col("doc_id") == F.col("d")) & (F.col("start") >= F.col("s")) & (F.col("start") < F.col("e")), "left").withColumns({"near": F.coalesce("sentence", "near"), "near_at": F.when(F.col("s").isNotNull(), F.col("start") - F.col("s")).otherwise(F.col("near_at"))}).drop("d", "s", "e", "sentence")
    located = located.withColumn("no", F.row_number().over(by))
    name = F.concat(F.lit("F"), F.when(F.col("no") < 1000, F.lpad(F.col("no").cast("string"), 3, "0")).otherwise(F.col("no").cast("string")))
    located = located.withColumns({"finding_id": name, "column": F.col("start") - F.col("from") + 1, "line": F.col("line") + 1})
    return located.withColumnRenamed("near", "context").withColumnRenamed("near_at", "context_offset").drop("from")


def applied(text: Column, start: Column, stop: Column, original: Column, suggestion: Column) -> Column:
    """The text with one suggestion put in; null where the span no longer holds the original."""
    now = F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))
    return F.when(now == original, F.concat(F.substring(text, F.lit(1), start.cast("int")), suggestion, F.substring(text, (stop + 1).cast("int"), F.length(text))))


def decided(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The report's rows: each record with the latest decision (doc_id, finding_id, status, chosen, at), else open.

    A decision with status 'undo' takes the one before back.
    """
    last = Window.partitionBy("doc_id", "finding_id").orderBy(F.col("at").desc())
    kept = decisions.withColumn("_n", F.row_number().over(last)).filter("_n = 1 and status <> 'undo'").select("doc_id", "finding_id", "status", "chosen")
    return records.join(kept, ["doc_id", "finding_id"], "left").withColumn("status", F.coalesce("status", F.lit("open")))


def totals(rows: DataFrame) -> DataFrame:
    """(doc_id, all, open, accepted, rejected, and counts by category and severity as maps)."""
    names = ("open", "accepted", "rejected")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("all"), *(F.count_if(F.col("status") == s).alias(s) for s in names))
    for column in ("category", "severity"):
        by = rows.groupBy("doc_id", column).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))
        counts = counts.join(by, "doc_id")
    return counts


def fields(rows: DataFrame) -> DataFrame:
    """rows with their place in words and figures, and the suggestion to show: the chosen one if accepted, else all."""
    khmer = lambda c: chars.to_khmer_digits(F.col(c).cast("string"))
    place = F.concat(F.lit("កថាខណ្ឌ "), khmer("paragraph"), F.lit(" · បន្ទាត់ "), khmer("line"), F.lit(" · ជួរ "), khmer("column"))
    plain = F.concat(F.lit("para "), F.col("paragraph").cast("string"), F.lit(", line "), F.col("line").cast("string"), F.lit(", col "), F.col("column").cast("string"))
    shown = F.when((F.col("status") == "accepted") & F.col("chosen").isNotNull(), F.col("chosen")).otherwise(F.array_join("suggestions", " / "))
    return rows.withColumns({"place_km": place, "place_en": plain, "shown": shown})


def csv_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, no, line): a line of 21 cells for each row of fields(); line 0 has the headers after a byte order mark. Lines end
    with carriage return and line feed in csv_text()."""
    status = F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("status"))
    empty = F.lit("")
    cells = ["no", status, "paragraph", "line", "column", "start", "stop", "context", "original", "category", empty, "severity", empty, "shown", F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")), "confidence_level", empty, empty, empty, "rule_id", F.when(F.col("human_review"), "yes").otherwise("no")]
    line = F.concat_ws(",", *(csv_cell(F.col(c) if isinstance(c, str) else c) for c in cells))
    head = "﻿" + ",".join(f'"{h}"' for h in HEADERS)
    return rows.select("doc_id", "no", line.alias("line")).unionByName(rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("no"), F.lit(head).alias("line")))


def csv_text(lines: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\r\n")
    return lines.groupBy("doc_id").agg(F.concat(joined, F.lit("\r\n")).alias("csv"))


def passage(context: Column, at: Column, original: Column) -> Column:
    """The context as HTML with the flagged text marked, if it stands where it should."""
    here = F.substring(context, (at + 1).cast("int"), F.length(original))
    marked = F.concat(html_escape(F.substring(context, F.lit(1), at.cast("int"))), F.lit("<mark>"), html_escape(original), F.lit("</mark>"), html_escape(F.substring(context, (at + F.length(original) + 1).cast("int"), F.length(context))))
    return F.when(here == original, marked).otherwise(html_escape(context))


def html_report(rows: DataFrame) -> DataFrame:
    """(doc_id, html): a page with counts by category and a table of the findings; everything is escaped, nothing scripted."""
    cells = ("no", "place_en", "passage", "category", "severity", "shown", "confidence_level", "status")
    full = rows.withColumn("passage", passage(F.col("context"), F.col("context_offset"), F.col("original")))
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c) if c == "passage" else html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    line = F.concat(F.lit('<tr class="st-'), F.col("status"), F.lit('">'), *map(cell, cells), F.lit("</tr>"))
    table = full.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("h")))), lambda x: x["h"]), "\n").alias("rows"))
    counts = rows.groupBy("doc_id", "category").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category", "n"))), lambda x: F.concat(F.lit("<tr><td>"), html_escape(x["category"]), F.lit("</td><td>"), x["n"].cast("string"), F.lit("</td></tr>"))), "").alias("summary"))
    page = F.concat(F.lit('<!doctype html>\n<html lang="km"><head><meta charset="utf-8"><title>Report</title></head><body><table>'), F.col("summary"), F.lit("</table><table>"), F.col("rows"), F.lit("</table></body></html>"))
    return table.join(counts, "doc_id").select("doc_id", page.alias("html"))


#: What a proposal may be about, its longest original and the bounds of its confidence.
PROPOSED = ("grammar", "structure", "wording", "missing", "unnecessary", "clarity", "spelling", "punctuation", "repetition", "terminology")
MOST_ORIGINAL, LEAST_SURE, MOST_SURE = 400, 0.2, 0.6


def accepted_proposals(docs: DataFrame, proposals: DataFrame, misspelled: DataFrame, legal: bool = False) -> DataFrame:
    """Proposals (doc_id, place, original, category, suggestion, confidence) that hold up, with start and stop.

    The category must be a known one and the original stand in the text; the k-th proposal of one original gets its k-th
    place (places may overlap) or goes. Suggestions that change nothing or that ``misspelled`` (suggestion) lists are
    dropped, the proposal stays as advice. Confidence is held within bounds; legal texts need a human.
    """
    rows = proposals.filter(F.col("category").isin(*PROPOSED) & F.length("original").between(1, MOST_ORIGINAL))
    k = F.row_number().over(Window.partitionBy("doc_id", "original").orderBy("place"))
    rows = rows.withColumn("k", k).join(docs.select("doc_id", "text"), "doc_id")
    # places of one string: every one where the rest of the text begins with it
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text") - F.length("original") + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.length("original")) == F.col("original"))
    rows = rows.withColumn("start", (F.get(starts, F.col("k") - 1) - 1).cast("long")).filter("start is not null").drop("text", "k")
    bad = misspelled.select(F.col("suggestion").alias("bad")).distinct()
    rows = rows.join(bad, F.col("suggestion") == F.col("bad"), "left")
    keep = (F.coalesce("suggestion", F.lit("")) != "") & (F.col("suggestion") != F.col("original")) & F.col("bad").isNull()
    sure = F.least(F.lit(MOST_SURE), F.greatest(F.lit(LEAST_SURE), F.coalesce("confidence", F.lit(0.4))))
    return rows.select("doc_id", "category", "start", (F.col("start") + F.length("original")).alias("stop"), "original", F.when(keep, F.array("suggestion")).otherwise(F.array().cast("array<string>")).alias("suggestions"), F.lit("suggestion").alias("severity"), sure.alias("confidence"), F.lit(legal).alias("human_review"))


def accepted_rewrites(rewrites: DataFrame, legal: bool = False, most: int = 3) -> DataFrame:
    """Rewrites (passage_id, place, passage, text, errors, errors_before: counts of spelling errors) that may be offered: the
    first ``most`` of each passage, Khmer, not the passage, at most twice as long and 40 characters, with all its numbers and no
    more errors; meaning_changed says whether words of meaning differ, which legal texts forbid."""
    digits = lambda c: F.array_join(F.array_sort(F.regexp_extract_all(c, F.lit(r"[0-9\x{17E0}-\x{17E9}]+"), F.lit(0))), ",")
    rows = rewrites.filter(F.col("place") < most).withColumn("text", F.trim("text"))
    rows = rows.filter((F.col("text") != "") & (F.col("text") != F.col("passage")) & (F.length("text") <= 2 * F.length("passage") + 40) & F.col("text").rlike(r"[\x{1780}-\x{17FF}]") & (digits(F.col("text")) == digits(F.col("passage"))) & (F.col("errors") <= F.col("errors_before")))
    rows = rows.withColumn("meaning_changed", meaning_signature(F.col("text")) != meaning_signature(F.col("passage")))
    return rows.filter("not meaning_changed") if legal else rows
