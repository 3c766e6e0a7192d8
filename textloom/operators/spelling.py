"""Spelling over analysed sentences: listed misspellings, unknown words and their likely words, split words, variants.

Distances are computed once for each distinct string, over pairs that share a sound bucket and a length band
(lexicon.candidates); occurrences only join the ranked result. Lists are gathered by sentence, never by document.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import normalize
from textloom.operators import lexicon as lex
from textloom.operators.lexicon import AUTHORITATIVE, SOURCES, bits

# Words that introduce a name, and letters typical of foreign words.
NAME_INTRODUCERS = ("លោក", "លោកស្រី", "អ្នកស្រី", "កញ្ញា", "នាង", "ឯកឧត្ដម", "ឯកឧត្តម", "លោកជំទាវ", "សម្ដេច", "ឈ្មោះ", "នាម", "ខេត្ត", "ស្រុក", "ឃុំ", "សង្កាត់", "ភូមិ", "ក្រុង", "វត្ត", "ផ្លូវ", "ក្រុមហ៊ុន", "ទីក្រុង", "ប្រទេស", "បណ្ឌិត", "សាស្ត្រាចារ្យ", "ព្រះតេជគុណ", "ឧកញ៉ា", "អ្នកឧកញ៉ា", "ប្អូន", "បង", "កូន", "ព្រះនាម", "នាមត្រកូល", "គោត្តនាម", "ឯកឧត្ដមបណ្ឌិត")
FOREIGN = r"\x{17A0}\x{17D2}[\x{1782}\x{179C}\x{179F}\x{17A1}\x{1787}\x{17A0}\x{1794}]|[\x{1780}-\x{17A2}][\x{17C9}\x{17CA}]|\x{17A2}\x{17CA}|\x{1792}\x{17D2}\x{1799}|\x{179F}\x{17D2}\x{1798}\x{17CA}|\x{17A0}\x{17D2}\x{179C}|\x{1783}\x{17D2}\x{1799}"
#: Words on each side that an unknown one may belong together with.
REACH = 2
SPAN = ["doc_id", "sent", "start", "stop"]


def listed(sentences: DataFrame, wrong: list[dict], first: int = 0) -> DataFrame:
    """Listed misspellings (rows wrong, correct, confidence) at word borders without blanks inside; ``first`` is the number of
    the first of them among the phrases of the analysis."""
    rows = sentences.sparkSession.createDataFrame([(first + n, r["correct"], float(r["confidence"])) for n, r in enumerate(wrong)], "id int, correct string, confidence double")
    hits = sentences.select("doc_id", "sent", "words", F.explode("phrases").alias("p")).filter(F.forall(F.slice("words", F.col("p.i") + 2, F.col("p.j") - F.col("p.i")), lambda w: w["joined"]))
    hits = hits.select("doc_id", "sent", F.get("words", F.col("p.i"))["start"].alias("start"), F.get("words", F.col("p.j"))["stop"].alias("stop"), F.col("p.id").alias("id"))
    return hits.join(rows, "id").select(*SPAN, F.lit("spelling.curated").alias("rule_id"), F.array("correct").alias("suggestions"), F.lit("error").alias("severity"), "confidence")


def _free(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """rows that overlap no claimed span of their sentence."""
    c = claims.select("doc_id", "sent", F.col("start").alias("s"), F.col("stop").alias("e"))
    meet = rows["doc_id"].eqNullSafe(c["doc_id"]) & (rows["sent"] == c["sent"]) & (rows["start"] < c["e"]) & (rows["stop"] > c["s"])
    return rows.join(c, meet, "left_anti")


def _windows(words: Column, u: Column) -> Column:
    """The unknown word with up to REACH touching words on each side, as structs (a, b, start, stop, key, penalty, before, after)."""
    at = lambda i: F.get(words, i)
    touching = lambda i, n: F.forall(F.slice(words, i + 1, n), lambda w: w["joined"])

    def one(a: int, b: int) -> Column:
        i, j = u - a, u + b
        inside = F.slice(words, F.greatest(i, F.lit(0)) + 1, F.lit(a + b + 1))
        cost = lambda w: F.when((~w["known"] & ~w["wrong"]) | (w["clusters"] < 2), 0.0).when(bits(w["f"], AUTHORITATIVE), 0.35).otherwise(0.1)
        penalty = F.aggregate(inside, F.lit(0.0), lambda s, w: s + cost(w))
        before = F.when(at(i)["joined"], at(i - 1)["key"])
        after = F.when(at(j + 1)["joined"], at(j + 1)["key"])
        fits = (i >= 0) & (j < F.size(words)) & (F.lit(True) if not a else touching(i + 1, a)) & (F.lit(True) if not b else touching(u + 1, b))
        return F.when(fits, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), at(i)["start"].alias("s"), at(j)["stop"].alias("e"), F.array_join(F.transform(inside, lambda w: w["key"]), "").alias("key"), penalty.alias("penalty"), before.alias("before"), after.alias("after")))

    return F.filter(F.array(*(one(a, b) for a in range(REACH + 1) for b in range(REACH + 1))), lambda x: x.isNotNull())


def _first_free(rows: DataFrame) -> DataFrame:
    """Of the rows of a sentence, in order, those whose own span overlaps no span that an earlier one took (s to e)."""
    every = F.array_sort(F.collect_list(F.struct("start", "stop", "s", "e", "row")))
    none = F.slice(F.col("every"), 1, 0)
    kept = F.aggregate("every", none, lambda done, x: F.when(F.exists(done, lambda d: (x["start"] < d["e"]) & (x["stop"] > d["s"])), done).otherwise(F.concat(done, F.array(x))))
    return rows.groupBy("doc_id", "sent").agg(every.alias("every")).select("doc_id", "sent", F.explode(kept).alias("x")).select("doc_id", "sent", "x.*")


def unknown_words(sentences: DataFrame, lexicon: DataFrame, bigrams: DataFrame, claims: DataFrame) -> DataFrame:
    """Unknown words: the likeliest word for them or for them with their neighbours, else that they are not in the lexicon."""
    one = sentences.select("doc_id", "sent", "words", F.posexplode("words").alias("u", "w")).filter(~F.col("w.known") & ~F.col("w.wrong"))
    prev = F.get("words", F.col("u") - 1)["key"]
    name = (F.col("u") > 0) & prev.isin(*NAME_INTRODUCERS) & F.col("w.gap").rlike(r"\A[ \t\x{A0}\x{3000}\x{200B}]*\z")
    one = one.select("doc_id", "sent", F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), F.col("w.key").alias("own"), F.coalesce(name, F.lit(False)).alias("name"), F.col("w.text").rlike(FOREIGN).alias("foreign"), F.coalesce(F.col("w.next") == "repeat", F.lit(False)).alias("doubled"), _windows(F.col("words"), F.col("u")).alias("windows"))
    one = _free(one, claims)
    windows = one.select(*SPAN, F.explode("windows").alias("v")).select(*SPAN, "v.*")
    bare = (F.col("a") == 0) & (F.col("b") == 0)
    near = lex.candidates(windows.filter(~bare), lexicon, limit=4, wide=False).withColumn("wide", F.lit(False))
    near = near.unionByName(lex.candidates(windows.filter(bare), lexicon, limit=4, wide=True).withColumn("wide", F.lit(True)))
    pair = bigrams.select("a", "b").distinct()
    windows = windows.persist(StorageLevel.DISK_ONLY)
    before, after = pair.select(F.col("a").alias("before"), F.col("b").alias("candidate"), F.lit(0.15).alias("bonus_before")), pair.select(F.col("b").alias("after"), F.col("a").alias("candidate"), F.lit(0.15).alias("bonus_after"))
    options = windows.withColumn("wide", bare).join(near, ["key", "wide"]).join(before, ["before", "candidate"], "left").join(after, ["after", "candidate"], "left")
    size = F.size(normalize.units(F.col("candidate")))
    score = F.col("distance") + F.col("penalty") - 0.04 * F.log10(1 + F.col("n")) - F.coalesce("bonus_before", F.lit(0.0)) - F.coalesce("bonus_after", F.lit(0.0)) - 0.02 * size
    order = F.struct(score.alias("score"), "a", "b", "place", "candidate", "distance", "s", "e", "f", F.col("key").alias("window"))
    ranked = options.groupBy(*SPAN).agg(F.array_sort(F.collect_list(order)).alias("options"))
    best = F.get("options", F.lit(0))
    found = one.drop("windows").join(ranked, SPAN, "left").withColumn("best", best)
    found = found.withColumn("rival", F.exists("options", lambda o: (o["candidate"] != F.col("best.candidate")) & (o["score"] - F.col("best.score") < 0.25)))
    likely = F.col("best").isNotNull() & ~(F.col("name") & (F.col("best.distance") > 0.3)) & ~(F.col("foreign") & (F.col("best.distance") > 0.6))
    d = F.col("best.distance")
    sure = F.when(d <= 0.25, 0.9).when(d <= 0.6, 0.85).when(d <= 1, 0.7).when(d <= 1.5, 0.55).otherwise(0.45)
    for test, less in ((F.col("rival"), 0.15), (F.size(normalize.units(F.col("own"))) <= 2, 0.1), (F.col("name") | F.col("foreign"), 0.2), (F.col("doubled"), 0.15)):
        sure = sure - F.when(test, less).otherwise(0.0)
    sure = F.round(F.least(F.greatest(sure, F.lit(0.05)), F.lit(0.99)), 2)
    fold = lambda c: F.replace(F.replace(c, F.lit("្ដ"), F.lit("្ត")), F.lit("ឲ"), F.lit("ឱ"))
    variant = fold(F.col("best.candidate")) == fold(F.col("best.window"))
    same = F.filter("options", lambda o: (o["s"] == F.col("best.s")) & (o["e"] == F.col("best.e")))
    given = F.slice(F.array_distinct(F.transform(same, lambda o: o["candidate"])), 1, 4)
    row = F.when(likely, F.struct(F.when(variant, "spelling.variant").otherwise("spelling.dictionary").alias("rule_id"), given.alias("suggestions"), F.when(variant, "suggestion").when(sure >= 0.6, "error").otherwise("warning").alias("severity"), F.when(variant, 0.6).otherwise(sure).alias("confidence")))
    row = row.otherwise(F.struct(F.lit("spelling.unknown").alias("rule_id"), F.array().cast("array<string>").alias("suggestions"), F.lit("info").alias("severity"), F.lit(0.3).alias("confidence")))
    found = found.withColumn("likely", likely).filter("likely or not name")
    # a word without a likely word takes no span
    found = found.select(*SPAN, F.when(F.col("likely"), F.col("best.s")).otherwise(F.col("stop")).alias("s"), F.when(F.col("likely"), F.col("best.e")).otherwise(F.col("stop")).alias("e"), row.alias("row"))
    kept = _first_free(found)
    start = F.when(F.col("row.rule_id") == "spelling.unknown", F.col("start")).otherwise(F.col("s"))
    return kept.select("doc_id", "sent", start.alias("start"), F.when(F.col("row.rule_id") == "spelling.unknown", F.col("stop")).otherwise(F.col("e")).alias("stop"), "row.rule_id", "row.suggestions", "row.severity", "row.confidence")


def split_words(sentences: DataFrame, lexicon: DataFrame, claims: DataFrame) -> DataFrame:
    """Two or three touching known words, one of them weak, that together are near an authoritative word of four units or more."""

    def run(size: int) -> Column:
        part = lambda i: F.slice("words", i + 1, size)
        fits = lambda i: (i + size <= F.size("words")) & F.forall(part(i), lambda w: w["known"]) & F.forall(F.slice("words", i + 2, size - 1), lambda w: w["joined"]) & F.exists(part(i), lambda w: lex.weak(w["f"], w["n"]))
        make = lambda w, i: F.when(fits(i), F.struct(i.alias("i"), F.lit(-size).alias("less"), w["start"].alias("start"), F.get("words", i + size - 1)["stop"].alias("stop"), F.array_join(F.transform(part(i), lambda x: x["key"]), "").alias("key")))
        return F.filter(F.transform("words", make), lambda x: x.isNotNull())

    rows = sentences.select("doc_id", "sent", F.explode(F.concat(run(3), run(2))).alias("x")).select("doc_id", "sent", "x.*")
    rows = _free(rows, claims).join(lexicon.filter(lex.known(F.col("f"))).select("key"), "key", "left_anti")
    near = lex.candidates(rows, lexicon, limit=3, sure_only=True, most=1.0)
    given = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "candidate", "distance"))).alias("c"))
    given = given.filter(F.size(normalize.units(F.get("c", F.lit(0))["candidate"])) >= 4)
    sure = F.when(F.get("c", F.lit(0))["distance"] <= 0.6, 0.65).otherwise(0.55)
    found = rows.join(given, "key").select("doc_id", "sent", "start", "stop", F.col("start").alias("s"), F.col("stop").alias("e"), F.struct(F.col("less").alias("order"), F.transform("c", lambda x: x["candidate"]).alias("suggestions"), sure.alias("confidence")).alias("row"))
    # of those that start at one word the longest comes first
    longest = found.groupBy("doc_id", "sent", "start").agg(F.min_by(F.struct("stop", "s", "e", "row"), "row.order").alias("x")).select("doc_id", "sent", "start", "x.*")
    kept = _first_free(longest)
    return kept.select(*SPAN, F.lit("spelling.split-word").alias("rule_id"), "row.suggestions", F.lit("error").alias("severity"), "row.confidence")


def strict_variants(sentences: DataFrame, lexicon: DataFrame, claims: DataFrame) -> DataFrame:
    """Known words that are no headword but have a headword as a variant spelling."""
    heads = lex.variants(lexicon).filter(bits(F.col("f"), SOURCES["headword"])).groupBy("key").agg(F.array_sort(F.collect_list("variant")).alias("suggestions"))
    words = sentences.select("doc_id", "sent", F.explode("words").alias("w")).filter(F.col("w.known") & ~bits(F.col("w.f"), SOURCES["headword"])).select("doc_id", "sent", F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), F.col("w.key").alias("key"))
    return _free(words, claims).join(heads, "key").select(*SPAN, F.lit("spelling.variant").alias("rule_id"), "suggestions", F.lit("suggestion").alias("severity"), F.lit(0.7).alias("confidence"))


def spelling(sentences: DataFrame, lexicon: DataFrame, bigrams: DataFrame, wrong: list[dict] = (), strict: bool = False) -> DataFrame:
    """(doc_id, sent, start, stop, rule_id, suggestions, severity, confidence): each layer leaves out spans that one before took.

    wrong are the listed misspellings, which must be the first phrases of the analysis, in order.
    """
    open_ = lambda w: (~w["known"]) | lex.weak(w["f"], w["n"])
    if not strict:  # other sentences have nothing to find
        sentences = sentences.filter((F.size("phrases") > 0) | F.exists("words", open_))
    # each layer reads them again: the analysis of the texts should not run each time
    sentences = sentences.persist(StorageLevel.DISK_ONLY)
    sure = listed(sentences.withColumn("phrases", F.filter("phrases", lambda p: p["id"] < len(wrong))), list(wrong))
    # findings are few; the layers after them read them again
    sure = sure.persist(StorageLevel.DISK_ONLY)
    maybe = unknown_words(sentences, lexicon, bigrams, sure).persist(StorageLevel.DISK_ONLY)
    found = sure.unionByName(maybe)
    # a word that is only not in the lexicon takes no span
    taken = lambda x: x.filter("rule_id <> 'spelling.unknown'").select(*SPAN)
    found = found.unionByName(split_words(sentences, lexicon, taken(found)).persist(StorageLevel.DISK_ONLY))
    return found.unionByName(strict_variants(sentences, lexicon, taken(found))) if strict else found
