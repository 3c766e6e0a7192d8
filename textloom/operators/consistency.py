"""One document, one form: mixed variant spellings, defined terms written otherwise, two words for one thing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import distance, normalize
from textloom.functions.spans import spans

# How a term is introduced, and the edits within which a later form is the same term.
INTRODUCED = r"(?:\x{178F}\x{1791}\x{17C5}\x{1793}\x{17C1}\x{17C7}\x{17A0}\x{17C5}\x{1790}\x{17B6}|\x{178F}\x{1791}\x{17C5}\x{17A0}\x{17C5}\x{1790}\x{17B6}|\x{17A0}\x{17C5}\x{1780}\x{17B6}\x{178F}\x{17CB}\x{1790}\x{17B6}|\x{17A0}\x{17C5}\x{1790}\x{17B6}|\x{178A}\x{17C2}\x{179B}\x{17A0}\x{17C5}\x{1790}\x{17B6})"
QUOTED = r"\x{00AB}[^\x{00BB}\n]{2,60}\x{00BB}"
SAME_TERM = 1.5


def variant_mix(sentences: DataFrame, groups: DataFrame) -> DataFrame:
    """Words of a document in another form than its commonest of the same group (fold, forms); of equal counts the earlier wins.

    Words are compared by key, so a form inside a longer word of the lexicon is left alone.
    """
    forms = groups.select("fold", F.explode("forms").alias("key"))
    uses = sentences.select("doc_id", F.explode("words").alias("w")).select("doc_id", F.col("w.key").alias("key"), F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), F.col("w.text").alias("original")).join(forms, "key")
    counts = uses.groupBy("doc_id", "fold", "key").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    preferred = counts.groupBy("doc_id", "fold").agg(F.max_by("key", F.struct("n", (-F.col("first")).alias("f"))).alias("preferred"), F.count("*").alias("m")).filter("m > 1")
    found = uses.join(preferred, ["doc_id", "fold"]).filter("key <> preferred")
    return found.select("doc_id", F.lit("terminology.variant-mix").alias("rule_id"), "start", "stop", "original", F.array("preferred").alias("suggestions"))


def defined_terms(docs: DataFrame) -> DataFrame:
    """Quoted terms after a definition that are near the defined one but not the same."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = F.transform(spans(F.col("text"), rf"{INTRODUCED}\s*{QUOTED}"), lambda s: F.struct(s["stop"].alias("after"), F.regexp_extract(s["original"], r"\x{00AB}([^\x{00BB}\n]{2,60})\x{00BB}", 1).alias("term")))
    quoted = F.transform(spans(F.col("text"), QUOTED), lambda s: F.struct((s["start"] + 1).alias("start"), (s["stop"] - 1).alias("stop"), F.substring(s["original"], F.lit(2), F.length(s["original"]) - 2).alias("q")))
    docs = docs.filter(F.col("text").rlike(INTRODUCED)).select("doc_id", made.alias("made"), quoted.alias("quoted"))
    later = lambda d: F.filter("quoted", lambda q: q["stop"] >= d["after"])
    pairs = F.flatten(F.transform("made", lambda d: F.transform(later(d), lambda q: F.struct(d["term"].alias("term"), q["start"].alias("start"), q["stop"].alias("stop"), q["q"].alias("original")))))
    both = docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.term", "p.start", "p.stop", "p.original")

    def near(batches):
        for batch in batches:
            keep = []
            for term, other in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                a, b = (normalize.key_of(x) for x in (term, other))
                u = distance.units_of(a)
                keep.append(a != b and len(u) >= 3 and distance.weighted_distance(distance.units_of(b), u, SAME_TERM) <= SAME_TERM)
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = both.mapInArrow(near, f"doc_id {kind}, term string, start long, stop long, original string")
    return found.select("doc_id", F.lit("terminology.defined-term").alias("rule_id"), "start", "stop", "original", F.array("term").alias("suggestions")).distinct()


def synonym_mix(docs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Documents that use both words of a pair: the first place of the one that comes later."""
    out = None
    for a, b in pairs:
        i, j = F.instr("text", F.lit(a)) - 1, F.instr("text", F.lit(b)) - 1
        later = F.when(i < j, F.struct(j.cast("long").alias("start"), F.lit(b).alias("original"), F.lit(a).alias("s"))).otherwise(F.struct(i.cast("long").alias("start"), F.lit(a).alias("original"), F.lit(b).alias("s")))
        one = F.when((i >= 0) & (j >= 0), later)
        out = [one] if out is None else [*out, one]
    hits = F.filter(F.array(*(out or [F.lit(None).cast("struct<start:bigint,original:string,s:string>")])), lambda x: x.isNotNull())
    found = docs.select("doc_id", F.explode(hits).alias("x"))
    return found.select("doc_id", F.lit("terminology.synonym-mix").alias("rule_id"), "x.start", (F.col("x.start") + F.length("x.original")).alias("stop"), "x.original", F.array("x.s").alias("suggestions"))


def user_rules(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Places of the variants of user rules (preferred, variant), one scan for all of them."""
    quoted = lambda v: "".join(rf"\x{{{ord(c):X}}}" for c in v)
    parts = [F.transform(spans(F.col("text"), quoted(v)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["original"].alias("original"), F.lit(p).alias("preferred"))) for p, v in rules if v]
    if not parts:
        return docs.limit(0).select("doc_id", F.lit("").alias("rule_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit("").alias("original"), F.array(F.lit("")).alias("suggestions"))
    return docs.select("doc_id", F.inline(F.concat(*parts))).select("doc_id", F.lit("terminology.user-rule").alias("rule_id"), "start", "stop", "original", F.array("preferred").alias("suggestions"))
