"""Chunks of a text by kind, and words of Khmer runs by least cost over a lexicon."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import chars, normalize
from textloom.functions.spans import spans

#: Kinds of chunks, the first that matches wins.
KINDS = {
    "khmer": rf"{chars.BASE}[\x{{1780}}-\x{{17D3}}\x{{17DD}}\x{{200C}}\x{{200D}}]*",
    "orphan": r"[\x{17B4}-\x{17D3}\x{17DD}]+",
    "repeat": r"\x{17D7}",
    "zwsp": r"\x{200B}+",
    "newline": r"\r?\n",
    "space": r"[ \t\x{00A0}\x{3000}]+",
    "number": r"[\x{17E0}-\x{17E9}]+(?:[.,:/-][\x{17E0}-\x{17E9}]+)*|[0-9]+(?:[.,:/-][0-9]+)*",
    "punct": r"[\x{17D4}-\x{17DA}\x{17DC}.,;:!?'\x{22}\x{00AB}\x{00BB}\x{201C}\x{201D}\x{2018}\x{2019}()\[\]{}<>\-\x{2013}\x{2014}/\\\x{2026}%]",
    "latin": r"[A-Za-z\x{00C0}-\x{024F}]+",
    "other": r"(?s:.)",
}
CHUNK = "|".join(KINDS.values())
MAX_WORD = 16
#: A lexicon is held whole by every task; more rows are an error.
MAX_LEXICON = 1_000_000


def kind(chunk: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        hit = chunk.rlike(rf"\A(?:{pattern})\z")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_at, kind, start, chunk): the whole text in pieces; null and empty texts have none."""
    one = docs.select("doc_id", F.posexplode(spans(F.col("text"), CHUNK)).alias("at", "s"))
    return one.select("doc_id", F.col("at").cast("long").alias("chunk_at"), kind(F.col("s.original")).alias("kind"), "s.start", F.col("s.original").alias("chunk"))


def word_cost(authoritative: bool, misspelling: bool, n: int) -> float:
    """Fixed values of path costs: 0.9, 1.5, 1, 0.1, 0.3, 0.03. misspelling: that is all that is known of the word."""
    if misspelling:
        return 0.9
    if not authoritative and n < 3:
        return 1.5
    return 1 + (0 if authoritative else 0.1) - min(0.3, 0.03 * math.log1p(n))


def cheapest(keys: list[str], costs: dict[str, float]) -> list[tuple[int, int, bool]]:
    """(first cluster, end, known) of the words of one run of clusters by least total cost: a cluster outside the lexicon
    costs 2; unknown neighbours become one."""
    n = len(keys)
    best, back = [0.0] + [math.inf] * n, [(0, False)] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + MAX_WORD) + 1):
            cost = costs.get("".join(keys[i:j]))
            known = cost is not None
            if not known and j > i + 1:
                continue
            total = best[i] + (cost if known else 2.0)
            if total < best[j]:
                best[j], back[j] = total, (i, known)
    cuts, j = [], n
    while j:
        i, known = back[j]
        cuts.append((i, j, known))
        j = i
    out: list[tuple[int, int, bool]] = []
    for i, j, known in reversed(cuts):
        if out and not known and not out[-1][2]:
            out[-1] = (out[-1][0], j, False)
        else:
            out.append((i, j, known))
    return out


def segment_run(raw: list[str], keys: list[str], costs: dict[str, float]) -> list[tuple[str, bool]]:
    """The words of one run of clusters, and whether the lexicon has them."""
    return [("".join(raw[i:j]), known) for i, j, known in cheapest(keys, costs)]


def segments(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, start, word, known) of the Khmer runs; lexicon: (key, authoritative, misspelling, n), keys normalised.

    A key that only misspelling rows have is recognised as a unit but not known; with other rows it is an ordinary word.
    """
    rows = lexicon.groupBy("key").agg(F.bool_or(F.coalesce("authoritative", F.lit(False))).alias("a"), F.bool_and(F.coalesce("misspelling", F.lit(False))).alias("wrong"), F.max(F.coalesce("n", F.lit(0))).alias("n")).limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"over {MAX_LEXICON} lexicon rows")
    costs = {r["key"]: word_cost(r["a"], r["wrong"], r["n"]) for r in rows}
    wrong = {r["key"] for r in rows if r["wrong"]}

    def cut(batches):
        for batch in batches:
            out = []
            for k, start, run in zip(*(c.to_pylist() for c in batch.columns)):
                raw = normalize.CLUSTERS.findall(run)
                keys = [normalize.normalized(c) for c in raw]
                at = start
                for i, j, known in cheapest(keys, costs):
                    word = "".join(raw[i:j])
                    out.append((k, at, word, known and "".join(keys[i:j]) not in wrong))
                    at += len(word)
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_())], ["doc_id", "start", "word", "known"])

    runs = chunks(docs).filter("kind = 'khmer'").select("doc_id", "start", "chunk")
    return runs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, word string, known boolean")
