"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences (runs of letters and digits, lower case). Running
Karp-Rabin hashes of ``min_match`` tokens find the seeds that a document shares with an item; seeds
on one diagonal join to maximal matches. Tiling then marks the longest match of unmarked tokens again
and again, so that a passage with its parts reordered is still covered, and no token counts twice.
A document is contaminated by an item if tiles cover at least ``coverage`` of the item's tokens.

The benchmark is dealt out in blocks of at most MAX_BLOCK_TOKENS tokens; all documents are read
against each block, so what is sent to the executors has a fixed bound.

Defined cases: null or empty texts have no tokens and match nothing; items shorter than ``min_match``
tokens have no seed and match nothing; repeated documents and items each give their own rows; a null
id is kept. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import table

MIN_MATCH = 5
COVERAGE = 0.6
MAX_BLOCK_TOKENS = 1_000_000
BASE = 1_000_003
_TOKEN = re.compile(r"[^\W_]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def tokens(text: str) -> list[str]:
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _TOKEN.findall(text.lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + x[k : k + n]
    return h


def tile(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles (start, item start, length) from all shared seeds (i in the text, j in the item)."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(i - j) != 0)) + 1
    starts = np.concatenate(([0], breaks))
    lengths = np.diff(np.concatenate((starts, [len(i)]))) + size - 1
    matches = [(-int(n), int(i[s]), int(j[s])) for s, n in zip(starts, lengths)]
    heapq.heapify(matches)
    in_text, in_item, tiles = set(), set(), []
    while matches:
        n, a, b = heapq.heappop(matches)
        free = [k for k in range(-n) if a + k not in in_text and b + k not in in_item]
        if len(free) == -n:
            tiles.append((a, b, -n))
            in_text.update(range(a, a - n))
            in_item.update(range(b, b - n))
            continue
        run = 0
        for k, x in enumerate(free):  # unmarked parts go back if they are long enough
            run = run + 1 if k and free[k - 1] == x - 1 else 1
            if run >= size and (k + 1 == len(free) or free[k + 1] != x + 1):
                heapq.heappush(matches, (-run, a + x - run + 1, b + x - run + 1))
    return tiles


class Block:
    """A part of the benchmark, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]], size: int = MIN_MATCH) -> None:
        self.size = size
        self.vocabulary: dict[str, int] = {}
        self.items = []
        hashes, item, at = [], [], []
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens(text or "")], np.int64)
            h = rolling(ids, size)
            hashes.append(h)
            item.append(np.full(len(h), len(self.items)))
            at.append(np.arange(len(h)))
            self.items.append((key, ids))
        order = np.argsort(h := np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), kind="stable")
        self.hashes, self.item, self.at = h[order], np.concatenate([[], *item])[order].astype(int), np.concatenate([[], *at])[order].astype(int)

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, covered tokens, tiles) for every item that shares a seed with the text."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        if len(ids) < self.size or not len(self.hashes):
            return []
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        at = np.flatnonzero(unknown[self.size :] == unknown[: -self.size])
        if not len(at):
            return []
        h = rolling(ids, self.size)[at]
        first = np.searchsorted(self.hashes, h)
        hit = self.hashes[np.minimum(first, len(self.hashes) - 1)] == h
        at, h, first = at[hit], h[hit], first[hit]
        if not len(at):
            return []
        n = np.searchsorted(self.hashes, h, "right") - first
        i = np.repeat(at, n)
        seed = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, j = self.item[seed], self.at[seed]
        out = []
        for k in np.unique(item):
            here, own = item == k, self.items[k][1]
            a, b = i[here], j[here]
            same = np.all([ids[a + x] == own[b + x] for x in range(self.size)], axis=0)  # a hash may lie
            if same.any():
                tiles = tile(a[same], b[same], self.size)
                out.append((int(k), sum(t[2] for t in tiles), len(tiles)))
        return out


def blocks(benchmark: DataFrame, text: str, key: str, most: int = MAX_BLOCK_TOKENS):
    """The benchmark's rows in lists of at most ``most`` tokens (or a single longer item)."""
    part, n = [], 0
    for row in benchmark.select(F.col(key), F.col(text)).toLocalIterator():
        size = len(tokens(row[1] or ""))
        if part and n + size > most:
            yield part
            part, n = [], 0
        part.append((row[0], row[1]))
        n += size
    if part:
        yield part


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(key, item, n_tiles, covered, item_tokens, coverage) for every contaminated row and item."""
    kind, item_kind = docs.schema[key].dataType, benchmark.schema[item_key].dataType
    schema = f"key {kind.simpleString()}, item {item_kind.simpleString()}, n_tiles int, covered int, item_tokens int, coverage double"
    out = None
    for part in blocks(benchmark, item_text, item_key):

        def run(batches, part=part):
            block = Block(part, min_match)
            for batch in batches:
                at, rows = [], []
                for k, t in enumerate(batch.column(1)):
                    for item, covered, tiles in block.search(t.as_py() or ""):
                        size = len(block.items[item][1])
                        if covered >= coverage * size:
                            at.append(k)
                            rows.append((block.items[item][0], tiles, covered, size, covered / size))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (to_arrow_type(item_kind), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["key", "item", "n_tiles", "covered", "item_tokens", "coverage"])

        found = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns."""
    at = docs.columns.index(text)
    for part in blocks(benchmark, item_text, item_key):

        def run(batches, part=part):
            block = Block(part, min_match)
            for batch in batches:
                clean = [not any(c >= coverage * len(block.items[k][1]) for k, c, _ in block.search(t.as_py() or "")) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
