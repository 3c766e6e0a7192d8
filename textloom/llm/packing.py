"""Packing of token sequences: dominance reduction, then best fit.

Documents become token ids and an end id; ones longer than the capacity are cut into pieces. Which
pieces share a sequence depends on their lengths alone, so the packing is solved on the histogram of
lengths (at most ``capacity`` numbers, whatever the input's size) and its result is a list of runs:
``n`` pieces of one length, by rank, go to as many consecutive sequences at one offset. Pieces are
ranked within their length by salted buckets, so no task holds all pieces of a length.

Reduction (Martello and Toth): for the longest piece, a set of one or two pieces is fixed for good
if it dominates every other set with that piece: alone if nothing else fits, with a piece that fills
the sequence exactly, with the longest fitting piece if no two others fit together or no fitting set
is longer. The remainder goes by best fit, longest first.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed each; an empty
table gives an empty result. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import staged, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, twice over. Results don't depend on it.
CACHE_WORDS = 600_000
BUCKETS = 4096


@lru_cache(2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts by a tokenizer whose tokens never span ASCII white space, word by word with a memo.

    The memo has two generations: when the younger is full it becomes the older, whose words are
    taken over as they are met again.
    """

    def __init__(self, name: str = TOKENIZER, cache_words: int = CACHE_WORDS) -> None:
        self.encoder = _tokenizer(tokenizer_path(name))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        self.ends = {c: self._batch([c])[0] for c in (b",", b".")}

    def words(self, text: bytes) -> list[bytes]:
        # the tokenizer lowers case itself; special tokens are matched before that
        return (text if b"<|" in text else text.lower()).split()

    def _batch(self, words: list[bytes]) -> list[bytes]:
        found = self.encoder.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.cache_words:
            self.known, self.older = {}, self.known
        new, known, older = [], self.known, self.older
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        # a comma or full stop after an ASCII letter is a token of its own
        stems = {w: w[:-1] for w in new if w[-1] in b",." and w[-2:-1].isalpha()}
        bare = [w for w in {stems.get(w, w) for w in new} if w not in known]
        for at in range(0, len(bare), 4096):
            part = bare[at : at + 4096]
            known.update(zip(part, self._batch(part)))
        for w, stem in stems.items():
            known[w] = known[stem] + self.ends[w[-1:]]

    def encode(self, text: bytes) -> bytes:
        """Ids of one text as little-endian 32-bit numbers."""
        words = self.words(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for at in range(0, len(words), self.cache_words):
            part = words[at : at + self.cache_words]
            self.learn(set(part))
            out += map(self.known.__getitem__, part)
        return b"".join(out)


@lru_cache(2)
def word_ids(name: str = TOKENIZER) -> WordIds:
    """One memo for each worker process, kept from task to task."""
    return WordIds(name)


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, crc, bucket) for every piece of every row; bucket is a salt for ranking."""
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        ids, count = word_ids(tokenizer), 0
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1).cast(pa.binary())):
                flat = ids.encode(t.as_py() or b"") + end
                for p, o in enumerate(range(0, len(flat), 4 * capacity)):
                    part = flat[o : o + 4 * capacity]
                    at.append(k)
                    piece.append(p)
                    start.append(o // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            bucket = (np.arange(count, count + len(at)) % BUCKETS).astype(np.int32)
            count += len(at)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(bucket)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "crc", "bucket"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, piece int, start long, length long, crc long, bucket int")


class Plan:
    """A packing of a histogram of lengths, as runs (length, first rank, n, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = {k: n for k, n in histogram.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, first: int, second: int | None, n: int) -> None:
        self._place(first, n, self.sequences, 0)
        if second is not None:
            self._place(second, n, self.sequences, first)
        self.sequences += n
        self.fixed += n

    def _longest_pair(self, sizes: list[int], room: int, spare: dict[int, int]) -> int:
        """The greatest sum of two pieces that fit in room, 0 if none do."""
        best, i, j = 0, 0, len(sizes) - 1
        while i <= j:
            both = sizes[i] + sizes[j]
            if both > room:
                j -= 1
            elif i == j and spare[sizes[i]] < 2:
                break
            else:
                best = max(best, both)
                i += 1
        return best

    def _reduce(self) -> None:
        for length in sorted(self.left, reverse=True):
            room = self.capacity - length
            while self.left.get(length):
                spare = {k: n - (k == length) for k, n in self.left.items() if n > (k == length)}
                sizes = sorted(k for k in spare if k <= room)
                if not sizes:
                    self._fix(length, None, self.left[length] if length > room else 1)
                    continue
                longest = sizes[-1]
                n = self.left[length] // 2 if longest == length else min(self.left[length], self.left[longest])
                if longest < room:
                    three, pair = self._three_smallest(sizes, spare), self._longest_pair(sizes, room, spare)
                    if pair > longest or (three is not None and three <= room):
                        break
                if longest == length:
                    self._place(length, n, self.sequences, 0)
                    self._place(length, n, self.sequences, length)
                    self.sequences += n
                    self.fixed += n
                else:
                    self._fix(length, longest, n)

    @staticmethod
    def _three_smallest(sizes: list[int], spare: dict[int, int]) -> int | None:
        three: list[int] = []
        for k in sizes:
            three += [k] * min(3, spare[k])
            if len(three) >= 3:
                return sum(three[:3])
        return None

    def _best_fit(self) -> None:
        open_: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]
        for length in sorted(self.left, reverse=True):
            room = length
            while n := self.left.get(length, 0):
                while room < self.capacity and not open_[room]:
                    room += 1
                if room < self.capacity:
                    first, bins = open_[room].pop()
                else:
                    first, bins = self.sequences, -(-n // (self.capacity // length))
                    self.sequences += bins
                each = room // length
                full, rest = min(bins, n // each), 0
                for k in range(each if full else 0):
                    self._place(length, full, first, self.capacity - room + k * length)
                if full:
                    open_[room - each * length].append((first, full))
                if full < bins and (rest := min(n - full * each, each - 1)):
                    for k in range(rest):
                        self._place(length, 1, first + full, self.capacity - room + k * length)
                    open_[room - rest * length].append((first + full, 1))
                if full + bool(rest) < bins:
                    open_[room].append((first + full + bool(rest), bins - full - bool(rest)))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of pieces()."""
    spark = found.sparkSession
    found = staged(found, "pieces")
    counts = staged(found.groupBy("length", "bucket").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    runs = spark.createDataFrame(plan.runs, "r_length long, r_first long, r_n long, r_sequence long, r_offset long")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce(before, F.lit(0)).alias("base"))
    order = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece", "crc", "start"))
    ranked = found.withColumn("at", order).join(bases, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
    ranked = ranked.withColumn("at", F.col("base") + F.col("at") - 1)
    here = (F.col("length") == F.col("r_length")) & (F.col("at") >= F.col("r_first")) & (F.col("at") < F.col("r_first") + F.col("r_n"))
    # the plan's size depends on the capacity, not on the input
    placed = ranked.join(F.broadcast(runs) if len(plan.runs) <= 100 * capacity else runs, here)
    sequence = F.col("r_sequence") + F.col("at") - F.col("r_first")
    return placed.select("key", "piece", "start", "length", "crc", sequence.alias("sequence_id"), F.col("r_offset").alias("offset"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(pieces(table(spark, sf_dir, "documents")))
    return placed.select(F.col("key").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
