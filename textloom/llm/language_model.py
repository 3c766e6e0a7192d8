"""N-gram language model in an Elias-Fano trie.

Three levels over the training texts' tokens (words and one end a text), each in shards that are
files of the shared folder, memory-mapped by the executors:

1. words, as sorted 64-bit hashes with exact counts; a word's id is its rank over all shards;
2. word pairs: for each first word, monotone pointers into its successors, and the successors as one
   Elias-Fano sequence; quantised log probabilities and back-off weights;
3. triples: the context is the position of its pair in level 2, and the last word is written relative
   to its context: as its rank among the successors of the middle word, a far smaller number.

A shard of level 2 follows its first words; level 3 cuts it where the pairs' counts reach SHARD_TOKENS, so
that the triples of a very common word are in many files. A chunk asks every shard once a level; what
that costs does not grow with the shard (EliasFano.find), and chunks are large to ask seldom.

Probabilities are interpolated with absolute discounting down to add-half word probabilities. Levels 2
and 3 hold the pairs and triples seen ``least`` times or more, the mass of others goes to the back-off
weight; the query keeps all of them (least 1). (A triple can be seen ``least`` times only if both its
pairs are, so level 3 counts only such triples; this loses none.)

The corpus is read once, into a table of word numbers in the shared folder. Counts of all levels cover
all training texts and go by shards of bounded size (SHARD_TOKENS tokens); the driver gets four
numbers a shard. Repeated writes of a lost task replace a shard's file as a whole.

Defined cases: null text is empty, one end token; repeated rows are each counted and scored; with no
training text all tokens are unknown with probability one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import by_group, discard, fresh_dir, table
from textloom.llm.elias_fano import EliasFano, read_arrays, write_arrays

CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 4_000_000
FLUSH = 6_000_000
DISCOUNT = 0.75
STEP = 4096.0
LOG10 = math.log(10)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokens_table(docs: DataFrame, text: str = "text", key: str = "doc_id", train: str = "train") -> DataFrame:
    """Chunks of texts as word numbers: (keys, train, lengths, vocabulary of sorted hashes, ids)."""
    kind, own = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)

    def run(batches):
        import xxhash

        words, keys, marks, parts = _Ids({b"": 0}), [], [], []

        def chunk():
            nonlocal words, keys, marks, parts
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            vocabulary, rank = np.unique(hashes, return_inverse=True)
            ids = rank.astype(np.uint32)[np.concatenate(parts)]
            columns = [pa.array([keys], pa.list_(own)), *(pa.array([x.tobytes()], pa.binary()) for x in (np.array(marks, np.uint8), np.array([len(p) for p in parts], np.uint32), vocabulary, ids))]
            words, keys, marks, parts = _Ids({b"": 0}), [], [], []
            return pa.RecordBatch.from_arrays(columns, ["keys", "train", "lengths", "vocabulary", "ids"])

        n = 0
        for batch in batches:
            for k, mark, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                found = (t.as_py() or b"").lower().split()
                ids = np.zeros(len(found) + 1, np.uint32)
                ids[:-1] = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
                keys.append(k)
                marks.append(bool(mark))
                parts.append(ids)
                n += len(ids)
                if n >= CHUNK_TOKENS:
                    n = 0
                    yield chunk()
        if keys:
            yield chunk()

    return docs.select(F.col(key), F.col(train), F.col(text)).mapInArrow(run, f"keys array<{kind}>, train binary, lengths binary, vocabulary binary, ids binary")


class Chunk:
    def __init__(self, train: bytes, lengths: bytes, vocabulary: bytes, ids: bytes) -> None:
        self.train, self.lengths = np.frombuffer(train, np.uint8).astype(bool), np.frombuffer(lengths, np.uint32).astype(np.int64)
        self.vocabulary, self.ids = np.frombuffer(vocabulary, np.uint64), np.frombuffer(ids, np.uint32)

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, lengths) of the training texts."""
        return self.ids[np.repeat(self.train, self.lengths)], self.lengths[self.train]

    def end(self) -> int:
        """The number of the end token."""
        import xxhash

        return int(np.searchsorted(self.vocabulary, np.uint64(xxhash.xxh64_intdigest(b""))))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


class Counts:
    """Adds up counts of sorted 64-bit keys and hands them on by shard."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, extra: np.ndarray) -> bool:
        self.parts.append((keys, counts.astype(np.uint32), extra))
        self.n += len(keys)
        return self.n > FLUSH

    @staticmethod
    def merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts, extra = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys, counts, extra = keys[order], counts[order], extra[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts[:0].astype(np.int64), extra[first]

    def rows(self, shard) -> pa.RecordBatch:
        keys, counts, extra = self.merge(self.parts)
        self.parts, self.n = [], 0
        of = shard(keys)
        cuts = np.flatnonzero(np.diff(of)) + 1
        out = [(int(of[a]), pack_keys(keys[a:b]), counts[a:b].astype(np.uint32).tobytes(), extra[a:b].astype(np.uint16).tobytes()) for a, b in zip([0, *cuts], [*cuts, len(keys)]) if b > a]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["shard", "keys", "counts", "extra"])


BLOB = "shard int, keys binary, counts binary, extra binary"


def pack_keys(keys: np.ndarray) -> bytes:
    """Differences of sorted keys by byte planes, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _merged(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of a shard's rows, added up in rounds, so that repeated keys are not all held at once."""
    parts, new = [], 0
    for _, k, c, x in group:
        parts.append((unpack_keys(k), np.frombuffer(c, np.uint32), np.frombuffer(x, np.uint16)))
        new += len(parts[-1][0])
        if new > max(FLUSH, len(parts[0][0])):
            parts, new = [Counts.merge(parts)], 0
    return Counts.merge(parts)


def quantised(log10_p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities, to 1/4096, up to 16."""
    return np.clip(np.rint(-log10_p * STEP), 0, 65535).astype(np.uint16)


class Trie:
    """The levels of a model under one folder; what it holds itself are a few numbers a shard."""

    def __init__(self, root: str, shards: int) -> None:
        self.root, self.shards = root, shards
        self.words = np.zeros(shards + 1, np.int64)  # first word id of each shard
        self.pairs = np.zeros(shards + 1, np.int64)  # first pair position of each shard
        self.contexts = self.pairs  # first pair position of each file of level 3, which splits the shards of common words
        self.total = 0

    def file(self, level: int, shard: int) -> str:
        return f"{self.root}/level{level}-{shard:06d}.bin"

    def _by_shard(self, shards: np.ndarray):
        """(shard, slice) of runs of a sorted array of shard numbers."""
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shards)]):
            if b > a:
                yield int(shards[a]), slice(a, b)

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of sorted hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for s, part in self._by_shard(shard_of(hashes, self.shards)):
            if self.words[s + 1] == self.words[s]:
                continue
            level = read_arrays(self.file(1, s))
            at = np.minimum(np.searchsorted(level["hashes"], hashes[part]), len(level["hashes"]) - 1)
            hit = level["hashes"][at] == hashes[part]
            ids[part] = np.where(hit, at + self.words[s], -1)
            counts[part] = np.where(hit, level["counts"][at], 0)
        return ids, counts

    def word_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.words[-1] + 1)))

    def pair_positions(self, keys: np.ndarray) -> np.ndarray:
        """Positions (or -1) of sorted pair keys, first << 32 | second."""
        out = np.full(len(keys), -1)
        first = (keys >> np.uint64(32)).astype(np.int64)
        for s, part in self._by_shard(np.searchsorted(self.words, first, "right") - 1):
            if self.pairs[s + 1] > self.pairs[s]:
                level = read_arrays(self.file(2, s))
                value = (first[part] - self.words[s]) * self.words[-1] + (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                at = EliasFano(level, "successors").find(value)
                out[part] = np.where(at >= 0, at + self.pairs[s], -1)
        return out

    def _gather(self, level: int, name: str, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Values of one array of a level at sorted positions."""
        out = np.zeros(len(at), np.int64)
        for s, part in self._by_shard(np.searchsorted(bounds, at, "right") - 1):
            arrays = read_arrays(self.file(level, s))
            out[part] = arrays[name][at[part] - bounds[s]]
        return out

    def pointers(self, words: np.ndarray) -> np.ndarray:
        """Position of the first pair of each word (sorted ids)."""
        out = np.zeros(len(words), np.int64)
        for s, part in self._by_shard(np.searchsorted(self.words, words, "right") - 1):
            out[part] = self.pairs[s] + EliasFano(read_arrays(self.file(2, s)), "pointers").access(words[part] - self.words[s])
        return out

    def triple_probs(self, keys: np.ndarray) -> np.ndarray:
        """Quantised log probabilities of sorted triple keys, context position << 32 | relative rank; -1 if absent."""
        out = np.full(len(keys), -1)
        context = (keys >> np.uint64(32)).astype(np.int64)
        for s, part in self._by_shard(np.searchsorted(self.contexts, context, "right") - 1):
            level = read_arrays(self.file(3, s))
            span, rank = int(level["span"][0]), (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = EliasFano(level, "successors").find(np.where(rank < span, (context[part] - self.contexts[s]) * span + rank, -1).clip(0))
            out[part] = np.where((at >= 0) & (rank < span), level["probs"][np.maximum(at, 0)].astype(np.int64) if len(level["probs"]) else -1, -1)
        return out

    def context(self, words: np.ndarray, lengths: np.ndarray, end: int):
        """(previous word, whether it is in the text) of every token; the end token stands before a text."""
        inside = np.ones(len(words), bool)
        inside[np.cumsum(lengths)[:-1]] = False
        inside[:1] = False
        previous = np.concatenate((np.full(1, end, words.dtype), words[:-1])) if len(words) else words
        return np.where(inside, previous, np.asarray(end, words.dtype)), inside

    def positions(self, of: np.ndarray, words: np.ndarray, previous: np.ndarray):
        """(positions, ranks among the first word's successors) of the distinct pairs known; every token's number among them or -1.

        of: the id or -1 of every word number; ids go up with the numbers.
        """
        number = np.full(len(words), -1, np.int32)
        seen = np.flatnonzero((of[words] >= 0) & (of[previous] >= 0))
        keys, back = np.unique(pair_keys(previous[seen], words[seen]), return_inverse=True)
        first = of[(keys >> np.uint64(32)).astype(np.int64)]
        at = self.pair_positions(pair_keys(first, of[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]))
        hit = at >= 0
        number[seen] = np.where(hit, np.cumsum(hit) - 1, -1).astype(np.int32)[back]
        first, at = first[hit], at[hit]
        heads = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
        return at, at - np.repeat(self.pointers(first[heads]), np.diff(heads, append=len(first))), number

    def triple_keys(self, inside: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, number: np.ndarray):
        """(token numbers, keys) of tokens whose two pairs are both in level 2."""
        before = np.concatenate((np.full(1, -1, np.int32), number[:-1])) if len(number) else number
        here = np.flatnonzero(inside & (number >= 0) & (before >= 0))
        return here, pair_keys(pairs[before[here]], ranks[number[here]])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)


def _chunks(batches):
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("train", "lengths", "vocabulary", "ids"))):
            yield Chunk(*(x.as_py() for x in row))


def build(chunks: DataFrame, root: str, tokens: int, least: int = 2) -> Trie:
    """Count all levels over the training texts of a tokens_table and write their files."""
    size = SHARD_TOKENS
    trie = Trie(root, max(1, -(-tokens // size)))
    shards = trie.shards

    def count_words(batches):
        found, of = Counts(), lambda keys: shard_of(keys, shards)
        for chunk in _chunks(batches):
            n = np.bincount(chunk.training()[0], minlength=len(chunk.vocabulary))
            if found.add(chunk.vocabulary[n > 0], n[n > 0], np.zeros((n > 0).sum(), np.uint16)):
                yield found.rows(of)
        if found.parts:
            yield found.rows(of)

    def write_words(group):
        hashes, counts, _ = _merged(group)
        write_arrays(trie.file(1, group[0][0]), {"hashes": hashes, "counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)})
        return [(group[0][0], len(hashes), int(counts.sum()), [])]

    def sizes(blobs: DataFrame, write) -> list:
        found = by_group(blobs, ["shard"], [], write, "shard int, n long, total long, cuts array<long>").collect()
        del blobs
        discard()  # the level's counts are no longer needed
        return found

    for r in sizes(chunks.mapInArrow(count_words, BLOB), write_words):
        trie.words[r["shard"] + 1] = r["n"]
        trie.total += r["total"]
    trie.words = np.cumsum(trie.words)
    if not trie.total:
        return trie
    if trie.words[-1] >= 1 << 32:
        raise ValueError("word ids need over 32 bits")

    def count_pairs(batches):
        found, shard = Counts(), lambda keys: np.searchsorted(trie.words, (keys >> np.uint64(32)).astype(np.int64), "right") - 1
        for chunk in _chunks(batches):
            of, counts = trie.word_ids(chunk.vocabulary)
            words, lengths = chunk.training()
            previous, inside = trie.context(words, lengths, chunk.end())
            often = counts[words] >= least  # others are in no pair seen that often
            both = often & np.where(inside, np.concatenate(([True], often[:-1])) if len(often) else often, True)
            keys, n = np.unique(pair_keys(previous[both], words[both]), return_counts=True)
            keys = pair_keys(of[(keys >> np.uint64(32)).astype(np.int64)], of[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)])
            if found.add(keys, n, np.zeros(len(keys), np.uint16)):
                yield found.rows(shard)
        if found.parts:
            yield found.rows(shard)

    def write_pairs(group):
        shard = group[0][0]
        keys, counts, _ = _merged(group)
        keys, counts = keys[counts >= least], counts[counts >= least]
        words = read_arrays(trie.file(1, shard))["counts"].astype(np.float64)
        first, second = (keys >> np.uint64(32)).astype(np.int64) - trie.words[shard], (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        mass = np.bincount(first, counts - DISCOUNT, len(words)) / words
        back = np.clip(1 - mass, 1e-9, 1)
        ids, rank = np.unique(second, return_inverse=True)
        lower = 10 ** trie.word_log10(_counts_of(trie, ids))[rank]
        p = (counts - DISCOUNT) / words[first] + back[first] * lower
        pointers = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=len(words)))))
        arrays = EliasFano.encode(first * trie.words[-1] + second, len(words) * int(trie.words[-1]), "successors") | EliasFano.encode(pointers, len(keys) + 1, "pointers")
        write_arrays(trie.file(2, shard), arrays | {"probs": quantised(np.log10(p)), "back": quantised(np.log10(back)), "counts": counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64)})
        tokens = np.cumsum(counts)
        cuts = np.unique(np.searchsorted(tokens, np.arange(1, (int(tokens[-1]) if len(tokens) else 0) // size + 1) * size))
        return [(shard, len(keys), 0, cuts[(cuts > 0) & (cuts < len(keys))].tolist())]

    def _counts_of(trie, ids):
        out = np.zeros(len(ids))
        for s, part in trie._by_shard(np.searchsorted(trie.words, ids, "right") - 1):
            out[part] = read_arrays(trie.file(1, s))["counts"][ids[part] - trie.words[s]]
        return out

    found = sizes(chunks.mapInArrow(count_pairs, BLOB), write_pairs)
    for r in found:
        trie.pairs[r["shard"] + 1] = r["n"]
    trie.pairs = np.cumsum(trie.pairs)
    trie.contexts = np.sort(np.concatenate([trie.pairs, *(trie.pairs[r["shard"]] + np.array(r["cuts"], np.int64) for r in found)]))
    if trie.pairs[-1] >= 1 << 32:
        raise ValueError("pair positions need over 32 bits")

    def count_triples(batches):
        found, shard = Counts(), lambda keys: np.searchsorted(trie.contexts, (keys >> np.uint64(32)).astype(np.int64), "right") - 1
        for chunk in _chunks(batches):
            of, _ = trie.word_ids(chunk.vocabulary)
            words, lengths = chunk.training()
            previous, inside = trie.context(words, lengths, chunk.end())
            pairs, ranks, number = trie.positions(of, words, previous)
            here, keys = trie.triple_keys(inside, pairs, ranks, number)
            order = np.argsort(keys)
            keys, here = keys[order], here[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            lower = trie._gather(2, "probs", pairs, trie.pairs)[number[here[first]]]
            if found.add(keys[first], np.diff(first, append=len(keys)), lower.astype(np.uint16)):
                yield found.rows(shard)
        if found.parts:
            yield found.rows(shard)

    def write_triples(group):
        shard = group[0][0]
        keys, counts, lower = _merged(group)
        often = counts >= least
        keys, counts, lower = keys[often], counts[often], lower[often]
        start, of = trie.contexts[shard], np.searchsorted(trie.pairs, trie.contexts[shard], "right") - 1
        pairs = read_arrays(trie.file(2, of))["counts"][start - trie.pairs[of] : trie.contexts[shard + 1] - trie.pairs[of]].astype(np.float64)
        context, rank = (keys >> np.uint64(32)).astype(np.int64) - start, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        back = np.clip(1 - np.bincount(context, counts - DISCOUNT, len(pairs)) / pairs, 1e-9, 1)
        p = (counts - DISCOUNT) / pairs[context] + back[context] * 10 ** (lower.astype(np.float64) / -STEP)
        span = int(rank.max()) + 1 if len(rank) else 1
        arrays = EliasFano.encode(context * span + rank, len(pairs) * span, "successors")
        write_arrays(trie.file(3, shard), arrays | {"span": np.array([span]), "probs": quantised(np.log10(p)), "back": quantised(np.log10(back))})
        return [(shard, len(keys), 0, [])]

    written = {r["shard"] for r in sizes(chunks.mapInArrow(count_triples, BLOB), write_triples)}
    empty = np.zeros(0, np.int64)
    for s in range(len(trie.contexts) - 1):  # those with pairs but no triples
        n = int(trie.contexts[s + 1] - trie.contexts[s])
        if n and s not in written:
            write_arrays(trie.file(3, s), EliasFano.encode(empty, n, "successors") | {"span": np.array([1]), "probs": empty.astype(np.uint16), "back": np.zeros(n, np.uint16)})
    return trie


def log10_probs(trie: Trie, of: np.ndarray, words: np.ndarray, lengths: np.ndarray, word_log10: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of every token, given the two before it; of: the id or -1 of every word number."""
    previous, inside = trie.context(words, lengths, end)
    pairs, ranks, number = trie.positions(of, words, previous)
    out = word_log10.copy()
    # back-off weight of the previous word where the pair is unknown
    known = np.flatnonzero((number < 0) & (of[previous] >= 0))
    needed = np.zeros(len(of), bool)
    needed[previous[known]] = True
    needed = np.flatnonzero(needed)
    ids, weight, weights = of[needed], np.zeros(len(needed)), np.zeros(len(of))
    for s, part in trie._by_shard(np.searchsorted(trie.words, ids, "right") - 1):
        if trie.pairs[s + 1] > trie.pairs[s]:
            weight[part] = read_arrays(trie.file(2, s))["back"][ids[part] - trie.words[s]]
    weights[needed] = weight
    out[known] -= weights[previous[known]] / STEP
    hit = np.flatnonzero(number >= 0)
    out[hit] = -trie._gather(2, "probs", pairs, trie.pairs)[number[hit]] / STEP
    here, keys = trie.triple_keys(inside, pairs, ranks, number)
    unique, inverse = np.unique(keys, return_inverse=True)
    found = trie.triple_probs(unique)[inverse]
    third = np.zeros(len(words), bool)
    third[here[found >= 0]] = True
    out[here[found >= 0]] = -found[found >= 0] / STEP
    before = np.concatenate((np.full(1, -1, np.int32), number[:-1])) if len(number) else number
    lost = np.flatnonzero(inside & (before >= 0) & ~third)
    out[lost] -= trie._gather(3, "back", pairs, trie.contexts)[before[lost]] / STEP
    return out


def score_chunks(chunks: DataFrame, trie: Trie, kind: str) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) for every text of a tokens_table."""

    def run(batches):
        for batch in batches:
            for k, *row in zip(*(batch.column(c) for c in ("keys", "train", "lengths", "vocabulary", "ids"))):
                chunk = Chunk(*(x.as_py() for x in row))
                of, counts = trie.word_ids(chunk.vocabulary)
                base = trie.word_log10(counts)[chunk.ids]
                p = log10_probs(trie, of, chunk.ids, chunk.lengths, base, chunk.end()) if trie.total else base
                starts = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1]))
                total = lambda x: np.add.reduceat(x, starts)
                n = len(starts)
                columns = [k.values, pa.array(chunk.train), pa.array(chunk.lengths), pa.array(total((of >= 0).astype(np.int64)[chunk.ids])), pa.array(np.full(n, trie.total, np.int64)), pa.array(total(base)), pa.array(total(p))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.mapInArrow(run, f"key {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", train: str = "train", least: int = 2) -> DataFrame:
    """Learn from the rows marked in ``train`` and score all rows; pairs and triples seen under ``least`` times are left out."""
    spark = docs.sparkSession
    root, kind = fresh_dir(spark, "trie"), docs.schema[key].dataType.simpleString()
    found = tokens_table(docs, text, key, train)
    found.write.option("compression", "zstd").parquet(f"{root}/tokens")
    chunks = spark.read.schema(found.schema).parquet(f"{root}/tokens")
    tokens = chunks.agg(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    trie = build(chunks, root, int(tokens), least)
    return score_chunks(chunks, trie, kind)


def op2_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    found = score_texts(docs, least=1)
    return found.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_elias_fano_lm": op2_elias_fano_lm}
ORACLE_SQL: dict[str, str] = {}
