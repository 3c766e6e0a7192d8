"""SimHash near-duplicate detection with Golay-code keys.

Fingerprints: 64-bit majority vote over XXH64 hashes (seed 42) of word shingles. Near fingerprints
(at most two differing bits) are found without comparing all pairs: the 64 bits are cut into three
segments, of which at least one has no error. Each segment, zero-padded to 23 bits, is decoded with
the perfect Golay code to the indices of nearby codewords: one index where the nearest codeword is
at distance 2 or less, else six (the one at distance 3 and the five at distance 4). Any two 23-bit
words at distance 2 or less share such an index, so a pair of near fingerprints always shares a key
made of an exact segment and a codeword index of the next one. Keys are joined and pairs verified.

The pipeline's stage removes near copies with a similarity of 0.8 or more of their five-word shingles. Their
fingerprints differ in up to 14 of 64 bits, more than Golay keys bridge, so it adds keys from an exact prefix
filter on the shingles and verifies those pairs on whole shingle sets (similar_groups).

Defined cases: null text is empty; an empty text has fingerprint zero and links like any other;
repeated rows all stay, each with its component; a null id is kept and never becomes a component id
unless its component has no other. Only id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, row_hash, staged, table, unused, with_key_in

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: x^11+x^9+x^7+x^6+x^5+x+1, a generator of the (23,12) Golay code.
GENERATOR = 0b101011100011
HOT_BUCKET = 2000
SPLIT_DEPTH = 4
#: Texts are near copies if their sets of five-word shingles have this Jaccard similarity or more.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Cells (2 to this power) by which shingles are counted, to take the rarer ones as keys first.
ORDER_BITS = 20
#: Of the texts' shingle sets only those of asked nodes are made; a bitmap of 2 to this power of bits leaves out most others.
ASKED_BITS = 23
#: Parts shared by more nodes get new keys, by the difference to a hub, in place of a list of their pairs.
HOT_PART = 64
WINDOW_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit fingerprint of one text: a bit is 1 if set in over half of the shingle hashes."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """One row (key, fp) for each row of docs; fp holds the 64 bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp long")


@lru_cache(1)
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """(error patterns by syndrome, up to six each; how many there are)."""
    rows = []
    for i in range(23):
        x = 1 << i
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        rows.append(x)
    by: dict[int, dict[int, list[int]]] = {}
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = v = 0
            for i in at:
                s ^= rows[i]
                v |= 1 << i
            by.setdefault(s, {}).setdefault(weight, []).append(v)
    errors, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s, found in by.items():
        least = min(found)
        near = found[least] + (found[4] if least == 3 else [])
        errors[s, : len(near)], count[s] = near, len(near)
    return errors, count


def codeword_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (n x 6 indices of nearby codewords, how many of them hold)."""
    errors, count = _syndromes()
    s = x.astype(np.int64)
    for b in range(22, 10, -1):
        s = np.where(s >> b & 1, s ^ (GENERATOR << (b - 11)), s)
    return (x[:, None].astype(np.int64) ^ errors[s]) >> 11, count[s]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of unsigned fingerprints."""
    at, keys = [], []
    parts = [((fps >> np.uint64(o)) & np.uint64((1 << w) - 1)).astype(np.int64) for o, w in SEGMENTS]
    for s in range(len(parts)):
        index, count = codeword_indices(parts[(s + 1) % len(parts)])
        holds = np.arange(6)[None, :] < count[:, None]
        key = (np.int64(s) << 60) | (parts[s][:, None] << 12) | index
        at.append(np.nonzero(holds)[0])
        keys.append(key[holds])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 20000):
                block = fps[k : k + 20000]
                at, keys = golay_keys(block.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[at])], ["bucket", "fp"])

    return nodes.select("fp").mapInArrow(run, "bucket long, fp long")


def _split(hot: DataFrame, depth: int) -> DataFrame:
    """Deal a crowded bucket out by thirds of the bits: of two near fingerprints, one third at least is equal."""
    width = 64
    for _ in range(depth):
        width = (width + 2) // 3
    cuts = [(o, min(width, 64 - o)) for o in range(0, 64, width)]
    groups = [cuts[i::3] for i in range(3)]
    keys = []
    for i, group in enumerate(groups):
        mask = sum(((1 << w) - 1) << o for o, w in group)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64("bucket", F.lit(depth * 3 + i), F.col("fp").bitwiseAND(F.lit(mask))))
    return hot.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def near_pairs(nodes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints in nodes.fp that differ in one or two bits.

    Buckets of over hot_bucket fingerprints are dealt out anew by thirds of the bits, which is
    exact, until they are small or the depth is used up.
    """
    keyed = staged(_keyed(nodes), "simhash-keys")
    found = None
    for depth in range(SPLIT_DEPTH + 1):
        crowded = keyed.groupBy("bucket").count().filter(F.col("count") > hot_bucket).select("bucket")
        last = depth == SPLIT_DEPTH or not crowded.take(1)
        cold = keyed if last else keyed.join(crowded, "bucket", "left_anti")
        a, b = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        pairs = a.join(b.hint("merge"), "bucket").filter(near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            break
        keyed = staged(_split(keyed.join(crowded, "bucket", "left_semi"), depth + 1).distinct(), "simhash-split")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge (a, b).

    Alternating large and small stars; each round is written to the shared folder.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "stars")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id) for each row: component_id is the smallest key reachable by links."""
    fps = staged(fingerprints(docs, text, key, shingle), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("key").alias("rep")), "simhash-nodes")
    linked = components(near_pairs(nodes))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    reps = nodes.join(linked, nodes.fp == linked.node).select("fp", "root", "rep")
    roots = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = nodes.join(reps.join(roots, "root").select("fp", "component_id"), "fp", "left")
    of = of.select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(of, "fp").select("key", "fp", "component_id")


def _mixed(text: bytes) -> np.ndarray:
    """One 64-bit hash a word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.lower().split()], np.uint64)


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of width words; of the whole sequence where it is shorter."""
    n, out = max(len(h) - width + 1, 1), None
    for k in range(min(width, len(h))):
        part = h[k : k + n]
        out = part if out is None else (out ^ (out >> np.uint64(29))) * WINDOW_FACTOR + part
    return h if out is None else out


def shingle_set(h: np.ndarray, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct word shingles of a text with word hashes h, as sorted 64-bit hashes."""
    return np.unique(_windows(h, shingle))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _crowds(docs: DataFrame, text: str) -> np.ndarray:
    """In how many texts each cell of shingle hashes occurs: a table of fixed size, which only sets an order."""

    size = 1 << 10

    def count(batches):
        cells = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                cells[_cells(shingle_set(_mixed(t.as_py() or b"")))] += 1
        parts = cells.reshape(-1, size)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[k].tobytes() for k in at], pa.binary())], ["block", "cells"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(x.as_py(), "<u4")
                sums[k] = sums[k] + found if k in sums else found.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "cells"])

    found = docs.select(text).mapInArrow(count, "block int, cells binary").repartition("block").mapInArrow(add, "block int, cells binary").toArrow()
    out = np.zeros((1 << ORDER_BITS) // size * size, np.int64).reshape(-1, size)
    for k, x in zip(found["block"].to_pylist(), found["cells"].to_pylist()):
        out[k] = np.frombuffer(x, "<i8")
    return out.reshape(-1)


def prefix_keys(shingles: np.ndarray, crowds: np.ndarray) -> np.ndarray:
    """The first n - ceil(SIMILARITY n) + 1 of n sorted shingles, by the crowd of their cell and then by hash.

    Two sets of this similarity have SIMILARITY n shingles in common, so by any one order of all shingles they share
    one of these.
    """
    order = np.argsort(crowds[_cells(shingles)], kind="stable")
    return shingles[order[: int((1 - SIMILARITY) * len(shingles) + 1e-6) + 1]]


def similar(n: int, m: int, common: int) -> bool:
    return common >= SIMILARITY * (n + m - common) - 1e-9


def difference_keys(hub: np.ndarray, other: np.ndarray, crowds: np.ndarray) -> tuple[bool, int, np.ndarray]:
    """(whether two shingle sets are similar, how many shingles one of them alone has, keys of ``other`` beside this hub).

    Let D be what a set and the hub do not share. Similar sets x and y differ by (n + m) / 9 shingles at most, so D(x) and
    D(y) have (|D(x)| + |D(y)| - (n + m) / 9) / 2 in common: one at least unless both are similar to the hub (and
    then they are in one group already). So by any one order, x and y share one of the first |D| - t + 1 elements, t being
    the least overlap with any partner. The order is: those that the set has besides the hub, rarest cells first, then
    those of the hub that it lacks.
    """
    added, lost = np.setdiff1d(other, hub, assume_unique=True), np.setdiff1d(hub, other, assume_unique=True)
    size = len(added) + len(lost)
    linked = similar(len(hub), len(other), len(other) - len(added))
    # a similar partner has at most n / SIMILARITY shingles and so differs by n (1 + 1 / SIMILARITY) / 9 at most
    least = 4 * size // 9 + 1 if linked else max(1, math.ceil(size - len(other) * (1 + 1 / SIMILARITY) / 9 - 1e-6))
    order = np.argsort(crowds[_cells(added)], kind="stable")
    return linked, size, np.concatenate((added[order], ~lost))[: max(0, size - least + 1)]


def _described(docs: DataFrame, text: str, shared) -> DataFrame:
    """(row, node, fp, size, central, crowd, keys) of each row of (row, text); node identifies the sequence of words, crowd is of the last key's cell."""
    import xxhash

    kind = docs.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = []
            for t in batch.column(1).cast(pa.binary()):
                t = t.as_py() or b""
                parts = shingle_set(_mixed(t))
                same = xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 7)
                keys = prefix_keys(parts, shared.value)
                central = float(np.log2(shared.value[_cells(keys)]).mean()) if len(keys) else 0.0
                crowd = int(shared.value[_cells(keys[-1:])][0]) if len(keys) else 0
                found.append((same, fingerprint(t), len(parts), central, crowd, keys.view(np.int64)))
            node, fp, size, central, crowd, keys = zip(*found) if found else [()] * 6
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, fp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(size, pa.int32()), pa.array(central, pa.float32()), pa.array(crowd, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "node", "fp", "size", "central", "crowd", "keys"])

    return docs.select("row", text).mapInArrow(run, f"row {kind}, node long, fp long, size int, central float, crowd long, keys array<long>")


def _bucket_rows(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a part and whose sizes allow it, from rows (part, node, size, at, length, linked),
    with fits: whether they may be similar if this part is the first that they share.

    length counts the elements that the keys were taken from, at is a key's rank among them. At the first key that two nodes
    share, none of the elements before is common, which bounds their overlap.
    """
    cols = ("part", "node", "size", "at", "length", "linked")
    a, b = (keyed.select(*(F.col(c).alias(f"{c}_{s}") for c in cols)) for s in "ab")
    alike = (F.col("size_a") >= SIMILARITY * F.col("size_b")) & (F.col("size_b") >= SIMILARITY * F.col("size_a"))
    left = F.least(F.col("length_a") - F.col("at_a"), F.col("length_b") - F.col("at_b"))
    need = (F.col("length_a") + F.col("length_b") - (F.col("size_a") + F.col("size_b")) / 9) / 2
    pairs = a.join(b.hint("merge"), (F.col("part_a") == F.col("part_b")) & (F.col("node_a") < F.col("node_b")) & alike & ~(F.col("linked_a") & F.col("linked_b")))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), (left >= need - 1e-6).alias("fits"))


def _prefix_pairs(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar, from the parts of their prefixes that are not hot.

    Of two prefixes let z be the one that ends first in the order. All keys of z that the other has at all are in the other's
    prefix too, so the overlap is at most the keys shared plus what z has beyond its prefix.
    """
    shared = _bucket_rows(keyed.filter("not hot")).groupBy("a", "b").agg(F.count("*").alias("shared"), F.bool_or("fits").alias("fits")).filter("fits")
    hot = keyed.filter("hot").groupBy("node").agg(F.count("*").alias("hot"))
    beyond = F.col("size") - F.size("keys")
    ends = nodes.select("node", "size", beyond.alias("beyond"), F.struct("crowd", F.try_element_at("keys", F.lit(-1)).bitwiseXOR(F.lit(-(1 << 63))).alias("key")).alias("last")).join(hot, "node", "left")
    side = lambda s: ends.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("beyond").alias(f"beyond_{s}"), F.col("last").alias(f"last_{s}"), F.coalesce("hot", F.lit(0)).alias(f"hot_{s}"))
    both = shared.join(side("a"), "a").join(side("b"), "b")
    most = F.col("shared") + F.least("hot_a", "hot_b") + F.when(F.col("last_a") <= F.col("last_b"), F.col("beyond_a")).otherwise(F.col("beyond_b"))
    return both.filter(most >= 4 * (F.col("size_a") + F.col("size_b")) / 9 - 1e-6).select("a", "b")


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, parts): the shingle sets of the nodes in ``asked``, from one scan of the texts.

    Texts of other nodes are left out by a bitmap of fixed size first, then exactly by the join.
    """
    import xxhash

    cell = F.col("node").bitwiseAND(F.lit((1 << ASKED_BITS) - 1))
    words = asked.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (ASKED_BITS - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            found = {}
            for t in batch.column(0).cast(pa.binary()):
                t = t.as_py() or b""
                node = xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 7)
                low = node & ((1 << ASKED_BITS) - 1)
                if node not in found and int(shared.value[low >> 6]) >> (low & 63) & 1:
                    found[node] = shingle_set(_mixed(t)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "parts"])

    return docs.select("text").mapInArrow(run, "node long, parts array<long>").join(asked, "node", "left_semi").dropDuplicates(["node"])


def _compared(pairs: DataFrame, sets: DataFrame, shared) -> DataFrame:
    """pairs (a, b, hub boolean) with linked; for hubs (a) also length and keys of b beside the hub (difference_keys)."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("parts").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("parts").alias("y")), "b")

    def run(batches):
        for batch in batches:
            linked, length, keys = [], [], []
            for hub, x, y in zip(*(batch.column(k) for k in (2, 3, 4))):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                if hub.as_py():
                    found = difference_keys(x, y, shared.value)
                else:
                    found = similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))), 0, y[:0]
                linked.append(bool(found[0]))
                length.append(found[1])
                keys.append(found[2].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(linked, pa.bool_()), pa.array(length, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["a", "b", "hub", "linked", "length", "keys"])

    return both.select("a", "b", "hub", "x", "y").mapInArrow(run, "a long, b long, hub boolean, linked boolean, length int, keys array<long>")


def _crowded(posted: DataFrame, hot_bucket: int) -> DataFrame:
    """posted without the parts of one row, with hot: whether over hot_bucket rows share the part."""
    counts = posted.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    counts = staged(counts.select("part", (F.col("n") > hot_bucket).alias("hot")), "similar-parts")
    discard()
    return with_key_in(posted, "part", counts, "part").join(counts, "part")


def similar_links(docs: DataFrame, nodes: DataFrame, shared, hot_bucket: int) -> DataFrame:
    """Links (a, b) of nodes (node, size, central, crowd, keys): every pair of a similarity of 0.8 or more is linked, or joined by other links.

    Keys are the prefixes of the shingle sets. Buckets of up to hot_bucket nodes list their pairs that pass the
    size and position bounds. In a more crowded one, all are held against the hub
    (the node whose keys are the most common) and get new keys from their difference to it, which is exact
    (difference_keys), until no bucket is crowded or the depth is used up.
    """
    posted = nodes.select("node", F.posexplode("keys").alias("at", "part"))
    edges, sets, done = [], None, []
    for depth in range(SPLIT_DEPTH + 1):
        if depth == 0:
            keyed = _crowded(posted, hot_bucket).join(nodes.select("node", "size", "central", F.col("size").alias("length"), F.lit(False).alias("linked")), "node")
            keyed = staged(keyed, "similar-keys")
            pairs = _prefix_pairs(keyed, nodes)
        else:  # keys of differences leave few pairs within their bounds, so larger buckets are listed
            keyed = staged(_crowded(posted, hot_bucket * 32 if depth < SPLIT_DEPTH else 1 << 62), "similar-keys")
            pairs = _bucket_rows(keyed.filter("not hot")).filter("fits").select("a", "b").distinct()
        hot = keyed.filter("hot")
        hubs = hot.groupBy("part").agg(F.max_by("node", F.struct("central", "node")).alias("a"))
        hubs = hot.join(hubs, "part").filter("node <> a").select("a", F.col("node").alias("b"), "size", "central").distinct()
        asks = [pairs.select("a", "b", F.lit(False).alias("hub"), F.lit(0).alias("size"), F.lit(0.0).cast("float").alias("central")), hubs.select("a", "b", F.lit(True).alias("hub"), "size", "central")]
        asks = staged(asks[0].unionByName(asks[1]), "similar-pairs")
        discard()
        if sets is None:  # nodes of later rounds are among these
            asked = asks.select(F.col("a").alias("node")).unionByName(asks.select(F.col("b").alias("node"))).distinct()
            sets = staged(_sets(docs, staged(asked, "similar-asked")), "similar-sets")
        compared = staged(_compared(asks.select("a", "b", "hub"), sets, shared), "similar-compared")
        edges.append(compared.filter("linked").select("a", "b"))
        again = compared.filter("hub").join(asks.filter("hub").select("a", "b", "size", "central"), ["a", "b"])
        # the hub itself needs no key: all of its pairs are verified
        posted = again.select(F.col("a").alias("of"), F.col("b").alias("node"), "size", "central", "length", "linked", F.posexplode("keys").alias("at", "element"))
        posted = posted.select(F.xxhash64("of", "element").alias("part"), "node", "size", "central", "length", "linked", "at")
        done += [keyed, asks]
        if depth == SPLIT_DEPTH or not compared.filter("hub").take(1):
            break
    discard(*done, sets)
    return reduce(DataFrame.unionByName, edges)


def similar_groups(docs: DataFrame, hot_bucket: int = HOT_PART) -> DataFrame:
    """(row, component) for each row of docs (row: struct n, k, h; text): component is the smallest row reachable.

    Links: fingerprints that differ in MAX_BITS bits or fewer (Golay keys, near_pairs), and texts whose sets of five-word
    shingles have a similarity of 0.8 or more (similar_links). Equal texts are one node (64-bit hash of the words).
    """
    shared = docs.sparkSession.sparkContext.broadcast(_crowds(docs, "text"))
    base = staged(_described(docs, "text", shared), "similar")
    nodes = base.groupBy("node").agg(F.min("row").alias("rep"), *(F.first(c).alias(c) for c in ("fp", "size", "central", "crowd", "keys")))
    nodes = staged(nodes, "similar-nodes")
    fps = staged(nodes.groupBy("fp").agg(F.min("node").alias("of")), "similar-fps")
    ends = near_pairs(fps.select("fp")).join(fps.select(F.col("fp").alias("a"), F.col("of").alias("u")), "a").join(fps.select(F.col("fp").alias("b"), F.col("of").alias("v")), "b")
    near = nodes.join(fps, "fp").filter("node <> of").select(F.col("node").alias("a"), F.col("of").alias("b"))
    near = staged(near.unionByName(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))), "similar-near")

    roots = components(near.unionByName(similar_links(docs, nodes, shared, hot_bucket)))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    found = nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("comp"))
    least = found.groupBy("comp").agg(F.min("rep").alias("component"))
    out = staged(base.select("row", "node").join(found.select("node", "comp"), "node").join(least, "comp").select("row", "component"), "similar-groups")
    discard(base, nodes, fps, near)
    return out


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", hot_bucket: int = HOT_PART) -> DataFrame:
    """One row of each group of similar_groups: the first by key, then by a hash of the row. All columns stay.

    A row with a null key stays only if its group has no key. Of rows repeated in full one stays. Other columns may
    have any name and kind.
    """
    row = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), row_hash(docs).alias("h"))
    found = similar_groups(docs.select(row.alias("row"), F.col(text).alias("text")), hot_bucket)
    name = unused(docs.columns, "stay")
    stay = found.select(F.col("component").alias(name)).distinct()
    kept = docs.withColumn(unused(docs.columns, "row"), row)
    row_name = kept.columns[-1]
    kept = kept.join(stay, F.col(f"{row_name}.k").eqNullSafe(F.col(f"{name}.k")) & (F.col(f"{row_name}.h") == F.col(f"{name}.h")), "left_semi")
    if found.groupBy("row").count().filter("count > 1").take(1):
        kept = kept.dropDuplicates([row_name])
    return kept.drop(row_name)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
