"""Toxicity by maximum-scoring segments of token log-odds.

Learning: token counts of labelled texts, toxic and clean, over all labelled rows, of words and of word beginnings of
MIN_PREFIX to MAX_PREFIX characters (so that rare members of a word family count together). A unit's score is its
log-odds ratio of token rates with a Dirichlet prior (the unit's background rate, and one token). Units whose split
of texts (not tokens, so one long text can't make a unit) is significant by the signed root of its deviance are kept,
at most MAX_LEXICON of them, the most significant first. A word scores as its most specific unit: the whole word,
else its longest kept beginning; other words score a constant below zero, so that a passage must pay for them.

Scoring: a linear scan (Ruzzo and Tompa) finds all disjoint maximal-scoring segments of a text. The best segment of a
clean text of n tokens follows an extreme-value law, P(S <= s) = exp(-K n exp(-lambda s)) (Karlin and Altschul);
lambda and K are its maximum-likelihood values over the clean labelled texts. Segments with E = K n exp(-lambda S) below
SIGNIFICANT are significant passages; the -log10 of the E of all significant passages add up to the text's evidence.

The level of significance that units need is the one of LEVELS with the best ranking of texts that the lexicon was
not learned from: two halves by a hash of the text, each scored with the lexicon of the other half. The evidence of these
out-of-fold scores is calibrated to a probability by pooling adjacent violators, linear between the pools. What reaches the
driver are the lexicon and counts in bins, of bounded size.

Defined cases: null text is empty; a text without tokens scores the calibrated value of no evidence; a row with
several labels counts as toxic if any says so; with no labelled text of either class, or no unit that passes, all scores
are 0; repeated rows all stay (equal texts fall in one half); texts of any length are read whole; only the named columns
are read, so others can't clash.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, staged, table, with_key_in
from textloom.llm.decontaminate import tokens

MAX_LEXICON = 20_000
MIN_PREFIX, MAX_PREFIX = 4, 8
#: Weight of the background rate in the prior, in tokens.
PRIOR = 500.0
LEVELS = (4.2, 5.5, 7.0, 9.0, 12.0)
#: What a neutral token costs.
NEUTRAL = -0.1
#: Units held by a task before it passes their counts on.
FLUSH = 400_000
THRESHOLD = 0.3
SIGNIFICANT = 0.01
#: Bins of a score or of evidence, by its logarithm.
BINS = 200
KNOWN_WORDS = 500_000


class Cached(dict):
    """A function's results by argument, emptied when full."""

    def __init__(self, function, most: int = KNOWN_WORDS) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.function(key)
        return out


def beginnings(word: str) -> tuple[str, ...]:
    """The beginnings of a word, longest first."""
    return tuple(word[:k] for k in range(min(MAX_PREFIX, len(word) - 1), MIN_PREFIX - 1, -1))


def units(word: str) -> tuple[str, ...]:
    """The word itself (marked) and its beginnings, longest first."""
    return ("=" + word, *beginnings(word))


def token_counts(labelled: DataFrame) -> DataFrame:
    """(unit, and for half h and class c: tokens t<h><c> and texts d<h><c>) of rows (text, toxic, half)."""

    def run(batches):
        starts = Cached(beginnings)
        # by half and class: tokens of words, texts of words, texts of beginnings
        counts = [[Counter() for _ in range(3)] for _ in range(4)]

        def flush():
            for at, (words, texts, parts) in enumerate(counts):
                within = dict.fromkeys(parts, 0)
                for w, n in words.items():
                    for u in starts[w]:
                        within[u] += n
                columns = ["=" + w for w in words] + list(within), [*words.values(), *within.values()], [*(texts[w] for w in words), *parts.values()]
                for c in (words, texts, parts):
                    c.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array([at] * len(columns[0]), pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["unit", "at", "t", "d"])

        for batch in batches:
            for t, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                words, texts, parts = counts[2 * half + bool(toxic)]
                found = tokens(t or "")
                words.update(found)
                found = set(found)
                texts.update(found)
                parts.update(set().union(*map(starts.__getitem__, found)))
                if sum(len(x) + len(y) for _, x, y in counts) > FLUSH:
                    yield from flush()
        yield from flush()

    parts = labelled.select("text", "toxic", "half").mapInArrow(run, "unit string, at int, t long, d long")
    of = lambda kind, at: F.sum(F.when(F.col("at") == at, F.col(kind)).otherwise(0))
    return parts.groupBy("unit").agg(*(of(kind, 2 * h + c).alias(f"{kind}{h}{c}") for kind in "td" for h in (0, 1) for c in (0, 1)))


def _rated(toxic, clean, d_toxic, d_clean, sizes: tuple[float, float, float, float]):
    """(log-odds ratio of token rates, signed root deviance of the split of texts) of a unit."""
    n_toxic, n_clean, all_toxic, all_clean = sizes  # tokens, texts
    share = n_toxic / (n_toxic + n_clean)
    prior = PRIOR * (toxic + clean) / F.lit(n_toxic + n_clean)
    delta = F.log((toxic + prior + share) / F.lit(n_toxic + PRIOR)) - F.log((clean + prior + 1 - share) / F.lit(n_clean + PRIOR))
    part = all_toxic / (all_toxic + all_clean)
    expected, rest = (d_toxic + d_clean) * part, (d_toxic + d_clean) * (1 - part)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(d_toxic, expected) + term(d_clean, rest)))) * F.signum(d_toxic - expected)
    return delta, z


def lexicons(counts: DataFrame, sizes: dict[str, float]) -> list[dict[str, tuple[float, float]]]:
    """Units with (log-odds ratio, significance) learned from half 0, from half 1 and from all; sizes are tokens and texts."""
    rows, kept = [], None
    for halves in ((0,), (1,), (0, 1)):
        columns = [sum((F.col(f"{kind}{h}{c}") for h in halves[1:]), F.col(f"{kind}{halves[0]}{c}")) for kind in "td" for c in (1, 0)]
        total = [float(sum(sizes[f"{kind}{h}{c}"] for h in halves)) for kind in "td" for c in (1, 0)]
        if not all(total):
            rows.append((F.lit(0.0), F.lit(0.0)))
            continue
        rows.append(_rated(*columns, tuple(total)))
        common = columns[2] + columns[3] < 0.5 * (total[2] + total[3])
        fits = common & (F.abs(rows[-1][1]) >= LEVELS[0])
        kept = fits if kept is None else kept | fits
    if kept is None:
        return [{}, {}, {}]
    most = F.greatest(*(F.abs(z) for _, z in rows))
    cells = [x.alias(f"{name}{k}") for k, row in enumerate(rows) for name, x in zip(("delta", "z"), row)]
    found = counts.filter(kept).select("unit", *cells, most.alias("most")).orderBy(F.desc("most"), "unit").limit(MAX_LEXICON).collect()
    return [{r["unit"]: (r[f"delta{k}"], r[f"z{k}"]) for r in found} for k in range(3)]


def at_level(lexicon: dict[str, tuple[float, float]], level: float) -> dict[str, float]:
    return {u: delta for u, (delta, z) in lexicon.items() if abs(z) >= level}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by Ruzzo and Tompa's scan over runs of one sign."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    for k in at.tolist():
        start, end, left, right = k, k + 1, float(total[k]), float(total[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - x) for s, e, x, r in stack]


class Scorer:
    """Scores texts with the log-odds of units and the extreme-value law (lam, log_k) of clean text."""

    def __init__(self, weights: dict[str, float], lam: float = 1.0, log_k: float = 0.0) -> None:
        self.weights, self.lam, self.log_k = weights, lam, log_k
        self.known = Cached(self.weight)

    def __reduce__(self):
        return Scorer, (self.weights, self.lam, self.log_k)

    def weight(self, word: str) -> float:
        return next((self.weights[u] for u in units(word) if u in self.weights), NEUTRAL)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, all maximal segments (first token, end, score))."""
        words = tokens(text)
        return len(words), segments(np.fromiter(map(self.known.__getitem__, words), float, len(words)))

    def log_e(self, score: float, n: int) -> float:
        """log10 of the number of segments of this score expected in clean text of n tokens."""
        return (self.log_k + math.log(max(n, 1)) - self.lam * score) / math.log(10)

    def significant(self, text: str) -> list[tuple[int, int, float]]:
        """The significant passages of a text: (first token, end, -log10 of E)."""
        n, found = self.passages(text)
        return [(s, e, -x) for s, e, v in found if (x := self.log_e(v, n)) < math.log10(SIGNIFICANT)]

    def evidence(self, text: str) -> tuple[float, int]:
        """(-log10 of the E of the significant passages together, or of the best one if none is; how many are significant)."""
        n, found = self.passages(text)
        if not found:
            return 0.0, 0
        bits = [-self.log_e(v, n) for _, _, v in found]
        good = [b for b in bits if b > -math.log10(SIGNIFICANT)]
        # evidence starts at E = 1000, so that weak passages still rank
        return max(sum(good), max(bits)) + 3 if max(bits) > -3 else 0.0, len(good)


def bin_of(x: float) -> int:
    """0 for nothing, else by the logarithm."""
    return 0 if x <= 0 else min(BINS, 1 + int(10 * math.log2(1 + x)))


def extreme_value(cells: list[tuple[float, float, int]]) -> tuple[float, float]:
    """(lambda, log K) of best scores of clean texts, from cells (score or 0 if none, tokens, texts), by maximum likelihood.

    A text without a segment says only that its best score is below any. K is exact for a given lambda; lambda
    is found by golden section.
    """
    scored = [(s, n, m) for s, n, m in cells if s > 0]
    total, silent = sum(m for _, _, m in scored), sum(n * m for s, n, m in cells if s <= 0)
    if total < 20:  # too few to tell a law from: a unit of log-odds counts as such
        return 1.0, math.log((total + 1) / max(1.0, sum(n * m for _, n, m in cells)))

    def likelihood(lam: float) -> tuple[float, float]:
        mass = silent + sum(m * n * math.exp(-lam * s) for s, n, m in scored)
        k = total / mass
        return sum(m * (math.log(k * n * lam) - lam * s) for s, n, m in scored) - k * mass, math.log(k)

    low, high, golden = 0.02, 10.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if likelihood(a)[0] >= likelihood(b)[0] else (a, high)
    return low, likelihood(low)[1]


def ranking(cells: list[tuple[float, int, int]]) -> float:
    """The probability that a toxic text ranks above a clean one, from cells (value, toxic, clean); ties count half."""
    below = hits = 0.0
    by: dict[float, list[int]] = {}
    for value, t, c in cells:
        row = by.setdefault(value, [0, 0])
        row[0], row[1] = row[0] + t, row[1] + c
    for value in sorted(by):
        t, c = by[value]
        hits += t * (below + c / 2)
        below += c
    n = sum(t for t, _ in by.values()) * below
    return hits / n if n else 0.5


def _best_cells(labelled: DataFrame, found: list[dict]) -> list[tuple]:
    """(level, toxic, sum of best scores, sum of log tokens, texts) of cells of labelled texts, each scored out of fold."""

    def run(batches):
        scorers = [[Scorer(at_level(found[1 - half], level)) for level in LEVELS] for half in (0, 1)]
        known = [Cached(lambda word, of=of: tuple(s.weight(word) for s in of)) for of in scorers]
        cells: dict[tuple, list[float]] = {}
        for batch in batches:
            for t, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(t or "")
                n = len(words)
                each = np.array(list(map(known[half].__getitem__, words))).reshape(n, len(LEVELS))
                total = np.concatenate((np.zeros((1, len(LEVELS))), np.cumsum(each, axis=0)))
                # the best segment ends where the running total is most above its least value so far
                for k, best in enumerate((total - np.minimum.accumulate(total, axis=0)).max(axis=0).tolist()):
                    row = cells.setdefault((k, bool(toxic), bin_of(best), int(2 * math.log2(max(n, 1)))), [0.0, 0.0, 0])
                    row[0], row[1], row[2] = row[0] + best, row[1] + math.log(max(n, 1)), row[2] + 1
        columns = list(zip(*((*key, *row) for key, row in cells.items()))) or [()] * 7
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["level", "toxic", "s", "n", "score", "tokens", "texts"])

    cells = labelled.select("text", "toxic", "half").mapInArrow(run, "level int, toxic boolean, s int, n int, score double, tokens double, texts long")
    return [tuple(r) for r in cells.groupBy("level", "toxic", "s", "n").agg(F.sum("score"), F.sum("tokens"), F.sum("texts")).orderBy("level", "toxic", "s", "n").collect()]


def _evidence_cells(labelled: DataFrame, scorers: list[Scorer]) -> dict[int, tuple[int, int]]:
    """{bin of evidence: (toxic, clean)} of labelled texts, each scored by the scorer of the other half."""

    def run(batches):
        cells: Counter = Counter()
        for batch in batches:
            for t, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                cells[bin_of(scorers[1 - half].evidence(t or "")[0]), bool(toxic)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cells], pa.int32()), pa.array([y for _, y in cells], pa.bool_()), pa.array(cells.values(), pa.int64())], ["b", "toxic", "texts"])

    rows = labelled.select("text", "toxic", "half").mapInArrow(run, "b int, toxic boolean, texts long").groupBy("b").agg(F.sum(F.when(F.col("toxic"), F.col("texts")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("texts"))).alias("c")).collect()
    return {r["b"]: (r["t"], r["c"]) for r in rows}


def calibrate(bins: dict[int, tuple[int, int]]) -> list[tuple[float, float]]:
    """Points (bin, probability) that rise, from (toxic, clean) counts by bin: adjacent violators are pooled and smoothed."""
    total = [sum(v[k] for v in bins.values()) for k in (0, 1)]
    if not total[0] or not total[1]:
        return []
    rate = total[0] / sum(total)
    pools: list[list[float]] = []  # toxic, all, sum of bins
    for b in sorted(bins):
        t, c = bins[b]
        pools.append([t, t + c, b * (t + c)])
        while len(pools) > 1 and (pools[-2][0] + rate) / (pools[-2][1] + 1) >= (pools[-1][0] + rate) / (pools[-1][1] + 1):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [(w / n, (t + rate) / (n + 1)) for t, n, w in pools]


def fit(labelled: DataFrame) -> tuple[Scorer, list[tuple[float, float]]]:
    """A scorer and the calibration points, from rows (text, toxic boolean)."""
    labelled = staged(labelled.select("text", "toxic", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(1)).cast("int").alias("half")), "toxic-labelled")
    discard()
    counts = staged(token_counts(labelled), "toxic-counts")
    # every token has one whole-word unit
    tokens_of = counts.filter("unit like '=%'").agg(*(F.coalesce(F.sum(f"t{h}{c}"), F.lit(0)).alias(f"t{h}{c}") for h in (0, 1) for c in (0, 1))).first().asDict()
    texts_of = {f"d{h}{c}": 0 for h in (0, 1) for c in (0, 1)}
    texts_of |= {f"d{r['half']}{int(r['toxic'])}": r["count"] for r in labelled.groupBy("half", "toxic").count().collect()}
    found = lexicons(counts, tokens_of | texts_of)
    if not found[2]:
        discard(labelled, counts)
        return Scorer({}), []
    best, law, level = -1.0, (1.0, 0.0), LEVELS[0]
    cells = _best_cells(labelled, found)
    for k, x in enumerate(LEVELS):
        mine = [(toxic, score / texts, math.exp(size / texts), texts) for lvl, toxic, _, _, score, size, texts in cells if lvl == k]
        lam, log_k = extreme_value([(s, n, m) for toxic, s, n, m in mine if not toxic])
        value = lambda s, n: lam * s - log_k - math.log(n) if s > 0 else -1e9  # noqa: B023, E731
        rank = ranking([(value(s, n), m * toxic, m * (not toxic)) for toxic, s, n, m in mine])
        if rank >= best:
            best, law, level = rank, (lam, log_k), x
    scorers = [Scorer(at_level(x, level), *law) for x in found]
    points = calibrate(_evidence_cells(labelled, scorers[:2]))
    discard(labelled, counts)
    return scorers[2], points


def score(docs: DataFrame, scorer: Scorer, points: list[tuple[float, float]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score (linear between the calibration points, rising a little beside them), n_passages and predicted for each row."""
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, n_passages int"
    xs, ys = ([p[k] for p in points] or [0.0] for k in (0, 1))

    def run(batches):
        for batch in batches:
            found = [scorer.evidence(t.as_py() or "") for t in batch.column(len(keep))]
            x = np.log2(1 + np.array([e for e, _ in found], float))
            at = np.where(x > 0, 1.5 + 10 * x, 0.0)
            value = np.interp(at, xs, ys) * (1 - 1e-4) + (1e-4 * (1 - np.exp2(-x)) if points else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(value, pa.float64()), pa.array([n for _, n in found], pa.int32())], [*keep, "score", "n_passages"])

    found = docs.select(*keep, text).mapInArrow(run, schema)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    marks = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("toxic") == 1).alias("toxic"))
    train = with_key_in(docs.filter("not held_out"), "doc_id", marks, "label_id")
    labelled = train.join(marks.hint("merge"), F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    scorer, points = fit(labelled)
    return score(docs, scorer, points, ("doc_id", "held_out")).select("doc_id", "held_out", "score", "predicted", "n_passages")


QUERIES = {"op1_toxic_passages": op1_toxic_passages}
ORACLE_SQL: dict[str, str] = {}
