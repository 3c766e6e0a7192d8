"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose statistic exceeds a cutoff; a text goes if any rule rejects it. Cutoffs are set per
stratum (language) from labelled rows in two folds by a hash of the id. One third proposes a sequence of cutoff sets, from
lenient to strict: for each share of good texts in STEPS, every rule takes the cutoff within that share that
rejects most bad texts for the good ones lost. The other two thirds are the holdout: the sequence is walked while the exact
(Clopper-Pearson) upper bound on the share of good texts that the whole set rejects is at most ``risk``, and
stops at the first set that fails (fixed-sequence testing, so no correction within a walk). The error level is divided by
the number of strata (Bonferroni). So with a probability of at least 1 - ``level``, in no stratum do
the rules together reject over ``risk`` of the good texts that pass the base rule. A stratum with too few
labelled good rows for any bound (about 440 in the holdout for four strata) gets no cutoff and rejects by the
fixed base rule only.

All statistics are column expressions; no Python runs on the executors. What reaches the driver are
counts by (stratum, rule, grid cell) and by (stratum, step), of at most MAX_STRATA strata.

Defined cases: null text is empty and fails the base rule; a null stratum is a stratum of its own, as is '';
a row of labels repeated for one id counts once, as good only if all say so; repeated rows all stay; an empty
table or no labels give the base rule alone; other columns of docs may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, WORD_SPLIT, discard, let, staged, table, text_column

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
RISK = 0.01
GOOD_WEIGHT = 10.0
LEVEL = 0.05
MAX_STRATA = 1000
#: Up to so many repeated windows are looked up one by one; more are found by sorting. The result is the same.
FEW_REPEATS = 64
#: Shares of good texts that each rule may lose in a proposed set of cutoffs.
STEPS = (0.0, 0.0003, 0.0006, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01)
#: Cutoffs of every rule, most lenient first; statistics are shares or rates capped at 1.
GRID = tuple(round(x / 40, 3) for x in range(38, 0, -1))
RULES = ("symbols_per_word", "repeated_lines", "repeated_words", "upper_letters", "marks_per_word")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, for an array without empty words."""
    windows = let(words, lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))))

    def union(starts: Column) -> Column:
        gain = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        return F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_sort(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        return union(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def by_lookup(h: Column, repeated: Column) -> Column:
        return union(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda i: i.isNotNull()))

    def covered(h: Column, repeated: Column) -> Column:
        none, few = F.size(repeated) == 0, F.size(repeated) <= FEW_REPEATS
        return F.when(none, F.lit(0).cast("long")).when(few, by_lookup(h, repeated)).otherwise(by_sort(h))

    def repeats(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k + 1) == x)))
        return let(again, lambda repeated: covered(h, repeated))

    return let(windows, repeats)


def statistics(text: Column) -> Column:
    """A struct of the word, symbol, line and repeat statistics of one text."""
    text = text_column(text)
    trimmed = F.trim(text, F.lit(SPACE))
    bare = text
    for blank in SPACE:
        bare = F.replace(bare, F.lit(blank), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")

    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SPLIT))
    from_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    from_lines = let(lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    parts = F.struct(
        from_words.alias("w"),
        from_lines.alias("l"),
        F.length(bare).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count("[!?]").alias("n_marks"),
        count("[A-Z]").alias("n_upper"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(F.lit(0.0))

    def flat(s: Column) -> Column:
        n = s["w"]["n_words"]
        return F.struct(
            n.alias("n_words"),
            s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * s["w"]["n_repeat_words"] > 50 * n)).alias("base_failed"),
            share(s["n_symbols"], n).alias("symbols_per_word"),
            share(s["l"]["n_dup_lines"], s["l"]["n_lines"]).alias("repeated_lines"),
            share(s["w"]["n_repeat_words"], n).alias("repeated_words"),
            share(s["n_upper"], s["word_chars"]).alias("upper_letters"),
            share(s["n_marks"], n).alias("marks_per_word"),
        )

    return let(parts, flat)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of Binomial(n, p), summed from exact log terms."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    base = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def bounded(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound at level delta on a rate with k of n hits is at most risk."""
    return n > 0 and k < n and k <= n * risk and binomial_cdf(k, n, risk) <= delta


def propose(hists: dict[str, tuple[list[int], list[int]]]) -> list[dict[str, float]]:
    """Sets of cutoffs by rule, each as strict as the one before or stricter, without repeats.

    hists has (good, bad) for each rule: how many rows exceed 0, 1, ... of the cutoffs. A rule's cutoff in a set is the one
    that rejects most bad texts for the good ones lost (GOOD_WEIGHT to one, as shares) among those that
    lose no more than the step's share of the good; the most lenient of equals; none if none is worth it.
    """
    sets: list[dict[str, float]] = []
    for share in STEPS:
        found = {}
        for rule, (good, bad) in hists.items():
            n, best = sum(good), 0.0
            for g, cutoff in enumerate(GRID):
                # a text exceeds cutoff g if it exceeds over len(GRID) - 1 - g of the cutoffs, the least being last
                lost = sum(good[len(GRID) - g :])
                if lost > share * n:
                    break
                gain = sum(bad[len(GRID) - g :]) / max(1, sum(bad)) - GOOD_WEIGHT * lost / max(1, n)
                if gain > best:
                    found[rule], best = cutoff, gain
        if found and (not sets or found != sets[-1]):
            sets.append(found)
    return sets


def certified(first: list[int], risk: float, delta: float) -> int:
    """How many sets of the sequence are certified; first[k] counts the good rows that set k is the first to reject, the last
    entry those that none rejects."""
    n, lost = sum(first), 0
    for k in range(len(first) - 1):
        lost += first[k]
        if not bounded(lost, n, risk, delta):
            return k
    return len(first) - 1


def _by_stratum(column: Column, values: dict, otherwise: Column) -> Column:
    out = otherwise
    for name, value in values.items():
        out = F.when(column.eqNullSafe(F.lit(name)), value).otherwise(out)
    return out


def _hits(stats: Column, cutoffs: dict[str, float]) -> Column:
    out = F.lit(False)
    for rule, cutoff in cutoffs.items():
        out = out | (stats[rule] > F.lit(cutoff))
    return out


def fit_cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[str | None, dict[str, float]]:
    """{stratum: {rule: cutoff}} from rows (key, stratum string, good boolean, s struct of statistics).

    Rows that the base rule fails tell nothing of the cutoffs and are left out. The counts collected are bounded by
    strata, rules, grid and steps.
    """
    used = labelled.filter("not s.base_failed").select("stratum", "good", "s", (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).alias("proposes"))
    # no bound holds with fewer good rows, at any level
    enough = math.log(level) / math.log1p(-risk)
    sizes = used.filter("not proposes and good").groupBy("stratum").count().filter(F.col("count") >= enough).limit(MAX_STRATA + 1).collect()
    if len(sizes) > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} strata")
    strata = [r["stratum"] for r in sizes]
    delta = level / max(1, len(strata))
    known = _by_stratum(F.col("stratum"), {x: F.lit(True) for x in strata}, F.lit(False))
    cell = lambda r: sum((F.col(f"s.{r}") > g).cast("int") for g in GRID)
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), cell(r).alias("over")) for r in RULES)))
    counts = used.filter(F.col("proposes") & known).select("stratum", "good", cells.alias("c")).groupBy("stratum", "good", "c.rule", "c.over").count().collect()
    hists: dict = {x: {r: ([0] * (len(GRID) + 1), [0] * (len(GRID) + 1)) for r in RULES} for x in strata}
    for r in counts:
        hists[r["stratum"]][r["rule"]][0 if r["good"] else 1][r["over"]] += r["count"]
    sets = {x: propose(h) for x, h in hists.items()}
    step = _by_stratum(F.col("stratum"), {x: sum(((~_hits(F.col("s"), c)).cast("int") for c in found), F.lit(0)) for x, found in sets.items() if found}, F.lit(None))
    first = used.filter(~F.col("proposes") & F.col("good")).select("stratum", step.cast("int").alias("step")).filter("step is not null").groupBy("stratum", "step").count().collect()
    chosen = {}
    for x, found in sets.items():
        tally = [0] * (len(found) + 1)
        for r in first:
            if r["stratum"] == x:
                tally[r["step"]] += r["count"]
        k = certified(tally, risk, delta) if found else 0
        if k:
            chosen[x] = found[k - 1]
    return chosen


def rejected(stats: Column, stratum: Column, cutoffs: dict[str | None, dict[str, float]]) -> Column:
    """Whether any risk-controlled rule of its stratum rejects a row."""
    return _by_stratum(stratum.cast("string"), {x: _hits(stats, c) for x, c in cutoffs.items()}, F.lit(False))


def good_ids(labels: DataFrame) -> DataFrame:
    """(label_id, good), one row an id: good only if every label of it is 1; null labels don't count."""
    return labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 1).alias("good"))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, s) of each row, written to the shared folder: narrow rows to join labels to."""
    return staged(docs.select(F.col(key).alias("key"), F.col(stratum).cast("string").alias("stratum"), statistics(F.col(text)).alias("s")), "quality")


def cutoffs_of(rows: DataFrame, labels: DataFrame) -> dict[str | None, dict[str, float]]:
    return fit_cutoffs(staged(rows.join(good_ids(labels), F.col("key") == F.col("label_id")).select("key", "stratum", "good", "s"), "quality-labelled"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = described(table(spark, sf_dir, "documents"))
    cutoffs = cutoffs_of(rows, table(spark, sf_dir, "labels"))
    kept = ~F.col("s.base_failed") & ~rejected(F.col("s"), F.col("stratum"), cutoffs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rows.select(F.col("key").alias("doc_id"), *(F.col(f"s.{n}").alias(n) for n in names), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) that the base rule and the cutoffs keep, all columns."""
    rows = described(docs)
    cutoffs = cutoffs_of(rows, labels)
    discard(rows)
    verdict = let(statistics(F.col("text")), lambda s: ~s["base_failed"] & ~rejected(s, F.col("lang"), cutoffs))
    return docs.filter(verdict)


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {}
