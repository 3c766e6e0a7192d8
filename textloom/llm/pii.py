"""Personal data by candidate spans and gradient boosting, in column expressions only.

High-recall generators propose spans that may overlap: the base patterns (email, ip, card, phone) and
wider ones (addresses with "(at)" and "[dot]", bracketed dots, card groups with other separators,
phone numbers without a plus sign). A gradient-boosted ensemble of depth-two trees scores each candidate by
format and context features. It learns from three kinds of rows: base candidates, labelled by their check; base spans of the
corpus rewritten in a disguise inside their own context (planted), which are positive; and wide candidates as they occur,
positive where they overlap a base span that passes, else negative. A wide candidate's own check is a feature only.
The features are small numbers, so training needs only their counts (at most MAX_CELLS rows, whatever the corpus's
size). Per kind, the threshold is the lowest score at which, on the half of the spans (by a hash) that the trees
did not see, PRECISION of the planted and free wide candidates above it are planted; free ones as they occur count as false,
so precision is understated where they are real. A kind without such a score adds nothing. Base spans that pass
their check always stay; the model adds wide ones that overlap none.

No Python runs on the executors. The patterns use possessive repeats, so the matcher neither recurses
nor backtracks over long runs. redact() looks for candidates twice (to learn, and to rewrite): storing them beside the
texts between would leave a copy of the corpus behind.

Defined cases: null text is empty and has no spans; a corpus without spans adds none; repeated rows each give a row;
texts of any length are read whole. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, let, staged, table, text_column

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?i:dot)[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:[\[(]\.[\])][0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00 ?)?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
WIDE_NEEDS = {"email": r"[\[(](?i:at)[\])]", "ip": r"[\[(]\.[\])]", "card": r"[0-9]{4}[ ._/-]", "phone": r"[0-9][ .-][0-9]"}
CONTEXT = r"(?i)(?:mail|tel|phone|call|fax|fon|card|visa|iban|ip|host|contact|address)[^A-Za-z0-9]*$"
CONTEXT_CHARS = 24
MAX_CELLS = 100_000
ROUNDS, RATE, RIDGE = 24, 0.4, 1.0
PRECISION = 0.9
BLOCK = 256

SPAN = "struct<kind:int,start:int,stop:int,wide:int,passes:boolean,f:struct<digits:int,valid:int,plus:int,paren:int,seps:int,context:int,around:int,joined:int>,fold:int>"
FEATURES = {"kind": range(1, 4), "wide": (1,), "digits": range(1, 21), "valid": (1,), "plus": (1,), "paren": (1,), "seps": range(1, 6), "context": (1,), "around": range(1, 6), "joined": (1,)}


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an int array, by blocks, so that the work is about n * BLOCK."""
    add = lambda a, x: a + x
    zero = F.lit(0)

    def small(v: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(F.slice(v, 1, i + 1), zero, add))

    def large(v: Column) -> Column:
        n = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(zero, n), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), zero, add))
        return let(
            sums,
            lambda s: F.transform(
                v,
                lambda _, i: F.aggregate(F.slice(s, 1, F.floor(i / BLOCK).cast("int")), zero, add)
                + F.aggregate(F.slice(v, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK + 1).cast("int")), zero, add),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, small(v)).otherwise(large(v)))


def matched(text: Column, pattern: str) -> Column:
    """Array of struct(start, stop, m) of all leftmost non-overlapping matches; offsets in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return let(
        found,
        lambda m: let(
            gaps,
            lambda g: let(
                prefix_sums(F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))),
                lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("stop"), x.alias("m"))),
            ),
        ),
    )


def passes(kind: str, m: Column) -> tuple[Column, Column]:
    """(whether a match passes its kind's check, whether its checksum or parts are right whatever its length)."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        right = F.coalesce(F.when(n <= 40, F.call_function("luhn_check", digits)), F.lit(False))
        return right & n.between(12, 19), right
    if kind == "ip":
        right = ~F.exists(F.split(F.regexp_replace(m, r"[\[\]()]", ""), r"\."), lambda x: ~x.rlike(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
        return right, right
    if kind == "phone":
        return n.between(9, 15), n.between(9, 15)
    return F.lit(True), m.rlike(r"[A-Za-z]{2,}\z")


def _spans(text: Column, kind: str, wide: bool) -> Column:
    k = KINDS.index(kind)

    def one(x: Column) -> Column:
        m = x["m"]
        passed, right = passes(kind, m)
        before = F.substring(text, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT_CHARS)))
        after = F.substring(text, x["stop"] + 1, F.lit(CONTEXT_CHARS))
        near = F.length(F.regexp_replace(F.concat(before, after), "[^0-9]", ""))
        features = F.struct(
            F.least(F.length(F.regexp_replace(m, "[^0-9]", "")), F.lit(20)).cast("int").alias("digits"),
            right.cast("int").alias("valid"),
            m.startswith("+").cast("int").alias("plus"),
            m.contains("(").cast("int").alias("paren"),
            F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9+]", "")), F.lit(5)).cast("int").alias("seps"),
            before.rlike(CONTEXT).cast("int").alias("context"),
            F.least(F.ceil(near / 4), F.lit(5)).cast("int").alias("around"),
            (before.rlike(r"[A-Za-z0-9_/=-]\z") | after.rlike(r"\A[A-Za-z0-9_/=-]")).cast("int").alias("joined"),
        )
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(int(wide)).alias("wide"), passed.alias("passes"), features.alias("f"), (F.crc32(m) % 2).cast("int").alias("fold"))

    pattern, needs = (WIDE if wide else BASE)[kind], (WIDE_NEEDS if wide else NEEDS)[kind]
    return F.when(text.rlike(needs), F.transform(matched(text, pattern), one)).otherwise(F.array()).cast(f"array<{SPAN}>")


def candidates(text: Column) -> Column:
    """All candidate spans of one text, base and wide, as an array of SPAN."""
    return let(text_column(text), lambda t: F.concat(*(_spans(t, k, w) for w in (False, True) for k in KINDS)))


def disguised(m: Column, kind: Column) -> Column:
    """A base span in one of three other spellings, by its hash."""
    way = F.crc32(F.concat(m, F.lit("#"))) % 3
    pick = lambda a, b, c: F.when(way == 0, a).when(way == 1, b).otherwise(c)
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    dots = lambda x: F.replace(domain, F.lit("."), F.lit(x))
    email = pick(F.concat(local, F.lit(" (at) "), domain), F.concat(local, F.lit("[at]"), dots("[dot]")), F.concat(local, F.lit(" [AT] "), dots(" (dot) ")))
    digits = F.regexp_replace(m, "[^0-9]", "")
    group = lambda sep: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    ip = pick(F.replace(m, F.lit("."), F.lit("[.]")), F.replace(m, F.lit("."), F.lit("(.)")), F.replace(m, F.lit("."), F.lit("[.]")))
    phone = pick(F.regexp_replace(m, r"\A\+", "00"), F.regexp_replace(m, r"\A\+", "00 "), F.regexp_replace(m, r"\A\+[0-9]{1,3}[ .-]?", ""))
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, pick(group("."), group("/"), group("_"))).otherwise(phone)


def planted(text: Column, spans: Column) -> Column:
    """For each base span that passes: its context with the span disguised, where that stands, its kind and fold."""
    t = text_column(text)

    def one(s: Column) -> Column:
        before = F.substring(t, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS)))
        new = disguised(F.substring(t, s["start"] + 1, s["stop"] - s["start"]), s["kind"])
        snippet = F.concat(before, new, F.substring(t, s["stop"] + 1, F.lit(CONTEXT_CHARS)))
        return F.struct(snippet.alias("snippet"), F.length(before).alias("start"), (F.length(before) + F.length(new)).alias("stop"), s["kind"].alias("kind"), s["fold"].alias("fold"))

    return F.transform(F.filter(spans, lambda s: (s["wide"] == 0) & s["passes"]), one)


def described(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """``keep``, all candidate spans of each row and the planted ones, written to the shared folder."""
    found = docs.select(*keep, let(candidates(F.col(text)), lambda c: F.struct(c.alias("spans"), planted(F.col(text), c).alias("plants"))).alias("_f"))
    return staged(found.select(*keep, "_f.spans", "_f.plants"), "pii")


class Boosted:
    """Newton-boosted trees of depth two over small-number features, fitted to counts."""

    def __init__(self, cells: list[tuple[dict[str, int], bool, int]]) -> None:
        pos, neg = sum(n for _, y, n in cells if y), sum(n for _, y, n in cells if not y)
        self.start = math.log((pos + 1) / (neg + 1))
        self.trees: list[tuple] = []
        scores = [self.start] * len(cells)
        for _ in range(ROUNDS if pos and neg else 0):
            p = [1 / (1 + math.exp(-s)) for s in scores]
            grad = [n * (y - q) for (_, y, n), q in zip(cells, p)]
            hess = [n * q * (1 - q) for (_, _, n), q in zip(cells, p)]
            tree = self._grow(cells, grad, hess, list(range(len(cells))), 2)
            self.trees.append(tree)
            scores = [s + self._leaf(tree, x) for s, (x, _, _) in zip(scores, cells)]

    def _grow(self, cells, grad, hess, rows, depth):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        best = None
        for name, cuts in FEATURES.items() if depth else ():
            for cut in cuts:
                left = [i for i in rows if cells[i][0][name] < cut]
                if not left or len(left) == len(rows):
                    continue
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, name, cut
        if best is None or best[0] <= 1e-9:
            return RATE * g / (h + RIDGE)
        _, name, cut = best
        sides = [[i for i in rows if (cells[i][0][name] < cut) == left] for left in (True, False)]
        return name, cut, *(self._grow(cells, grad, hess, side, depth - 1) for side in sides)

    def _leaf(self, tree, x: dict[str, int]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
        return tree

    def value(self, x: dict[str, int]) -> float:
        return reduce(lambda a, t: a + self._leaf(t, x), self.trees, self.start)  # in the order of column()

    def column(self, feature: Callable[[str], Column]) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(feature(tree[0]) < tree[1], of(tree[2])).otherwise(of(tree[3]))

        return reduce(lambda a, t: a + of(t), self.trees, F.lit(float(self.start)))


def apart(s: Column, o: Column) -> Column:
    return (s["stop"] <= o["start"]) | (o["stop"] <= s["start"])


def examples(found: DataFrame) -> DataFrame:
    """(features, label, fold, free) of all candidates of rows (spans, plants); free ones are wide and overlap no base span."""
    names = [n for n in FEATURES if n not in ("kind", "wide")]

    def labelled(spans: Column) -> Column:
        base = F.filter(spans, lambda s: (s["wide"] == 0) & s["passes"])
        return let(base, lambda b: F.transform(spans, lambda s: F.struct(s.alias("s"), F.when(s["wide"] == 0, s["passes"]).otherwise(F.exists(b, lambda o: ~apart(s, o))).alias("label"))))

    flat = [F.col("e.s.kind"), F.col("e.s.wide"), *(F.col(f"e.s.f.{n}") for n in names), F.col("e.label")]
    natural = found.filter("size(spans) > 0").select(F.explode(labelled(F.col("spans"))).alias("e"))
    natural = natural.select(*flat, F.col("e.s.fold"), ((F.col("e.s.wide") == 1) & ~F.col("e.label")).alias("free"))
    plants = found.filter("size(plants) > 0").select(F.explode("plants").alias("p"))
    hits = F.filter(candidates(F.col("p.snippet")), lambda s: (s["wide"] == 1) & (s["kind"] == F.col("p.kind")) & ~apart(s, F.col("p")))
    made = plants.select("p.fold", F.explode(hits).alias("s")).select(F.struct("s", F.lit(True).alias("label")).alias("e"), "fold")
    return natural.unionByName(made.select(*flat, "fold", F.lit(True).alias("free")))


def fit(found: DataFrame) -> tuple[Boosted, dict[str, float]]:
    """The ensemble and the threshold of each kind that has one, from rows (spans, plants)."""
    one = examples(found)
    rows = one.groupBy(*one.columns).count().limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("more feature cells than the features allow")
    of = lambda keep: [({f: r[f] for f in FEATURES}, r["label"], r["count"]) for r in sorted(rows) if keep(r)]
    model, thresholds = Boosted(of(lambda r: r["fold"] == 0)), {}
    for k, kind in enumerate(KINDS):
        seen = sorted(((model.value(x), y, n) for x, y, n in of(lambda r: r["fold"] == 1 and r["free"] and r["kind"] == k)), key=lambda v: -v[0])
        hits = total = 0
        for i, (value, y, n) in enumerate(seen):
            hits, total = hits + n * y, total + n
            if (i + 1 == len(seen) or seen[i + 1][0] < value) and hits >= PRECISION * total:
                thresholds[kind] = value
    return model, thresholds


def selected(spans: Column, model: Boosted, thresholds: dict[str, float]) -> Column:
    """The spans that stay: base ones that pass, and wide ones the model takes that overlap no other."""
    base = F.filter(spans, lambda s: (s["wide"] == 0) & s["passes"])

    def takes(s: Column) -> Column:
        value = model.column(lambda f: s[f] if f in ("kind", "wide") else s["f"][f])
        least = reduce(lambda a, k: F.when(s["kind"] == KINDS.index(k), F.lit(thresholds[k])).otherwise(a), thresholds, F.lit(float("inf")))
        return (s["wide"] == 1) & (value >= least)

    def join(b: Column) -> Column:
        free = F.filter(spans, lambda s: takes(s) & ~F.exists(b, lambda o: ~apart(s, o)))
        first = let(free, lambda w: F.filter(w, lambda s: ~F.exists(w, lambda o: (o["kind"] < s["kind"]) & ~apart(s, o))))
        return F.concat(b, first)

    return let(base, join)


def in_order(spans: Column) -> Column:
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))


def listing(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        merge = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] > s["start"]), merge).otherwise(F.concat(done, F.array(s)))

    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(u: Column) -> Column:
        before = lambda i: F.coalesce(F.get(u, i - 1)["stop"], F.lit(0))
        parts = F.transform(u, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.get(names, s["kind"])))
        end = F.element_at(u, -1)["stop"]
        return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))

    merged = F.aggregate(in_order(spans), empty, add)
    return F.when(F.size(spans) == 0, text).otherwise(let(merged, cut))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in ``text`` replaced; all other columns stay. Null texts stay null."""
    found = described(docs, text)
    model, thresholds = fit(found)
    discard(found)
    new = let(candidates(F.col(text)), lambda c: F.when(F.size(c) == 0, F.col(text)).otherwise(let(selected(c, model, thresholds), lambda s: redacted(F.col(text), s))))
    return docs.withColumn(text, new)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = described(docs, "text", "doc_id")
    model, thresholds = fit(found)
    base = F.filter("spans", lambda s: (s["wide"] == 0) & s["passes"])
    count = lambda k: F.size(F.filter("spans", lambda s: (s["wide"] == 0) & s["passes"] & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(listing(base), 256).alias("base_sha256"), listing(selected(F.col("spans"), model, thresholds)).alias("spans"))


QUERIES = {"op9_personal_data": op9_personal_data}
ORACLE_SQL: dict[str, str] = {}
