"""Regular-expression spans: the shared primitive of all surface rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums go by blocks of so many matches, so that the work grows with the matches and not their square.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,original>> of all leftmost non-overlapping matches; offsets in code points from 0."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def place(m: Column, g: Column) -> Column:
        widths = F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x))
        return let(widths, lambda w: let(block_sums(w), lambda b: let(F.transform(b, lambda x, k: total(F.slice(b, 1, k))), lambda before: each(m, w, before))))

    def block_sums(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block(F.size(w) - 1)), lambda k: total(F.slice(w, k * BLOCK + 1, BLOCK)))

    def each(m: Column, w: Column, before: Column) -> Column:
        return F.transform(m, lambda x, i: _one(F.get(before, block(i)) + total(F.slice(w, block(i) * BLOCK + 1, i % BLOCK + 1)), x))

    def _one(stop: Column, x: Column) -> Column:
        return F.struct((stop - F.length(x)).cast("long").alias("start"), stop.cast("long").alias("stop"), x.alias("original"))

    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), let(found, lambda m: let(gaps, lambda g: place(m, g)))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,original:string>>"))


def findings(docs: DataFrame, rules: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule_id, start, stop, original, text) for all rules {rule_id: pattern} in one scan of the text."""
    def named(rule: str):
        return lambda s: F.struct(F.lit(rule).alias("rule_id"), s["start"].alias("start"), s["stop"].alias("stop"), s["original"].alias("original"))

    each = [F.transform(spans(F.col(text), p), named(r)) for r, p in rules.items()]
    return docs.filter(F.col(text).rlike("|".join(f"(?:{p})" for p in rules.values()))).select(F.col(key), F.col(text), F.inline(F.concat(*each)))


def findings_sql(source: str, rules: dict[str, str], key: str = "doc_id") -> str:
    """The same rows as SQL over ``source`` (key, text)."""
    one = """
SELECT {key}, text, '{rule}' AS rule_id,
  (list_sum(list_transform(g[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::BIGINT AS start,
  m[i+1] AS original
FROM (SELECT {key}, text, m, g, unnest(range(len(m))) AS i
      FROM (SELECT {key}, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {source} AS s)) AS e"""
    parts = [one.format(key=key, rule=r, p=p.replace("'", "''"), source=source) for r, p in rules.items()]
    return f"SELECT {key}, rule_id, start, (start + length(original))::BIGINT AS stop, original, text FROM ({' UNION ALL '.join(parts)}) AS f"
