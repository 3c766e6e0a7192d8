"""Sentences as rows of words: the table that the dictionary-based rules read.

One Arrow pass cuts each text into chunks, segments its Khmer runs by least cost over the lexicon, and groups the tokens into
sentences. Rules are then expressions over the array of words of a row; nothing is shuffled. Offsets are code points.
The lexicon and the phrases are held whole by every task, up to MAX_LEXICON rows (an error beyond).
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from textloom.functions import normalize, tokens
from textloom.operators.lexicon import AUTHORITATIVE, MISSPELLING

WORD = "struct<key:string,text:string,start:bigint,stop:bigint,known:boolean,wrong:boolean,clusters:int,f:int,n:int,p:int,gap:string,next:string,joined:boolean>"
NUMBER = "struct<text:string,start:bigint,stop:bigint,before:string,after:string,after_kind:string>"
SENTENCE = f"sent bigint, start bigint, stop bigint, text string, terminator string, words array<{WORD}>, numbers array<{NUMBER}>, phrases array<struct<id:int,i:int,j:int>>"
# What ends a sentence besides a line end.
TERMINATORS = frozenset("។៕?!៖")


def _python(pattern: str) -> str:
    return re.sub(r"\\u\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)


_CHUNK = re.compile(_python("|".join(f"(?P<{k}>{p})" for k, p in tokens.KINDS.items()).replace("\\x{", "\\u{").replace("(?s:.)", "[\\s\\S]")))


def lexicon_rows(lexicon: DataFrame) -> dict[str, tuple[int, int, int]]:
    rows = lexicon.select("key", "f", "n", "p").limit(tokens.MAX_LEXICON + 1).collect()
    if len(rows) > tokens.MAX_LEXICON:
        raise ValueError(f"over {tokens.MAX_LEXICON} lexicon rows")
    return {r["key"]: (r["f"], r["n"] or 0, r["p"] or 0) for r in rows}


def tokenized(text: str, entries: dict, costs: dict[str, float]) -> list[tuple]:
    """(kind, start, stop, key, clusters) of all tokens; kinds of Khmer runs are word, misspelled and unknown."""
    out = []
    for m in _CHUNK.finditer(text):
        if m.lastgroup != "khmer":
            out.append((m.lastgroup, m.start(), m.end(), "", 0))
            continue
        raw = normalize.CLUSTERS.findall(m[0])
        keys, at = [normalize.normalized(c) for c in raw], m.start()
        for i, j, known in tokens.cheapest(keys, costs):
            size = sum(map(len, raw[i:j]))
            key = "".join(keys[i:j])
            kind = "unknown" if not known else "misspelled" if entries[key][0] == MISSPELLING else "word"
            out.append((kind, at, at + size, key, j - i))
            at += size
    return out


def costs_of(entries: dict) -> dict[str, float]:
    return {k: tokens.word_cost(bool(f & AUTHORITATIVE), f == MISSPELLING, n) for k, (f, n, _) in entries.items()}


class Phrases:
    """Phrases found at word borders: their key is the joined keys of consecutive words."""

    def __init__(self, keys: list[str]) -> None:
        self.ids = defaultdict(list)
        self.starts = {k[:n] for k in keys for n in range(1, len(k) + 1)}
        for n, k in enumerate(keys):
            if k:
                self.ids[k].append(n)

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        out = []
        for i in range(len(words)) if self.ids else ():
            joined = ""
            for j in range(i, len(words)):
                joined += words[j]
                if joined not in self.starts:
                    break
                out += [(n, i, j) for n in self.ids.get(joined, ())]
        return out


def _sentence(text: str, part: list[tuple], after: str | None, entries: dict, phrases: Phrases) -> tuple | None:
    spoken = [k for k, t in enumerate(part) if t[0] in ("word", "misspelled", "unknown")]
    if not spoken:
        return None
    words, end = [], None
    for k in spoken:
        kind, start, stop, key, clusters = part[k]
        f, n, p = entries.get(key, (0, 0, 0)) if kind != "unknown" else (0, 0, 0)
        following = part[k + 1][0] if k + 1 < len(part) else after
        words.append((key, text[start:stop], start, stop, kind == "word", kind == "misspelled", clusters, f, n, p, "" if end is None else text[end:start], following, end == start))
        end = stop
    numbers = []
    for k, t in enumerate(part):
        if t[0] == "number":
            i, j = k - 1, k + 1
            while i >= 0 and (part[i][0] in ("space", "zwsp") or part[i][3] == "ចំនួន"):
                i -= 1
            while j < len(part) and part[j][0] in ("space", "zwsp"):
                j += 1
            last = part[j] if j < len(part) else None
            numbers.append((text[t[1] : t[2]], t[1], t[2], part[i][3] if i >= 0 else "", (last[3] or text[last[1] : last[2]]) if last else "", last[0] if last else ""))
    final = part[-1]
    terminator = text[final[1] : final[2]] if final[0] == "punct" and text[final[1] : final[2]] in TERMINATORS else None
    return part[0][1], final[2], text[part[0][1] : final[2]], terminator, words, numbers, phrases.find([w[0] for w in words])


def analysed(docs: DataFrame, lexicon: DataFrame, phrases: list[str] = ()) -> DataFrame:
    """(doc_id, sent, start, stop, text, terminator, words, numbers, phrases) of every sentence with a word.

    terminator is null at a line's or text's end. Of a word: gap is what stands between it and the word before, next the
    kind of the token right after it, joined whether it touches the word before. phrases has (id, first and last word) of
    each of the given phrases (their place in the list).
    """
    spark = docs.sparkSession
    entries = lexicon_rows(lexicon)
    shared = spark.sparkContext.broadcast((entries, costs_of(entries), Phrases([normalize.key_of(p) for p in phrases])))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SENTENCE}"
    target = to_arrow_schema(_parse_datatype_string(schema))
    names = {"words": [x.split(":")[0] for x in WORD[7:-1].split(",")], "numbers": [x.split(":")[0] for x in NUMBER[7:-1].split(",")], "phrases": ["id", "i", "j"]}

    def batch_of(rows):
        columns = []
        for at, field in enumerate(target):
            values = [r[at] for r in rows]
            if field.name in names:
                values = [[dict(zip(names[field.name], x)) for x in v] for v in values]
            columns.append(pa.array(values, field.type))
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches):
        known, costs, found = shared.value
        rows = []
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                sent, part = 0, []
                every = tokenized(text or "", known, costs)
                for k, t in enumerate([*every, ("newline", 0, 0, "", 0)]):
                    ends = t[0] == "newline"
                    if not ends:
                        part.append(t)
                        ends = t[0] == "punct" and text[t[1] : t[2]] in TERMINATORS
                    if ends and part:
                        after = every[k + 1][0] if t[0] == "punct" and k + 1 < len(every) else t[0]
                        row = _sentence(text, part, after, known, found)
                        if row:
                            rows.append((doc, sent, *row))
                            sent += 1
                        part = []
                if len(rows) > 2000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bigrams(sentences: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n) of neighbouring known words of analysed sentences, ``least`` times or more."""
    pairs = F.filter(F.transform("words", lambda w, i: F.struct(F.get("words", i - 1)["key"].alias("a"), w["key"].alias("b"))), lambda x: x["a"].isNotNull())
    return sentences.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def unigrams(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode("words.key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
