"""Cluster normalisation as array expressions: marks of a syllable in one order, doubles removed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import chars

CLUSTER = rf"{chars.BASE}(?:{chars.COENG}{chars.BASE}|[\x{{17B4}}-\x{{17D1}}\x{{17D3}}\x{{17DD}}\x{{200C}}\x{{200D}}]|{chars.COENG})*|[\x{{17B4}}-\x{{17D3}}\x{{17DD}}]+"
UNIT = rf"{chars.COENG}{chars.BASE}|(?s:.)"
RO = "្រ"
#: Deprecated letters and their replacements.
DEPRECATED = {"ឣ": "អ", "ឤ": "អា", "ឨ": "ឧក", "៓": "ំ", "៘": "។ល។"}


def units(text: Column) -> Column:
    """A subscript sign with its letter is one unit; else each character."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def clusters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0))


def replace_deprecated(text: Column) -> Column:
    for old, new in DEPRECATED.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: Classes of marks in storage order; those after the first lose repeated marks.
ORDER = (chars.ROBAT, rf"{chars.COENG}(?!{RO[1]}){chars.BASE}", RO, chars.SHIFTER, chars.VOWEL, chars.SIGN)


def normalize_cluster(cluster: Column) -> Column:
    """Base, robat, subscripts, subscript RO, shifters, vowels (joined), signs, and what is none of these as it comes.

    Deprecated letters are replaced first; only the first letter is the base.
    """
    parts = units(F.regexp_replace(replace_deprecated(cluster), r"[\x{17B4}\x{17B5}\x{200C}\x{200D}]", ""))

    def arranged(p: Column) -> Column:
        base = F.coalesce(F.get(p, F.lit(0)), F.lit("")).rlike(rf"\A{chars.BASE}\z")
        rest = F.when(base, F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))).otherwise(p)
        only = lambda c: F.filter(rest, lambda u: u.rlike(rf"\A{c}\z"))
        picks = [only(c) for c in ORDER]
        texts = [F.array_join(x if k == 0 else F.array_distinct(x), "") for k, x in enumerate(picks)]
        texts[4] = F.replace(F.replace(texts[4], F.lit("េី"), F.lit("ើ")), F.lit("េា"), F.lit("ោ"))
        others = F.array_join(F.filter(rest, lambda u: ~u.rlike(rf"\A(?:{'|'.join(ORDER)})\z")), "")
        return F.concat(F.when(base, F.get(p, F.lit(0))).otherwise(""), *texts, others)

    return F.element_at(F.transform(F.array(parts), arranged), 1)


_PLAIN = [re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", c)) for c in ORDER]
_UNIT = re.compile("្[ក-ឳ]|.", re.S)
CLUSTERS = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", CLUSTER))


def normalized(cluster: str) -> str:
    """normalize_cluster for one string."""
    for old, new in DEPRECATED.items():
        cluster = cluster.replace(old, new)
    parts = _UNIT.findall(re.sub("[\u17b4\u17b5\u200c\u200d]", "", cluster))
    base = parts.pop(0) if parts and "ក" <= parts[0] <= "ឳ" else ""
    ranked = sorted(((next((k for k, c in enumerate(_PLAIN) if c.fullmatch(u)), len(ORDER)), i, u) for i, u in enumerate(parts)), key=lambda x: x[:2])
    groups: list[list[str]] = [[] for _ in range(len(ORDER) + 1)]
    for k, _, u in ranked:
        if k in (0, len(ORDER)) or u not in groups[k]:
            groups[k].append(u)
    texts = ["".join(g) for g in groups]
    texts[4] = texts[4].replace("េី", "ើ").replace("េា", "ោ")
    return base + "".join(texts)


def key_of(word: str) -> str:
    """word_key for one string."""
    return CLUSTERS.sub(lambda m: normalized(m[0]), re.sub("[\u200b-\u200d\u2060\ufeff]", "", word).replace("៘", "។ល។"))


def fold_of(word: str) -> str:
    return key_of(word).replace("្ដ", "្ត").replace("ឲ", "ឱ")


def word_key(text: Column) -> Column:
    """The text with every cluster in storage order, without zero-width characters."""
    bare = F.replace(F.regexp_replace(text, chars.ZERO_WIDTH, ""), F.lit("៘"), F.lit("។ល។"))
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit(rf"{CLUSTER}|(?s:.)"), F.lit(0)), lambda c: F.when(c.rlike(rf"\A{chars.LETTER_OR_MARK}"), normalize_cluster(c)).otherwise(c)), "")


#: Why a cluster changes, in order; the first five by pattern, the last where none applies.
REASONS = {
    "deprecated": r"[\x{17A3}\x{17A4}\x{17A8}\x{17D3}\x{17D8}]",
    "inherent-vowel": r"[\x{17B4}\x{17B5}]",
    "zero-width": r"[\x{200C}\x{200D}]",
    "split-vowel": r"\x{17C1}[\x{17B6}\x{17B8}]",
    "doubled-mark": "|".join(f"{c}{c}" for c in map(chr, range(0x17B6, 0x17D2))),
}


def describe(cluster: Column) -> Column:
    """Names of the reasons why a cluster is not in storage order; 'order' if none of the others."""
    found = F.filter(F.array(*(F.when(cluster.rlike(p), F.lit(name)) for name, p in REASONS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("order")))


def fold_key(text: Column) -> Column:
    """Word key with spelling variants folded: subscript DA to TA, one form of the vowel O."""
    return F.replace(F.replace(word_key(text), F.lit("្ដ"), F.lit("្ត")), F.lit("ឲ"), F.lit("ឱ"))
