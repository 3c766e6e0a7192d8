"""What a correction must not change, repair of visually ordered text, and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import chars
from textloom.functions.normalize import word_key

#: Markers of meaning by class.
MARKERS = {
    "NEG": ("មិន", "ពុំ", "គ្មាន", "កុំ", "អត់", "ទេ", "ហាម", "ហាមឃាត់", "មិនអាច", "មិនត្រូវ"),
    "OBLIGE": ("ត្រូវ", "ត្រូវតែ", "ចាំបាច់", "កាតព្វកិច្ច"),
    "PERMIT": ("អាច", "សិទ្ធិ", "អនុញ្ញាត", "គួរ"),
    "AND": ("និង", "ព្រមទាំង"),
    "OR": ("ឬ", "ឬក៏"),
    "FUTURE": ("នឹង",),
    "PAST": ("បាន",),
}
#: Vowels drawn before their consonant, and the subscript RO.
PREBASE = rf"(^|[^\x{{1780}}-\x{{17D3}}])([\x{{17C1}}-\x{{17C3}}])({chars.CONSONANT}(?:{chars.COENG}{chars.CONSONANT})*)"
RO_FIRST = rf"(^|[^\x{{1780}}-\x{{17D3}}])(\x{{17D2}}\x{{179A}})({chars.CONSONANT})((?:{chars.COENG}{chars.CONSONANT})?)"


def meaning_signature(text: Column) -> Column:
    """Sorted markers, numbers and quotations, comma-joined: equal for texts that say the same of them."""
    longest = sorted((w for words in MARKERS.values() for w in words), key=len, reverse=True)
    marks = F.transform(F.regexp_extract_all(word_key(text), F.lit("|".join(longest)), F.lit(0)), _class)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9\x{17E0}-\x{17E9}]+"), F.lit(0)), lambda x: F.concat(F.lit("#"), chars.to_arabic_digits(x)))
    quotes = F.transform(F.regexp_extract_all(text, F.lit("«[^»]*»"), F.lit(0)), lambda x: F.concat(F.lit("Q"), x))
    return F.array_join(F.array_sort(F.concat(marks, numbers, quotes)), ",")


def _class(marker: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in MARKERS.items():
        out = F.when(marker.isin(*words), name).otherwise(out)
    return out


def visual_order_score(text: Column) -> Column:
    """Syllables that start with a mark drawn first, to a tenth of the Khmer characters (at least 1)."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (count(PREBASE) + count(RO_FIRST)) / F.greatest(F.lit(1.0), count(r"[\x{1780}-\x{17FF}]") / 10)


def repair_visual_order(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, PREBASE, "$1$3$2"), RO_FIRST, "$1$3$2$4")


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def csv_cell(value: Column) -> Column:
    """A quoted cell: quotes doubled, line ends as spaces, null empty."""
    text = F.regexp_replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), r"\r?\n", " ")
    return F.concat(F.lit('"'), text, F.lit('"'))
