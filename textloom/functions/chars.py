"""Character classes of the Khmer block as regular expressions that Java and RE2 read alike, and digit maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the Unicode Khmer block.
CONSONANT = r"[\x{1780}-\x{17A2}]"
INDEPENDENT_VOWEL = r"[\x{17A3}-\x{17B3}]"
BASE = r"[\x{1780}-\x{17B3}]"
VOWEL = r"[\x{17B6}-\x{17C5}]"
SHIFTER = r"[\x{17C9}\x{17CA}]"
ROBAT = r"\x{17CC}"
SIGN = r"[\x{17C6}-\x{17C8}\x{17CB}\x{17CD}-\x{17D1}\x{17D3}\x{17DD}]"
COENG = r"\x{17D2}"
MARK = r"[\x{17B4}-\x{17D3}\x{17DD}]"
LETTER_OR_MARK = r"[\x{1780}-\x{17D3}\x{17DD}]"
KHMER_DIGIT = r"[\x{17E0}-\x{17E9}]"
KHMER = r"[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
ARABIC_DIGITS, KHMER_DIGITS = "0123456789", "០១២៣៤៥៦៧៨៩"
PREDICATES = {"consonant": CONSONANT, "independent_vowel": INDEPENDENT_VOWEL, "base": BASE, "vowel": VOWEL, "shifter": SHIFTER, "robat": ROBAT, "sign": SIGN, "letter_or_mark": LETTER_OR_MARK, "khmer_digit": KHMER_DIGIT, "khmer": KHMER}


def has(text: Column, kind: str) -> Column:
    return text.rlike(PREDICATES[kind])


def to_khmer_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, KHMER_DIGITS)


def to_arabic_digits(text: Column) -> Column:
    return F.translate(text, KHMER_DIGITS, ARABIC_DIGITS)
