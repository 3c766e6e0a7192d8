"""Weighted edit distance between words in units (a letter, or a subscript sign with its letter), and blocking keys for it.

Plain Python on short lists: it runs inside Arrow batches over distinct pairs that the blocking keys leave.
"""

from __future__ import annotations

import math
import zlib

COENG = "្"

# Costs of confusing the members of a group with one another.
CONFUSED = (
    (0.2, ("្ត", "្ដ")), (0.2, ("ឲ", "ឱ")),
    (0.5, ("ិ", "ី")), (0.5, ("ឹ", "ឺ")), (0.5, ("ុ", "ូ")), (0.5, ("ួ", "ូ")),
    (0.5, ("េ", "ែ")), (0.5, ("ែ", "ៃ")), (0.5, ("ោ", "ៅ")), (0.5, ("ៀ", "ឿ")), (0.5, ("ើ", "ឿ")),
    (0.5, ("់", "័", "៍", "៏", "៌", "៎")), (0.5, ("៉", "៊")), (0.5, ("ះ", "ៈ")),
    (0.6, ("ក", "គ")), (0.6, ("ខ", "ឃ")), (0.6, ("ច", "ជ")), (0.6, ("ឆ", "ឈ")), (0.6, ("ដ", "ឌ")),
    (0.6, ("ថ", "ធ", "ឋ", "ឍ")), (0.6, ("ណ", "ន")), (0.6, ("ត", "ទ")), (0.6, ("ប", "ព")), (0.6, ("ផ", "ភ")),
    (0.6, ("ល", "ឡ")), (0.6, ("ស", "ឝ", "ឞ")), (0.6, ("ញ", "ង")), (0.6, ("អ", "ឣ")),
)
SMALL_MARKS = frozenset("់័៍៏៌៎៉៊ំះ៑")
SWAP, OWN_SUBSCRIPT, SMALL, SUBSCRIPT = 0.5, 0.8, 0.7, 0.8
#: The least cost of adding or dropping a unit, and of any other edit.
LEAST_INDEL = 0.7


def _is_base(c: str) -> bool:
    return "ក" <= c <= "ឳ"


def _pairs() -> dict[tuple[str, str], float]:
    out = {}
    for cost, group in CONFUSED:
        for a in group:
            for b in group:
                if a != b:
                    out[a, b] = cost
                    if len(a) == len(b) == 1 and _is_base(a) and _is_base(b):
                        out[COENG + a, COENG + b] = cost
    return out


SUBSTITUTE = _pairs()
#: The group that each letter or mark belongs to; a later group wins.
GROUP = {member: f"g{n}" for n, (_, group) in enumerate(CONFUSED) for member in group}
FIRST_GROUP = {member: f"g{n}" for n, (_, group) in reversed(list(enumerate(CONFUSED))) for member in group if len(member) == 1 and _is_base(member)}


def units_of(word: str) -> list[str]:
    out: list[str] = []
    for c in word:
        if out and out[-1] == COENG and _is_base(c):
            out[-1] += c
        else:
            out.append(c)
    return out


def substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    found = SUBSTITUTE.get((a, b))
    if found is not None:
        return found
    return OWN_SUBSCRIPT if COENG + a == b or COENG + b == a else 1.0


def indel(unit: str) -> float:
    return SMALL if unit in SMALL_MARKS else SUBSCRIPT if len(unit) == 2 else 1.0


def weighted_distance(a: list[str], b: list[str], most: float = math.inf) -> float:
    """Least total cost of edits from a to b, with swaps of neighbours; infinite as soon as it must exceed ``most``."""
    if abs(len(a) - len(b)) * LEAST_INDEL > most + 1e-9:
        return math.inf
    rows = [[0.0]]
    for u in b:
        rows[0].append(rows[0][-1] + indel(u))
    for i, x in enumerate(a, 1):
        above = rows[-1]
        row = [above[0] + indel(x)]
        for j, y in enumerate(b, 1):
            options = [above[j - 1] + substitution(x, y), above[j] + indel(x), row[-1] + indel(y)]
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                options.append(rows[-2][j - 2] + SWAP)
            row.append(min(options))
        if min(row) > most:
            return math.inf
        rows = [rows[-1], row]
    return rows[-1][-1]


def sound_bucket(word: str) -> str:
    """The sound group of the first letter, or that letter."""
    first = word.lstrip(COENG)[:1] if word[:1] == COENG and len(word) > 1 else word[:1]
    return FIRST_GROUP.get(first, first)


def signature(units: list[str]) -> int:
    """32 bits, one for the group of each unit: confusable units share a bit, so k differing bits cost at least 0.5 * ceil(k / 2)."""
    out = 0
    for u in units:
        letter = u[1] if len(u) == 2 and u[0] == COENG else u
        out |= 1 << (zlib.crc32(GROUP.get(letter, letter).encode()) % 32)
    return out


def too_far(a: int, b: int, most: float) -> bool:
    """Whether two signatures rule out a distance of ``most``."""
    return 0.5 * math.ceil((a ^ b).bit_count() / 2) > most


def most_for(n_units: int) -> float:
    """The distance allowed for a word of so many units."""
    return 0.6 if n_units <= 2 else 1.0 if n_units <= 4 else 1.5 if n_units <= 7 else 2.0


def character_accuracy(found: str, expected: str) -> float:
    """1 - edit distance / length of the expected text, white space left out, at least 0."""
    a, b = "".join(found.split()), "".join(expected.split())
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return max(0.0, 1 - row[-1] / max(1, len(b)))


def confidence_level(value: float) -> str:
    """High from 0.8, medium from 0.55."""
    return "high" if value >= 0.8 else "medium" if value >= 0.55 else "low"
