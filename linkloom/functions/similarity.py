"""String similarities: kernels in plain Python, one batched Arrow UDF for all of them, and Column forms of the token measures.

``ratio`` is the normalised insertion-deletion similarity, from 0 to 100:
twice the longest common subsequence over the sum of lengths.  It is computed
with one bit per character, so a row of the table is one integer operation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (Hyyro's bit-parallel form)."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & where.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of common words against either side and of the sides with each other; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (left and right):
        return 100.0
    space = 1 if both else 0
    n = len(both)
    n_left, n_right = n + space + len(left), n + space + len(right)
    distance = len(left) + len(right) - 2 * lcs(left, right)
    best = 100.0 * (1 - distance / (n_left + n_right))
    if both:
        best = max(best, 100.0 * (1 - (space + len(left)) / (n + n_left)), 100.0 * (1 - (space + len(right)) / (n + n_right)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one; windows may run over its ends."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a

    def best(short: str, long: str) -> float:
        n = len(short)
        where: dict[str, int] = {}
        for i, x in enumerate(short):
            where[x] = where.get(x, 0) | (1 << i)
        full = (1 << n) - 1
        room = {x: w.bit_count() for x, w in where.items()}  # letters of the text that the window lacks; below 0 it has more
        shared, bounds = 0, []
        for i in range(1 - n, len(long)):
            if i + n <= len(long):
                x = long[i + n - 1]
                if x in room:
                    shared += room[x] > 0
                    room[x] -= 1
            if i > 0:
                x = long[i - 1]
                if x in room:
                    room[x] += 1
                    shared -= room[x] > 0
            # no window has more in common with the text than their letters as bags
            if shared:
                bounds.append((-shared / (n + min(i + n, len(long)) - max(i, 0)), i))
        top = 0.0
        for bound, i in sorted(bounds):
            if -200.0 * bound <= top:
                break
            window = long[max(i, 0) : i + n]
            s = full
            for y in window:
                u = s & where.get(y, 0)
                s = ((s + u) | (s - u)) & full
            top = max(top, 200.0 * (n - s.bit_count()) / (n + len(window)))
        return top

    out = best(a, b)
    return max(out, best(b, a)) if len(a) == len(b) and out < 100.0 else out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of four equal first letters where it is over 0.7; two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


_VOWELS = "AEIOUY"


@lru_cache(1 << 16)
def metaphone(word: str) -> str:
    """The primary Double Metaphone code of a word, by the published sound rules; at most four sounds."""
    w = "".join(c for c in word.upper() if c.isalpha())
    n, i, out = len(w), 0, []

    def at(k: int, *strings: str) -> bool:
        return k >= 0 and any(w.startswith(s, k) for s in strings)

    def vowel(k: int) -> bool:
        return 0 <= k < n and w[k] in _VOWELS

    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w
    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if at(0, "X"):
        out.append("S")
        i = 1
    while i < n and len(out) < 4:
        c, step = w[i], 1
        sound = ""
        if c in _VOWELS:
            sound = "A" if i == 0 else ""
        elif c == "B":
            sound, step = "P", 2 if at(i + 1, "B") else 1
        elif c == "Ç":
            sound = "S"
        elif c == "C":
            if i > 1 and not vowel(i - 2) and at(i - 1, "ACH") and not at(i + 2, "I") and (not at(i + 2, "E") or at(i - 2, "BACHER", "MACHER")):
                sound, step = "K", 2
            elif i == 0 and at(0, "CAESAR"):
                sound, step = "S", 2
            elif at(i, "CH"):
                step = 2
                if i > 0 and at(i, "CHAE"):
                    sound = "K"
                elif i == 0 and at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not at(0, "CHORE"):
                    sound = "K"
                elif at(0, "VAN ", "VON ", "SCH") or at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, "T", "S") or ((i == 0 or at(i - 1, "A", "O", "U", "E")) and at(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W")):
                    sound = "K"
                else:
                    sound = "K" if i > 0 and at(0, "MC") else "X"
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                sound, step = "S", 2
            elif at(i + 1, "CIA"):
                sound, step = "X", 3
            elif at(i, "CC") and not (i == 1 and at(0, "M")):
                if at(i + 2, "I", "E", "H") and not at(i + 2, "HU"):
                    sound, step = ("KS" if (i == 1 and at(0, "A")) or at(i - 1, "UCCEE", "UCCES") else "X"), 3
                else:
                    sound, step = "K", 2
            elif at(i, "CK", "CG", "CQ"):
                sound, step = "K", 2
            elif at(i, "CI", "CE", "CY"):
                sound, step = "S", 2
            else:
                sound = "K"
                step = 3 if at(i + 1, " C", " Q", " G") else 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                sound, step = ("J", 3) if at(i + 2, "I", "E", "Y") else ("TK", 2)
            else:
                sound, step = "T", 2 if at(i, "DT", "DD") else 1
        elif c in "FV":
            sound, step = "F", 2 if at(i + 1, c) else 1
        elif c == "G":
            if at(i + 1, "H"):
                step = 2
                if i > 0 and not vowel(i - 1):
                    sound = "K"
                elif i == 0:
                    sound = "J" if at(2, "I") else "K"
                elif (i > 1 and at(i - 2, "B", "H", "D")) or (i > 2 and at(i - 3, "B", "H", "D")) or (i > 3 and at(i - 4, "B", "H")):
                    sound = ""
                elif i > 2 and at(i - 1, "U") and at(i - 3, "C", "G", "L", "R", "T"):
                    sound = "F"
                else:
                    sound = "K" if i > 0 and not at(i - 1, "I") else ""
            elif at(i + 1, "N"):
                step = 2
                if i == 1 and vowel(0) and not slavic:
                    sound = "KN"
                else:
                    sound = "N" if not at(i + 2, "EY") and not slavic else "KN"
            elif at(i + 1, "LI") and not slavic:
                sound, step = "KL", 2
            elif i == 0 and at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
                sound, step = "K", 2
            elif at(i + 1, "ER", "Y") and not at(0, "DANGER", "RANGER", "MANGER") and not at(i - 1, "E", "I", "RGY", "OGY"):
                sound, step = "K", 2
            elif at(i + 1, "E", "I", "Y") or at(i - 1, "AGGI", "OGGI"):
                sound, step = ("K" if at(0, "SCH") or at(i + 1, "ET") else "J"), 2
            else:
                sound, step = "K", 2 if at(i + 1, "G") else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                sound, step = "H", 2
        elif c == "J":
            if at(i, "JOSE"):
                sound = "H"
            elif i == 0:
                sound = "J"
            elif vowel(i - 1) and not slavic and at(i + 1, "A", "O"):
                sound = "J"
            elif i == n - 1:
                sound = "J"
            elif not at(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, "S", "K", "L"):
                sound = "J"
            step = 2 if at(i + 1, "J") else 1
        elif c in "KLMNQRPTSWXZ" or c == "Ñ":
            sound, step = _rest(w, i, at, vowel, slavic)
        out.extend(sound)
        i += step
    return "".join(out[:4])


def _rest(w: str, i: int, at: Callable, vowel: Callable, slavic: bool) -> tuple[str, int]:
    """Sound and letters used for the consonants from K on."""
    n, c = len(w), w[i]
    twice = 2 if at(i + 1, c) else 1
    if c in "KLN":
        return c, twice
    if c == "Ñ":
        return "N", 1
    if c == "M":
        return "M", 2 if (at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER"))) or at(i + 1, "M") else 1
    if c == "P":
        return ("F", 2) if at(i + 1, "H") else ("P", 2 if at(i + 1, "P", "B") else 1)
    if c == "Q":
        return "K", twice
    if c == "R":
        silent = i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA")
        return "" if silent else "R", twice
    if c == "S":
        if at(i - 1, "ISL", "YSL"):
            return "", 1
        if i == 0 and at(0, "SUGAR"):
            return "X", 1
        if at(i, "SH"):
            return ("S" if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X"), 2
        if at(i, "SIO", "SIA"):
            return "S", 3
        if (i == 0 and at(1, "M", "N", "L", "W")) or at(i + 1, "Z"):
            return "S", 2 if at(i + 1, "Z") else 1
        if at(i, "SC"):
            if at(i + 2, "H"):
                if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                    return ("X" if at(i + 3, "ER", "EN") else "SK"), 3
                return "X", 3
            return ("S" if at(i + 2, "I", "E", "Y") else "SK"), 3
        if i == n - 1 and at(i - 2, "AI", "OI"):
            return "", 1
        return "S", 2 if at(i + 1, "S", "Z") else 1
    if c == "T":
        if at(i, "TION", "TIA", "TCH"):
            return "X", 3
        if at(i, "TH", "TTH"):
            return ("T" if at(i + 2, "OM", "AM") or at(0, "SCH") else "0"), 2
        return "T", 2 if at(i + 1, "T", "D") else 1
    if c == "W":
        if at(i, "WR"):
            return "R", 2
        if i == 0 and (vowel(1) or at(0, "WH")):
            return "A", 1
        if (i == n - 1 and vowel(i - 1)) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, "SCH"):
            return "", 1
        return ("TS", 4) if at(i, "WICZ", "WITZ") else ("", 1)
    if c == "X":
        silent = i == n - 1 and (at(i - 3, "IAU", "EAU") or at(i - 2, "AU", "OU"))
        return "" if silent else "KS", 2 if at(i + 1, "C", "X") else 1
    return ("J", 2) if at(i + 1, "H") else ("S", twice)  # Z


KERNELS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio,
    "token_sort": token_sort_ratio,
    "token_set": token_set_ratio,
    "partial": partial_ratio,
    "jaro_winkler": jaro_winkler,
}


def similarities(a: Column, b: Column, *names: str) -> Column:
    """A struct of the named similarities: one pass to Python and back for all of them."""
    chosen = [(n, KERNELS[n]) for n in names]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, str], tuple[float, ...]] = {}
        rows = []
        for p in zip(x.fillna(""), y.fillna("")):
            if p not in seen:
                seen[p] = tuple(k(*p) for _, k in chosen)
            rows.append(seen[p])
        return pd.DataFrame(rows, columns=list(names), dtype="float64")

    return run(a, b)


@F.pandas_udf(StringType())
def double_metaphone(words: pd.Series) -> pd.Series:
    return words.fillna("").map(metaphone)


def sql_ratio(a: Column, b: Column) -> Column:
    """``ratio`` inside the JVM, by rows of the common-subsequence table; for short texts."""
    left, right = F.split(a, ""), F.split(b, "")
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        grown = F.aggregate(
            F.sequence(F.lit(1), F.length(b)), start,
            lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(right, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(acc, j), F.element_at(prev, j + 1))))),
        )
        return grown

    whole = F.aggregate(left, zero, row, lambda r: F.element_at(r, F.lit(-1)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * whole / total)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if a side has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def acronym_match(a: Column, b: Column) -> Column:
    """Whether the single word of one side is the first letters of the other side's two or more."""
    first = lambda t: F.array_join(F.transform(t, lambda x: F.left(x, F.lit(1))), "")
    one = lambda many, single: (F.size(many) >= 2) & (F.size(single) == 1) & (F.get(single, F.lit(0)) == first(many))
    return F.coalesce(one(a, b), F.lit(False)) | F.coalesce(one(b, a), F.lit(False))
