"""Secret scans: fixed patterns and a battery of randomness tests.

Besides the patterns, every run of characters that an encoding could have made
is a candidate; ``=`` belongs to it as padding at its end alone.  Its encoding
is inferred from its alphabet (hex, base32 and base36 of either case, base64),
and three tests of randomness give p-values under the hypothesis that
its characters were drawn uniformly and independently: a chi-squared test of
uniformity, a test of runs about the alphabet's middle, and a test of lag-one
serial correlation.  The tests look for departures from randomness, so a text
gets a small p-value and a key a large one.  The null hypothesis that matters
for a finding is "this is ordinary text"; ordinary words deviate in the
chi-squared statistic, so the score of a candidate turns the combined evidence
into an e-value, the likelihood ratio of random characters against text, and
the e-BH rule with weights that grow with length controls the false-discovery
rate among the candidates of a document.

A document is scanned alone and whole, in one narrow pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.text import small_batches

#: The patterns that are always found.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Candidates are at least so long; shorter runs carry too little evidence.
LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}+(?:=++(?![A-Za-z0-9+/_-]))?" % LEAST)
#: What letters and digits of one case alone are split at: base64 of that length would mix cases.
PART = re.compile(r"[A-Za-z0-9]{%d,}+=*+" % LEAST)
#: The false-discovery rate among a document's candidates.
FDR = 0.01
ENCODINGS = (
    ("hex", frozenset("0123456789abcdef"), "0123456789abcdef"),
    ("hex", frozenset("0123456789ABCDEF"), "0123456789ABCDEF"),
    ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32", frozenset("abcdefghijklmnopqrstuvwxyz234567"), "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", frozenset("0123456789abcdefghijklmnopqrstuvwxyz"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: How often text goes from one case (0 lower, 1 upper) to the next; random letters go to either alike.
TEXT_CASE = {(0, 0): 0.85, (0, 1): 0.15, (1, 0): 0.7, (1, 1): 0.3}


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom >= x), by the Wilson-Hilferty transform."""
    return _normal_tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def infer(candidate: str) -> tuple[str, list[int], int] | None:
    """The narrowest encoding of the candidate, its symbols as numbers, and the alphabet's size."""
    body = candidate.rstrip("=")
    for name, letters, order in ENCODINGS:
        if letters.issuperset(body):
            table = {c: i for i, c in enumerate(order)} | {"-": 62, "_": 63} if name == "base64" else {c: i for i, c in enumerate(order)}
            return name, [table[c] for c in body], len(order)
    return None


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity (against clumping), of runs and of serial correlation; small means not random."""
    n = len(symbols)
    expected = n / size
    # an alphabet larger than the text is folded, so that each class expects four symbols at least
    fold = 1
    while expected * fold < 4 and size // fold > 2:
        fold *= 2
    classes = size // fold
    counts = Counter(s // fold for s in symbols)
    chi = sum((counts.get(i, 0) - n / classes) ** 2 for i in range(classes)) / (n / classes)
    uniform = _chi_tail(chi, classes - 1)
    high = [s >= size // 2 for s in symbols]
    ones = sum(high)
    zeros = n - ones
    if ones and zeros and n > 2:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * ones * zeros / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    lag = sum((a - mean) * (b - mean) for a, b in zip(symbols, symbols[1:])) / var if var else 1.0
    serial = 2 * _normal_tail(abs(lag * math.sqrt(n)))
    return min(1.0, uniform), min(1.0, p_runs), min(1.0, serial)


def evidence(candidate: str) -> float:
    """Log of the e-value for "random" against "text": zero or less is no evidence.

    Random symbols of an alphabet mix character classes at known rates.  Text
    keeps to one class for long; the evidence is the count of changes of class
    (lower, upper, digit) over what text makes, less what the battery objects.
    Letters of both cases without a digit may be words with capitals, which
    change class often but in one way, so there each kind of change counts.
    """
    found = infer(candidate)
    if found is None:
        return -math.inf
    name, symbols, size = found
    if len(symbols) < LEAST:
        return -math.inf
    kinds = [0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 for c in candidate if c.isalnum()]
    if len(kinds) < LEAST or len(set(kinds)) < 2:
        return -math.inf  # one class never changes, so its ratio is below zero: words, a number or a path
    if set(kinds) == {0, 1}:
        ratio = sum(math.log(0.5 / TEXT_CASE[pair]) for pair in zip(kinds, kinds[1:]))
    else:
        changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
        n = len(kinds) - 1
        rate = {"hex": 0.47, "base32": 0.3, "base36": 0.4, "base64": 0.6}[name]
        text = 0.12  # text with digits or capitals changes its class about once in eight characters
        ratio = changes * math.log(rate / text) + (n - changes) * math.log((1 - rate) / (1 - text))
    worst = min(battery(symbols, size))
    return ratio + math.log(max(worst, 1e-300) * 3) if worst < 1 / 3 else ratio


def select(candidates: list[tuple[int, int, str]], rate: float = FDR) -> list[tuple[int, int]]:
    """The weighted e-BH rule: longer candidates, better able to show randomness, weigh more."""
    if not candidates:
        return []
    logs = [evidence(c) for _, _, c in candidates]
    weigh = [min(4.0, (b - a) / 32) for a, b, _ in candidates]
    total = sum(weigh)
    scored = sorted(((e + math.log(w * len(candidates) / total), (a, b)) for e, w, (a, b, _) in zip(logs, weigh, candidates)), key=lambda x: (-x[0], x[1]))
    keep = 0
    for i, (e, _) in enumerate(scored, 1):
        if e >= math.log(len(candidates) / (i * rate)):
            keep = i
    return [s for _, s in scored[:keep]]


def _parts(m: re.Match) -> list[tuple[int, int, str]]:
    """A candidate, or its long parts where separators stand between letters of one case."""
    run = m.group()
    if run.rstrip("=").isalnum() or run.lower() != run != run.upper():
        return [(m.start(), m.end(), run)]
    return [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in PART.finditer(run)]


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a text in order; code points, end exclusive."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    free = []
    at = 0
    ends = []
    for a, _, b in base:
        ends.append((a, max(b, ends[-1][1]) if ends else b))
    for start, end, run in (p for m in CANDIDATE.finditer(text) for p in _parts(m)):
        while at < len(ends) and ends[at][1] <= start:
            at += 1
        if at == len(ends) or ends[at][0] >= end:
            free.append((start, end, run))
    return sorted(base + [(a, 3, b) for a, b in select(free)])


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for text in batch.column(1):
            found = spans(text.as_py() or "")
            base = [x for x in found if x[1] < 3]
            counts = Counter(k for _, k, _ in base)
            out.append((counts[0], counts[1], counts[2], hashlib.sha256(_written(base).encode()).hexdigest(), _written(found)))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans; repeated rows each get a row; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"cast(`{text}` as string) AS text")
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
