"""Words of Arrow string columns as numpy arrays, without a Python object per word.

Texts are UTF-8 bytes end to end.  A word class is a table of 256 flags; every
byte from 0x80 up belongs to a character outside ASCII and counts as a word
byte, so words never split a character.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_000_000
#: Rows of one Arrow batch; a row can be a very long text.
BATCH_ROWS = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
WORD = np.ones(256, dtype=bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
#: The word class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[0x09:0x0E] = NOT_SPACE[0x20] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the user chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def with_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names; without one only local mode gets a folder of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files, and checkpoints where it is told to, that no table refers to any more.

    Its cleaner learns of them when the driver's heap is collected, which a
    driver that does little else than plan seldom does by itself.
    """
    spark.sparkContext._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of some texts: start and end byte, 64-bit hash, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, prefixes: tuple[int, ...] = ()):
        low = LOWER[data]
        member = kind[low]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        before = np.concatenate(([False], member[:-1])) & ~first[:-1]
        after = np.concatenate((member[1:], [False])) & ~first[1:]
        self.start = np.flatnonzero(member & ~before)
        self.end = np.flatnonzero(member & ~after) + 1
        self.of_text = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.of_text)
        lens = self.end - self.start
        total = int(lens.max(initial=0))
        power = np.concatenate((np.ones(1, np.uint64), np.full(total, _BASE | np.uint64(1)))).cumprod(dtype=np.uint64)
        self.hash = np.zeros(len(lens), np.uint64)
        self.prefix = {p: np.zeros(len(lens), np.uint64) for p in prefixes}
        through = np.concatenate(([0], np.cumsum(lens)))
        at = 0
        while at < len(lens):  # blocks of words: one very long text needs no more memory than many short ones
            to = max(at + 1, int(np.searchsorted(through, through[at] + SLICE_BYTES, side="right")) - 1)
            a, b = self.start[at], self.end[to - 1]
            own = low[a:b][member[a:b]].astype(np.uint64) + np.uint64(1)
            begin = through[at:to] - through[at]
            place = np.arange(len(own)) - np.repeat(begin, lens[at:to])
            own *= power[place]
            self.hash[at:to] = np.add.reduceat(own, begin)
            for p, out in self.prefix.items():
                out[at:to] = np.add.reduceat(np.where(place < p, own, np.uint64(0)), begin)
            at = to
        self.hash = mix(self.hash ^ lens.astype(np.uint64))
        for p in prefixes:
            self.prefix[p] = mix(self.prefix[p] ^ np.uint64(p << 32))

    def texts(self) -> np.ndarray:
        """The text, as a row of the slice, that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)


def words_of(column: pa.Array, kind: np.ndarray = WORD, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, Words]]:
    """For slices of the column: first row, row after the last, and their words."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind, prefixes)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, each run's first word, and where each text's runs begin.

    Runs never cross texts; a text of fewer than k words has none.
    """
    runs = np.maximum(words.count - k + 1, 0)
    of_text = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(of_text[-1]) + np.repeat(words.of_text[:-1] - of_text[:-1], runs)
    h = np.zeros(len(first), np.uint64)
    for i in range(k):
        h = mix(h * (_BASE | np.uint64(1)) + words.hash[first + i])
    return h, first, of_text
