"""Variable-capacity best-fit packing.

Texts are cut into pieces of at most the largest permitted length and packed
into bins of several permitted lengths.  Documents are dealt by a hash into
shards of bounded size, and each shard is packed alone, so nothing but ids and
lengths moves and no task or driver sees all documents.

Within a shard pieces go in from the longest: into the open bin with the least
room that still fits, else into a new bin.  Which size a new bin gets is
decided by cost: for each permitted size the padding that its opening would
leave after it is topped up, best-fit, from the shorter pieces that wait (a
histogram of their lengths), as a share of the bin.  A last step downsizes
each bin to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted lengths of a sequence, in words.
SIZES = (512, 1024, 2048)
#: Documents in a shard, about.
SHARD = 2048


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, int, int]]:
    """(bin, its size, offset in it) for each length, none longer than the largest size; zero-length pieces take no room."""
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    waiting = sorted(lengths)
    open_bins: list[tuple[int, int]] = []  # (room, bin), in order
    used: list[int] = []
    capacity: list[int] = []
    placed = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        waiting.pop()  # the longest, which is this one
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            b = len(used)
            used.append(0)
            best = None
            for size in sizes:
                if size < n:
                    continue
                left, end = size - n, len(waiting)
                while left and end:  # top up from the waiting lengths
                    end = bisect_right(waiting, left, 0, end)
                    if not end or not waiting[end - 1]:
                        break
                    end -= 1
                    left -= waiting[end]
                cost = (left / size, size)  # of equal padding the shorter sequence, whose attention costs less
                if best is None or cost < best[0]:
                    best = (cost, size)
            capacity.append(best[1])
            room = best[1]
        placed[i] = (b, used[b])
        used[b] += n
        if room - n:
            insort(open_bins, (room - n, b))
    small = [sizes[bisect_left(sizes, u)] for u in used]
    return [(b, small[b], at) for b, at in placed]


def words(text: Column) -> Column:
    """The length of a text, in runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, first_word, n_words, bin_id, bin_size, bin_at.

    A document longer than the largest size gives full pieces and a rest;
    null and empty texts give one piece of no words, so no row is lost.  Rows
    with one id are packed as documents of their own; other columns are
    ignored; an empty table gives no rows.
    """
    most = max(sizes)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), words(F.col(text)).cast("int").alias("n"))
    shards = max(1, -(-docs.count() // shard))
    where = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()), F.lit(3)), F.lit(shards)).cast("long")
    rows = rows.select("doc_id", "n", where.alias("shard"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], kind="stable")
        ids, pieces, firsts, lengths = [], [], [], []
        for doc, n in zip(pdf["doc_id"], pdf["n"]):
            for p, at in enumerate(range(0, max(n, 1), most)):
                ids.append(doc)
                pieces.append(p)
                firsts.append(at)
                lengths.append(min(most, n - at))
        where = pack(lengths, sizes)
        own = f"{pdf['shard'].iloc[0]}-"
        return pd.DataFrame({
            "doc_id": pd.array(ids, dtype="Int64"), "piece": pieces, "first_word": firsts, "n_words": lengths,
            "bin_id": [f"{own}{b}" for b, _, _ in where], "bin_size": [s for _, s, _ in where], "bin_at": [a for _, _, a in where],
        })

    return rows.groupBy("shard").applyInPandas(one, "doc_id long, piece long, first_word long, n_words long, bin_id string, bin_size long, bin_at long")
