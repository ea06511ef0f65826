"""Near-duplicates by order MinHash.

A text's k-mers are its runs of five words, labelled with their occurrence so
that repeats count.  In each of ``TABLES`` tables a text is sketched by its
``DRAWN`` k-mers of least hash, kept in text order: two texts share a sketch
only if they share those k-mers and their order, so the chance follows the
edit similarity (Marcais et al., 2019).

Candidates are verified by banded alignment of their words: the edit distance
is followed as far as a similar pair allows, and a pair is linked when
1 - distance / (words of the longer text) is ``SIMILAR`` or more.  Words that a
similar pair must share, as bags, decide first which pairs are aligned.

Texts of equal word sequence, by 128 bits of hash, are one class from the
start and only their representative is compared.  Buckets that hold the same
members in several tables are compared once.  A bucket too large for one task,
in members or words, is dealt to blocks: first every block is compared with
itself and a few pivots of the bucket, which joins a large group of copies at
a cost in proportion to it; then what is not in the bucket's main component is
compared with all blocks.  So no pair is lost, no task holds more than two
blocks, and a task gives back only the links that span what it joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.text import grams, mix, release, small_batches, with_checkpoints, words_of

K = 5
DRAWN = 2
TABLES = 20
SIMILAR = 0.8
#: Members and words of a block, at most, unless one text has more.
BLOCK, BLOCK_WORDS = 1024, 500_000
#: Up to so many words the distance is computed with one bit a word.
BITS = 4096
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each text, and where each text's runs begin; a shorter text is one run."""
    h, _, of_text = grams(words, K)
    runs = np.diff(of_text)
    short = np.flatnonzero((words.count > 0) & (words.count < K))
    if not len(short):
        return h, of_text
    extra = np.zeros(len(runs), np.int64)
    extra[short] = 1
    where = np.concatenate(([0], np.cumsum(runs + extra)))
    out = np.empty(where[-1], np.uint64)
    own = np.ones(len(out), bool)
    own[where[short]] = False
    out[own] = h
    for t in short:  # of at most four words
        x = words.count[t : t + 1].astype(np.uint64)
        for i in range(words.of_text[t], words.of_text[t + 1]):
            x = mix(x * np.uint64(31) + words.hash[i : i + 1])
        out[where[t]] = x[0]
    return out, where


def labelled(h: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with the number of their occurrence in their text."""
    text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
    order = np.lexsort((h, text))
    hs, ts = h[order], text[order]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1]))) if len(hs) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(hs)) - np.repeat(first, np.diff(np.concatenate((first, [len(hs)]))))
    out = h.copy()
    again = nth > 0
    out[order[again]] = mix(hs[again] + nth[again].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def sketches(items: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """One key for each text that has runs and each table, as an array (texts, tables)."""
    starts = of_text[:-1]
    n = np.diff(of_text)
    out = np.empty((len(n), TABLES), np.int64)
    place = np.arange(len(items))
    for t in range(TABLES):
        x = mix(items ^ _SEEDS[t])
        chosen = []
        for _ in range(DRAWN):
            low = np.minimum.reduceat(x, starts)
            at = np.minimum.reduceat(np.where(x == np.repeat(low, n), place, len(items)), starts)
            none = low == _TOP  # fewer runs than are drawn
            chosen.append(np.where(none, len(items), at))
            x[at[~none]] = _TOP
        order = np.sort(np.stack(chosen), axis=0)
        key = np.full(len(n), np.uint64(t + 1))
        padded = np.concatenate((items, np.zeros(1, np.uint64)))
        for row in order:
            key = mix(key * np.uint64(0x100000001B3) + padded[row])
        out[:, t] = key.view(np.int64)
    return out


def sequence_hash(words, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each text's whole word sequence: words weighed by odd powers, so that order counts."""
    whole = np.zeros(len(words.count), np.uint64)
    have = words.count > 0
    if have.any():
        power = np.full(int(words.count.max()), np.uint64(base))
        power[0] = 1
        power = power.cumprod(dtype=np.uint64)
        of = words.of_text[:-1][have]
        place = np.arange(len(words.hash)) - np.repeat(of, words.count[have])
        whole[have] = np.add.reduceat(words.hash * power[place], of)
    return mix(whole + words.count.astype(np.uint64))


def _identity(words) -> list[pa.Array]:
    return [pa.array(sequence_hash(words, x).view(np.int64)) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in words_of(batch.column(1)):
            h, of_text = kmers(words)
            have = np.diff(of_text) > 0
            keys = np.zeros((0, TABLES), np.int64)
            if have.any():
                starts = np.concatenate((of_text[:-1][have], [of_text[-1]]))
                keys = sketches(labelled(h, starts), starts)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(have * TABLES))).astype(np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.count), *_identity(words), lists], ["id", "n", "h1", "h2", "keys"])


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in words_of(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.count), *_identity(words)], ["doc_id", "n_words", "o1", "o2"])


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text, four bytes each."""
    for batch in batches:
        for a, b, words in words_of(batch.column(1)):
            short = (words.hash >> np.uint64(32)).astype(np.uint32)
            body = [short[words.of_text[i] : words.of_text[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(body, pa.binary())], ["id", "body"])


def _by_bits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance with one bit for each word of ``a`` (Myers, 1999); ends when it must be over ``most``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    n, left = len(a), len(b)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, d = full, 0, n
    for y in b.tolist():
        eq = where.get(y, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        grows = down | (full & ~(xh | up))
        falls = up & xh
        d += bool(grows & top) - bool(falls & top)
        left -= 1
        if d - left > most:
            return most + 1
        grows = (grows << 1) | 1
        falls <<= 1
        up = full & (falls | ~(xv | grows))
        down = grows & xv & full
    return d


def _by_waves(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance by the furthest cell of each diagonal of the band at each number of edits (Ukkonen, 1985)."""
    n, m = len(a), len(b)
    goal = m - n  # the diagonal, place in b less place in a, of the end
    far = np.full(2 * most + 5, -2, np.int64)  # the furthest place in a on diagonal i - most - 2
    middle = most + 2
    reach = np.zeros(1, np.int64)
    for d in range(most + 1):
        diag = np.arange(-d, d + 1)
        at = diag + middle
        if d:
            reach = np.maximum(np.maximum(far[at - 1], far[at] + 1), far[at + 1] + 1)
        reach = np.minimum(np.minimum(reach, n), m - diag)
        ok = reach >= np.maximum(0, -diag)
        live = np.flatnonzero(ok & (reach < n) & (reach + diag < m))
        while len(live):
            same = a[reach[live]] == b[reach[live] + diag[live]]
            live = live[same]
            reach[live] += 1
            live = live[(reach[live] < n) & (reach[live] + diag[live] < m)]
        fresh = np.full_like(far, -2)
        fresh[at] = np.where(ok, reach, -2)
        far = fresh
        if -d <= goal <= d and far[goal + middle] >= n:
            return d
    return most + 1


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences; ``most`` + 1 where it is over ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return min(len(b), most + 1)
    return min((_by_bits if len(a) <= BITS else _by_waves)(a, b, most), most + 1)


def allowed(n: int, m: int, similar: float = SIMILAR) -> int:
    """The most edits of a similar pair of texts of n and m words."""
    return int(np.floor(max(n, m) * (1 - similar) + 1e-9))


def similarity(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """1 - distance / (words of the longer text); 0 where it is under ``similar``."""
    most, longest = allowed(len(a), len(b), similar), max(len(a), len(b))
    d = distance(a, b, most)
    return 1 - d / longest if d <= most and longest else 0.0


def spanning_links(ids: list, texts: list[np.ndarray], asks: np.ndarray | None = None, group: np.ndarray | None = None, side: np.ndarray | None = None, similar: float = SIMILAR) -> list[tuple]:
    """Verified links that connect all similar texts of a task.

    Only pairs that a text of ``asks`` is part of count, all if it is not
    given; texts of one ``group`` are connected already, and those of one
    ``side`` have been compared.  Words shared as bags
    are counted through an inverted index, so that pairs that share too few
    are never aligned, nor are pairs that are connected.
    """
    n = len(ids)
    sizes = np.array([len(x) for x in texts])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    flat = labelled(np.concatenate(texts).astype(np.uint64), begin)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, codes = owner[order], code[order]
    first = np.searchsorted(codes, np.arange(codes[-1] + 2)) if len(codes) else np.zeros(1, np.int64)
    df = np.diff(first)
    part = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1]
    asks = np.ones(n, bool) if asks is None else asks
    out = []
    for i in np.flatnonzero(asks):
        bound = np.maximum(sizes, sizes[i])
        most = np.floor(bound * (1 - similar) + 1e-9)
        can = (part != part[i]) & (side != side[i] if side is not None else part >= 0) & (np.abs(sizes - sizes[i]) <= most) & ~(asks & (np.arange(n) < i))
        if not can.any():
            continue
        own = code[begin[i] : begin[i + 1]]
        own = own[df[own] > 1]
        if not len(own):
            continue
        spans = df[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        shared = np.bincount(posting[at], minlength=n)
        for j in np.flatnonzero(can & (shared >= bound - most)).tolist():
            if part[i] != part[j] and similarity(texts[i], texts[j], similar):
                part[part == part[j]] = part[i]
                out.append((ids[i], ids[j]))
    return out


def _verify(similar: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asks", "id"]).drop_duplicates("id", keep="last")  # who both asks and is asked, asks
        texts = [np.frombuffer(x, np.uint32) for x in pdf["body"]]
        found = spanning_links(pdf["id"].tolist(), texts, pdf["asks"].to_numpy(), pdf["grp"].to_numpy(), pdf["side"].to_numpy(), similar)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _links(members: DataFrame, bodies: DataFrame, similar: float) -> DataFrame:
    """Links that tasks find; ``members`` are rows (task columns t1, t2, t3, id, asks, grp, side)."""
    rows = members.join(bodies, "id")
    return rows.groupBy("t1", "t2", "t3").applyInPandas(_verify(similar), "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest id it is linked to over any path), n_words.

    Texts without words, null ones included, are alone; so are rows without
    an id.  Rows that repeat an id are one node, for which the smallest of
    their texts is compared.  Very long texts are compared whole.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with_checkpoints(spark)
    release(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    drawn = rows.mapInArrow(_sketch, "id long, n long, h1 long, h2 long, keys array<long>")
    # equal word sequences: the least id stands for all; copies are merged before the shuffle
    some = drawn.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")).checkpoint()
    drawn_keys = some.select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key"))
    hashes = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    pivots = F.array(F.min("id"), F.max("id"), *[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in (3, 4)]).alias("pivots")
    bucket = drawn_keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"), *hashes, pivots).filter("m > 1")
    once = bucket.groupBy("m", "words", "s1", "s2").agg(F.min("key").alias("key"), F.first("pivots").alias("pivots"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    once = once.select("key", F.when(F.col("m") == 2, 1).otherwise(blocks).alias("blocks"), F.array_distinct("pivots").alias("pivots"))
    members = drawn_keys.join(once, "key").select("key", "blocks", "id", "n", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int").alias("block")).checkpoint()
    involved = members.select("id").distinct()
    bodies = rows.join(involved, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).mapInArrow(_contents, "id long, body binary").checkpoint()
    release(spark)
    large = members.filter("blocks > 1")
    own = members.select(F.col("key").alias("t1"), F.col("block").alias("t2"), F.lit(0).alias("t3"), "id")
    spread = once.filter("blocks > 1").select(F.col("key").alias("t1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t2"), F.lit(0).alias("t3"), F.explode("pivots").alias("id"))
    found = _links(own.unionByName(spread).distinct().select("*", F.lit(True).alias("asks"), F.col("id").alias("grp"), F.col("id").alias("side")), bodies, similar).checkpoint()
    release(spark)
    roots = components(found).checkpoint()
    if not large.isEmpty():
        marked = large.join(roots, F.col("id") == F.col("node"), "left").select("key", "block", "blocks", "id", "n", F.coalesce("root", "id").alias("grp"))
        sizes = marked.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
        main = sizes.groupBy("key").agg(F.max(F.struct("c", "grp", "w")).alias("x"), F.sum("c").alias("c"), F.sum("w").alias("w"))
        others = F.greatest(F.ceil((F.col("c") - F.col("x.c")) / BLOCK), F.ceil((F.col("w") - F.col("x.w")) / BLOCK_WORDS)).cast("int")
        marked = marked.join(main.select("key", F.col("x.grp").alias("main"), others.alias("parts")).filter("parts > 0"), "key")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        marked = marked.withColumn("asks", F.col("grp") != F.col("main")).withColumn("side", F.col("block").cast("long"))
        what = ["id", "asks", "grp", "side"]
        # many askers: every block meets every other; few: they are sent to all blocks, in parts that a task can hold
        many = F.col("parts") * 2 >= F.col("blocks")
        met = marked.filter(many).withColumn("other", every(F.col("blocks"))).filter("other <> block")
        met = met.select(F.col("key").alias("t1"), F.least("block", "other").alias("t2"), F.greatest("block", "other").alias("t3"), *what)
        asked = marked.filter(~many).withColumn("asks", F.lit(False)).select(F.col("key").alias("t1"), F.col("block").alias("t2"), every(F.col("parts")).alias("t3"), *what)
        asking = marked.filter(~many).filter("asks").select(F.col("key").alias("t1"), every(F.col("blocks")).alias("t2"), F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")).cast("int").alias("t3"), *what)
        more = _links(met.unionByName(asked).unionByName(asking), bodies, similar)
        roots = components(found.unionByName(more))
    named = some.select("h1", "h2", "n", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("class_id"))
    small = rows.mapInArrow(_sequences, "doc_id long, n_words long, o1 long, o2 long")
    small = small.withColumn("o1", F.when((F.col("n_words") > 0) & F.col("doc_id").isNotNull(), F.col("o1")))
    joined = small.join(named, (F.col("o1") == F.col("h1")) & (F.col("o2") == F.col("h2")) & (F.col("n_words") == F.col("n")), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_words")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class, the one whose id names it; rows without an id stay.

    Rows without words stay too; rows that repeat an id share its fate; all
    columns are kept, whatever their names; an empty table stays empty.
    """
    gone = classes(docs, key, text, similar).filter("doc_id <> class_id").select(F.col("doc_id").alias("id of a copy")).distinct()
    return docs.join(gone, docs[key] == gone["id of a copy"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
