"""Benchmark decontamination with Spark expressions only.

A benchmark item's windows are its runs of 10 words.  Their hashes are a set
that is broadcast; a document's words are hashed once, the hashes of its
windows are scanned against the set, and a comparison of all words verifies
each hit; words are taken out of a text for hits alone.  Texts are scanned in
chunks of words, so a very long one needs no more memory than many short ones,
and no text is shuffled.

The set's size is checked: one of more than ``MOST_BROADCAST`` windows is not
broadcast, and the windows of documents meet it in a shuffled join by hash,
still in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Windows of a broadcast set, each of at most 10 words.
MOST_BROADCAST = 500_000
#: Words of a text that are scanned at a time.
CHUNK = 1000
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII take a faster path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SPLIT), "")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """hash, win, item_id: each window of each item, once."""
    items = benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    runs = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))), lambda i: F.slice("w", i, F.lit(width)))).alias("win"))
    return runs.distinct().select(F.xxhash64(_hashes("win")).alias("hash"), "win", "item_id")


def _hashes(of: str) -> Column:
    """The hash of each word; a window's hash is that of its words' hashes."""
    return F.transform(of, lambda x: F.xxhash64(x))


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans (first word, words), items.

    ``rid`` tells rows apart, so repeated ids and rows each get a row.  Null
    and empty texts have no words and no hits; items without words have no
    windows; an empty benchmark hits nothing; an item that is there twice is
    one; other columns are ignored; an empty table gives no rows.
    """
    wins = windows(benchmark, item, item_text, width)
    sizes = wins.groupBy(F.size("win").alias("n")).count().collect()  # a row for each length, ``width`` at most
    lengths, total = sorted(r["n"] for r in sizes), sum(r["count"] for r in sizes)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), words(F.col(text)).alias("w"))
    chunk = lambda c: F.struct((c * CHUNK).alias("base"), F.slice("w", c * CHUNK + 1, F.lit(CHUNK + width - 1)).alias("w"))
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"greatest(size(w) - 1, 0) div {CHUNK}").cast("int")), chunk)
    # the whole text's words end here: only a chunk goes with the rows of its windows
    parts = rows.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), chunks.alias("c")).select("rid", "doc_id", "n_words", F.explode_outer("c").alias("c"))
    parts = parts.select("rid", "doc_id", "n_words", F.col("c.base").alias("base"), F.col("c.w").alias("w"))
    # a window is one number, its length times CHUNK and its place in the chunk; -1 stands for the text itself.
    # No array is filtered for being empty (that would make it twice): a chunk without windows gives one more row for the text
    none = F.array().cast("array<int>")
    codes = [F.when(F.col("base") == 0, F.array(F.lit(-1))).otherwise(none)]
    for n in lengths:
        starts = F.least(F.size("w") - (n - 1), F.lit(CHUNK))
        codes.append(F.when(starts >= 1, F.sequence(F.lit(n * CHUNK), F.lit(n * CHUNK - 1) + starts)).otherwise(none))
    at = parts.select("*", _hashes("w").alias("h"), F.concat(*codes).alias("codes")).select("rid", "doc_id", "n_words", "base", "w", "h", F.explode_outer("codes").alias("code"))
    place, length = F.col("code") % CHUNK, F.floor(F.col("code") / CHUNK).cast("int")
    here = F.slice("w", place + 1, length).alias("here")
    at_hash = F.when(F.col("code") >= 0, F.xxhash64(F.slice("h", place + 1, length))).alias("at_hash")
    at = at.select("rid", "doc_id", "n_words", F.when(F.col("code") >= 0, F.col("base") + place).alias("pos"), "code", "w", at_hash)
    if total <= MOST_BROADCAST:  # ``w`` goes no further than the scan's own stage
        joined = at.join(F.broadcast(wins), F.col("at_hash") == F.col("hash"), "left").select("*", F.when(F.col("hash").isNotNull(), here).alias("here"))
    else:
        at = at.select("rid", "doc_id", "n_words", "pos", "at_hash", F.when(F.col("code") >= 0, here).alias("here"))
        joined = at.join(wins, F.col("at_hash") == F.col("hash"), "left")
    hits = joined.filter(F.col("pos").isNull() | (F.col("here") == F.col("win")))
    span = F.when(F.col("pos").isNotNull(), F.struct(F.col("pos").alias("start"), F.size("here").alias("len")))
    return hits.groupBy("rid", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("pos").isNotNull(), F.col("item_id"))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``; cases as in :func:`occurrences`."""
    found = occurrences(docs, benchmark, key, text, item=item, item_text=item_text)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    found = found.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _marked(docs: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """id, digest and spans of the texts that hold a window."""
    tagged = docs.select(F.struct(F.col(key).alias("id"), F.sha2(text, 256).alias("digest")).alias("mark"), F.col(text).alias("body"))
    return occurrences(tagged, benchmark, "mark", "body").filter(F.size("spans") > 0).select("doc_id.id", "doc_id.digest", "spans")


def _with_marks(docs: DataFrame, bad: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """``row``, a row of ``docs`` whole, joined to its marks: no name of its columns can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("row_id"), F.sha2(text, 256).alias("row_digest"))
    return rows.join(bad, F.col("row_id").eqNullSafe(F.col("id")) & F.col("row_digest").eqNullSafe(F.col("digest")), how)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window, with all their columns.

    Null and empty texts and null ids stay as they are; rows that repeat stay
    or go together; an empty table or benchmark drops nothing.
    """
    bad = _marked(docs, benchmark, key, text).select("id", "digest").distinct()
    return _with_marks(docs, bad, key, text, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of hit windows, and the gap after each, cut out of the text; other texts stay as they are."""
    bad = _marked(docs, benchmark, key, text).dropDuplicates(["id", "digest"])
    rows = _with_marks(docs, bad, key, text, "left").select("row", "spans")
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    body = F.col("row").getField(text)
    gone = F.map_from_entries(F.transform(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))), lambda i: F.struct(i, F.lit(True))))
    rows = rows.withColumns({"gone": gone, "gaps": F.split(body, pattern), "found": F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1))})
    kept = F.transform("found", lambda w, i: F.when(F.map_contains_key("gone", i), F.lit("")).otherwise(F.concat(w, F.get("gaps", i + 1))))
    cut = F.concat(F.get("gaps", F.lit(0)), F.array_join(kept, ""))
    return rows.select(*[F.when(F.col("spans").isNull(), body).otherwise(cut).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
