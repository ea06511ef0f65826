"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained in numpy from confirmed toxic documents (P) and
from unlabelled text (U), a bounded sample of the rows that have labels, which
are not looked at in U, with the class-prior-corrected risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

where a step is taken against the second term alone when it turns negative
(Kiryo et al., 2017).  Features are the shares of a text's words, and of word
beginnings of 3 to 6 bytes, hashed to ``DIM`` slots; a text is scored whole in
one narrow pass.  How many rows the samples have at most are parameters of
:func:`train`; they are the rows with the smallest hash of their id, so they
don't depend on how the input is partitioned.  Scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.text import Words, mix, small_batches, with_checkpoints, words_of

DIM = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: Slots that get a weight, at most, and by how many standard errors their share must differ.
CHOSEN, LEAST_Z = 400, 2.5


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def _slots(words: Words) -> list[np.ndarray]:
    slots = [words.hash, *(mix(words.prefix[p]) for p in PREFIXES)]
    return [(x & np.uint64(DIM - 1)).astype(np.int64) for x in slots]


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in words_of(batch.column(1), prefixes=PREFIXES):
            text = words.texts()
            keys = np.concatenate([text * DIM + s for s in _slots(words)]) if len(text) else np.zeros(0, np.int64)
            keys, counts = np.unique(keys, return_counts=True)
            owner = keys // DIM
            share = (counts / np.maximum(words.count[owner], 1)).astype(np.float32)
            at = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(at, pa.array((keys % DIM).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(share))], ["toxic", "slot", "share"]
            )


@dataclass
class Model:
    of_share: np.ndarray
    of_presence: np.ndarray
    bias: float
    prior: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for a, b, words in words_of(column, prefixes=PREFIXES):
            text = words.texts()
            total, there = np.zeros(b - a), []
            for s in _slots(words):
                total += np.bincount(text, self.of_share[s], minlength=b - a)
                hit = np.flatnonzero(self.of_presence[s])
                there.append(text[hit] * DIM + s[hit])
            keys = np.unique(np.concatenate(there))
            out[a:b] = self.bias + total / np.maximum(words.count, 1) + np.bincount(keys // DIM, self.of_presence[keys % DIM], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def choose_slots(rows: DataFrame) -> list[int]:
    """The slots that P has more of than U, by their share or by the texts that have them, in standard errors.

    Spark sums each slot's moments; no more than the chosen slots reach the driver.
    """
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    flat = rows.select("toxic", F.explode(F.arrays_zip("slot", "share")).alias("x")).select("toxic", F.col("x.slot").alias("slot"), F.col("x.share").cast("double").alias("share"))
    of = lambda which, v: F.sum(F.when(F.col("toxic") == which, v).otherwise(0.0))
    one = F.lit(1.0)
    sums = flat.groupBy("slot").agg(*[of(w, v).alias(f"{k}{w}") for w in (1, 0) for k, v in (("s", F.col("share")), ("q", F.col("share") ** 2), ("c", one))])

    def z(first: str, second: str) -> Column:
        mean = {w: F.col(f"{first}{w}") / n[w] for w in (1, 0)}
        var = {w: F.greatest(F.col(f"{second}{w}") / n[w] - mean[w] ** 2, F.lit(0.0)) for w in (1, 0)}
        # a slot that P holds by chance has no variance to speak of; U's lends it some
        return (mean[1] - mean[0]) / F.sqrt((var[1] + var[0]) / n[1] + var[0] / n[0] + 1e-9)

    sums = sums.select("slot", z("s", "q").alias("share"), z("c", "c").alias("presence"))
    chosen = [sums.filter(F.col(by) > LEAST_Z).orderBy(F.desc(by), "slot").limit(CHOSEN).select("slot") for by in ("share", "presence")]
    return sorted({r["slot"] for r in chosen[0].union(chosen[1]).collect()})


def _dense(slots: list[int]):
    """Each row's shares of the chosen slots."""
    column = np.full(DIM, -1, np.int32)
    column[slots] = np.arange(len(slots))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, share = batch.column(1), batch.column(2)
            at = np.asarray(slot.offsets) - slot.offsets[0].as_py()
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            c = column[np.asarray(slot.flatten())]
            own = c >= 0
            out = np.zeros((len(batch), len(slots)), np.float32)
            out[row[own], c[own]] = np.asarray(share.flatten())[own]
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(slots), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["toxic", "x"])

    return run


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 1500, batch: int = 512, rate: float = 0.02, decay: float = 1e-2, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on the non-negative risk with the logistic loss.

    ``xp`` and ``xu`` hold shares of slots in P and U; gives each slot's
    weights, of its share and of being there, and the bias.
    """
    rng = np.random.default_rng(seed)
    xp, xu = (np.hstack([x, x > 0]).astype(np.float64) for x in (xp, xu))
    n = xp.shape[1]
    scale = 1 / np.maximum(np.sqrt(xu.var(0) + xp.var(0)), 1e-6)
    xp, xu = np.hstack([xp * scale, np.ones((len(xp), 1))]), np.hstack([xu * scale, np.ones((len(xu), 1))])
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        p, u = xp[rng.choice(len(xp), min(len(xp), batch), replace=False)], xu[rng.choice(len(xu), min(len(xu), batch), replace=False)]
        fp, fu = p @ w, u @ w
        sig_p, sig_u = 1 / (1 + np.exp(-np.clip(fp, -60, 60))), 1 / (1 + np.exp(-np.clip(fu, -60, 60)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:  # d/df: P's loss as positives, then U's loss less P's share of it
            gp, gu = prior * ((sig_p - 1) - sig_p) / len(p), sig_u / len(u)
        else:
            gp, gu = prior * sig_p / len(p), -sig_u / len(u)
        g = gp @ p + gu @ u
        g[:n] += decay * w[:n]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        step = rate * (1 - t / steps) + 1e-3
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    share, presence = (w[:n] * scale).reshape(2, -1)
    return share, presence, float(w[n])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, key: str = "doc_id", text: str = "text", most_p: int = 3000, most_u: int = 6000) -> Model:
    """A model from labelled rows outside the held-out fold, ``most_p`` toxic and ``most_u`` of any label at most.

    The class prior is the share of toxic labels there.  Null labels and ids
    are not used; an id that is labelled twice counts once in U, and in P if
    any of its labels is toxic; ties in the order of the samples go to the
    smaller id.  Without positives, or without labels at all, the model says
    0.5 less a little for every text.
    """
    small_batches(docs.sparkSession)
    with_checkpoints(docs.sparkSession)
    known = labels.select(F.col(key).alias("k"), F.col("toxic").alias("toxic")).filter(F.col("k").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("k"), folds) != held))
    n, total = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    nothing = np.zeros(DIM, np.float32)
    if not n or not total:
        return Model(nothing, nothing, -0.01, 0.0)
    prior = min(max(total / n, 1e-3), 0.9)
    order = F.xxhash64(F.col("k"), F.lit(11))
    pos = known.filter("toxic = 1").select("k").distinct().orderBy(order, "k").limit(most_p).select("k", F.lit(1).alias("toxic"))
    unl = known.select("k").distinct().orderBy(order, "k").limit(most_u).select("k", F.lit(0).alias("toxic"))
    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(pos.unionByName(unl)), "k")
    rows = chosen.select("toxic", "text").mapInArrow(_features, "toxic int, slot array<int>, share array<float>").checkpoint()
    if rows.select("toxic").distinct().count() < 2:
        return Model(nothing, nothing, -0.01, prior)
    slots = choose_slots(rows)
    table = rows.mapInArrow(_dense(slots), "toxic int, x array<float>").toArrow()
    toxic = table["toxic"].to_numpy()
    x = np.asarray(pa.chunked_array([c.flatten() for c in table["x"].chunks], pa.float32())).reshape(len(toxic), len(slots))
    share, presence, bias = fit_nnpu(x[toxic == 1], x[toxic == 0], prior)
    model = Model(nothing.copy(), nothing.copy(), bias, prior)
    model.of_share[slots], model.of_presence[slots] = share, presence
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no features and get the model's bias; repeated
    rows each get a row; very long texts are scored whole; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores(batch.column(2)))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key), folds) == held).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, with all their columns.

    Null and empty texts stay if the model's bias is under 0.5, which a prior
    under a half makes so; repeated rows stay or go together; an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
