"""Language-model scoring with a log-bilinear model.

Token counts of all training documents are gathered by Spark.  The ``WORDS``
most frequent tokens have vectors and belong to ``CLASSES`` classes: the
``SINGLE`` most frequent are classes of their own, the others are grouped by
what stands beside them; one more class holds all rarer tokens.  With classes
a and b of the token before and the one before that,

    P(token) = P(class | a, b) * P(token | class, a),

where both parts are log-bilinear: the context's vectors predict the vector of
what comes next.  A token of the last class has its add-one share of it, so
the probabilities of all seen tokens and of one unseen type sum to one.

Both parts are trained in numpy by noise-contrastive estimation.  The
estimator needs a context's next tokens only as counts, so Spark counts every
training position, (a, b, class) and (a, token), and the tables, which are
bounded by the classes and not by the corpus, are what the steps go through:
each data position comes with ``NOISE`` samples drawn from the unigram
distribution.  Counts are integers and samples depend on a seed and the
counts alone, so neither the model nor a score depends on the partitioning.

The normalisers of all contexts are tabulated once by batched matrix
products, so scores are normalised log-probabilities.  What is broadcast is
bounded: the model, and the counts of the ``KNOWN`` most frequent tokens.
Counts of rarer tokens reach the documents through a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.text import NOT_SPACE, Words, mix, small_batches, with_checkpoints, words_of
from linkloom.llm.toxicity import fold

#: Tokens with vectors, tokens that are classes of their own, and classes, without the one of all rarer tokens.
WORDS, SINGLE, CLASSES = 1 << 15, 96, 254
DEPTH = 16
#: Most frequent tokens whose counts every task holds.
KNOWN = 1 << 18
#: Distinct keys that a task holds before it passes counts on.
HELD = 1 << 20
#: The hash of the token that ends a text.
END = np.uint64(0xE7D5B1C3A9F80765)
#: Noise samples of a position, passes over the counts, and the rate of a step.
NOISE, PASSES, RATE = 8, 10, 0.3
#: Directions that a token's neighbours are summed along, for the grouping; and its rounds.
AXES, ROUNDS = 16, 8


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, each text's words and then its end, and where each text begins."""
    of_text = words.of_text + np.arange(len(words.of_text))
    out = np.full(of_text[-1], END)
    at = np.ones(len(out), dtype=bool)
    at[of_text[1:] - 1] = False
    out[at] = words.hash
    return out, of_text


class Tally:
    """Counts of 64-bit keys in bounded memory: full tallies are passed on, to be summed by Spark."""

    def __init__(self, most: int = HELD):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.held))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n, minlength=len(keys)).astype(np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > 2 * self.most:
            self.held = [self._merge()]
            self.size = len(self.held[0][0])
            if self.size > self.most:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, n = self._merge()
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["token", "c"])
        self.held, self.size = [], 0


def tallied(learn: DataFrame, keys: Callable[[Words], np.ndarray]) -> DataFrame:
    """(token, c): how often each key stands in the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, words in words_of(batch.column(0), NOT_SPACE):
                yield from tally.add(keys(words))
        yield from tally.rest()

    return learn.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon:
    """Numbers of the frequent tokens, from 0 in order of frequency; all others have the last one."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known)
        self.keys = known[self.order]
        self.n = len(known)

    def of(self, token: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(token), np.int64)
        at = np.minimum(np.searchsorted(self.keys, token), self.n - 1)
        return np.where(self.keys[at] == token, self.order[at], self.n)


def before(ids: np.ndarray, of_text: np.ndarray, start: int, by: int) -> np.ndarray:
    """What stands ``by`` places before each token of its text; ``start`` before a text's first."""
    out = np.full(len(ids), start)
    out[by:] = ids[:-by] if len(ids) > by else ids[:0]
    for i in range(by):
        first = of_text[:-1] + i
        out[first[first < of_text[1:]]] = start
    return out


def neighbours(lexicon: Lexicon, single: int = SINGLE):
    """For each task: sums over a token's neighbours of fixed signs of the frequent tokens, whole numbers."""
    signs = np.where(np.random.default_rng(3).random((single + 2, AXES)) < 0.5, -1, 1).astype(np.int64)
    signs[single:] = 0  # rarer tokens and the start say nothing

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((lexicon.n + 1, AXES), np.int64)
        for batch in batches:
            for _, _, words in words_of(batch.column(0), NOT_SPACE):
                token, of_text = tokens(words)
                ids = lexicon.of(token)
                kind = np.minimum(ids, single)
                one = before(kind, of_text, single + 1, 1)
                after = np.full(len(ids), single + 1)
                after[:-1] = kind[1:]
                after[of_text[1:] - 1] = single + 1
                half = AXES // 2
                for d in range(AXES):
                    value = signs[one, d] if d < half else signs[after, d]
                    sums[:, d] += np.bincount(ids, value, minlength=lexicon.n + 1).astype(np.int64)
        own = np.flatnonzero(sums[: lexicon.n].any(1))
        for i in range(0, len(own), 50_000):
            at = own[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[at, d]) for d in range(AXES))], ["id", *(f"d{d}" for d in range(AXES))])

    return run


def group(profile: np.ndarray, count: np.ndarray, single: int = SINGLE, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each token, most frequent first: singles, then groups of like neighbours by k-means."""
    n = len(profile)
    out = np.arange(n)
    if n <= classes:
        return out
    x = (profile[single:] / np.maximum(count[single:, None], 1)).astype(np.float64)
    weight = np.sqrt(count[single:].astype(np.float64))
    centre = x[np.linspace(0, min(len(x), 8 * (classes - single)) - 1, classes - single).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([np.argmin((centre * centre).sum(1) - 2 * part @ centre.T, axis=1) for part in np.array_split(x, max(1, len(x) // 8192))])
        total = np.bincount(near, weight, minlength=len(centre))
        for d in range(x.shape[1]):
            sums = np.bincount(near, weight * x[:, d], minlength=len(centre))
            centre[:, d] = np.where(total > 0, sums / np.maximum(total, 1e-300), centre[:, d])
    out[single:] = single + near
    return out


class Adagrad:
    """Steps along gradients, each parameter's scaled by the root of its past squares."""

    def __init__(self, **parameters: np.ndarray):
        self.parameters = parameters
        self.squares = {k: np.full_like(x, 1e-8) for k, x in parameters.items()}

    def step(self, rate: float, **gradients: np.ndarray) -> None:
        for k, g in gradients.items():
            self.squares[k] += g * g
            self.parameters[k] += (rate * g / np.sqrt(self.squares[k])).astype(np.float32)


def contrast(s: np.ndarray, data: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The gradient of the estimator by the scores less the log of the noise's rate: data up, noise down."""
    np.clip(s, -30, 30, out=s)
    sigma = 1 / (1 + np.exp(-s))
    return data * (1 - sigma) - noise * sigma


class LogBilinear:
    """s(c | a, b) = (k1 * R[a] + k2 * R[b]) . Q[c] + bias[c] for classes; s(w | a) = T[a] . V[w] + share[w] within a class."""

    def __init__(self, of_word: np.ndarray, count: np.ndarray, rest: float, seed: int = 5):
        """``of_word``: each token's class; ``count``: its count; ``rest``: the weight of the class of all rarer tokens."""
        rng = np.random.default_rng(seed)
        self.of_word = of_word
        self.n = int(of_word.max(initial=-1)) + 2  # with the class of all rarer tokens, the last
        weight = np.bincount(of_word, count + 1.0, minlength=self.n)
        weight[self.n - 1] = rest
        weight = np.maximum(weight, 1e-3)
        self.unigram = (weight / weight.sum()).astype(np.float32)
        vectors = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.r, self.q, self.k = vectors(self.n + 1, DEPTH), vectors(self.n, DEPTH) * 0, np.ones((2, DEPTH), np.float32)
        self.bias = np.log(self.unigram)
        self.t, self.v = vectors(self.n + 1, DEPTH), np.zeros((len(of_word), DEPTH), np.float32)
        self.within = ((count + 1.0) / weight[of_word]).astype(np.float32)  # the unigram share of a token in its class
        self.share = np.log(self.within)

    def fit_classes(self, counts: np.ndarray, passes: int = PASSES, rate: float = RATE, seed: int = 11) -> None:
        """``counts[b, a, c]``: how often class c follows a, and b before it."""
        steps = Adagrad(r=self.r, q=self.q, k=self.k, bias=self.bias)
        shift = np.log(NOISE * self.unigram)
        blocks = np.array_split(np.arange(self.n + 1), min(16, self.n + 1))
        rng = np.random.default_rng(seed)
        for t in range(passes):
            for at in blocks:
                data = counts[at].reshape(-1, self.n)
                seen = data.sum(1)
                own = np.flatnonzero(seen)
                if not len(own):
                    continue
                data, seen = data[own], seen[own]
                b, a = at[own // (self.n + 1)], own % (self.n + 1)
                noise = rng.poisson((NOISE * seen)[:, None] * self.unigram).astype(np.float32)
                ra, rb = self.r[a], self.r[b]
                pred = self.k[0] * ra + self.k[1] * rb
                g = contrast(pred @ self.q.T + (self.bias - shift), data, noise) / seen.sum()
                to = g @ self.q
                into = np.zeros_like(self.r)
                np.add.at(into, a, to * self.k[0])
                np.add.at(into, b, to * self.k[1])
                steps.step(rate * (1 - t / passes) + 0.01, r=into, q=g.T @ pred, k=np.stack([(to * ra).sum(0), (to * rb).sum(0)]), bias=g.sum(0))

    def fit_words(self, counts: Callable[[int, int], np.ndarray], passes: int = PASSES // 2, rate: float = RATE, seed: int = 13, block: int = 4096) -> None:
        """``counts(i, j)``: how often each token from i to j stands after each class, as an array (classes, tokens)."""
        if not len(self.v):
            return
        rng = np.random.default_rng(seed)
        seen = np.zeros((self.n + 1, self.n), np.float64)  # of each class after each
        spans = [(i, min(i + block, len(self.v))) for i in range(0, len(self.v), block)]
        for i, j in spans:
            part = counts(i, j)
            for c in np.unique(self.of_word[i:j]):
                seen[:, c] += part[:, self.of_word[i:j] == c].sum(1)
        total = max(seen.sum(), 1.0)
        steps = Adagrad(t=self.t, v=self.v, share=self.share)
        for p in range(passes):
            into = np.zeros_like(self.t)
            for i, j in spans:
                c = self.of_word[i:j]
                noise = rng.poisson(NOISE * seen[:, c] * self.within[i:j]).astype(np.float32)
                g = contrast(self.t @ self.v[i:j].T + (self.share[i:j] - np.log(NOISE * self.within[i:j])), counts(i, j), noise)
                alone = g.T @ self.t, g.sum(0)
                into += g @ self.v[i:j]
                own = slice(i, j)
                steps.squares["v"][own] += alone[0] ** 2
                steps.squares["share"][own] += alone[1] ** 2
                now = rate * (1 - p / passes) + 0.01
                self.v[own] += (now * alone[0] / np.sqrt(steps.squares["v"][own])).astype(np.float32)
                self.share[own] += (now * alone[1] / np.sqrt(steps.squares["share"][own])).astype(np.float32)
            steps.step(rate * (1 - p / passes) + 0.01, t=into / total)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs: a's part and b's part of a class score, the normaliser of (a, b), and P(w | class, a) of every token."""
        of_a, of_b = (self.k[0] * self.r) @ self.q.T + self.bias, (self.k[1] * self.r) @ self.q.T
        log_z = np.empty((self.n + 1, self.n + 1), np.float32)
        for b in range(self.n + 1):
            s = of_a + of_b[b]
            top = s.max(1)
            log_z[:, b] = top + np.log(np.exp(s - top[:, None]).sum(1))
        word = self.t @ self.v.T + self.share
        by_class = np.argsort(self.of_word, kind="stable")
        first = np.searchsorted(self.of_word[by_class], np.arange(self.n))
        for c in range(self.n - 1):
            own = by_class[first[c] : first[c + 1]]
            s = word[:, own]
            top = s.max(1, keepdims=True) if len(own) else 0.0
            word[:, own] = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        return of_a, of_b, log_z, word

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def log_prob(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural log of P(class c | a, b), times that of token w where it has a vector; tables are made once in a process."""
        if "_made" not in self.__dict__:
            self._made = self.tables()
        of_a, of_b, log_z, word = self._made
        out = of_a[a, c].astype(np.float64) + of_b[b, c] - log_z[a, b]
        known = w < len(self.of_word)
        out[known] += word[a[known], w[known]]
        return out


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, class_part double, base_part double, token long, k long"


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon, keys, counts, rest = shared.value
        log_c = np.log10(counts + 1.0)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, words in words_of(batch.column(2), NOT_SPACE):
                token, of_text = tokens(words)
                text = np.repeat(np.arange(hi - lo), np.diff(of_text))
                ids = lexicon.of(token)
                cls = np.append(model.of_word, model.n - 1)[ids]
                lbl = model.log_prob(before(cls, of_text, model.n, 1), before(cls, of_text, model.n, 2), cls, ids) / np.log(10)
                at = np.minimum(np.searchsorted(keys, token), max(len(keys) - 1, 0))
                have = keys[at] == token if len(keys) else np.zeros(len(token), bool)
                c = np.where(have, log_c[at] if len(keys) else 0.0, 0.0)
                # inside the last class a token has its add-one share; a rarer token's count is added after the join
                lbl += np.where(ids == lexicon.n, c - np.log10(rest), 0.0)
                per = lambda x: np.bincount(text, x, minlength=hi - lo)
                n = hi - lo
                head = [
                    np.arange(rid, rid + n), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), np.diff(of_text), per(have).astype(np.int64),
                    per(lbl), per(c), mix(np.arange(rid, rid + n).astype(np.uint64)).view(np.int64), np.zeros(n, np.int64),
                ]
                yield _batch(head)
                own = ~have
                if own.any():
                    pair = np.stack([text[own], token[own].view(np.int64)])
                    order = np.lexsort(pair[::-1])
                    t, w = pair[0][order], pair[1][order]
                    new = np.concatenate(([True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])))
                    first = np.flatnonzero(new)
                    k = np.diff(np.concatenate((first, [len(t)])))
                    m = len(first)
                    nothing = pa.nulls(m, pa.int64())
                    zero = np.zeros(m)
                    yield _batch([rid + t[first], nothing, pa.nulls(m, pa.bool_()), np.zeros(m, np.int64), np.zeros(m, np.int64), zero, zero, w[first], k])
                rid += n

    return run


def _batch(columns: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in _SCORED.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def frequent(counts: DataFrame, most: int = KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` tokens, the most frequent first, and their counts.

    Counts fall into classes of a thirty-second of a doubling; a histogram of
    those, a few hundred rows, tells which classes fit, and only their tokens
    reach the driver.  No task ranks all tokens.
    """
    bucket = F.floor(F.log2("c") * 32)
    held, least = 0, None
    for b, n in sorted(counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if held + n > most:
            break
        held, least = held + n, b
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best = counts.filter(bucket >= least).toArrow()
    token, c = np.asarray(best["token"].to_numpy(), np.int64), np.asarray(best["c"].to_numpy(), np.int64)
    order = np.lexsort((token, -c))
    return token[order].view(np.uint64), c[order]


def train(learn: DataFrame, lexicon: Lexicon, count: np.ndarray, total: int, distinct: int) -> LogBilinear:
    """A model of the texts of ``learn``; all their positions are counted."""
    shared = learn.sparkSession.sparkContext.broadcast(lexicon)
    columns = [f"d{d}" for d in range(AXES)]
    sums = learn.mapInArrow(lambda batches: neighbours(shared.value)(batches), "id long, " + ", ".join(f"{c} long" for c in columns))
    table = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    profile = np.zeros((lexicon.n, AXES))
    profile[table["id"].to_numpy()] = np.stack([table[c].to_numpy() for c in columns], axis=1)
    of_word = group(profile, count)
    model = LogBilinear(of_word, count.astype(np.float64), float(total - count.sum() + (distinct - lexicon.n) + 1))
    if not total:
        return model
    n, words = model.n, lexicon.n
    of_id = learn.sparkSession.sparkContext.broadcast(np.append(of_word, n - 1))

    def keys(words_: Words) -> np.ndarray:
        """Both tables' cells of all positions: (b, a, class), and after them (a, token)."""
        token, of_text = tokens(words_)
        ids = shared.value.of(token)
        cls = of_id.value[ids]
        a, b = before(cls, of_text, n, 1), before(cls, of_text, n, 2)
        many = ids < words
        pair = (n + 1) ** 2 * n + a[many] * words + ids[many]
        return np.concatenate([(b * (n + 1) + a) * n + cls, pair]).astype(np.uint64)

    cells = tallied(learn, keys).checkpoint()
    size = (n + 1) ** 2 * n
    found = cells.filter(F.col("token") < size).toArrow()
    triples = np.zeros(size, np.float32)
    triples[found["token"].to_numpy()] = found["c"].to_numpy()
    model.fit_classes(triples.reshape(n + 1, n + 1, n))
    del triples, found
    found = cells.filter(F.col("token") >= size).select((F.col("token") - size).alias("token"), "c").toArrow()
    cell, c = found["token"].to_numpy(), found["c"].to_numpy()
    pairs = np.zeros((n + 1, words), np.float32)
    pairs[cell // words, cell % words] = c
    model.fit_words(lambda i, j: pairs[:, i:j])
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose id falls in the held-out fold are scored but not learnt
    from.  Null and empty texts have the end token alone; a null id hashes as
    an empty one; repeated rows each get a row and all count; ties in
    frequency go to the token of the smaller hash; a very long text is one
    slice of a task's work and counts whole; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with_checkpoints(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key), folds) == held).alias("held_out"), F.col(text).alias("text"))
    learn = rows.filter("not held_out").select("text")
    counts = tallied(learn, lambda words: tokens(words)[0]).checkpoint()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    known, known_c = frequent(counts)
    lexicon = Lexicon(known[:WORDS])
    model = train(learn, lexicon, known_c[:WORDS], int(total), int(distinct))
    rest = float(total - known_c[:WORDS].sum() + (distinct - lexicon.n) + 1)  # the last class, add-one, with one unseen type
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((model, lexicon, known[order], known_c[order], rest))
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(_score(shared), _SCORED)
    rare = counts.select(F.col("token").alias("t"), "c") if distinct > len(known) else counts.select(F.col("token").alias("t"), "c").limit(0)
    # a document's own row has k = 0 and a made-up token, so that such rows spread over all tasks
    joined = scored.join(rare, (F.col("token") == F.col("t")) & (F.col("k") > 0), "left")
    more = F.coalesce(F.col("k") * F.log10(F.col("c") + 1.0), F.lit(0.0))
    done = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("k")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.col("class_part") + more).alias("score"), F.sum(F.col("base_part") + more).alias("base"),
    )
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
