"""Toxicity: subword-bag embeddings, averaged over short windows of words, into a linear softmax; both are trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts

BITS = 17
SIZES = (3, 4, 5, 6)
WINDOW = 8
#: Places of a text at which n-grams are read at once; results don't depend on it.
CHUNK = 1 << 18
SPACE = np.uint32(32)
#: Parts of the sample, each scored by a model of the others to set the curve.
FOLDS = 3
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x9E3779B9)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points; each run of white space and control characters is one space, and one stands at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[SPACE], np.where(c <= 32, SPACE, c), [SPACE]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != SPACE) | (c[:-1] != SPACE)])]


def subwords(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, number of the word of each, words of the text): character n-grams of all words with their marks, and each whole word, part by part.

    An n-gram may begin or end with the space beside a word but has none inside. A word that only repeats the one before it is left out.
    """
    c = _codes(text)
    space = c == SPACE
    at = np.flatnonzero(space)
    words = len(at) - 1
    if words <= 0:
        return
    whole = np.zeros(words, np.uint64)
    mixed = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(space, dtype=np.int32)
    mixed = np.cumsum((mixed ^ (mixed >> np.uint64(29))) * (np.arange(len(c)) - at[ends - 1] + 1).astype(np.uint64), dtype=np.uint64)
    whole = mixed[at[1:] - 1] - mixed[at[:-1]]
    fresh = np.concatenate([[True], whole[1:] != whole[:-1]])
    number, n_words = np.cumsum(fresh) - 1, int(fresh.sum())
    yield ((whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.uint32)[fresh], number[fresh], n_words
    for low in range(0, len(c), CHUNK):
        part, marks = c[low : low + CHUNK + max(SIZES) - 1], ends[low : low + CHUNK + max(SIZES) - 1]
        h = part * np.uint32(_MULTIPLIERS[0])
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            h = (h[:-1] ^ (part[n - 1 :] * np.uint32(_MULTIPLIERS[n - 1]))) * np.uint32(0x01000193)
            if n in SIZES:
                first = np.flatnonzero(marks[n - 2 : len(part) - 1][:CHUNK] == marks[: len(part) - n + 1][:CHUNK])
                word = marks[first] - 1
                kept = fresh[word]
                mixed = h[first[kept]]
                yield (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), number[word[kept]], n_words


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last + 1) of each window of WINDOW words, half a window apart; a shorter text is one window."""
    start = np.arange(0, max(1, n - WINDOW // 2), WINDOW // 2)
    return start, np.minimum(start + WINDOW, n)


class Model(NamedTuple):
    """bucket_logits: what a bucket adds to logit(toxic) - logit(not); a word has the mean of its buckets, a window the mean of its words."""

    bucket_logits: np.ndarray
    bias: float
    slope: float
    shift: float

    def logit(self, text: str | None) -> float:
        """The largest window's; that of a text without words is minus infinity."""
        sums = counts = None
        for buckets, word, n in subwords(text or ""):
            if sums is None:
                sums, counts = np.zeros(n), np.zeros(n)
            sums += np.bincount(word, self.bucket_logits[buckets], n)
            counts += np.bincount(word, minlength=n)
        if sums is None:
            return -np.inf
        upto = np.concatenate([[0.0], np.cumsum(sums / np.maximum(counts, 1))])
        start, end = _windows(len(sums))
        return float((upto[end] - upto[start]).max()) / WINDOW + self.bias

    def score(self, text: str | None) -> float:
        """The curve at the text's logit: 0 for a text without words."""
        logit = self.logit(text)
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))) if logit > -np.inf else 0.0


class Bag(NamedTuple):
    """The buckets of a text in the order of its words, where each word's begin (one more than words), how many it has, and the text's windows."""

    buckets: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    windows: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, text: str) -> Bag | None:
        parts = list(subwords(text))
        if not parts:
            return None
        word = np.concatenate([w for _, w, _ in parts])
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(parts[0][2] + 1))
        return cls(np.concatenate([b for b, _, _ in parts])[order], starts, np.diff(starts), _windows(parts[0][2]))

    def best(self, logits: np.ndarray) -> tuple[int, float]:
        """(number of the window with the largest logit, that logit)."""
        each = np.add.reduceat(logits[self.buckets], self.starts[:-1]) / self.sizes
        upto = np.concatenate([[0.0], np.cumsum(each)])
        start, end = self.windows
        sums = (upto[end] - upto[start]) / WINDOW
        return int(sums.argmax()), float(sums.max())

    def window(self, number: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of one window, or of the mean of all: the weights average a word's buckets, then the words."""
        n, (start, end) = len(self.sizes), self.windows
        if number is None:
            held = np.bincount(np.concatenate([start, end]), np.repeat([1.0, -1.0], len(start)), n + 1).cumsum()[:n] / WINDOW / len(start)
            low, high = 0, n
        else:
            low, high = int(start[number]), int(end[number])
            held = np.full(high - low, 1 / WINDOW)
        size = self.sizes[low:high]
        return self.buckets[self.starts[low] : self.starts[high]], np.repeat(held / size, size)


def fit(texts: list[str], toxic: list[int], weights: list[float] | None = None, **options) -> Model:
    """Embeddings and softmax trained together on the window of each text that scores highest so far, then a logistic curve through the texts' logits.

    The curve is set by logits that a text gets from a model that hasn't seen it: one for each of FOLDS parts of the texts. ``weights`` undo an uneven sample.
    """
    y = np.asarray(toxic, int)
    weights = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    bags = [Bag.of(t) for t in texts]
    kept = [i for i, bag in enumerate(bags) if bag]
    bags, y, weights = [bags[i] for i in kept], y[kept], weights[kept]
    if not len(y) or y.min() == y.max():
        rate_of = float(y[0]) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 6.0 if rate_of else -6.0)
    fold = np.random.default_rng(23).permutation(len(y)) % FOLDS
    logit = np.zeros(len(y))
    for k in range(FOLDS):
        logits, bias = _embed(bags, y, np.flatnonzero(fold != k), **options)
        for i in np.flatnonzero(fold == k):
            logit[i] = bags[i].best(logits)[1] + bias
    return Model(*_embed(bags, y, np.arange(len(y)), **options), **_curve(logit, y, weights))


def _embed(bags: list[Bag], y: np.ndarray, rows: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 1.0, batch: int = 16, decay: float = 1.0, seed: int = 11) -> tuple[np.ndarray, float]:
    """(bucket_logits, bias) of embeddings and a softmax over them, by batches with steps that shrink as a bucket has been met (Adagrad)."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    u = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gu = np.full(1 << BITS, 1e-2, np.float32), np.full((dim, 2), 1e-2, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            if at % (8 * batch) == 0:
                logits = e @ (u[:, 1] - u[:, 0])
            picks = []
            for i in order[at : at + batch]:
                if epoch == 0:
                    picks.append((*bags[i].window(None), y[i]))
                    continue
                picks.append((*bags[i].window(bags[i].best(logits)[0]), y[i]))
                if not y[i]:
                    picks.append((*bags[i].window(int(rng.integers(len(bags[i].windows[0])))), 0))
            sizes = np.array([len(b) for b, _, _ in picks])
            ids, s = np.concatenate([b for b, _, _ in picks]), np.concatenate([w for _, w, _ in picks]).astype(np.float32)
            z = np.add.reduceat(e[ids] * s[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            p = z @ u + bias
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(picks)), [k for _, _, k in picks]] -= 1
            pull = np.repeat(p @ u.T, sizes, 0) * s[:, None]
            met, back = np.unique(ids, return_inverse=True)
            pull = np.stack([np.bincount(back, pull[:, d], len(met)) for d in range(dim)], 1).astype(np.float32) + decay * e[met] / len(rows)
            ge[met] += (pull * pull).mean(1)
            e[met] -= rate * pull / np.sqrt(ge[met])[:, None]
            step = z.T @ p
            gu += step * step
            u -= rate * 0.2 * step / np.sqrt(gu)
            bias -= 0.01 * p.sum(0)
    return (e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """Slope and shift of a logistic curve by Newton steps with a weak prior."""
    scale = max(float(x.std()), 1e-6)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        grad = design.T @ (w * (p - y)) + 0.05 * theta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return {"slope": max(float(theta[0] / scale), 1e-6), "shift": float(theta[1])}


def train(docs: DataFrame, labels: DataFrame, rows: int = 3000, longest: int = 20_000, seed: int = 5, most_chars: int = 12_000_000) -> Model:
    """A model from a bounded sample of the labelled rows of ``docs(doc_id, text)``: about ``rows`` of at most ``longest`` code points, a half toxic if
    there are so many, and ``most_chars`` code points in all (their n-grams take about 14 bytes each). Draws go by a hash of doc_id. Null texts and labels other than 0 and 1 teach nothing; of a doc_id with several labels, the largest counts; of
    one with several texts, each does. Without labels of both kinds all texts get one score, of the kind there is (none: not toxic)."""
    one = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    share = {k: min(1.0, rows / 2 / max(n, 1)) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    wanted = F.when(F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))) * 1_000_000
    # From 0 to 1 for either kind, so that a shorter sample has both in the same shares.
    picked = one.withColumn("_draw", draw / wanted).filter(F.col("_draw") < 1).orderBy("_draw", "doc_id").limit(2 * rows)
    # At most 2 * rows pairs of numbers, so the texts need no shuffle.
    known = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= longest))
    drawn = known.join(F.broadcast(picked), "doc_id")
    ends, total = 1.0, 0
    for r in drawn.select("_draw", "doc_id", F.length("text").alias("n")).orderBy("_draw", "doc_id", "n").limit(2 * rows).collect():
        total += r.n
        if total > most_chars:
            ends = r["_draw"]
            break
    sample = drawn.filter(F.col("_draw") < ends).orderBy("_draw", "doc_id", "text").limit(2 * rows).select("text", "toxic").collect()
    return fit([r["text"] for r in sample], [r["toxic"] for r in sample], [1 / share[r["toxic"]] for r in sample])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on). Texts are read whole, long ones part by part; a null text counts as empty,
    one without words has score 0. Columns of those two names are replaced, all others stay, whatever their names; rows don't depend on each other, so repeated
    ones get equal scores. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts(batches):
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.pandas_udf(run, "double")("text").alias("score"))
    return scored.select("doc.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", "toxic")
    return score_toxicity(docs, train(docs.filter("not held_out"), labels)).drop("text")
