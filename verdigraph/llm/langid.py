"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts

#: ISO codes by family; a code that is missing is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "rm", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "semitic": ("ar", "he", "am", "mt"),
}
UNDETERMINED = "und"
BITS = 13
#: Code points that are put through at once, so that a very long text takes no more memory.
CHUNK = 1 << 18


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes), lang)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _count(c: np.ndarray, n: int) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of code points that begin at the first ``n`` places."""
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    grams = np.concatenate([one[:n], two[:n] * np.uint32(0x165667B1), three[:n] * np.uint32(0x9E3779B1)])
    return np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, values) of the hashed 1- to 3-grams of the lower-cased letters, words padded by a space; None without a letter.

    Values are square roots of shares, so their length is 1. A text goes through in chunks, each with the last two places of the one before; the
    result doesn't depend on where they end. A sigma at the end of a word counts as any other.
    """
    if not text:
        return None
    counts, held, any_letter = np.zeros(1 << BITS, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK].lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), np.uint32)
        known = _letters()[c]
        any_letter |= bool(known.any())
        ends = [] if at + CHUNK < len(text) else [np.array([32], np.uint32)]
        c = np.concatenate([held, np.where(known, c, np.uint32(32)), *ends])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        n = len(c) if ends else max(0, len(c) - 2)
        counts += _count(c, n)
        held = c[n:]
    if not any_letter:
        return None
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.uint16), np.sqrt(counts[buckets] / counts.sum()).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss for y in -1, 1: dual coordinate descent over the rows in random order."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    margin = 1 / (2 * cost)
    norm = np.array([float(values @ values) for _, values in rows]) + 1 + margin
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            buckets, values = rows[i]
            step = (1 - y[i] * (w[buckets] @ values + bias) - margin * alpha[i]) / norm[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                w[buckets] += (new - alpha[i]) * y[i] * values
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return np.append(w, bias).astype(np.float32)


class Model(NamedTuple):
    families: list[str]
    family_weights: np.ndarray
    langs: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is how far the decisions are from even, from 0 to 1."""
        found = features(text) if self.families else None
        if found is None:
            return UNDETERMINED, 0.0
        at, x = np.append(found[0].astype(np.int64), 1 << BITS), np.append(found[1], np.float32(1))
        margins = self.family_weights[:, at] @ x
        best = int(margins.argmax())
        others = np.delete(margins, best)
        score = _sigmoid(2 * float(margins[best] - others.max())) if len(others) else 1.0
        langs = self.langs[self.families[best]]
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes:
                m = float(w[at] @ x)
                votes[a if m > 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        lang = max(langs, key=lambda v: (votes[v], sums[v], v))
        return lang, score * (_sigmoid(4 * sums[lang] / (len(langs) - 1)) if len(langs) > 1 else 1.0)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from texts and their languages."""
    return fit_features([features(t) for t in texts], langs)


def fit_features(found: list[tuple[np.ndarray, np.ndarray] | None], langs: list[str]) -> Model:
    """Family machines against all other families, and a machine for each two languages of a family. Rows without a letter teach nothing."""
    got = [(f, lang) for f, lang in zip(found, langs, strict=True) if f is not None]
    if not got:
        return Model([], np.zeros((0, 0), np.float32), {}, {})
    rows, own = [f for f, _ in got], np.array([lang for _, lang in got])
    names = np.array([family(v) for v in own])
    families = sorted(set(names))
    weights = [fit_svm(rows, np.where(names == f, 1.0, -1.0)) if len(families) > 1 else np.zeros((1 << BITS) + 1, np.float32) for f in families]
    inside = {f: sorted(set(own[names == f])) for f in families}
    pairs = {}
    for two in inside.values():
        for a, b in combinations(two, 2):
            at = np.flatnonzero((own == a) | (own == b))
            pairs[a, b] = fit_svm([rows[i] for i in at], np.where(own[at] == a, 1.0, -1.0))
    return Model(families, np.array(weights), inside, pairs)


def _packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts(batches):
        found = [features(t) for t in texts]
        yield pd.Series([None if f is None else f[1].tobytes() + f[0].tobytes() for f in found], dtype=object)


def _unpacked(packed: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    if packed is None:
        return None
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint16, n, 4 * n), np.frombuffer(packed, np.float32, n)


def train(docs: DataFrame, rows: int = 2400, seed: int = 5, least: int = 20, most_langs: int = 1000) -> Model:
    """A model from a bounded sample of ``docs(doc_id, text, lang)``: about ``rows`` rows, shared evenly by the languages; texts of any length are in it.
    With many languages it grows, to about ``least`` rows (or all there are) for each. Only the ``most_langs`` languages with the most rows are learned, of
    equal ones the first by name. The sample goes by a hash of doc_id and text, so it doesn't depend on the order of rows, and rows of one doc_id are drawn
    apart. Features, 48 KB for a text at most, are computed where the texts are; only those of the sample come to the driver. Rows with a null text or lang
    teach nothing; without any row the model knows no language."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return fit([], [])
    each = max(least, rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1_000_000))
    limits = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1_000_000, -(-1_000_000 * each // n)))])
    drawn = known.select("doc_id", "text", "lang", draw.alias("draw")).filter(F.col("draw") < F.try_element_at(limits, F.col("lang")))
    packed = drawn.select("draw", "doc_id", "lang", F.pandas_udf(_packed, "binary")("text").alias("found"))
    sample = packed.orderBy("draw", "doc_id", "lang", "found").limit(2 * max(rows, each * len(counts))).select("found", "lang").collect()
    return fit_features([_unpacked(r["found"]) for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score. A null text or one without a letter is UNDETERMINED with score 0, as is all if the model knows no language.

    Texts are read whole, long ones in chunks. Columns of those two names are replaced, all others stay, whatever their names; rows don't depend on
    each other, so repeated rows get equal results; an even vote goes to the larger sum, then to the later name. An empty table gives an empty result.
    """

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts(batches):
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    # A filter on what it finds must not make it run a second time beside itself.
    found = F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()("text")
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), found.alias("found")).select("doc.*", "found.*")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs.select("doc_id", "text", "held_out"), train(docs.filter("not held_out"))).drop("text")
