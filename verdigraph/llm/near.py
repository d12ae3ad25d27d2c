"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Documents with one and the same n-gram set form a class, which goes through as one row. Bands tie classes into clusters of candidates; a cluster is
compared in cells of bounded size, each pair of its blocks once, and a cell gives back counts and a spanning forest of links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts
from verdigraph.llm.components import components
from verdigraph.plans.lineage import cut
from verdigraph.plans.skew import hub_join

SIZE = 5
#: N-grams of one block of a cell: two blocks and their index stay within some hundred MB.
BLOCK = 1_500_000
CHUNK = 1 << 12


def bands_for(threshold: float, recall: float, most_hashes: int = 140) -> tuple[int, int]:
    """(bands, rows): the most rows, for the fewest false candidates, with which a pair at ``threshold`` shares a band with probability ``recall``."""
    found = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows <= most_hashes:
            found = (bands, rows)
    if found is None:
        raise ValueError("no number of bands reaches this recall within most_hashes")
    return found


def grams(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(each) - size + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(min(size, len(each))):
        h = (h ^ each[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return np.unique(h)


@cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(g: np.ndarray, bands: int, rows: int) -> list[int]:
    """A 64-bit key for each band of MinHash values."""
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(g), CHUNK):
        low = np.minimum(low, (g[at : at + CHUNK, None] * _multipliers(bands * rows)).min(0))
    keys = np.zeros(bands, np.uint64)
    for j in range(rows):
        keys = (keys ^ low[j::rows]) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def _class(g: np.ndarray) -> bytes | None:
    return hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None


def with_classes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, row, cls (null without words), n_grams and keys for each row of ``docs(doc_id, text)``; ``row`` is row_key()."""

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts(batches):
            out = []
            for text in texts:
                g = grams(text)
                out.append((_class(g), len(g), signature(g, bands, rows) if len(g) else None))
            yield pd.DataFrame(out, columns=["cls", "n_grams", "keys"])

    found = F.pandas_udf(sign, "cls binary, n_grams long, keys array<long>")("text")
    return docs.select("doc_id", row_key().alias("row"), found.alias("found")).select("doc_id", "row", "found.*")


def row_key() -> Column:
    """A 128-bit digest of doc_id and text, the same for repeated rows only."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))))


def compare(members: pd.DataFrame, threshold: float, bands: int, rows: int) -> pd.DataFrame:
    """cls, root, links of the members (text, cls, copies, block, left, right) of one cell: all pairs of its two blocks that share a band.

    ``root`` names the first class that a class is tied to inside this cell; ``links`` counts documents, copies included.
    """
    got = {}
    for text, cls, copies, block in zip(members.text, members.cls, members.copies, members.block, strict=True):
        if _class(g := grams(text)) != bytes(cls):
            raise ValueError("two rows have one key but different texts")
        got[bytes(cls)] = (g, int(copies), int(block))
    names = sorted(got)
    sets, copies, block = [got[c][0] for c in names], np.array([got[c][1] for c in names]), np.array([got[c][2] for c in names])
    keys = np.array([signature(g, bands, rows) for g in sets], np.int64).reshape(len(names), bands)
    left, right = int(members.left.iloc[0]), int(members.right.iloc[0])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.zeros(0, int))
    size = np.array([len(g) for g in sets])
    ends = np.cumsum(size)
    starts = ends - size
    held = np.zeros(len(ids) + 1, bool)
    parent = list(range(len(names)))
    links = np.zeros(len(names), np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(names)):
        rest = np.arange(i + 1, len(names))
        if left != right:
            rest = rest[block[rest] != block[i]]
        rest = rest[(np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i])) & (keys[rest] == keys[i]).any(1)]
        if not len(rest):
            continue
        own = ids[starts[i] : ends[i]]
        held[own] = True
        where = np.repeat(starts[rest] - np.concatenate([[0], np.cumsum(size[rest])[:-1]]), size[rest]) + np.arange(size[rest].sum())
        both = np.add.reduceat(held[ids[where]], np.concatenate([[0], np.cumsum(size[rest])[:-1]]), dtype=np.int64)
        held[own] = False
        near = rest[both >= threshold * (size[rest] + size[i] - both) - 1e-9]
        links[i] += copies[near].sum()
        links[near] += copies[i]
        for j in near:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"cls": names, "root": [names[root(i)] for i in range(len(names))], "links": links})


def near_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links: one row for each row of ``docs(doc_id, text)``.

    Two documents are linked if the Jaccard similarity of their sets of 5-word runs (a shorter text is one run) is at least ``threshold``; equal sets have
    1. class_id is the least doc_id of all that links reach, copy_id the least with the same set, n_copies their number, n_links the number of other rows
    linked to this one, copies included. A pair just at the threshold is found with probability ``recall``, closer pairs with more.
    A null text or one without words has no links and is its own class. Repeated rows are copies of each other. Long texts are read whole. An empty table
    gives an empty result; null doc_ids are kept and never name a class that has others. Other columns are not read, whatever their names.
    """
    return _joined(docs, threshold, recall).drop("row", "component")


def _joined(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of near_join with row, their row_key(), and component, which names their class (null without words)."""
    bands, rows = bands_for(threshold, recall)
    signed = cut(with_classes(docs.select("doc_id", "text"), bands, rows), "near-signed")
    by_class = signed.filter("cls is not null").groupBy("cls")
    named_by = [F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.min("row").alias("row"), F.first("keys").alias("keys"), F.first("n_grams").alias("n_grams")]
    classes = cut(by_class.agg(*named_by), "near-classes")
    n_classes = classes.count()
    banded = classes.select("cls", F.posexplode("keys").alias("band", "key"))
    first = banded.groupBy("band", "key").agg(F.min("cls").alias("b"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first, "near-bands")
    ties = hub_join(banded, first, ["band", "key"], "n", bands * n_classes).filter("cls <> b").select(F.col("cls").alias("a"), "b")
    clusters = components(ties).withColumnRenamed("node", "cls")
    members = clusters.join(classes.drop("keys"), "cls")
    blocks = members.groupBy("component").agg(F.sum("n_grams").alias("total")).withColumn("blocks", F.ceil(F.col("total") / BLOCK))
    members = members.join(blocks.drop("total"), "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    # A class goes by the text of one of its rows; a repeated row comes once.
    texts = docs.select("doc_id", "text").select("text", row_key().alias("row"))
    placed = texts.join(members.select("row", "cls", "copies", "component", "block", "blocks"), "row").dropDuplicates(["row"]).drop("row")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    cells = placed.groupBy("component", "left", "right")
    found = cut(cells.applyInPandas(lambda pdf: compare(pdf, threshold, bands, rows), "cls binary, root binary, links long"), "near-found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    named = classes.select("cls", "copy_id", "copies").join(links, "cls", "left").join(reached, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    named = named.join(least, "component").select("cls", "component", "copy_id", "class_id", F.col("copies").alias("n_copies"), n_links.alias("n_links"))
    out = signed.select("doc_id", "row", "cls").join(named, "cls", "left")
    one = F.lit(1).cast("long")
    ids = [F.coalesce(c, "doc_id").alias(c) for c in ("class_id", "copy_id")]
    return out.select("doc_id", *ids, F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("n_links", one - 1).alias("n_links"), "row", "component")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each class: of its least doc_id (null comes last) the one with the least row_key().

    Rows without words stay, of repeated ones one. Columns keep their names, whatever they are. An empty table gives an empty result.
    """
    joined = _joined(docs, **options).select("component", F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = joined.filter("component is not null").groupBy("component").agg(F.min(F.struct("none", "doc_id", "row")).alias("best")).select("best.row")
    kept = best.unionByName(joined.filter("component is null").select("row")).distinct()
    keyed = docs.select(row_key().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return keyed.join(kept, "row").groupBy("row").agg(F.first("doc").alias("doc")).select("doc.*")


def op2_near(spark, sf_dir):
    return near_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
