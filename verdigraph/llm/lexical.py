"""Ranked lexical search: dual-sorted wavelet trees per shard.

A shard is some thousand documents. Its postings stand list by list, each list by falling impact, and a wavelet tree over the document numbers keeps
that order in every node. So the first posting of a list inside a node has the list's largest impact among the node's documents: the sum of these
firsts bounds every score below the node. Nodes are opened best first, and a leaf, one document, has its exact score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts
from verdigraph.plans.lineage import cut

#: Distinct terms of the items that are searched together; their table goes to every task.
TERMS = 200_000
#: Postings and documents of one tree.
POSTINGS, DOCUMENTS = 500_000, 65_536
#: Ranges that are opened together.
RANGES = 4096
#: Letters and digits of ASCII and every byte of other characters stay, A to Z as small letters; the rest parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WaveletTree:
    """The postings (doc, term, impact) of documents 0 to ``n_docs`` - 1, a document at most once for each term.

    Level d has its postings by the first d bits of the document number, then by term, then by falling impact. ``zeros`` counts, for each level, the
    postings before each place that go to the left child; so a range of one level gives its ranges in both children.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order].astype(np.int32), impact[order].astype(np.int32)
        self.n, self.depth, self.n_docs = len(doc), (n_docs - 1).bit_length(), n_docs
        self.term = term[order]
        zeros, impacts = [], [impact]
        for d in range(self.depth):
            to = doc >> (self.depth - 1 - d)
            zeros.append(np.concatenate([[0], np.cumsum(1 - (to & 1))]).astype(np.int32))
            order = np.argsort(to, kind="stable")
            doc, impact = doc[order], impact[order]
            impacts.append(impact)
        self.zeros = np.concatenate(zeros) if zeros else np.zeros(0, np.int32)
        self.impacts = np.concatenate(impacts)

    def _bounds(self, level: np.ndarray, at: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        first = self.impacts[level[:, None] * self.n + np.minimum(at, self.n - 1)]
        return np.where(at < end, first, 0).astype(np.int64) @ weight

    def top(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` highest sums of weight times impact above 0, equal ones by document number."""
        at, end = np.searchsorted(self.term, term, "left"), np.searchsorted(self.term, term, "right")
        held = (at < end) & (weight > 0)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not held.any():
            return docs, scores
        weight = weight[held].astype(np.int64)
        one = np.zeros(1, np.int64)
        root = self._bounds(one, at[held][None], end[held][None], weight)
        # Nodes of one entry: level, number among the level's nodes, first and last place, bound, terms, and each term's range.
        heap = [(-int(root[0]), 0, (one, one, one, one + self.n, root, np.arange(len(weight)), at[held][None], end[held][None]))]
        width, serial = max(1, RANGES // len(weight)), 1
        while heap:
            most, _, (level, number, start, stop, bound, cols, at, end) = heapq.heappop(heap)
            if len(docs) >= k:
                if -most < scores[k - 1]:
                    break
                # A node at the kth score still matters if it has a document before the kth.
                live = (bound > scores[k - 1]) | ((bound == scores[k - 1]) & (number << (self.depth - level) < docs[k - 1]))
                level, number, start, stop, bound, at, end = (x[live] for x in (level, number, start, stop, bound, at, end))
            leaf = level == self.depth
            if leaf.any():
                docs, scores = np.concatenate([docs, number[leaf]]), np.concatenate([scores, bound[leaf]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                level, number, start, stop, bound, at, end = (x[~leaf] for x in (level, number, start, stop, bound, at, end))
            if not len(level):
                continue
            base = level * (self.n + 1)
            before = self.zeros[base + start].astype(np.int64)
            left_at, left_end = self.zeros[base[:, None] + at] - before[:, None], self.zeros[base[:, None] + end] - before[:, None]
            middle = start + self.zeros[base + stop] - before
            at, end = at - start[:, None], end - start[:, None]
            at = np.concatenate([start[:, None] + left_at, middle[:, None] + at - left_at])
            end = np.concatenate([start[:, None] + left_end, middle[:, None] + end - left_end])
            level, number = np.tile(level + 1, 2), np.concatenate([2 * number, 2 * number + 1])
            start, stop = np.concatenate([start, middle]), np.concatenate([middle, stop])
            bound = self._bounds(level, at, end, weight[cols])
            order = np.lexsort((number << (self.depth - level), -bound))
            order = order[: np.count_nonzero(bound)]
            for i in range(0, len(order), width):
                own = order[i : i + width]
                has = (at[own] < end[own]).any(0)
                entry = (level[own], number[own], start[own], stop[own], bound[own], cols[has], at[np.ix_(own, has)], end[np.ix_(own, has)])
                heapq.heappush(heap, (-int(bound[own[0]]), serial, entry))
                serial += 1
        return docs, scores


def impacts(tf: np.ndarray, words: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence count of a term adds to a document of ``words`` terms, for each unit of weight; 64-bit integers, division rounds down."""
    m = 25 + (75 * words * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id (0 where it is null, as ``none`` says), words (terms in all), ids and tfs (the terms that ``number`` has) of every document."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts(batches):
            out = []
            for text in texts:
                found = terms(text)
                tf = Counter(map(number.get, found))
                tf.pop(None, None)
                out.append((len(found), [*tf], [*tf.values()]))
            yield pd.DataFrame(out, columns=["words", "ids", "tfs"])

    found = F.pandas_udf(count, "words long, ids array<int>, tfs array<int>")("text")
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), found.alias("found")).select("doc_id", "none", "found.*")


def _search(counted: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the ``k`` best documents of each shard for each of ``asked`` (item, term ids, weights)."""

    def shard(rows: list[tuple]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[:2])
        sizes = [len(r[3]) for r in rows]
        doc = np.repeat(np.arange(len(rows)), sizes)
        ids, tfs = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows]).astype(np.int64)
        words = np.repeat(np.array([r[2] for r in rows], np.int64), sizes)
        tree = WaveletTree(doc, ids, impacts(tfs, words, n_docs, n_terms), len(rows))
        out = []
        for item, own, weights in asked:
            found, scores = tree.top(own, weights, k)
            out += [(item, *rows[d][:2], s) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["item", "none", "doc_id", "score"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(batch.none, batch.doc_id, batch.words, batch.ids, batch.tfs, strict=True):
                rows.append(r)
                size += len(r[3])
                if size >= POSTINGS or len(rows) >= DOCUMENTS:
                    yield shard(rows)
                    rows, size = [], 0
        if rows:
            yield shard(rows)

    hits = counted.filter(F.size("ids") > 0)
    best = hits.mapInPandas(search, "item long, none boolean, doc_id long, score long")
    return best.select("item", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``, exactly.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; only A to Z are lower-cased. The score is the sum, over the
    item's terms with repeats, of weight times impact (see ``impacts``); the weight is floor(1000 ln((2N + 2) / (2 df + 1))). Documents with score 0
    aren't returned, equal scores come by ascending doc_id (null last).
    A null or empty text has no terms: as an item it has no result, as a document it isn't found and doesn't count. Repeated documents are each found,
    repeated items each answered. Texts are read whole. Empty tables give an empty result. Other columns aren't read, whatever their names.

    Shards are runs of the scan, so documents are not shuffled and a hot doc_id has no task of its own. Items with more than ``most_terms`` terms
    in all are searched in several rounds, each over all documents: what is sent to the tasks stays bounded.
    """
    spark = docs.sparkSession
    parse = F.pandas_udf(lambda texts: texts.map(lambda t: terms(t)), "array<binary>")
    rows = cut(items.select("item_id", F.monotonically_increasing_id().alias("item"), parse(F.coalesce("text", F.lit(""))).alias("terms")), "lexical-items")
    sizes = F.size(F.array_distinct("terms"))
    rounds = max(1, -(-(rows.agg(F.sum(sizes)).first()[0] or 0) // most_terms))
    texts, out, totals = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), [], None
    for i in range(rounds):
        # Bounded: about most_terms terms in each round.
        own = [(r.item, Counter(map(bytes, r.terms))) for r in rows.filter(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i).select("item", "terms").collect()]
        number = {t: j for j, t in enumerate(sorted({t for _, found in own for t in found}))}
        counted = cut(_counted(texts, number), "lexical-counts")
        if totals is None:
            totals = counted.agg(F.count_if(F.col("words") > 0), F.coalesce(F.sum("words"), F.lit(0))).first()
        df = dict(map(tuple, counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect()))
        asked = []
        for item, found in own:
            ids = np.array([number[t] for t in found], np.int64)
            weights = [n * math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * df.get(number[t], 0) + 1))) for t, n in found.items()]
            asked.append((item, ids, np.array(weights, np.int64)))
        out.append(_search(counted, asked, *totals, k))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    few = rows.select("item", "item_id")
    return ranked.join(few, "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark, sf_dir):
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS ts FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
asked AS (SELECT item, item_id, term, count(*) AS n FROM (SELECT item, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
held AS (SELECT r, doc_id, words, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS words, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, n_docs),
scored AS (
  SELECT item, item_id, r, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * words * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term), total GROUP BY item, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
