"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

A cut depends on the last 32 bytes only, so a passage is cut alike wherever it stands, but for its edges. Chunks are short and end with a word, or with
a character where there is no white space; text goes only where a run of chunks that stand elsewhere before is long enough, so shared phrases and
headings stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts
from verdigraph.plans.lineage import cut
from verdigraph.plans.skew import hub_join

#: One in CUT_EVERY word ends is a cut. After BARE bytes without white space, one in BARE_EVERY ends of characters is.
CUT_EVERY = 5
BARE, BARE_EVERY = 32, 32
#: A run is removed from MIN_RUN words on; where words are longer than that on average, each WORD_BYTES bytes count as a word.
MIN_RUN = 18
WORD_BYTES = 16
BLOCK = 1 << 20
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _gear(b: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte k before] << k over the last 32 bytes: sums of 1, 2, 4, 8 and 16 bytes double each time."""
    h = GEAR[b]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(end of each chunk in bytes, its length in words). A very long text goes through in blocks that overlap by the window.

    Words are those that begin in the chunk, or its bytes by WORD_BYTES if that is more.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.frombuffer(data, np.uint8)
    cuts, starts = [], []
    for at in range(0, len(whole), BLOCK):
        low = max(0, at - 64)
        b = whole[low : at + BLOCK + 1]
        n = min(BLOCK, len(whole) - at)
        space = _SPACE[b]
        h = _gear(b)
        hit = space & ((h >> np.uint32(12) & np.uint32(0xFF)) % np.uint32(CUT_EVERY) == 0)
        if np.diff(np.flatnonzero(space), prepend=-1, append=len(b)).max() > BARE:
            spaces = np.cumsum(space, dtype=np.int32)
            bare = np.zeros(len(b), bool)
            bare[BARE - 1 :] = spaces[BARE - 1 :] == np.concatenate([[0], spaces[:-BARE]])
            whole_character = np.concatenate([b[1:] & 0xC0 != 0x80, [True]])
            hit |= bare & whole_character & (h >> np.uint32(12) & np.uint32(BARE_EVERY - 1) == 0)
        first = np.concatenate([[low == 0], space[:-1]]) & ~space
        cuts.append(np.flatnonzero(hit[at - low : at - low + n]) + at + 1)
        starts.append(np.flatnonzero(first[at - low : at - low + n]) + at)
    ends = np.concatenate([*cuts, [len(whole)]])
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
    words = np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)
    return ends, np.maximum(words, np.diff(ends, prepend=0) // WORD_BYTES)


def digests(data: bytes, ends: np.ndarray) -> list[int]:
    at = [0, *ends.tolist()]
    return [xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(at, at[1:], strict=False)]


def _long_runs(seen: np.ndarray, words: np.ndarray, min_run: int) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of seen chunks with at least ``min_run`` words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], seen.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if words[a:b].sum() >= min_run]


def _repeats(own: list[int]) -> np.ndarray:
    """Which chunks stand earlier in the same text."""
    known: set[int] = set()
    return np.array([d in known or known.add(d) is not None for d in own], bool)


def without_runs(text: str, elsewhere: set[int], min_run: int = MIN_RUN) -> tuple[str, int, list[dict]]:
    """(text, removed words, removed code point spans) without the long runs of chunks that are in ``elsewhere`` or earlier in the text."""
    data = text.encode("utf-8", "surrogatepass")
    ends, words = chunk_ends(data)
    own = digests(data, ends)
    seen = _repeats(own) | np.fromiter((d in elsewhere for d in own), bool, len(own))
    kept, spans, removed, at, place = [], [], 0, 0, 0
    starts = np.concatenate([[0], ends])
    for a, b in _long_runs(seen, words, min_run):
        piece = data[at : starts[a]].decode("utf-8", "surrogatepass")
        gone = len(data[starts[a] : starts[b]].decode("utf-8", "surrogatepass"))
        kept.append(piece)
        spans.append({"start": place + len(piece), "end": place + len(piece) + gone})
        place, at = place + len(piece) + gone, starts[b]
        removed += int(words[a:b].sum())
    return "".join([*kept, data[at:].decode("utf-8", "surrogatepass")]), removed, spans


def document_order(docs: DataFrame) -> Column:
    """A number for each document: its doc_id where ids are whole numbers, a hash of other ids; null ids come last, by a hash of the text."""
    kind = dict(docs.dtypes)["doc_id"]
    number = F.col("doc_id").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.shiftright(F.xxhash64("doc_id"), 2)
    return F.coalesce(number, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2))


def dedup_substrings(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with text cut down and removed_words, removed_spans: passages that an earlier document has, or that stand earlier in the text, go.

    Each chunk stays in the first document that has it, at its first place there; a run of at least ``min_run`` words of other chunks is removed whole.
    Documents go by document_order(): by doc_id, null ones last; rows of one doc_id by a hash of their text, and of equal rows one stands before the others.
    A null text stays null, an empty one empty; long ones are read whole. An empty table gives an empty result. Columns of those two names are replaced,
    all others kept, whatever their names. Digests are counted with partial sums; those that very many documents share are not shuffled.
    """

    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts(batches):
            out = []
            for text in texts:
                data = (text or "").encode("utf-8", "surrogatepass")
                ends, words = chunk_ends(data)
                own = digests(data, ends)
                again = _repeats(own)
                out.append((np.unique(np.array(own, np.int64)), bool(words[again].sum() >= min_run)))
            yield pd.DataFrame(out, columns=["digests", "again"])

    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, elsewhere in batches:
            for at in range(0, len(texts), 250):
                pairs = zip(texts.iloc[at : at + 250], elsewhere.iloc[at : at + 250], strict=True)
                rows = [without_runs(t, set(e.tolist()), min_run) if e is not None and t is not None else (None, 0, []) for t, e in pairs]
                yield pd.DataFrame(rows, columns=["text", "removed_words", "removed_spans"])

    who, tie = document_order(docs).alias("who"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    chunks = cut(docs.select(who, tie, F.pandas_udf(chunk, "digests array<long>, again boolean")("text").alias("c")).select("who", "tie", "c.*"), "chunks")
    each = chunks.select("who", "tie", F.explode("digests").alias("digest"))
    shared = cut(each.groupBy("digest").agg(F.count("*").alias("n"), F.min("who").alias("owner")).filter("n > 1"), "shared-chunks")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marks = hub_join(each, shared, ["digest"], "n", total).filter("who > owner").select("who", "tie", "digest")
    marks = marks.unionByName(chunks.filter("again").select("who", "tie", F.lit(None).cast("long").alias("digest")))
    rest = [c for c in docs.columns if c not in ("text", "removed_words", "removed_spans")]
    given = docs.select(who, tie, "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"))
    marks, given = _within_ids(chunks, each, marks, given)
    marks = marks.groupBy("who", "tie").agg(F.collect_set("digest").alias("elsewhere"))
    joined = given.join(marks, ["who", "tie"], "left")
    # Only texts that may lose something go to Python.
    # As its parts are read apart, it must not be taken for something to run once for each.
    run = F.pandas_udf(clean, "text string, removed_words long, removed_spans array<struct<start:int,end:int>>").asNondeterministic()
    found = run(F.when(F.col("elsewhere").isNotNull(), F.col("text")), "elsewhere")
    out = joined.select("doc", "text", found.alias("r"), (F.col("elsewhere").isNotNull() & F.col("text").isNotNull()).alias("changed"))
    text = F.when(F.col("changed"), F.col("r.text")).otherwise(F.col("text"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = [text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c == "text" or c in rest]
    return out.select(*columns, F.coalesce("r.removed_words", F.lit(0).cast("long")).alias("removed_words"), F.coalesce("r.removed_spans", none).alias("removed_spans"))


def _within_ids(chunks: DataFrame, each: DataFrame, marks: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``marks`` and ``given`` where several rows have one place in the order: the chunks that another of them has before are marked too.

    Equal rows are written once more, so that each has a number; all but the first of them get a ``tie`` of their own. Where each row has its own place, as
    usual, nothing of this runs.
    """
    places = chunks.groupBy("who").agg(F.count("*").alias("rows"), F.min("tie").alias("low"), F.max("tie").alias("high")).filter("rows > 1")
    places = cut(places, "shared-places")
    shared, different = places.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(F.col("low") != F.col("high"))).first()
    if not shared:
        return marks, given
    inner = each.join(places.select("who"), "who", "left_semi")
    if different:
        firsts = inner.groupBy("who", "digest").agg(F.min("tie").alias("first"))
        marks = marks.unionByName(inner.distinct().join(firsts, ["who", "digest"]).filter("tie > first").select("who", "tie", "digest"))
    equal = chunks.groupBy("who", "tie").agg(F.count("*").alias("n")).filter("n > 1").select("who", "tie")
    copies = cut(given.join(equal, ["who", "tie"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "equal-rows")
    first = copies.groupBy("who", "tie").agg(F.min("row").alias("row"))
    # A later copy has all its chunks before it. Its tie is its number from below, which no other row of the place has but by a hash of that value.
    later = copies.join(first, ["who", "tie", "row"], "left_anti").withColumn("old", F.col("tie")).withColumn("tie", -1 - F.col("row"))
    own = each.join(equal, ["who", "tie"], "left_semi").distinct().withColumnRenamed("tie", "old")
    marks = marks.unionByName(later.select("who", "tie", "old").join(own, ["who", "old"]).select("who", "tie", "digest"))
    kept = given.join(equal, ["who", "tie"], "left_anti").unionByName(copies.join(first, ["who", "tie", "row"], "left_semi").drop("row"))
    return marks, kept.unionByName(later.drop("row", "old"))


def op9_substrings(spark, sf_dir):
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "text"))
