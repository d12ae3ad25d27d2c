"""Document fingerprints: the k smallest distinct hashes of a text's word shingles.

Sketches of parts merge into the sketch of the whole; two of them estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Quantiles of the order, and code points of one bucket at least. So many buckets are broadcast at most; with more they have LARGE code points each.
COARSE, SMALL, MOST_BROADCAST, LARGE = 256, 400_000, 1 << 19, 200_000_000


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """A hash for each run of ``size`` words; a shorter text has one shingle of all its words, a text without words none.

    ``words`` must be a column of the frame, not an expression: every step of the lambda reads it.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, to: str, k: int = 128, size: int = 5) -> DataFrame:
    return df.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn(to, bottom(shingle_hashes(F.col("_words"), size), k)).drop("_words")


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """The share of both sketches' hashes among the k smallest of their union; exact while both hold all their shingles. Two empty texts are alike (1)."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(sketch: Column, k: int = 128) -> Column:
    """The estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that the k smallest take."""
    taken = (F.element_at(sketch, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) / taken)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The estimated share of a's shingles that b has, from their resemblance and counts. An empty a is contained (1)."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((F.lit(1.0) + j) * na)))


def merge_sketches(df: DataFrame, keys: Sequence[str], sketch: str, k: int = 128, salts: int = 64) -> DataFrame:
    """One sketch for each key from those of its parts: the k smallest of each salt of the hashes first, so a hot key never meets whole in one task.

    A null key is a key; null sketches count as empty. Other columns are not read. An empty table gives an empty result.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in keys]).alias("key")
    parts = df.select(key, F.coalesce(sketch, F.array().cast("array<bigint>")).alias("sketch"))
    # A key stays although all its parts are empty: its one row with a null hash.
    hashes = parts.select("key", F.explode_outer("sketch").alias("h")).distinct()
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("h")))
    few = hashes.withColumn("salt", F.pmod(F.coalesce("h", F.lit(0)), F.lit(salts))).withColumn("rank", rank("key", "salt")).filter(F.col("rank") <= k)
    few = few.withColumn("rank", rank("key")).filter(F.col("rank") <= k)
    return few.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias(sketch)).select("key.*", sketch)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def order_bucket(docs: DataFrame) -> tuple[Column, bool]:
    """(a bucket number that grows with the place of a row of ``docs(doc_id, text)``, whether buckets are few enough to be broadcast).

    Rows go by doc_id, null ones first by a hash of their text. Quantiles of doc_id, and even steps between them, make buckets of about SMALL code
    points, or more where that would be more than MOST_BROADCAST; where even LARGE ones would be more, buckets have LARGE code points.
    """
    quantiles = F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10000)
    size, found = docs.agg(F.sum(F.length("text")), quantiles).first()
    bounds = sorted(set(found or [0]))
    wanted = (size or 0) // SMALL
    if wanted > MOST_BROADCAST:
        wanted = max(MOST_BROADCAST, (size or 0) // LARGE)
    steps = max(1, -(-wanted // len(bounds)))
    lows = F.array(*[F.lit(b).cast("double") for b in bounds])
    x = F.col("doc_id").cast("double")
    cell = F.greatest(F.size(F.filter(lows, lambda b: b <= x)), F.lit(1))
    low, high = F.get(lows, cell - 1), F.coalesce(F.get(lows, cell), F.lit(bounds[-1] + 1).cast("double"))
    inside = F.greatest(F.lit(0), F.least(F.floor((x - low) / (high - low) * steps), F.lit(steps - 1)))
    none = F.shiftright(null_order(), 54) - F.lit(1 << 12)
    return F.when(F.col("doc_id").isNull(), none).otherwise((cell * steps + inside).cast("long")), wanted <= MOST_BROADCAST


def null_order() -> Column:
    """What rows without doc_id go by, before their text; null for others."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def fingerprint_edits(docs: DataFrame, k: int = 128, size: int = 5) -> DataFrame:
    """doc_id, n_chars, edited, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained, n_shingles for ``docs(doc_id, text)``.

    The edited text has its last floor(n_chars / 4) code points replaced by as many (or all) from the start of the next document by ascending doc_id
    (rows with one doc_id by text, null doc_ids first by a hash of the text); the last row's next is the first row. ``contained`` is the estimated share
    of a text's shingles that the edited text has, ``n_shingles`` the estimated number of distinct ones. A null text is empty; two empty texts have
    likeness 1, an empty and another 0, an empty text is contained. An empty table gives an empty result; a single row is its own next. Repeated rows
    are rows of their own. Other columns are not read, whatever their names. doc_id must be a number.
    Rows meet their next in buckets of nearby doc_ids; only each bucket's first row is fetched for the bucket before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket, few = order_bucket(rows)
    first = F.struct(F.col("doc_id"), null_order().alias("h"))
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.min(first).alias("head"))
    ring = Window.orderBy("bucket")
    around = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    heads = heads.select(F.col("bucket").alias("to"), around("head").alias("head"), around("bucket").alias("bucket"))
    keyed = rows.withColumn("bucket", bucket)
    # Rows of two numbers and a bucket: MOST_BROADCAST of them at most if broadcast.
    fetched = keyed.join(F.broadcast(heads) if few else heads, "bucket").filter(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & null_order().eqNullSafe(F.col("head.h")))
    fetched = with_sketch(fetched.groupBy(F.col("to").alias("bucket")).agg(F.min("text").alias("head_text")), "head_text", "head_sketch", k, size)
    order = Window.partitionBy("bucket").orderBy("doc_id", null_order(), "text")
    dealt = with_sketch(rows, "text", "sketch", k, size).withColumn("bucket", bucket).withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    met = dealt.join(fetched, "bucket", "left").withColumn("next_text", F.coalesce("next_text", "head_text")).withColumn("next_sketch", F.coalesce("next_sketch", "head_sketch"))
    n = F.length("text")
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int"))))
    met = with_sketch(met, "edited", "edited_sketch", k, size)
    own, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return met.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", F.sha2("edited", 256).alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"), resemblance(own, after, k).alias("near_next"), containment(own, other, k).alias("contained"), distinct_shingles(own, k).alias("n_shingles"),
    )


def op6_fingerprint(spark, sf_dir):
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("edited")
