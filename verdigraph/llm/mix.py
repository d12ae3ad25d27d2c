"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points are mapped through the cumulative shares of the sources, so each run of slots holds the sources in their shares. The k-th slot
of a source takes the k-th block of ``block_words`` words of that source's shuffled word stream, which runs at most ``cap`` times over its documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut
from verdigraph.plans.skew import running_total, spread_join

#: A word, as Java and RE2 write it.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
GOLDEN = 0.6180339887498949
#: The fraction of GOLDEN * 2**20 steps from one run of 2**20 slots to the next.
STEP = 2**20
GOLDEN_STEP = (GOLDEN * STEP) % 1.0
#: Slots that are ranked together, at least; cells of the cumulative shares for each source, and at least.
CHUNK = 1024
CELLS_EACH, CELLS = 4, 1024
#: Slots that stay together in the text of the mix.
RUN = 1024


def source_key() -> Column:
    """Never null, and different for a null source and an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def shuffle_key(seed: int) -> Column:
    """60 bits of a digest, so that another engine can shuffle alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def row_key() -> Column:
    """A 128-bit digest of doc_id, source and text, the same for rows that are equal in these."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), source_key(), F.coalesce("text", F.lit("")))))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """row_id, key, doc, skey, size, h: each row with its number of words, written once so that row_id holds. ``doc`` has its columns but the text."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = docs.select(own, row_key().alias("key"), source_key().alias("skey"), size, shuffle_key(seed).alias("h"))
    return cut(rows.withColumn("row_id", F.monotonically_increasing_id()), "mix-sized")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """skey, pos, source_size, target, cut: one row for each source.

    A target is min(cap * size, level * weight), with the one level at which the targets add up to ``share`` of all words. That is where sharing
    by weight, stopping sources at their caps and sharing the rest again ends. With sources in the order of cap * size / weight, the level is the
    first rest / (weights from here on) that this source can take. ``cut`` is the target in whole words.
    """
    per = sizes.groupBy("skey", F.col("doc.source").alias("source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("pos", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
    limit = F.lit(cap) * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), "pos")
    rest = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = rest / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    tried = per.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= limit, F.struct("at", "level"))
    found = tried.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    target = F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit))
    return found.select("skey", "source", F.col("pos").cast("long").alias("pos"), "source_size", target.alias("target")).withColumn("cut", F.round("target").cast("long"))


def schedule(goals: DataFrame, block_words: int) -> DataFrame:
    """slot, skey, rank: the sources of all slots in order, each source's slots numbered from 0.

    The points give a source its share of slots to within a few; slots beyond a source's need are left out and those it lacks follow at the end.
    """
    spark = goals.sparkSession
    total, sources = goals.agg(F.coalesce(F.sum("cut"), F.lit(0)), F.count("*")).first()
    slots = -(-total // block_words)
    chunk, n_cells = max(CHUNK, int(slots**0.5)), max(CELLS, CELLS_EACH * sources)
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = goals.withColumn("hi", F.sum("cut").over(upto) / F.lit(max(total, 1))).withColumn("lo", F.col("hi") - F.col("cut") / F.lit(max(total, 1)))
    ends = ends.filter("cut > 0").withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("pos")), F.lit(0.0)))
    cells = ends.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1).cast("long")))).alias("cell"))
    point = (F.floor(F.col("slot") / STEP) * F.lit(GOLDEN_STEP) + (F.col("slot") % STEP) * F.lit(GOLDEN)) % F.lit(1.0)
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u"), F.floor(F.col("id") / F.lit(chunk)).alias("chunk")).withColumn("cell", F.floor(F.col("u") * n_cells))
    drawn = cut(points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "chunk", "skey", F.lit(1).alias("one")), "mix-drawn")
    ranked = running_total(drawn, "skey", "chunk", [F.col("slot")], "one", "rank")
    need = F.ceil(F.col("cut") / F.lit(block_words))
    wanted = goals.select("skey", "pos", need.alias("need"))
    natural = spread_join(ranked, wanted.select("skey", "need"), ["skey"], F.col("slot")).filter("rank < need").select("slot", "skey", "rank")
    had = drawn.groupBy("skey").agg(F.count("*").alias("had"))
    late = wanted.join(had, "skey", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need")
    late = late.select("skey", "pos", "had", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank"))
    return natural.unionByName(late.select((F.lit(slots) + (F.col("rank") - F.col("had")) * F.lit(max(sources, 1)) + F.col("pos") - 1).alias("slot"), "skey", "rank"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 256, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, plan) of a mix of ``docs(doc_id, text, source)``.

    ``plan`` has slot, skey, rank, row_id, at, first_word, words: the words of a document that a slot takes, counted from the document's start, and
    their place in the source's stream. ``rows`` has each input row with its row_id, size and goal, its own columns but the text in ``doc``.
    A null source is a source; sources go by code point, the null one last, and weigh ``weights`` in turn. A null or empty text has no words and is
    never taken. Repeated rows are taken as documents of their own; equal shuffle keys go by row. An empty table gives empty results. Columns
    besides doc_id, text and source have no influence, whatever their names. ``cap`` is the number of passes over a source's documents; of a last pass that isn't whole, its share is taken.
    """
    return planned(sized(docs, seed), weights, share, cap, block_words)


def planned(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What mix() returns, for rows that sized() has written."""
    goals = cut(targets(rows, weights, share, cap), "mix-targets")
    rows = spread_join(rows, goals.drop("source"), ["skey"], F.col("row_id"))
    stream = running_total(rows.drop("doc", "key").filter("size > 0").withColumn("bucket", F.shiftright("h", 50)), "skey", "bucket", [F.col("h"), F.col("row_id")], "size", "start")
    passes = stream.select("*", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))).alias("pass")).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("cut"))).filter("at < end")
    block = F.lit(block_words)
    blocks = passes.select("skey", "row_id", "at", "end", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))).alias("rank"))
    first = F.greatest(F.col("at"), F.col("rank") * block)
    words = F.least(F.col("end"), (F.col("rank") + 1) * block) - first
    blocks = cut(blocks.select("skey", "rank", "row_id", first.alias("at"), (first - F.col("at")).alias("first_word"), words.alias("words")), "mix-blocks")
    return rows, goals, schedule(goals, block_words).join(blocks, ["skey", "rank"])


def taken_words(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: the words that the plan takes of each, repeats counted."""
    sums = plan.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_blocks(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """slot, block_at, first_word, words, text, doc: the text of the mix, one row for each document's part of a slot.

    Runs of RUN slots stay together, each partition has its slots in order, and every run of slots has the sources in their shares.

    The parts of a slot, by block_at, are its block: ``block_words`` words of one source (the last block of a source may have fewer). A part has
    ``text`` from the start of its first word to the start of the word after its last; white space before a document's first word and after its last
    goes with those. So the parts of one pass over a document, put together, are the document. ``doc`` has the columns of the row it comes from.
    A row without words can't be mixed and goes; repeated rows are rows of their own; an empty table gives an empty result.
    """
    rows = sized(docs, seed)
    _, _, plan = planned(rows, **options)
    # Rows with one key are alike, so any of them can stand for the first, the second and so on; texts are shuffled by key, not written once more.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("row_id"))
    placed = plan.join(rows.select("row_id", "key", nth.alias("nth")), "row_id")
    takes = placed.groupBy("key").agg(F.collect_list(F.struct("nth", "slot", F.col("at").alias("block_at"), "first_word", "words")).alias("takes"))
    texts = docs.select(row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    met = texts.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key"))).join(takes, "key")
    split = F.regexp_extract_all("doc.text", F.lit(rf"(?:^{SPACE}+)?{WORD}(?:{SPACE}+|$)"), F.lit(0))
    met = met.select("doc", F.filter("takes", lambda t: t["nth"] == F.col("nth")).alias("takes"), split.alias("split")).filter(F.size("split") > 0)
    part = lambda t: F.struct(t["slot"].alias("slot"), t["block_at"].alias("block_at"), t["first_word"].alias("first_word"), t["words"].alias("words"), F.array_join(F.slice("split", (t["first_word"] + 1).cast("int"), t["words"].cast("int")), "").alias("text"))
    parts = met.select("doc", F.inline(F.transform("takes", part)))
    return parts.select("slot", "block_at", "first_word", "words", "text", "doc").repartition(F.floor(F.col("slot") / RUN)).sortWithinPartitions("slot", "block_at")


def op1_mix(spark, sf_dir):
    rows, _, plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken_words(rows, plan).select("doc.doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS pos FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS top FROM per),
tried AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY top / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY top / weight, pos) AS nth
  FROM weighed),
level AS (SELECT arg_min(level, nth) AS level FROM tried WHERE level * weight <= top),
goals AS (SELECT source, source_size, least(top, coalesce(level.level * weight, top)) AS target FROM tried, level),
stream AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, round(g.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, goal) - start) + greatest(0, least(start + source_size + size, goal) - start - source_size))::BIGINT AS taken
FROM stream"""
