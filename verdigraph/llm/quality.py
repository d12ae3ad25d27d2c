"""Quality rules: statistics of each text, and lines that too many documents of one host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut
from verdigraph.plans.skew import spread_join

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _repeat_windows(words: Column) -> tuple[Column, Column]:
    """(hashes of all 3-word windows, the same with their places, sorted): the latter is empty if no window repeats."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    column = F.col("_windows")
    placed = F.when(F.size(F.array_distinct(column)) < F.size(column), F.sort_array(F.transform(column, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    return hashes, placed


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``_lines``, an array of (h, words) for each line with a word.

    A null text counts as empty: all zero. Sorting the windows of one text finds those that repeat; places within two words of each other overlap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn("_kept_lines", lines)
    hashes, placed = _repeat_windows(F.col("_words"))
    df = df.withColumn("_windows", hashes).withColumn("_placed", placed)
    at, n = F.col("_placed"), F.size("_placed")
    nexts = F.zip_with(at, F.slice(at, F.lit(2), n), lambda a, b: F.struct(a["h"].alias("h"), a["p"].alias("p"), a["h"].eqNullSafe(b["h"]).alias("again")))
    places = F.zip_with(nexts, F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), at), lambda a, b: F.when(a["again"] | a["h"].eqNullSafe(b["h"]), a["p"]))
    df = df.withColumn("_places", F.when(n > 0, F.sort_array(F.filter(places, lambda p: p.isNotNull()))).otherwise(F.array().cast("array<int>")))
    p = F.col("_places")
    shared = F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.greatest(F.lit(0), F.lit(3) - (b - a))), F.lit(0), lambda acc, x: acc + x)
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_kept_lines") - F.size(F.array_distinct("_kept_lines"))).cast("long"),
            "n_repeat_words": (F.lit(3) * F.size(p) - shared).cast("long"),
            "_lines": F.transform("_kept_lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
        }
    ).drop("_text", "_words", "_kept_lines", "_windows", "_placed", "_places")


def quality(docs: DataFrame, host: str = "source", max_docs: int = 10, least_left: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """doc_id, the statistics, base_failed, removed_words, kept: one row for each row of ``docs(doc_id, text, <host>)``.

    A line is removed where more than ``max_docs`` distinct doc_ids of one host hold it in its normal form. A document is rejected that fails the base
    rules (fewer than ``min_words`` words, or over ``max_repeat`` of them in repeating windows) or of which less than ``least_left`` is left.
    Null hosts are one host, null doc_ids one document, a null text an empty one. Repeated rows each get their row but count once for a line.
    Other columns are not read. Counting goes by (host, line) with partial sums; a frequent line is joined back by salts of its documents.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    rows = cut(text_statistics(docs.select("doc_id", name.alias("_host"), "text")).drop("text").withColumn("row_id", F.monotonically_increasing_id()), "quality")
    lines = rows.select("row_id", "doc_id", "_host", F.inline("_lines"))
    often = lines.groupBy("_host", "h").agg(F.countDistinct(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("docs")).filter(F.col("docs") > max_docs).drop("docs")
    removed = spread_join(lines, often, ["_host", "h"], F.col("row_id")).groupBy("row_id").agg(F.sum("words").cast("long").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    out = rows.drop("_lines", "_host").join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= F.lit(least_left) * F.col("n_words"))).drop("row_id")


def without_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = 10) -> DataFrame:
    """``docs`` with the lines that ``quality`` counts as removed cut out of ``text``, and ``removed_lines``, how many these were.

    The other lines keep their order and their line breaks. A null text stays null, one of which all lines go is empty; rows that are equal in doc_id, host and text are
    cut alike. A column ``removed_lines`` is replaced, all others stay, whatever their names. An empty table gives an empty result. Texts meet the hashes of their frequent lines by a
    digest of the row, in a join that adaptive execution can split where very many rows are equal.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit(""))
    ident = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("|", ident, name, F.coalesce("text", F.lit("")))))
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), worded), lambda x: F.xxhash64(normal_line(x))))
    lines = docs.select(key.alias("key"), ident.alias("doc"), name.alias("_host"), F.explode(hashes).alias("h"))
    often = lines.groupBy("_host", "h").agg(F.countDistinct("doc").alias("docs")).filter(F.col("docs") > max_docs).drop("docs")
    marks = spread_join(lines, often, ["_host", "h"], F.col("key")).groupBy("key").agg(F.collect_set("h").alias("often"))
    rest = [c for c in docs.columns if c not in ("text", "removed_lines")]
    met = docs.select(key.alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc")).join(marks, "key", "left")
    each = F.split("text", "\n", -1)
    left = F.when(F.col("often").isNull(), each).otherwise(F.filter(each, lambda x: ~(worded(x) & F.array_contains("often", F.xxhash64(normal_line(x))))))
    met = met.select("doc", "text", "often", left.alias("left"), F.size(each).alias("n"))
    text = F.when(F.col("often").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c == "text" or c in rest]
    return met.select(*columns, F.when(F.col("often").isNull(), 0).otherwise(F.col("n") - F.size("left")).alias("removed_lines"))


def op3_quality(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, unnest(list_zip(w, range(len(w)))) AS x FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
placed AS (SELECT rid, x[1] AS w, x[2] AS p FROM words),
windows AS (
  SELECT rid, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM placed WINDOW o AS (PARTITION BY rid ORDER BY p)),
again AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
often AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
removed AS (SELECT rid, sum(words) AS n FROM lines JOIN often ON lines.norm = often.norm AND lines.source IS NOT DISTINCT FROM often.source GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
  FROM docs d LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 50 OR n_repeat_words > 0.5 * n_words AS base_failed,
       NOT (n_words < 50 OR n_repeat_words > 0.5 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept
FROM base"""
