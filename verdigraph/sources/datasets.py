"""Question sets in their published forms as rows of questions and ground truths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.functions import cypher, text
from verdigraph.sources.files import read_questions

#: Columns of the ambiguous questions, of which the first is the index, and of the Cypher questions.
AMBIGUOUS = ["_c0", "question_type", "ambig_question", "question", "gold_queries", "db_file", "db_dump", "is_ambiguous", "ambig_type", "domain", "split"]
CYPHER = "question string, cypher string, data_source string, instance_id string, database_reference_alias string"
#: How an instance's id begins in the published file, and here.
INSTANCE, CYPHER_ID, AMBIGUOUS_ID = "instance_id_", "T2C_", "AMB_"


def read_indexed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of strings whose first column, without a name, is the index ``idx``. A header in another order is an error."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    if df.columns != columns:
        raise ValueError(f"{path} has the columns {df.columns}, not {columns}")
    return df.withColumn("idx", F.col(columns[0]).cast("long")).drop(columns[0])


def ambiguous_questions(rows: DataFrame, split: str | None = None) -> DataFrame:
    """id, text, ambig_type, domain, split, db_file, readings: ambiguous questions that aren't merely vague, with their unambiguous readings.

    Ids come from the index, so filters don't change them. Readings (meaning, sql) are the unambiguous rows of the same question and database, in the
    order of the index; a question without any has none.
    """
    key = ["ambig_question", "db_file"]
    plain = rows.filter(F.col("question_type") == "unambig").dropna(subset=key)
    order = F.struct("idx", F.col("question").alias("meaning"), F.col("gold_queries").alias("sql"))
    readings = plain.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: F.struct(r["meaning"].alias("meaning"), r["sql"].alias("sql"))).alias("readings"))
    asked = rows.filter(text.truthy(F.col("is_ambiguous")) & (F.col("ambig_type") != "vague"))
    asked = asked.filter(F.col("split") == split) if split else asked
    met = asked.join(readings, key, "left")
    none = F.array().cast("array<struct<meaning:string,sql:string>>")
    return met.select(text.padded_id(AMBIGUOUS_ID, F.col("idx")).alias("id"), F.col("ambig_question").alias("text"), "ambig_type", "domain", "split", "db_file", F.coalesce("readings", none).alias("readings"))


def cypher_questions(rows: DataFrame, left_out: Iterable[str] = ()) -> DataFrame:
    """id, text, cypher, data_source, database: questions whose query only reads, without those of the sources ``left_out``.

    Line breaks that are written out in a query become line breaks. Write clauses are looked for in the whole text, literals included.
    """
    kept = rows.filter(~F.col("data_source").isin(list(left_out)) & ~cypher.writes(F.col("cypher")))
    ident = F.concat(F.lit(CYPHER_ID), F.regexp_replace("instance_id", f"^{INSTANCE}", ""))
    return kept.select(ident.alias("id"), F.col("question").alias("text"), F.replace("cypher", F.lit("\\n"), F.lit("\n")).alias("cypher"), "data_source", F.col("database_reference_alias").alias("database"))


def graph_questions(rows: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``rows`` of read_questions with defaults for what is missing and ``template``, the first 8 characters of the id; without ``excluded(qid)`` templates."""
    defaults: dict[str, Column] = {"function": F.lit("none"), "num_node": F.lit(0), "num_edge": F.lit(0), "level": F.lit(""), "s_expression": F.lit(""), "domains": F.array().cast("array<string>")}
    out = rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}).withColumn("template", F.substring("qid", 1, 8))
    if excluded is None:
        return out
    return out.join(excluded.select(F.substring("qid", 1, 8).alias("template")).distinct(), "template", "left_anti").select(*out.columns)


def ground_truths(graph: DataFrame | None, ambiguous: DataFrame | None, cyphers: DataFrame | None) -> DataFrame:
    """qid, dataset, content, readings, n_readings of the question sets that there are, as a judge needs them."""
    none = F.array().cast("array<struct<meaning:string,sql:string>>")
    parts = []
    if graph is not None:
        named = text.replace_longest_first(F.col("s_expression"), text.friendly_names(F.col("graph_query")))
        parts.append(graph.select("qid", F.lit("grailqa").alias("dataset"), named.alias("content"), none.alias("readings")))
    if ambiguous is not None:
        parts.append(ambiguous.select(F.col("id").alias("qid"), F.lit("ambrosia").alias("dataset"), F.lit("").alias("content"), "readings"))
    if cyphers is not None:
        parts.append(cyphers.select(F.col("id").alias("qid"), F.lit("text2cypher").alias("dataset"), F.col("cypher").alias("content"), none.alias("readings")))
    if not parts:
        raise ValueError("no question set is given")
    return reduce(DataFrame.unionByName, parts).withColumn("n_readings", F.greatest(F.lit(1), F.size("readings")))


def load_graph_questions(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    return graph_questions(read_questions(spark, path), excluded)


def load_ambiguous_questions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    return ambiguous_questions(read_indexed_csv(spark, path, AMBIGUOUS), split)


def load_cypher_questions(spark: SparkSession, path: str, left_out: Iterable[str] = ()) -> DataFrame:
    return cypher_questions(spark.read.schema(CYPHER).parquet(path), left_out)
