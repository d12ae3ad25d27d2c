"""Readers and writers for question sets, run records and reports. Schemas are explicit, so nothing is read twice to infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of run records, and the form of graph questions.
RUN_COLUMNS = ["Run", "Model", "Thinking", "QID", "Query", "Prompt Tokens", "Completion Tokens", "Inference Time (s)", "Response", "Reasoning", "Timestamp", "Error"]
QUESTION_GRAPH = "qid string, question string, function string, num_node int, num_edge int, level string, domains array<string>, s_expression string, graph_query struct<nodes:array<struct<nid:int,node_type:string,id:string,class:string,friendly_name:string,function:string>>,edges:array<struct<start:int,end:int,relation:string,friendly_name:string>>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of graph questions."""
    return spark.read.schema(QUESTION_GRAPH).option("multiLine", True).json(path)


def read_strings(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.csv") -> DataFrame:
    """CSV files of a tree as strings, with the three folders above each file as run_dir, grammar and model_dir; summaries are left out.

    A file whose header has other columns, or has them in another order, is an error."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(header=True, enforceSchema=False, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter=pattern).csv(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    df = df.select("*", F.element_at(parts, -4).alias("run_dir"), F.element_at(parts, -3).alias("grammar"), F.element_at(parts, -2).alias("model_dir"), F.element_at(parts, -1).alias("file"))
    return df.filter(~F.col("file").contains("summary"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    df = read_strings(spark, path, RUN_COLUMNS)
    kinds = {"Run": "int", "Prompt Tokens": "int", "Completion Tokens": "int", "Inference Time (s)": "double", "Thinking": "boolean"}
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in kinds.items()})


def read_prompts(spark: SparkSession, path: str, pattern: str = "*.prompt.md") -> DataFrame:
    """name, text of each prompt file."""
    df = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.prompt\.md$", "").alias("name"), F.col("value").alias("text"))


def _without(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``others`` doesn't have; nulls match each other."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return df.alias("a").join(others.select(*keys).distinct().alias("b"), same, "left_anti")


def finished_only(runs: DataFrame, keys: list[str]) -> DataFrame:
    """All or nothing: rows of queries of which no run failed."""
    return _without(runs, runs.filter(F.coalesce("Error", F.lit("")) != ""), keys)


def not_written(runs: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return _without(runs, written, keys)


def resumed(done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records of earlier jobs and of this one as one table."""
    return done.unionByName(fresh, allowMissingColumns=True)


def write_runs(runs: DataFrame, path: str) -> None:
    """Run records by grammar, model and mode, so that later scans read only the folders they need."""
    runs.write.mode("append").partitionBy("grammar", "Model", "Thinking").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
