"""Report files: fixed columns under fixed headers, one folder of CSV files a table, and the latest run of a folder of runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.operators.reports import pool_entries
from verdigraph.sources.files import write_csv

#: The headers of each report, with the column that stands under each where it has another name.
_GROUP = {"Model": "model", "Thinking": "thinking", "QID": "qid", "Query": "question", "Output Key": "output_key"}
_MERGE = {"LLM Merged": "merged", "Group Size": "group_size"}
_ANSWER = {"Representative Output": "representative", "Reasoning": "reasoning"}
_JUDGED = {**_GROUP, "Hypotheses Covered": "hypotheses", "Correct": "correct", "LLM Error Category": "category", **_MERGE, "Rationale": "rationale", **_ANSWER, "Runs": "runs"}
REPORTS: dict[str, dict[str, str]] = {
    "selected": {"id": "qid", "text": "question"},
    "grouped": {**_GROUP, "Group Size": "group_size", **_ANSWER, "LLM Merged": "merged", "Runs": "runs"},
    "evaluated": _JUDGED,
    "reviewed": {
        **_JUDGED, "Human Correct": "human_correct", "Human Hypotheses Covered": "human_hypotheses", "Discrepancy": "discrepancy", "Discrepancy Reason": "discrepancy_reason",
        "Error Category": "error_category", "Error Notes": "error_notes", "Review Timestamp": "reviewed_at", "Reviewed In Run": "reviewed_in",
    },
    "base_llm_errors": {"QID": "qid", "Query": "question", "Grammar": "grammar", "Model": "model", "Error Category": "error_category", "Error Notes": "error_notes", "Representative Output": "representative"},
    "judge_llm_errors": {"QID": "qid", "Query": "question", "Grammar": "grammar", "Model": "model", "LLM Said": "judge_said", "Human Said": "human_said", "Discrepancy Reason": "discrepancy_reason", "LLM Rationale": "rationale"},
    "validation": {
        "Query ID": "qid", "Source": "source", "Split": "split", "Query Text": "question", "Run Number": "run", "Candidate Raw": "raw", "Candidate JSON": "candidate", "Correct": "correct",
        "Error Category": "category", "Rationale": "rationale", "Query Rate": "rate", "Distinct Outputs": "n_outputs",
    },
    "error_distribution": {"Grammar": "grammar", "Model": "model", "Error Category": "category", "Count": "count", "Percentage": "percentage"},
    "element_summary": {"element": "element", "group": "side", "selection": "n_x", "selection_pct": "share_x", "all": "n_y", "all_pct": "share_y"},
}
_RATES = {"Success Rate": "success_rate", "Hypothesis Coverage": "hypothesis_coverage", "Inference Time (s)": "inference_time", "Completion Tokens": "completion_tokens"}


def metric_reports(ks: list[int], baseline: str) -> dict[str, dict[str, str]]:
    """The headers of the four metrics reports, which depend on the ks and the baseline grammar."""
    at = {f"Pass{sign}{k}": f"pass_{name}_{k}" for k in ks for sign, name in (("@", "at"), ("^", "pow"))}
    return {
        "query_level_metrics": {"Grammar": "grammar", "Model": "model", "QID": "qid", **_RATES, **at},
        "model_summary_metrics": {"Grammar": "grammar", "Model": "model", **{f"Avg {h}": f"avg_{c}" for h, c in _RATES.items()}, **at},
        "error_distribution": REPORTS["error_distribution"],
        "significance_tests": {"Model": "model", "Metric": "metric", f"Baseline ({baseline})": "baseline", "Comparison Grammar": "grammar", "Test Used": "test", "p-value": "p", "Significant (p<0.05)": "significant"},
    }


def _shown(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(F.col(column), "True").when(~F.col(column), "False")
    return F.array_join(column, ", ") if isinstance(kind, T.ArrayType) else F.col(column)


def write_report(df: DataFrame, headers: dict[str, str], path: str, by: tuple[str, ...] = ()) -> None:
    """The columns of ``headers`` as CSV, others are left out; truth values are True and False, lists are joined by commas. A table without rows is its header.

    With ``by`` there is a folder for each value of these columns, named ``<column>=<value>``; then a table without rows has no files.
    """
    shown = df.select(*[_shown(df, c).alias(h) for h, c in headers.items()], *[F.col(c).alias(f"_{c}") for c in by])
    if not by:
        return write_csv(shown, path)
    shown.write.mode("overwrite").partitionBy(*[f"_{c}" for c in by]).options(header=True, escape='"').csv(path)


def write_metrics(path: str, run: str, frames: dict[str, DataFrame], ks: list[int], baseline: str) -> None:
    """The four metrics tables of a run at ``<path>/<run>/<table>.csv``; all four are always there."""
    for name, headers in metric_reports(ks, baseline).items():
        write_report(frames[name].withColumn("baseline", F.lit(baseline)), headers, f"{path}/{run}/{name}.csv")


def latest_run(spark: SparkSession, path: str, table: str) -> str:
    """The name of the last run below ``path`` that has the table, by name. Only the list of files is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/*/{table}.csv")
    return files.agg(F.max(F.regexp_extract("path", rf"/([^/]+)/{re.escape(table)}\.csv(?:/|$)", 1))).first()[0]


def read_report(spark: SparkSession, path: str, headers: dict[str, str]) -> DataFrame:
    """A report as texts, under the columns' names."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    df = spark.read.schema(schema).options(header=True, enforceSchema=False, multiLine=True, escape='"').csv(path)
    return df.select(*[F.col(f"`{h}`").alias(c) for h, c in headers.items()])


def read_latest_metrics(spark: SparkSession, path: str, ks: list[int], baseline: str) -> dict[str, DataFrame]:
    """The four metrics tables of the last run below ``path``."""
    run = latest_run(spark, path, "query_level_metrics")
    return {name: read_report(spark, f"{path}/{run}/{name}.csv", headers) for name, headers in metric_reports(ks, baseline).items()}


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The queries of pool files, each a JSON map from id to query."""
    return pool_entries(spark.read.text(path, wholetext=True), "value")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """iteration, status, position of an experiment log, a JSON array; a file that isn't one has none."""
    log = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<iteration:int,status:string>>")).alias("position", "e"))
    return log.select("e.iteration", "e.status", "position")
