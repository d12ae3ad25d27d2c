"""Planning runs: grammars, models, modes and repetitions; routing of prompts and data sets; answer groups with merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.plans.skew import running_total

#: What ids of a data set begin with; other ids are of the last one.
PREFIXES = (("AMB_", "ambrosia"), ("T2C_", "text2cypher"))
OTHERS = "grailqa"
#: Positions of groups of one size that are counted together.
NEARBY = 10_000


def thinking_modes(models: DataFrame) -> DataFrame:
    """Enabled models with a row for each mode: thinking only where a level is set, both where it is supported, else none."""
    modes = F.when(F.col("think_level").isNotNull(), F.array(F.lit(True))).when(F.col("supports_thinking"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return models.filter("enabled").withColumn("thinking", F.explode(modes))


def run_plan(grammars: DataFrame, models: DataFrame, queries: DataFrame, repetitions: int) -> DataFrame:
    """grammar, model, thinking, qid, run: every query for every mode of every enabled model in every grammar, ``repetitions`` times.

    Grammars and models are settings, a few rows each; the plan has as many rows as the product says.
    """
    modes = thinking_modes(models).select("model", "thinking")
    settings = grammars.select("grammar").join(F.broadcast(modes), F.lit(True)).agg(F.collect_list(F.struct("grammar", "model", "thinking")).alias("settings"))
    every = queries.select("qid").join(F.broadcast(settings), F.lit(True)).select("qid", F.inline("settings"))
    return every.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).select("grammar", "model", "thinking", "qid", "run")


def options(shared: Column, own: Column) -> Column:
    """Shared options with a model's own over them."""
    kept = F.map_filter(shared, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(own, F.create_map().cast("map<string,string>")))


def dataset_of(qid: Column) -> Column:
    out = F.lit(OTHERS)
    for prefix, name in reversed(PREFIXES):
        out = F.when(F.startswith(qid, F.lit(prefix)), name).otherwise(out)
    return out


def with_prompt(df: DataFrame, prompts: DataFrame) -> DataFrame:
    """``df(grammar)`` with the prompt's text: of the entry named as the grammar, else of the first whose name is part of it; null if none is.

    ``prompts(position, name, text)`` is a catalogue of a few files; it is matched with the distinct grammars only.
    """
    names = df.select("grammar").distinct()
    fits = names.join(F.broadcast(prompts), F.contains(F.col("grammar"), F.col("name")))
    best = fits.groupBy("grammar").agg(F.min_by("text", F.struct(F.col("name") != F.col("grammar"), F.col("position"))).alias("prompt"))
    return df.join(best, "grammar", "left")


def seconds(total: Column, prompt: Column, evaluation: Column) -> Column:
    """Nanoseconds as seconds: of the total, or where that is 0 or missing of both parts."""
    return F.bround(F.coalesce(F.nullif(total, F.lit(0)), F.coalesce(prompt, F.lit(0)) + F.coalesce(evaluation, F.lit(0))) / 1e9, 6)


def placed(groups: DataFrame, keys: Sequence[str], size: str, position: Column, name: Column) -> DataFrame:
    """``groups`` with ``place``: each key's groups numbered from 1 by falling size, equal ones by position and name; two levels, so that a key with very many groups is split."""
    bucket = F.struct((-F.col(size)).alias("size"), F.floor(position / NEARBY).alias("near"))
    known = groups.withColumn("_key", F.struct(*keys)).withColumn("_bucket", bucket).withColumn("_one", F.lit(1))
    counted = running_total(known, "_key", "_bucket", [position, name], "_one", "_before")
    return counted.select(*groups.columns, (F.col("_before") + 1).cast("int").alias("place"))


def grouped_runs(runs: DataFrame, keys: Sequence[str], normal: Column) -> DataFrame:
    """keys, answer, group_size, first (the first row by position), runs, merged, place: equal answers as one group, the largest first.

    ``place`` numbers a key's groups from 1 by size, equal ones by their first row, a number in ``position``; groups are counted by size and nearby positions first, so
    those of one key are not sorted in one task. ``runs`` has the runs' names, whole numbers before others.
    """
    rest = [c for c in runs.columns if c not in keys]
    name = F.struct(F.col("run").try_cast("int").isNull().alias("text"), F.col("run").try_cast("int").alias("number"), F.col("run").cast("string").alias("name"))
    merged = F.bool_or("merged") if "merged" in rest else F.lit(False)
    groups = runs.withColumn("answer", normal).groupBy(*keys, "answer").agg(F.count("*").alias("group_size"), F.min_by(F.struct(*rest), "position").alias("first"), F.transform(F.array_sort(F.collect_list(name)), lambda x: x["name"]).alias("runs"), merged.alias("merged"))
    return placed(groups, keys, "group_size", F.col("first.position"), F.col("answer"))


def merged_groups(groups: DataFrame, same: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """``groups`` of grouped_runs with ``into``: the answer of the group that takes this one in, its own if none does.

    Groups of more than ``threshold`` rows are core; where a key has none, its first small group is. Small groups go, in the order of their first rows,
    into the first core group that ``same(keys, answer, other)`` says to be equivalent; one that finds none becomes the last core group. As a small
    group may go into one that stayed before it, the groups of one key, a few for each question, are folded in one row.
    """
    g = F.struct(F.col("first.position").alias("position"), "answer", "group_size")
    near = same.groupBy(*keys, "answer").agg(F.collect_set("other").alias("near"))
    rows = groups.join(near, [*keys, "answer"], "left").withColumn("g", F.struct(g["position"].alias("position"), g["answer"].alias("answer"), (F.col("group_size") > threshold).alias("core"), F.coalesce("near", F.array().cast("array<string>")).alias("near")))
    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("all"))
    has_core = F.exists("all", lambda x: x["core"])
    is_core = lambda x, i: x["core"] | (~has_core & (i == 0))
    core = F.transform(F.filter("all", is_core), lambda x: x["answer"])
    small = F.filter("all", lambda x, i: ~is_core(x, i))
    pair = lambda answer, into: F.struct(answer.alias("answer"), into.alias("into"))
    start = F.struct(core.alias("core"), F.transform(core, lambda a: pair(a, a)).alias("done"))

    def step(acc, x):
        found = F.get(F.filter(acc["core"], lambda c: F.array_contains(x["near"], c)), F.lit(0))
        return F.struct(F.when(found.isNull(), F.concat(acc["core"], F.array(x["answer"]))).otherwise(acc["core"]).alias("core"), F.concat(acc["done"], F.array(pair(x["answer"], F.coalesce(found, x["answer"])))).alias("done"))

    done = folded.select(*keys, F.inline(F.aggregate(small, start, step, lambda acc: acc["done"])))
    return groups.join(done, [*keys, "answer"])
