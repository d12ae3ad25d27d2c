"""Element tags of graph questions with their nodes and edges, function counts of Cypher texts, and two populations beside each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions of Cypher by kind, the name each is shown with, and what it looks like, case ignored. Earlier ones win at one place.
FUNCTIONS = [
    ("No form", "properties()", r"\bproperties\s*\("),
    ("No form", "keys()", r"\bkeys\s*\("),
    ("No form", "size() or length() of a property", r"\b(?:size|length)\s*\(\s*\w+\.\w+\s*\)"),
    ("No form", "text and list functions", r"\b(?:split|substring|left|right|replace|trim|ltrim|rtrim|reverse|head|last|tail|range|reduce|coalesce)\s*\(|\bapoc\.|\bUNWIND\b|\[\s*\w+\s+IN\b"),
    ("Workaround", "date() or datetime() with a value", r"\b(?:date|datetime)\s*\(\s*(?:''|\{)"),
    ("No form", "date() or datetime() without a value", r"\b(?:date|datetime)\s*\("),
    ("Convention", "type(r)", r"\btype\s*\("),
    ("Convention", "labels(n)", r"\blabels\s*\("),
    ("Workaround", "IS NULL, IS NOT NULL", r"\bIS\s+(?:NOT\s+)?NULL\b"),
    ("Workaround", "STARTS WITH, ENDS WITH", r"\b(?:STARTS|ENDS)\s+WITH\b"),
    ("Workaround", "shortestPath()", r"\b(?:all)?shortestPath\s*\("),
    ("Workaround", "size(list)", r"\bsize\s*\("),
    ("Workaround", "length(path)", r"\blength\s*\("),
    ("Workaround", "conversions", r"\b(?:toFloat|toInteger|toLower|toUpper|toString|toBoolean)\s*\("),
    ("Workaround", "id()", r"(?<![\w.])id\s*\("),
]
#: Functions of a question that compare, and superlatives with the sort direction and aggregate that each means.
COMPARES, SUPERLATIVES = (">", ">=", "<", "<="), {"argmax": ("DESC", "MAX"), "argmin": ("ASC", "MIN")}


def functions(text: Column) -> Column:
    """The distinct functions of a Cypher text without literals, sorted: one scan finds all, and each find is told by the first pattern that it fits."""
    every = "(?i)" + "|".join(f"(?:{p})" for _, _, p in FUNCTIONS)
    name = lambda found: reduce(lambda rest, f: F.when(F.regexp_like(found, F.lit(f"(?i)^(?:{f[2]})")), f[1]).otherwise(rest), reversed(FUNCTIONS), F.lit(None).cast("string"))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(every), F.lit(0)), name)))


def question_tags(function: Column, expression: Column, nodes: Column, edges: Column) -> Column:
    """The sorted element tags of a graph question.

    ``nodes`` are structs of nid, node_type and function, ``edges`` of start and end. Entities and literals are conditions, but for the literal of a superlative; a superlative can be
    said by sorting or by an aggregate, and has the tags of both.
    """
    literal = lambda n: F.coalesce((n["node_type"] == "literal") & ~F.coalesce(n["function"], F.lit("")).isin(*SUPERLATIVES), F.lit(False))
    entities, literals = F.size(F.filter(nodes, lambda n: n["node_type"] == "entity")), F.filter(nodes, literal)
    plain = F.transform(F.filter(nodes, lambda n: n["node_type"] == "literal"), lambda n: n["nid"])
    related = F.exists(edges, lambda e: ~F.array_contains(plain, e["start"]) & ~F.array_contains(plain, e["end"]))
    conditions = entities + F.size(literals)
    counted, best = function == "count", function.isin(*SUPERLATIVES)
    equal = (entities > 0) | F.exists(literals, lambda n: n["function"] == "none")
    tests = [
        (F.lit(True), ("ENTITY", "ATTRIBUTE (anywhere)", "One hypothesis")),
        (counted, ("Target COUNT", "COUNT", "LIST (any kind)", "CREATE_LIST")),
        (~counted, ("Target ENTITY_ID",)),
        *[(function == c, (c, "COMPARISON")) for c in COMPARES],
        *[(function == f, ("order_by", "limit", way, kind, "LIST (any kind)", "CREATE_LIST", "SCALAR_AGGREGATE")) for f, (way, kind) in SUPERLATIVES.items()],
        (related, ("relationships", "Relationship with a role")),
        (conditions > 0, ("constraint",)),
        ((conditions > 0) & (counted | best), ("LIST.filter",)),
        (conditions >= 2, ("AND",)),
        (equal, ("=", "COMPARISON")),
        (entities > 0, ("STRING value",)),
        (F.regexp_like(expression, F.lit("XMLSchema#(integer|float|double)")), ("NUMBER value",)),
        (F.regexp_like(expression, F.lit("XMLSchema#(date|gYear)")), ("DATE_TIME",)),
    ]
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.when(test, F.array(*map(F.lit, names))).otherwise(none) for test, names in tests])))


def populations(x: DataFrame, y: DataFrame, elements: DataFrame, tags: str = "tags", rows: str | None = None) -> DataFrame:
    """element, n_x, n_y, share_x, share_y, side: how many rows of two tagged frames have each element, and their share in percent.

    ``side`` is ``both``, ``x_only``, ``y_only`` or ``neither``. Elements that one of the frames or ``elements(element)`` has are all there.
    With ``rows``, a column of both frames, each row stands for that many equal ones.
    """
    times = F.col(rows) if rows else F.lit(1).cast("long")
    x, y = (df.select(tags, times.alias("_rows")) for df in (x, y))
    counts = lambda df, n: df.select(F.explode(tags).alias("element"), "_rows").groupBy("element").agg(F.sum("_rows").alias(n))
    # One row each.
    all_rows = F.coalesce(F.sum("_rows"), F.lit(0))
    totals = x.agg(all_rows.alias("_x")).withColumn("_one", F.lit(1)).join(F.broadcast(y.agg(all_rows.alias("_y")).withColumn("_one", F.lit(1))), "_one")
    found = elements.select("element").distinct().join(counts(x, "n_x"), "element", "full_outer").join(counts(y, "n_y"), "element", "full_outer").na.fill(0, ["n_x", "n_y"])
    found = found.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one")
    share = lambda n, of: F.coalesce(F.bround(F.lit(100.0) * F.col(n) / F.nullif(F.col(of), F.lit(0)), 1), F.lit(0.0))
    side = F.when((F.col("n_x") > 0) & (F.col("n_y") > 0), "both").when(F.col("n_x") > 0, "x_only").when(F.col("n_y") > 0, "y_only").otherwise("neither")
    return found.select("element", "n_x", "n_y", share("n_x", "_x").alias("share_x"), share("n_y", "_y").alias("share_y"), side.alias("side"))
