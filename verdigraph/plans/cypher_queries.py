"""Queries over Cypher texts: each customer's segment fills one of a few templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigraph.functions import cypher
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TEMPLATES = (
    "MATCH (a)-[r:KNOWS]->(b) WHERE NOT a.name = \"?, x\" RETURN DISTINCT r, count(b) AS n ORDER BY n DESC LIMIT 5",
    "MATCH p = shortestPath((a)-[e*1..4]-(b)) MATCH (b)--(c) RETURN length(p), e.since, [x IN c.list | x][0]",
    "MATCH (a:?) OPTIONAL MATCH (a)-[s]-(b) WITH a, collect(b) AS bs UNWIND bs AS one RETURN one.name SKIP 2 LIMIT 3",
    "MATCH (n) WHERE EXISTS { (n)--(:?) } RETURN n.name AS name UNION MATCH (m) RETURN coalesce(m.name, 'a,b') AS name",
    "MERGE (n:? {id: 1})\n SET n.seen = true\n RETURN n",
)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TEXTS = f"(SELECT c_custkey AS id, replace(list_extract([{', '.join(map(_quoted, TEMPLATES))}], (1 + c_custkey % {len(TEMPLATES)})::INT), '?', c_mktsegment) AS t FROM customer)"
TESTS = ", ".join(f"CASE WHEN regexp_matches(t, {_quoted(pattern)}, 'i') THEN '{tag}' END" for tag, pattern in cypher.CONSTRUCTS.items())
MATCHES = r"CASE WHEN len(regexp_extract_all(t, '\bMATCH\b', 0, 'i')) >= 2 THEN 'multiple_match' END"
LAST = r"regexp_extract_all(string_split_regex(t, '\bRETURN\b')[-1], '[\w.]+\(?')"
RETURNED = rf"CASE WHEN contains(t, 'RETURN') AND list_has_any(regexp_extract_all(t, '\[\s*(\w+)\s*[:\]*]', 1), {LAST}) THEN 'relationship_returned' END"
TAGS = f"list_sort(list_filter([{TESTS}, {MATCHES}, {RETURNED}], lambda x: x IS NOT NULL))"


def texts(spark, d):
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.lit(1) + F.col("c_custkey") % len(TEMPLATES)).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.replace(template, F.lit("?"), F.col("c_mktsegment")).alias("t"))


def by_text(own, to: str, value):
    """id and ``value(t)`` for each row of ``own(id, t)``. Equal texts, null ones too, are read once."""
    each = own.select(F.col("t").alias("_t")).distinct().select("_t", value(F.col("_t")).alias(to))
    return own.join(each, F.col("t").eqNullSafe(F.col("_t"))).select("id", to)


@query(f"SELECT id, {TAGS} AS tags FROM {TEXTS}")
def cypher_constructs(spark, d):
    return by_text(texts(spark, d), "tags", cypher.constructs)


@query(f"SELECT tag, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM customer), 1)::DOUBLE AS percentage FROM (SELECT unnest({TAGS}) AS tag FROM {TEXTS}) GROUP BY tag")
def cypher_construct_counts(spark, d):
    """How many texts have each construct, and their share of all texts, which is one row."""
    once = texts(spark, d).groupBy("t").agg(F.count("*").alias("n"))
    counts = once.select(F.explode(cypher.constructs(F.col("t"))).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))
    total = table(spark, d, "customer").agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("tag", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 1).alias("percentage"))


@query(rf"SELECT id FROM {TEXTS} WHERE NOT regexp_matches(t, '\b({'|'.join(cypher.WRITES)})\b', 'i')")
def cypher_read_only(spark, d):
    return texts(spark, d).filter(~cypher.writes(F.col("t"))).select("id")


@query(
    """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ['r', 'count(b) AS n'] WHEN 1 THEN ['length(p)', 'e.since', '[x IN c.list | x][0]']
WHEN 2 THEN ['one.name'] WHEN 3 THEN ['n.name AS name', 'coalesce(m.name, '''') AS name'] ELSE ['n'] END AS items FROM customer"""
)
def cypher_return_items(spark, d):
    return by_text(texts(spark, d), "items", lambda t: cypher.returned(cypher.without_literals(t)))
