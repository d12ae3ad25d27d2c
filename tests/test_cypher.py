from pyspark.sql import functions as F

from verdigraph.functions import cypher
from verdigraph.plans import cypher_queries


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_relationship_returned_on_its_own_only(spark):
    for end, want in (("r", True), ("a, r AS x", True), ("r.since", False), ("type(r)", True), ("r(1)", False), ("a.r", False), ("rr", False)):
        assert one(spark, f"MATCH (a)-[r:KNOWS]->(b) RETURN {end}", cypher.relationship_returned) is want, end
    assert one(spark, "MATCH (a)-[r]->(b) WHERE r.x = 1", cypher.relationship_returned) is False


def test_constructs(spark):
    assert one(spark, "match (a) match (b) return count(a) limit 3", cypher.constructs) == ["aggregation", "limit", "multiple_match"]
    # The index [0] counts as a variable named 0.
    assert one(spark, "MATCH (a)-[:X*1..3]->(b) WHERE a.x <> 1 RETURN a.names[0]", cypher.constructs) == ["list_index_slice", "negation", "relationship_returned", "var_length_path"]
    assert one(spark, "", cypher.constructs) == [] and one(spark, None, cypher.constructs) == []


def test_masking_and_items(spark):
    assert one(spark, "WHERE a = 'it\\'s, ok'\n AND b = \"x\"", cypher.without_literals) == "WHERE a = '' AND b = ''"
    assert one(spark, "RETURN a, f(b, [c, d]), {e: 1, g: 2}", cypher.returned) == ["a", "f(b, [c, d])", "{e: 1, g: 2}"]
    assert one(spark, "MATCH (n) WHERE n.x = 1", cypher.returned) == [] and one(spark, "RETURN 'x, RETURN y'", cypher.returned) == ["'x, RETURN y'"]
    assert one(spark, "CALL { MATCH (a) RETURN a } RETURN count(DISTINCT a) AS n LIMIT 2", cypher.returned) == ["a", "count(DISTINCT a) AS n"]
    assert one(spark, "RETURN DISTINCT a, b ORDER BY a UNION RETURN c LIMIT 1", cypher.returned) == ["a", "b", "c"]


def test_writes(spark):
    assert one(spark, "MATCH (n) detach delete n", cypher.writes) is True
    assert one(spark, "MATCH (n) RETURN n.settings", cypher.writes) is False


def test_equal_texts_are_read_once(spark):
    own = spark.createDataFrame([(1, "RETURN a"), (2, None), (3, "RETURN a"), (4, "RETURN b, c")], "id int, t string")
    df = cypher_queries.by_text(own, "items", cypher.returned)
    assert {r.id: r["items"] for r in df.collect()} == {1: ["a"], 2: None, 3: ["a"], 4: ["b", "c"]}
    plan = cypher_queries.cypher_return_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join"):]
