"""Element tags of Cypher texts, worked out by hand."""

from pyspark.sql import functions as F

from verdigraph.functions.elements import elements

BASE = {"ENTITY", "One hypothesis"}
WORKED = {
    "MATCH (n:Person) RETURN n": {"Target ENTITY_ID"},
    "MATCH (a)-->(b) RETURN DISTINCT b SKIP 2": {"Query distinct", "Query skip", "Relationship with any role", "Target ENTITY_ID", "relationships"},
    "MATCH (n) WHERE n.v > 3 OR n.v <> 4 RETURN avg(n.v)": {"OR", "!=", ">", "AVG", "CREATE_LIST", "COMPARISON", "SCALAR_AGGREGATE", "LIST (any kind)", "LIST.filter", "constraint", "ATTRIBUTE (anywhere)", "NUMBER value", "Target SCALAR_AGGREGATE"},
    "MATCH (a)-[e]->(b) RETURN e, type(e)": {"Relationship with any role", "relationships", "Target RELATIONSHIP_ID", "Target properties(), labels(), type() or keys()", "Several targets"},
    "MATCH p = (a)-[:X*2]->(b) RETURN nodes(p), b.name": {"PATH", "PATH with a role list", "NODES", "Target LIST", "Target ATTRIBUTE", "Several targets", "ATTRIBUTE (anywhere)", "=", "COMPARISON", "constraint", "COUNT", "RELATIONS", "NUMBER value", "LIST (any kind)"},
    "MATCH (n) WHERE all(x IN n.tags WHERE x = true) RETURN count(n) AS c ORDER BY c ASC": {"QUANTIFIER ALL", "QUANTIFIER_PREDICATE", "BOOLEAN value", "COUNT", "CREATE_LIST", "LIST (any kind)", "LIST.filter", "order_by", "ASC", "Target COUNT", "=", "COMPARISON", "constraint", "ATTRIBUTE (anywhere)"},
    "RETURN 1": {"Target ENTITY_ID", "NUMBER value"},
    "": set(),
    # An alias of an alias is followed one step, from what was said last.
    "MATCH (a) WITH a.x AS v, max(a.y) AS m WITH v AS w, m RETURN m, w": {"Target SCALAR_AGGREGATE", "Target ENTITY_ID", "Several targets", "MAX", "SCALAR_AGGREGATE", "CREATE_LIST", "LIST (any kind)", "ATTRIBUTE (anywhere)"},
    # Words and signs inside literals don't count, dates do.
    "MATCH (n) WHERE n.d = '2020-01-31' AND n.t = 'a OR b -[*]- LIMIT' RETURN n": {"=", "AND", "COMPARISON", "constraint", "ATTRIBUTE (anywhere)", "STRING value", "DATE_TIME", "Target ENTITY_ID"},
    "MATCH (a)-[r:KNOWS {w: 2}]->(b:B|C) RETURN r.w": {"Relationship with a role", "relationships", "Relationship attribute", "Several role types or labels", "=", "COMPARISON", "constraint", "ATTRIBUTE (anywhere)", "NUMBER value", "Target relationship attribute"},
    "MATCH (n) WHERE n.name =~ 'a.*' AND NOT (n)<-[:X]-() RETURN size(n.name)": {"=~", "MATCHES_REGEX", "COMPARISON", "AND", "NOT", "constraint", "ATTRIBUTE (anywhere)", "STRING value", "RELATIONSHIP_ID as a condition", "Relationship with a role", "relationships", "size() or length() of a property"},
    "MATCH (n) WHERE n.a CONTAINS 'x' RETURN n.a AS a, n.b AS b UNION ALL MATCH (m) WHERE m.a IS NULL RETURN m.a AS a, m.b AS b": {"CONTAINS", "COMPARISON", "constraint", "ATTRIBUTE (anywhere)", "STRING value", "UNION", "IS NULL or IS NOT NULL", "=", "Target ATTRIBUTE", "Several targets"},
}


def test_worked_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WORKED)] + [(99, None)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", elements(F.col("t")).alias("e")).collect()}
    assert got.pop(99) is None
    for i, (text, tags) in enumerate(WORKED.items()):
        assert set(got[i]) == BASE | tags, text
        assert got[i] == sorted(got[i])
