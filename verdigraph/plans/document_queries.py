"""Query documents over the graph of the test tables, each with its SQL: one for every kind of question that documents can ask."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from verdigraph.operators import document_tags
from verdigraph.operators.documents import hypotheses
from verdigraph.plans.graph_queries import load
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DOCUMENTS: dict[str, str] = {}


def ask(name: str, sql: str, document: list[dict], which: int = 0) -> None:
    DOCUMENTS[name] = json.dumps(document)
    QUERIES[name] = lambda spark, d: hypotheses(DOCUMENTS[name], load(spark, d))[which]
    ORACLE_SQL[name] = sql


def of(var: str, name: str = "name") -> dict:
    return {"attribute_name": name, "of": var}


def test(left, operator: str, right) -> dict:
    return {"left": left, "operator": operator, "right": right}


def entities(**kinds: str) -> list[dict]:
    return [{"id": i, "type": t} for i, t in kinds.items()]


def edge(name: str, src: str, role: str, dst: str) -> dict:
    return {"id": name, "role": role, "from": src, "to": dst}


def elements(var: str, **modifiers) -> dict:
    return {"list": {"list_elements": var}, **modifiers}


def most(var: str, name: str, kind: str = "MAX", **modifiers) -> dict:
    return {"source": elements(var, **modifiers), "map_expression": of(var, name), "aggregate_kind": kind}


ask(
    "doc_distinct",
    "SELECT DISTINCT 'c' || c_custkey AS e1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' AND c_acctbal > 5000",
    [{"target": ["e1"], "entities": entities(e1="Customer", e2="Order", e3="Part"), "relationships": [edge("r1", "e1", "placed", "e2"), edge("r2", "e2", "contains", "e3")],
      "constraint": {"and_conditions": [test(of("e3", "label"), "=", "Brand#11"), test(of("e1", "amount"), ">", 5000)]}, "distinct": True}],
)
ask(
    "doc_either",
    "SELECT DISTINCT 's' || s_suppkey AS e1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE n_name LIKE '%3%' OR p_brand = 'Brand#23'",
    [{"target": ["e1"], "entities": entities(e1="Supplier", e2="Nation", e3="Part"), "relationships": [edge("r1", "e1", "located_in", "e2"), edge("r2", "e1", "supplies", "e3")],
      "constraint": {"or_conditions": [test(of("e2"), "CONTAINS", "3"), test(of("e3", "label"), "=", "Brand#23")]}, "distinct": True}],
)
ask(
    "doc_attributes",
    "SELECT o_orderdate::TIMESTAMP AS e1_at, o_totalprice AS e1_amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    [{"target": [of("e1", "at"), of("e1", "amount")], "entities": entities(e1="Order", e2="Customer"), "relationships": [edge("r1", "e2", "placed", "e1")],
      "constraint": test(of("e2", "label"), "=", "BUILDING")}],
)
ask(
    "doc_shared_value",
    "SELECT n_name AS e1_name FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE s_acctbal > c_acctbal",
    [{"target": [of("e1")], "entities": entities(e1="Nation", e4="Supplier", e2="Customer"), "relationships": [edge("r3", "e4", "located_in", "e1"), edge("r1", "e2", "located_in", "e1")],
      "constraint": test(of("e4", "amount"), ">", of("e2", "amount"))}],
)
ask(
    "doc_edges",
    "SELECT 'n' || n_nationkey AS r2_src, 'part_of' AS r2_role, 'r' || n_regionkey AS r2_dst FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 9000",
    [{"target": ["r2"], "entities": entities(e1="Customer", e2="Nation", e3="Region"), "relationships": [edge("r1", "e1", "located_in", "e2"), edge("r2", "e2", "", "e3")],
      "constraint": {"and_conditions": [test(of("e1", "label"), "!=", "BUILDING"), test(of("e1", "amount"), ">", 9000)]}}],
)
ask(
    "doc_list",
    "SELECT 'c' || c_custkey AS e1, coalesce(list('o' || o_orderkey ORDER BY 'o' || o_orderkey) FILTER (o_orderkey IS NOT NULL), []) AS target_2 FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 2 GROUP BY c_custkey",
    [{"target": ["e1", elements("e2")], "entities": entities(e1="Customer", e2="Order", e3="Nation", e4="Region"),
      "relationships": [edge("r1", "e1", "located_in", "e3"), edge("r2", "e1", "placed", "e2"), edge("r3", "e3", "part_of", "e4")], "constraint": test(of("e4", "id"), "=", "r2")}],
)
ask(
    "doc_all",
    "SELECT 'n' || n_nationkey AS e1 FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT s_acctbal > 0)",
    [{"target": ["e1"], "entities": entities(e1="Nation", e2="Supplier"), "relationships": [edge("r1", "e2", "located_in", "e1")],
      "constraint": {"source": elements("e2"), "condition": test(of("e2", "amount"), ">", 0), "quantifier_kind": "ALL"}}],
)
ask(
    "doc_path_hops",
    "SELECT ['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey] AS p1, ['located_in', 'part_of'] AS p1_roles FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE regexp_matches(s_name, '^Supplier.*7$') AND contains(r_name, 'A') ORDER BY p1 LIMIT 5",
    [{"target": ["p1"], "entities": entities(e1="Supplier", e2="Region"), "paths": [{"id": "p1", "start": "e1", "end": "e2", "roles": ["located_in", "part_of"]}],
      "constraint": {"and_conditions": [test(of("e1"), "MATCHES_REGEX", "^Supplier.*7$"), test(of("e2"), "CONTAINS", "A"), test({"count": {"list": {"rels_of": "p1", "rel_id": "r1"}}}, "=", 2)]}, "limit": 5}],
)
ask(
    "doc_path_nodes",
    "SELECT ['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey] AS p1, ['located_in', 'part_of'] AS p1_roles, ['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey] AS target_2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
    [{"target": ["p1", {"list": {"nodes_of": "p1", "node_id": "e3"}}], "entities": entities(e1="Supplier", e2="Region"), "paths": [{"id": "p1", "start": "e1", "end": "e2", "roles": ["located_in", "part_of"]}],
      "constraint": test(of("e2", "id"), "=", "r1")}],
)
ask(
    "doc_ranked",
    "SELECT 'o' || o_orderkey AS e1 FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' ORDER BY o_totalprice DESC, 'o' || o_orderkey OFFSET 10 LIMIT 5",
    [{"target": ["e1"], "entities": entities(e1="Order"), "constraint": test(of("e1", "at"), ">", "1997-01-01"), "order_by": [{"expression": of("e1", "amount"), "direction": "DESC"}], "limit": 5, "skip": 10}],
)
ask(
    "doc_path_sum",
    "SELECT 'c' || o_custkey AS e1, 'p' || l_partkey AS e2, round(0.0 + o_totalprice + l_extendedprice, 4) AS target_3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12'",
    [{"target": ["e1", "e2", {"source": {"list": {"rels_of": "p1", "rel_id": "r1"}}, "map_expression": of("r1", "price"), "aggregate_kind": "SUM"}], "entities": entities(e1="Customer", e2="Part"),
      "paths": [{"id": "p1", "start": "e1", "end": "e2", "roles": ["placed", "contains"]}],
      "constraint": {"and_conditions": [test(of("e2", "label"), "=", "Brand#12"), test({"count": {"list": {"rels_of": "p1", "rel_id": "r1"}}}, "<=", 2)]}}],
)
ask(
    "doc_maximum",
    "SELECT max(c_acctbal) AS target_1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)",
    [{"target": [most("e1", "amount")], "entities": entities(e1="Customer", e2="Nation", e3="Supplier"), "relationships": [edge("r1", "e1", "located_in", "e2"), edge("r2", "e3", "located_in", "e2")],
      "constraint": {"source": elements("e3"), "condition": test(of("e3", "amount"), ">", 9000), "quantifier_kind": "EXISTS"}}],
)
ask(
    "doc_edge_attributes",
    "SELECT l_quantity AS r1_quantity, l_extendedprice AS r1_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND p_brand <> 'Brand#11'",
    [{"target": [of("r1", "quantity"), of("r1", "price")], "entities": entities(e1="Order", e2="Part"), "relationships": [edge("r1", "e1", "contains", "e2")],
      "constraint": {"and_conditions": [test(of("e1", "label"), "=", "F"), test(of("e2", "label"), "!=", "Brand#11")]}}],
)
_LATE = test(of("e2", "at"), ">", "1998-01-01")
_RICH = test(of("e1", "amount"), "=", most("e3", "amount"))
_DEAR = test(of("e2", "amount"), "=", most("e4", "amount", filter=test(of("e4", "at"), ">", "1998-01-01")))
_BOTH = entities(e1="Customer", e2="Order", e3="Customer", e4="Order")
_BUILDING = {"e1": test(of("e1", "label"), "=", "BUILDING"), "e3": test(of("e3", "label"), "=", "BUILDING")}
_READINGS = [
    {"target": ["e1", "e2"], "entities": _BOTH, "constraint": {"and_conditions": [_LATE, _RICH, _DEAR]}},
    {"target": ["e1", "e2"], "entities": _BOTH, "constraint": {"and_conditions": [_LATE, _BUILDING["e1"], test(of("e1", "amount"), "=", most("e3", "amount", filter=_BUILDING["e3"])), _DEAR]}},
]
_ORDERS = " UNION ALL SELECT NULL, 'o' || o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_totalprice = (SELECT max(o_totalprice) FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')"
ask("doc_readings_first", "SELECT 'c' || c_custkey AS e1, NULL AS e2 FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)" + _ORDERS, _READINGS)
ask("doc_readings_second", "SELECT 'c' || c_custkey AS e1, NULL AS e2 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal = (SELECT max(c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING')" + _ORDERS, _READINGS, 1)
ask(
    "doc_counted",
    "SELECT 'o' || l_orderkey AS e1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 920 GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 3",
    [{"target": ["e1"], "entities": entities(e1="Order", e2="Part"), "relationships": [edge("r1", "e1", "contains", "e2")],
      "constraint": test({"count": elements("e2", filter=test(of("e2", "amount"), ">", 920), distinct=True)}, ">", 3), "distinct": True}],
)
ask(
    "doc_distinct_values",
    "SELECT DISTINCT c_mktsegment AS e1_label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    [{"target": [of("e1", "label")], "entities": entities(e1="Customer", e2="Nation", e3="Region"), "relationships": [edge("r1", "e1", "located_in", "e2"), edge("r2", "e2", "part_of", "e3")],
      "constraint": test(of("e3", "id"), "=", "r1"), "distinct": True}],
)
ask(
    "doc_every_and_never",
    "SELECT DISTINCT 'o' || o_orderkey AS e1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
    [{"target": ["e1"], "entities": entities(e1="Order", e2="Part", e4="Customer"), "relationships": [edge("r1", "e1", "contains", "e2"), edge("r3", "e4", "placed", "e1")],
      "constraint": {"and_conditions": [test(of("e2", "id"), "=", "p7"), {"source": elements("e2"), "condition": "r1", "quantifier_kind": "ALL"},
        {"not_condition": {"and_conditions": ["r3", test(of("e4", "label"), "=", "BUILDING")]}}]}, "distinct": True}],
)
ask(
    "doc_never",
    "SELECT 'c' || c_custkey AS e1 FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    [{"target": ["e1"], "entities": entities(e1="Customer", e2="Order"), "relationships": [edge("r1", "e1", "placed", "e2")],
      "constraint": {"not_condition": {"and_conditions": ["r1", test(of("e2", "label"), "=", "P")]}}, "distinct": True}],
)
ask(
    "doc_self_pair",
    "SELECT DISTINCT 's' || a.s_suppkey AS e1 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND a.s_acctbal < b.s_acctbal",
    [{"target": ["e1"], "entities": entities(e1="Supplier", e2="Supplier", e3="Nation"), "relationships": [edge("r1", "e1", "located_in", "e3"), edge("r2", "e2", "located_in", "e3")],
      "constraint": {"and_conditions": [test(of("e1", "id"), "!=", of("e2", "id")), test(of("e1", "amount"), "<", of("e2", "amount"))]}, "distinct": True}],
)
ask(
    "doc_same_list",
    "SELECT 'p' || p_partkey AS e1 FROM part WHERE p_brand = 'Brand#13' AND p_retailprice = (SELECT max(p_retailprice) FROM part WHERE p_brand = 'Brand#13')",
    [{"target": ["e1"], "entities": entities(e1="Part"), "constraint": {"and_conditions": [test(of("e1", "label"), "=", "Brand#13"), test(of("e1", "amount"), "=", most("e1", "amount"))]}}],
)
ask(
    "doc_counts",
    "SELECT (SELECT count(*) FROM nation) AS target_1, (SELECT count(*) FROM part WHERE p_brand = 'Brand#11') AS target_2",
    [{"target": [{"count": elements("e1")}, {"count": elements("e2", filter=test(of("e2", "label"), "=", "Brand#11"))}], "entities": entities(e1="Nation", e2="Part")}],
)
ask(
    "doc_whether",
    "SELECT EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_acctbal < 0) AS target_1",
    [{"target": [test(of("e1", "amount"), "<", 0)], "entities": entities(e1="Supplier", e2="Nation", e3="Region"), "relationships": [edge("r1", "e1", "located_in", "e2"), edge("r2", "e2", "part_of", "e3")],
      "constraint": test(of("e3", "id"), "=", "r1")}],
)
ask(
    "doc_ranked_by_count",
    "SELECT 'n' || n_nationkey AS e1, count(s_suppkey) AS target_2 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey ORDER BY count(s_suppkey) DESC, 'n' || n_nationkey LIMIT 7",
    [{"target": ["e1", {"count": elements("e2")}], "entities": entities(e1="Nation", e2="Supplier"), "relationships": [edge("r1", "e2", "located_in", "e1")],
      "order_by": [{"expression": {"count": elements("e2")}, "direction": "DESC"}], "limit": 7}],
)
ask(
    "doc_either_exists",
    "SELECT 's' || s_suppkey AS e1 FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#55' AND p_retailprice > 1500) OR EXISTS (SELECT 1 FROM nation WHERE s_nationkey = n_nationkey AND n_regionkey = 0)",
    [{"target": ["e1"], "entities": entities(e1="Supplier", e2="Part", e3="Nation", e4="Region"), "relationships": [edge("r1", "e1", "supplies", "e2"), edge("r2", "e1", "located_in", "e3"), edge("r3", "e3", "part_of", "e4")],
      "constraint": {"or_conditions": [{"and_conditions": ["r1", test(of("e2", "label"), "=", "Brand#55"), test(of("e2", "amount"), ">", 1500)]}, {"and_conditions": ["r2", test(of("e4", "id"), "=", "r0")]}]}}],
)


def written(spark, d):
    """doc, text: a document for each customer. Its length, constraint and faults follow from the customer's numbers; every tenth is broken."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 4
    upto = lambda low: F.when(n >= low, F.sequence(F.lit(low), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    joined = lambda items: F.array_join(items, ",")
    entity = joined(F.transform(upto(0), lambda i: F.format_string('{"id":"e%d","type":"T%d"}', i, i)))
    links = joined(F.transform(upto(1), lambda i: F.format_string('{"id":"r%d","role":"to","from":"e%d","to":"e%d"}', i, i - 1, i)))
    plain = F.format_string('{"left":{"attribute_name":"segment","of":"e0"},"operator":"%s","right":"%s"}', F.when(k % 5 == 1, "!=").otherwise("="), "c_mktsegment")
    constraint = (
        F.when(k % 5 == 1, plain)
        .when(k % 5 == 2, F.concat(F.lit('{"and_conditions":[{"left":{"attribute_name":"since","of":"r1"},"operator":"<=","right":5},{"left":{"attribute_name":"name","of":"e0"},"operator":"CONTAINS","right":"a \\"count\\": 1"}]}')))
        .when(k % 5 == 3, F.concat(F.lit('{"source":{"list":{"list_elements":"e0"}},"quantifier_kind":"NONE","condition":'), plain, F.lit("}")))
        .when(k % 5 == 4, F.lit('{"left":{"count":{"list":{"list_elements":"e1"}}},"operator":">","right":3}'))
    )
    more = F.concat(F.when(constraint.isNull(), "").otherwise(F.concat(F.lit(',"constraint":'), constraint)), F.when(k % 3 == 0, ',"limit":5').otherwise(""), F.when(k % 11 == 0, ',"note":[1,[2,{"a":null}]]').otherwise(""))
    query = F.concat(F.lit('{"target":["e0"],"entities":['), entity, F.lit('],"relationships":['), links, F.lit("]"), more, F.lit("}"))
    text = F.concat(F.lit("["), query, F.when(k % 7 == 0, F.concat(F.lit(","), query)).otherwise(""), F.when(k % 10 == 9, "").otherwise("]"))
    return table(spark, d, "customer").select(k.alias("doc"), text.alias("text"))


_TAGGED = """(SELECT c_custkey AS doc, list_filter([CASE WHEN k % 7 = 0 THEN 'multi_hypothesis' END, CASE WHEN n >= 1 THEN 'relationships' END, CASE WHEN n >= 2 THEN 'multi_hop' END,
  CASE WHEN k % 5 = 2 AND n >= 1 THEN 'relationship_attributes' END, CASE WHEN k % 5 = 4 THEN 'aggregations' END, CASE WHEN k % 5 = 3 THEN 'quantifiers' END, CASE WHEN k % 3 = 0 THEN 'modifiers' END,
  CASE WHEN k % 5 = 2 THEN 'complex_constraints' END, CASE WHEN k % 5 IN (1, 3) THEN 'negation' END, CASE WHEN k % 5 = 2 THEN 'string_matching' END], lambda t: t IS NOT NULL AND k % 10 <> 9) AS found,
  CASE WHEN k % 10 = 9 THEN 0 ELSE n END AS hops FROM (SELECT c_custkey, c_custkey AS k, (c_nationkey % 4)::INT AS n FROM customer))"""
_SHOWN = f"(SELECT doc, CASE WHEN len(found) > 0 THEN found ELSE ['simple_structures'] END AS tags, hops FROM {_TAGGED})"


def document_features(spark, d):
    return document_tags.tags(written(spark, d))


def document_feature_counts(spark, d):
    return document_tags.tag_counts(document_tags.tags(written(spark, d)), 200)


def document_violations(spark, d):
    return document_tags.violations(written(spark, d))


QUERIES |= {f.__name__: f for f in (document_features, document_feature_counts, document_violations)}
ORACLE_SQL |= {
    "document_features": f"SELECT doc, tags, hops FROM {_SHOWN}",
    "document_feature_counts": f"SELECT tag, count(*) AS n, count(*) < 200 AS below FROM (SELECT unnest(tags) AS tag FROM {_SHOWN}) GROUP BY tag",
    "document_violations": """WITH q AS (SELECT k, n, unnest(CASE WHEN k % 7 = 0 THEN ['$/#0', '$/#1'] ELSE ['$/#0'] END) AS query FROM (SELECT c_custkey AS k, c_nationkey % 4 AS n FROM customer) WHERE k % 10 <> 9)
SELECT c_custkey AS doc, NULL AS query, 'not flat' AS problem, NULL AS detail FROM customer WHERE c_custkey % 10 = 9
UNION ALL SELECT k, query, 'unknown field', 'note' FROM q WHERE k % 11 = 0
UNION ALL SELECT k, query, 'not declared', CASE k % 5 WHEN 2 THEN 'r1' ELSE 'e1' END FROM q WHERE n = 0 AND k % 5 IN (2, 4)""",
}
