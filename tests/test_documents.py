"""Query documents: scoping rules and refusals on a small graph, and their parts, tags and faults against plain walks."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigraph.operators import document_tags
from verdigraph.operators.documents import hypotheses
from verdigraph.operators.graph import Graph
from verdigraph.plans.skew import repeated


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("a1", "Airline", "Ada", 5), ("a2", "Airline", "Bob", None), ("a3", "Airline", "", 9), ("p1", "Airport", "Reyk", 1), ("p2", "Airport", "Akur", 2), ("p3", "Airport", "Oslo", 3), ("i", "Country", "Iceland", 0), ("n", "Country", "Norway", 0), ("x", "Authority", "X", 0)]
    edges = [("flies_to", "a1", "p1", 10.0), ("flies_to", "a1", "p2", 20.0), ("flies_to", "a1", "p3", 5.0), ("flies_to", "a2", "p1", 7.0), ("flies_to", "a2", "p1", 8.0), ("flies_to", "a3", "p1", 1.0), ("flies_to", "a3", "p2", 2.0), ("in", "p1", "i", None), ("in", "p2", "i", None), ("in", "p3", "n", None), ("fined", "x", "a1", None)]
    return Graph(spark.createDataFrame(nodes, "id string, type string, name string, size int"), spark.createDataFrame(edges, "role string, src string, dst string, price double"))


def ask(g, *queries):
    return [sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr) for df in hypotheses(json.dumps(list(queries)), g)]


def of(var, name="name"):
    return {"attribute_name": name, "of": var}


def test(left, operator, right):
    return {"left": left, "operator": operator, "right": right}


test.__test__ = False
AIRLINE, AIRPORT = {"id": "e1", "type": "Airline"}, {"id": "e2", "type": "Airport"}
FLIES = {"id": "r1", "role": "flies_to", "from": "e1", "to": "e2"}
LIST = {"list": {"list_elements": "e2"}}


def test_every_airport_of_a_country_and_never_fined(g):
    query = {
        "target": ["e1"], "entities": [AIRLINE, AIRPORT, {"id": "e3", "type": "Country"}, {"id": "e4", "type": "Authority"}],
        "relationships": [FLIES, {"id": "r2", "role": "in", "from": "e2", "to": "e3"}, {"id": "r3", "role": "fined", "from": "e4", "to": "e1"}],
        "constraint": {"and_conditions": [test(of("e3"), "=", "Iceland"), {"source": LIST, "condition": "r1", "quantifier_kind": "ALL"}, {"not_condition": "r3"}]}, "distinct": True,
    }
    assert ask(g, query) == [[("a3",)]]
    query["constraint"]["and_conditions"].pop()
    # Now it is declared only, so it must hold.
    assert ask(g, query) == [[("a1",)]]
    query["relationships"].pop()
    assert ask(g, query) == [[("a1",), ("a3",)]]
    query["constraint"]["and_conditions"][1]["quantifier_kind"] = "NONE"
    assert ask(g, query) == [[]]
    # Over an empty list ALL holds.
    query["constraint"]["and_conditions"][0] = test(of("e3"), "=", "Nowhere")
    query["constraint"]["and_conditions"][1]["quantifier_kind"] = "ALL"
    assert ask(g, query) == [[("a1",), ("a2",), ("a3",)]]


def test_lists_are_bags_unless_distinct(g):
    query = {"target": ["e1", {"count": LIST}, {"count": {**LIST, "distinct": True}}, {"source": {**LIST, "filter": test(of("r1", "price"), ">", 7)}, "map_expression": of("r1", "price"), "aggregate_kind": "SUM"}], "entities": [AIRLINE, AIRPORT], "relationships": [FLIES]}
    assert ask(g, query) == [[("a1", 3, 3, 30.0), ("a2", 2, 1, 8.0), ("a3", 2, 2, None)]]


def test_lists_have_order_skip_and_limit(g):
    shown = {**LIST, "order_by": [{"expression": of("e2", "size"), "direction": "DESC"}], "skip": 1, "limit": 1}
    assert ask(g, {"target": ["e1", shown], "entities": [AIRLINE, AIRPORT], "relationships": [FLIES]}) == [[("a1", ("p2",)), ("a2", ("p1",)), ("a3", ("p1",))]]
    assert ask(g, {"target": ["e1", {**LIST, "order_by": shown["order_by"]}], "entities": [AIRLINE, AIRPORT], "relationships": [FLIES]})[0][0] == ("a1", ("p3", "p2", "p1"))


def test_missing_and_empty_attributes(g):
    names = lambda c: ask(g, {"target": ["e1"], "entities": [AIRLINE], "constraint": c})[0]
    assert names(test(of("e1", "size"), ">", 0)) == [("a1",), ("a3",)] and names({"not_condition": test(of("e1", "size"), ">", 6)}) == [("a1",)]
    assert names(test(of("e1"), "=", "")) == [("a3",)] and names(test(of("e1"), "!=", "")) == [("a1",), ("a2",)]
    assert names({"or_conditions": [test(of("e1"), "MATCHES_REGEX", "^A"), test(of("e1"), "CONTAINS", "ob")]}) == [("a1",), ("a2",)]


def test_alternatives_stay_apart(g):
    one = {"target": ["e1"], "entities": [AIRLINE]}
    assert ask(g, one, {**one, "order_by": [{"expression": of("e1", "size"), "direction": "DESC"}], "limit": 1}) == [[("a1",), ("a2",), ("a3",)], [("a3",)]]


def test_targets_that_nothing_connects_stand_beside_each_other(g):
    got = ask(g, {"target": ["e1", "e3"], "entities": [AIRLINE, {"id": "e3", "type": "Country"}], "constraint": test(of("e1", "size"), ">", 6)})[0]
    assert got == [("a3", None), (None, "i"), (None, "n")]
    # An equality connects them.
    assert ask(g, {"target": ["e1", "e2"], "entities": [AIRLINE, AIRPORT], "constraint": {"and_conditions": [test(of("e1"), "!=", of("e2")), test(of("e1", "size"), "=", of("e2", "size"))]}}) == [[]]


def test_the_same_list_ranges_over_the_rest(g):
    best = {"source": {"list": {"list_elements": "e2"}}, "map_expression": of("e2", "size"), "aggregate_kind": "MAX"}
    query = {"target": ["e2"], "entities": [AIRPORT, {"id": "e3", "type": "Country"}], "relationships": [{"id": "r2", "role": "in", "from": "e2", "to": "e3"}], "constraint": {"and_conditions": [test(of("e3"), "=", "Iceland"), test(of("e2", "size"), "=", best)]}}
    assert ask(g, query) == [[("p2",)]]


def test_paths_and_their_parts(g):
    path = {"id": "p1", "start": "e1", "end": "e3", "roles": ["flies_to", "in"]}
    parts = {"source": {"list": {"rels_of": "p1", "rel_id": "r9"}}, "map_expression": of("r9", "price"), "aggregate_kind": "MAX"}
    query = {"target": ["p1", parts], "entities": [AIRLINE, {"id": "e3", "type": "Country"}], "paths": [path], "constraint": {"and_conditions": [test(of("e3"), "=", "Norway"), test({"count": {"list": {"rels_of": "p1", "rel_id": "r8"}}}, "<=", 2)]}}
    assert ask(g, query) == [[(("a1", "p3", "n"), ("flies_to", "in"), 5.0)]]
    within = {"source": {"list": {"nodes_of": "p1", "node_id": "e9"}}, "condition": test(of("e9", "id"), "=", "p2"), "quantifier_kind": "EXISTS"}
    query["target"], query["constraint"]["and_conditions"][0] = ["e1"], within
    assert ask(g, query) == [[("a1",), ("a3",)]]


def test_conditions_alone(g):
    assert ask(g, {"target": [test(of("e1", "size"), ">", 8), test(of("e1", "size"), ">", 9)], "entities": [AIRLINE]}) == [[(True, False)]]


@pytest.mark.parametrize(("query", "why"), [
    ({"target": ["e1"], "entities": [AIRLINE, AIRLINE]}, "twice"),
    ({"target": ["e7"], "entities": [AIRLINE]}, "not declared"),
    ({"target": ["e1"], "entities": [AIRLINE], "relationships": [FLIES]}, "not declared: e2"),
    ({"target": ["e1"], "entities": [AIRLINE], "constraint": test(of("zz"), "=", 1)}, "not declared: zz"),
    ({"target": ["e1"], "entities": [AIRLINE, AIRPORT], "constraint": test(of("e1", "size"), "<", of("e2", "size"))}, "cross product"),
    ({"target": ["e1"], "entities": [AIRLINE, AIRPORT], "constraint": test(of("e2", "size"), "<", 1)}, "nothing connects"),
    ({"target": ["e1"], "entities": [AIRLINE], "constraint": test(of("e1", "wings"), "=", 2)}, "no attribute wings"),
    ({"target": ["e1"], "entities": [AIRLINE], "constraint": test(of("e1", "size"), "~", 2)}, "no operator"),
    ({"target": [], "entities": [AIRLINE]}, "target"),
])
def test_refusals(g, query, why):
    with pytest.raises(ValueError, match=why):
        hypotheses([query], g)
    with pytest.raises(ValueError, match="at least one"):
        hypotheses("[]", g)


# Parts, tags, faults.


def walk(value):
    if isinstance(value, dict):
        yield value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(inner)


def plain_tags(text):
    try:
        whole = json.loads(text)
    except (TypeError, ValueError):
        return [document_tags.PLAIN], 0
    dicts = list(walk(whole))
    keys = {k for d in dicts for k in d}
    own = {r["id"] for d in dicts for r in d.get("relationships", []) if "id" in r}

    def far(q):
        near = Counter()
        ties = [(r.get("from"), r.get("to")) for r in q.get("relationships", [])]
        at = {t for t in q["target"] if isinstance(t, str)}
        at |= {e for r in q.get("relationships", []) if r.get("id") in at for e in (r["from"], r["to"])}
        n = 0
        while at - near.keys():
            near.update({a: n + 1 for a in at - near.keys()})
            at = {y for x in near for a, b in ties for y in ((b,) if a == x else (a,) if b == x else ())}
            n += 1
        return max(near.values(), default=1) - 1

    hops = max((far(d) for d in dicts if "target" in d), default=0)
    said = lambda k, *v: any(d.get(k) in v for d in dicts if isinstance(d.get(k), str))
    found = {
        "multi_hypothesis": isinstance(whole, list) and len(whole) > 1, "relationships": own, "multi_hop": hops >= 2, "relationship_attributes": any(d.get("of") in own for d in dicts), "paths": any(d.get("paths") for d in dicts),
        "aggregations": keys & {"aggregate_kind", "count"}, "quantifiers": "quantifier_kind" in keys, "modifiers": keys & {"order_by", "limit", "skip"}, "complex_constraints": keys & {"and_conditions", "or_conditions"},
        "negation": "not_condition" in keys or said("operator", "!=") or said("quantifier_kind", "NONE"), "string_matching": said("operator", "CONTAINS", "MATCHES_REGEX"),
    }
    return [t for t in document_tags.TAGS if found[t]] or [document_tags.PLAIN], hops


def condition(rng, depth):
    kind = rng.randint(0, 5) if depth else 0
    if kind < 2:
        return test(of(rng.choice(["e0", "e1", "r1", "r2"])), rng.choice(["=", "!=", "CONTAINS", ">"]), rng.choice([1, 'a "count": b', None, True, [1, {"limit": 2}][:1]]))
    if kind == 2:
        return {"not_condition": condition(rng, depth - 1)}
    if kind == 3:
        return {rng.choice(["and_conditions", "or_conditions"]): [condition(rng, depth - 1) for _ in range(rng.randint(0, 2))]}
    if kind == 4:
        return {"source": {"list": {"list_elements": "e1"}, "filter": condition(rng, depth - 1)}, "condition": condition(rng, depth - 1), "quantifier_kind": rng.choice(["ALL", "NONE"])}
    return test({"count": {"list": {"list_elements": "e1"}}}, ">", 3)


def some_query(rng):
    n = rng.randint(1, 5)
    query = {"target": rng.choice([["e0"], ["r1"], ["e0", "e2"], [{"count": {"list": {"list_elements": "e0"}}}]]), "entities": [{"id": f"e{i}", "type": "T"} for i in range(n)]}
    if rng.random() < 0.8:
        query["relationships"] = [{"id": f"r{i}", "role": "x", "from": f"e{rng.randrange(n)}", "to": f"e{rng.randrange(n)}"} for i in range(1, rng.randint(1, 5))]
    for k, v in (("paths", []), ("paths", [{"id": "p1", "roles": []}]), ("limit", 3), ("distinct", True)):
        if rng.random() < 0.3:
            query[k] = v
    if rng.random() < 0.8:
        query["constraint"] = condition(rng, rng.randint(0, 5))
    return query


def test_tags_like_a_plain_walk(spark):
    rng = random.Random(11)
    texts = [json.dumps([some_query(rng) for _ in range(rng.randint(1, 2))]) for _ in range(80)]
    texts += ["", "[]", "{}", "null", "5", '"x"', "[[1]]", "{bad", None, json.dumps(some_query(rng)), '[{"target": ["e1"], "relationships": []}]']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    assert {r.doc: (r.tags, r.hops) for r in document_tags.tags(docs).collect()} == {i: plain_tags(t) for i, t in enumerate(texts)}


def test_violations(spark):
    good = {"target": ["e1", "r1"], "entities": [AIRLINE, AIRPORT], "relationships": [FLIES]}
    texts = [
        [good], [{**good, "colour": 1, "constraint": test(of("e9"), "like", 1)}], [{"target": ["e1"]}, good], [{**good, "entities": [AIRLINE, AIRLINE, AIRPORT]}], [[good]], good, [good, 3],
        [{**good, "limit": "5", "order_by": [{"expression": of("e1"), "direction": "UP"}], "relationships": [{"id": "r1", "from": "e1", "to": "e2"}]}],
    ]
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(100, "{"), (101, None)], "doc int, text string")
    got = sorted((r.doc, r.query, r.problem, r.detail) for r in document_tags.violations(docs).fillna("").collect())
    assert got == sorted([
        (1, "$/#0", "unknown field", "colour"), (1, "$/#0", "not declared", "e9"), (1, "$/#0", "unknown name", "operator like"), (2, "$/#0", "missing field", "entities"), (2, "$/#0", "not declared", "e1"),
        (3, "$/#0", "declared twice", "e1"), (4, "", "not flat", ""), (5, "", "not flat", ""), (6, "", "not flat", ""), (7, "$/#0", "no number", "limit 5"), (7, "$/#0", "unknown name", "direction UP"),
        (7, "$/#0", "missing field", "relationships.role"), (100, "", "not flat", ""), (101, "", "not flat", ""),
    ])
    assert document_tags.tag_counts(spark.createDataFrame([(["a", "b"],), (["a"],)], "tags array<string>"), 2).orderBy("tag").collect() == [("a", 2, False), ("b", 1, True)]
    assert document_tags.violations(docs.limit(0)).count() == 0 and document_tags.tags(docs.limit(0)).withColumn("x", F.lit(1)).count() == 0


def hub(spark, left, right):
    """Suppliers and customers of two nations in one partition, with their amounts; null, equal and signed zero values among them."""
    nodes = [("n0", "Nation", "N0", None), ("n1", "Nation", "N1", None)] + [(f"s{i}", "Supplier", None, v) for i, v in enumerate(left)] + [(f"c{i}", "Customer", None, v) for i, v in enumerate(right)]
    edges = [("located_in", n[0], f"n{int(n[0][1:]) % 3 % 2}") for n in nodes[2:]]
    return Graph(spark.createDataFrame(nodes, "id string, type string, name string, amount double").coalesce(1), spark.createDataFrame(edges, "role string, src string, dst string").coalesce(1))


def pairs(g):
    at, home = {r.id: r.amount for r in g.nodes.collect()}, {}
    for e in g.edges.collect():
        home.setdefault(e.dst, []).append(e.src)
    return [(n, a, b, at[a], at[b]) for n, there in home.items() for a in there for b in there if None not in (at[a], at[b])]


NATION = {"id": "e1", "type": "Nation"}
HOMES = {"entities": [NATION, {"id": "e4", "type": "Supplier"}, {"id": "e2", "type": "Customer"}], "relationships": [{"id": "r3", "role": "located_in", "from": "e4", "to": "e1"}, {"id": "r1", "role": "located_in", "from": "e2", "to": "e1"}]}
MEETS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@pytest.mark.parametrize("operator", MEETS)
def test_one_inequality_is_counted_and_not_compared(spark, operator):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, -0.0, 1.0, 2.0, 2.0, rng.uniform(-3, 3)])
    g = hub(spark, [value() for _ in range(40)], [value() for _ in range(60)])
    met = [(n, a, b, y) for n, a, b, x, y in pairs(g) if a[0] == "s" and b[0] == "c" and MEETS[operator](x, y)]
    want = [m[:3] for m in met]
    query = {"target": ["e1"], **HOMES, "constraint": test(of("e4", "amount"), operator, of("e2", "amount"))}
    some = {"and_conditions": [query["constraint"], test(of("e2", "amount"), ">", 0), test(of("e4", "id"), "!=", "s3")]}
    # When both are asked for, pairs are the answer.
    got = ask(g, {**query, "target": ["e4"], "distinct": True}, query, {**query, "target": ["e2", of("e1")]}, {**query, "target": ["e2", "e4"]}, {**query, "constraint": some})
    assert got == [sorted({(a,) for _, a, _ in want}), sorted((n,) for n, _, _ in want), sorted((b, n.upper()) for n, _, b in want), sorted((b, a) for _, a, b in want), sorted((n,) for n, a, b, y in met if a != "s3" and y > 0)]


def test_pairs_of_one_hub_are_many_tasks_work(spark):
    g = hub(spark, [float(i) for i in range(400)], [float(i) for i in range(400)])
    (df,) = hypotheses([{"target": [of("e1")], **HOMES, "constraint": test(of("e4", "amount"), ">", of("e2", "amount"))}], g)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == sum(n == m and a > b for a in range(400) for b in range(400) for n, m in [(a % 3 % 2, b % 3 % 2)]) and max(sizes) < sum(sizes) / 10


def test_distinct_answers_join_one_value_a_hub(spark, capsys):
    rng = random.Random(4)
    g = hub(spark, [rng.choice([None, 1.0, 2.0, rng.random()]) for _ in range(60)], [])
    query = {
        "target": ["e1"], "entities": [{"id": "e1", "type": "Supplier"}, {"id": "e2", "type": "Supplier"}, {"id": "e3", "type": "Nation"}], "distinct": True,
        "relationships": [{"id": "r1", "role": "located_in", "from": "e1", "to": "e3"}, {"id": "r2", "role": "located_in", "from": "e2", "to": "e3"}],
        "constraint": {"and_conditions": [test(of("e1", "id"), "!=", of("e2", "id")), test(of("e1", "amount"), "<", of("e2", "amount"))]},
    }
    (df,) = hypotheses([query], g)
    assert sorted(r.e1 for r in df.collect()) == sorted({a for _, a, _, x, y in pairs(g) if x < y})
    df.explain()
    assert "max(_value" in capsys.readouterr().out
    # Equal values of different suppliers meet too, so one value a nation wouldn't do.
    query["constraint"]["and_conditions"][1]["operator"] = "<="
    assert ask(g, query) == [sorted({(a,) for _, a, b, x, y in pairs(g) if a != b and x <= y})]


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 200_001), ("b", 65_536), ("c", 1), ("d", 0)], "k string, n long")
    assert {r.k: r["count"] for r in repeated(df, "n").groupBy("k").count().collect()} == {"a": 200_001, "b": 65_536, "c": 1}


def test_equal_texts_are_taken_apart_once(spark, monkeypatch):
    texts = ['[{"target":["e0"],"entities":[],"limit":5}]', '[{"target":["e0"],"entities":[],"note":1}]', "", None]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "doc long, text string")
    seen, parts = [], document_tags.parts
    monkeypatch.setattr(document_tags, "parts", lambda d: (seen.append(d.count()), parts(d))[1])
    assert {r.doc: (r.tags, r.hops) for r in document_tags.tags(docs).collect()} == {i: plain_tags(texts[i % 4] or "") for i in range(40)}
    got = Counter((r.doc % 4, r.problem) for r in document_tags.violations(docs).collect())
    assert got == {(0, "not declared"): 10, (1, "unknown field"): 10, (1, "not declared"): 10, (2, "not flat"): 10, (3, "not flat"): 10}
    assert seen == [3, 3]
