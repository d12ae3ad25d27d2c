import pytest
from pyspark.sql import functions as F

from verdigraph.operators import graph
from verdigraph.plans import graph_queries


@pytest.fixture(scope="module")
def g(spark):
    """A ring a-b-c-a with a branch to d, a double edge, and a node x alone."""
    nodes = spark.createDataFrame([("a", "N", 1.0), ("b", "N", 2.0), ("c", "M", None), ("d", "M", 2.0), ("x", "N", 0.0)], "id string, type string, v double")
    edges = spark.createDataFrame([("to", "a", "b"), ("to", "a", "b"), ("to", "b", "c"), ("to", "c", "a"), ("by", "b", "d")], "role string, src string, dst string")
    return graph.Graph(nodes, edges)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_take_no_edge_twice_and_keep_parallel_edges(spark, g):
    starts = spark.createDataFrame([("a",)], "start_id string")
    got = rows(graph.paths(g, starts, 5).select("end_id", "hops"))
    # The ring a, b, c comes back to a, from where the other of the two edges to b is left.
    assert got == sorted([("b", 1), ("c", 2), ("d", 2), ("a", 3), ("b", 4), ("d", 5)] * 2)
    assert rows(graph.paths(g, starts, 5, roles=["by"])) == []


def test_reach_closes_cycles(spark, g):
    starts = spark.createDataFrame([("a",)], "start_id string")
    assert rows(graph.reach(g, starts, 6).select("end_id", "hops")) == [("a", 3), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(graph.reach(g, starts, 6, 0).select("end_id", "hops")) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]


def test_reach_without_a_bound(spark, g):
    starts = spark.createDataFrame([("a",), ("c",)], "start_id string")
    assert rows(graph.reach(g, starts).filter("start_id = 'a'").select("end_id", "hops")) == [("a", 3), ("b", 1), ("c", 2), ("d", 2)]
    chain = spark.range(14).selectExpr("'r' as role", "id as src", "id + 1 as dst")
    long = graph.reach(graph.Graph(g.nodes, chain), spark.createDataFrame([(0,)], "start_id long"))
    assert (long.count(), long.agg(F.max("hops")).first()[0]) == (14, 14)


def test_bounded_lists(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "if(id % 7 = 0, null, id % 50) as v", "-id as o").unionByName(spark.sql("SELECT 9L as k, cast(null as bigint) as v, 0L as o"))
    whole = dict(rows(graph.lists(df, ["k"], "v", [F.col("o")])))
    assert dict(rows(graph.lists(df, ["k"], "v", [F.col("o")], skip=4, limit=5))) == {k: v[4:9] for k, v in whole.items()} and whole[9] == []
    assert dict(rows(graph.lists(df, ["k"], "v", skip=1, limit=3, distinct=True))) == {k: sorted(set(v))[1:4] for k, v in whole.items()}


def test_quantifiers(g):
    all_nodes, out = graph.entity(g, "s"), graph.bind(graph.relation(g, "s", "t"), g, "t")
    assert [r[0] for r in rows(graph.every(all_nodes, out, F.col("t_v") > 1, "s").select("s_id"))] == ["a", "d", "x"]
    assert [r[0] for r in rows(graph.some(all_nodes, out, "s").select("s_id"))] == ["a", "b", "c"]
    assert [r[0] for r in rows(graph.none(all_nodes, out, "s").select("s_id"))] == ["d", "x"]


def test_ties_and_nulls(g):
    nodes = graph.entity(g, "n")
    assert [r[0] for r in rows(graph.nth_value(nodes, "n_v", 1).select("n_id"))] == ["b", "d"]
    assert rows(graph.nth_value(nodes, "n_v", 9)) == []
    assert rows(graph.lists(nodes, ["n_type"], "n_v")) == [("M", [2.0]), ("N", [0.0, 1.0, 2.0])]
    assert dict(rows(graph.with_degree(nodes, graph.relation(g, "n", "t"), "n").select("n_id", "degree"))) == {"a": 2, "b": 2, "c": 1, "d": 0, "x": 0}


def test_empty_graph(spark, g):
    none = graph.Graph(g.nodes.limit(0), g.edges.limit(0))
    assert rows(graph.relate(graph.entity(none, "a"), none, "a", "b")) == []
    assert rows(graph.nth_value(graph.entity(none, "a"), "a_v", 1)) == []


def test_whole_graph_queries_leave_no_order_or_nation_out(spark):
    d = "/root/testdata/sf0.001"
    orders, lines = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("orders", "lineitem"))
    pairs = orders.join(lines, orders.o_orderkey == lines.l_orderkey).select("o_custkey", "l_suppkey").collect()
    assert {(r.src, r.dst) for r in graph_queries.graph_construct_all(spark, d).collect()} == {(f"c{a}", f"s{b}") for a, b in pairs}
    found = spark.read.parquet(f"{d}/supplier.parquet").collect()
    mean = sum(s.s_acctbal for s in found) / len(found)
    assert {r.id for r in graph_queries.graph_above_average_all(spark, d).collect()} == {f"s{s.s_suppkey}" for s in found if s.s_acctbal > mean}


def test_assertions(spark, g):
    edges = "role string, src string, dst string"
    said = spark.createDataFrame([("to", "a", "b"), ("to", "a", "new"), ("to", "a", "new"), ("by", "a", "b"), (None, "a", "b"), ("to", "a", None)], edges)
    after = graph.asserted(g, said)
    assert rows(after.edges) == sorted([*rows(g.edges), ("to", "a", "new"), ("by", "a", "b")])
    assert [r for r in rows(after.nodes.fillna("-")) if r[0] == "new"] == [("new", "-", None)] and after.nodes.count() == 6
    assert rows(graph.asserted(after, said).edges) == rows(after.edges) and rows(graph.asserted(g, said.limit(0)).edges) == rows(g.edges)


def test_asserted_attributes_keep_to_new_edges(spark, g):
    own = graph.Graph(g.nodes, spark.createDataFrame([("to", "a", "b", 1.0)], "role string, src string, dst string, w double"))
    said = spark.createDataFrame([("to", "a", "b", 9.0), ("to", "b", "a", 2.0), ("to", "b", "a", 3.0)], "role string, src string, dst string, w double")
    assert rows(graph.asserted(own, said).edges) == [("to", "a", "b", 1.0), ("to", "b", "a", 3.0)]
    assert sorted(tuple(r) for r in graph.asserted(own, said.drop("w").filter("src = 'b'")).edges.collect() if r.w is None) == [("to", "b", "a", None)]


def test_retractions(spark, g):
    left = lambda *said: rows(graph.retracted(g, spark.createDataFrame(list(said), "role string, src string, dst string")).edges)
    assert left(("to", "a", "b")) == [("by", "b", "d"), ("to", "b", "c"), ("to", "c", "a")]
    assert left(("to", "b", None)) == [("by", "b", "d"), ("to", "a", "b"), ("to", "a", "b"), ("to", "c", "a")]
    assert left((None, "b", None), (None, None, "a")) == [("to", "a", "b"), ("to", "a", "b")] and left(("to", None, None)) == [("by", "b", "d")]
    # A statement about nothing retracts nothing.
    assert left((None, None, None)) == rows(g.edges)


def test_coordinated(spark):
    subjects = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "n int, id string")
    objects = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (3, "z")], "n int, id string")
    assert rows(graph.coordinated(subjects, "likes", objects, ["n"])) == [("likes", s, o) for s in "ab" for o in "xy"]


def test_one_id_reads_only_its_kinds(spark):
    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan"), plan

    n, plan = scans(graph_queries.load(spark, "/root/testdata/sf0.001", dst="p7").edges)
    assert n == 2 and plan.count("EqualTo(l_partkey,7)") == 2
    n, plan = scans(graph_queries.load(spark, "/root/testdata/sf0.001", node="n3").nodes)
    assert n == 1 and "EqualTo(n_nationkey,3)" in plan


def test_coordinated_pairs_are_not_shuffled_again(spark):
    subjects = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (None, "b"), (2, "c")], "n int, id string")
    objects = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (None, "z")], "n int, id string")
    said = graph.coordinated(subjects, "likes", objects, ["n"])
    assert rows(said) == [("likes", "a", "x"), ("likes", "a", "y"), ("likes", "b", "x"), ("likes", "c", "x"), ("likes", "c", "y")]
    nodes = spark.createDataFrame([("a",)], "id string")
    home = graph.Graph(nodes, spark.createDataFrame([("likes", "a", "x"), ("in", "a", "n")], "role string, src string, dst string"))
    assert rows(graph.asserted(home, said).edges) == sorted([("in", "a", "n"), *rows(said)])
    # A role that the graph hasn't: its edges are not read to compare them.
    new = graph.asserted(home, graph.coordinated(subjects, "hates", objects, ["n"]), fresh=True).edges
    assert new.count() == 7 and "LeftAnti" not in new._jdf.queryExecution().optimizedPlan().toString()
