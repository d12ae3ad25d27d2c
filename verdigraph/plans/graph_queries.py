"""Queries over the property graph of the test tables.

Customer -placed-> Order -contains-> Part, Supplier -supplies-> Part, Customer and Supplier -located_in-> Nation -part_of-> Region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators import graph
from verdigraph.plans.skew import running_total, spread_join
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def load(spark, d, node: str | None = None, src: str | None = None, dst: str | None = None) -> graph.Graph:
    """Both sides are unions of typed scans: a filter on type or role leaves the scans of that kind alone.

    ``node``, ``src`` and ``dst`` are the id of the only node, or of the edges' only source or end. They are filters on the tables' own keys, which reach the files; kinds and
    roles that can't have such an id aren't read at all.
    """

    def at(df, prefix, column, ident):
        if ident is None:
            return df
        return df.filter(F.col(column) == int(ident[1:])) if ident[0] == prefix else None

    def nodes(name, kind, ident, shown, label=None, amount=None, when=None):
        null = F.lit(None)
        found = at(table(spark, d, name), name[0], ident, node)
        if found is None:
            return None
        return found.select(key(name[0], ident).alias("id"), F.lit(kind).alias("type"), F.col(shown).alias("name"), (F.col(label) if label else null).cast("string").alias("label"), (F.col(amount) if amount else null).cast("double").alias("amount"), (F.col(when) if when else null).cast("timestamp_ntz").alias("at"))

    def edges(df, role, start, end, quantity=None, price=None, once=False):
        null = F.lit(None).cast("double")
        for ends, ident in ((start, src), (end, dst)):
            df = df if df is None else at(df, *ends, ident)
        if df is None:
            return None
        df = df.select(start[1], end[1]).distinct() if once else df
        return df.select(F.lit(role).alias("role"), key(*start).alias("src"), key(*end).alias("dst"), (F.col(quantity) if quantity else null).alias("quantity"), (F.col(price) if price else null).alias("price"))

    kinds = [
        nodes("customer", "Customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"),
        nodes("supplier", "Supplier", "s_suppkey", "s_name", None, "s_acctbal"),
        nodes("part", "Part", "p_partkey", "p_name", "p_brand", "p_retailprice"),
        nodes("orders", "Order", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"),
        nodes("nation", "Nation", "n_nationkey", "n_name"),
        nodes("region", "Region", "r_regionkey", "r_name"),
    ]
    lines = table(spark, d, "lineitem")
    roles = [
        edges(table(spark, d, "orders"), "placed", ("c", "o_custkey"), ("o", "o_orderkey"), None, "o_totalprice"),
        edges(lines, "contains", ("o", "l_orderkey"), ("p", "l_partkey"), "l_quantity", "l_extendedprice"),
        edges(lines, "supplies", ("s", "l_suppkey"), ("p", "l_partkey"), once=True),
        edges(table(spark, d, "customer"), "located_in", ("c", "c_custkey"), ("n", "c_nationkey")),
        edges(table(spark, d, "supplier"), "located_in", ("s", "s_suppkey"), ("n", "s_nationkey")),
        edges(table(spark, d, "nation"), "part_of", ("n", "n_nationkey"), ("r", "n_regionkey")),
    ]

    def union(parts):
        return reduce(DataFrame.unionByName, [p for p in parts if p is not None])

    return graph.Graph(union(kinds), union(roles))


def _round(c, to):
    return F.round(c, 4).alias(to)


@query("SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def graph_entities(spark, d):
    c = graph.entity(load(spark, d), "c", "Customer").filter((F.col("c_label") == "BUILDING") & (F.col("c_amount") > 5000))
    return c.select(F.col("c_id").alias("id"), F.col("c_name").alias("name"))


@query("SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 45")
def graph_edges(spark, d):
    g = load(spark, d)
    df = graph.relate(graph.entity(g, "o", "Order").filter("o_name = '1-URGENT'"), g, "o", "p", "contains", "e").filter("e_quantity > 45")
    return df.select(F.col("o_id").alias("source"), F.col("p_id").alias("target"), F.col("e_quantity").alias("quantity"))


@query("SELECT 'n' || c_nationkey AS nation, list(c_name ORDER BY -c_acctbal, c_name)[2:4] AS names FROM customer GROUP BY c_nationkey")
def graph_list(spark, d):
    g = load(spark, d)
    df = graph.relate(graph.entity(g, "c", "Customer"), g, "c", "n", "located_in")
    return graph.lists(df, ["n_id"], "c_name", [-F.col("c_amount")], 1, 3, to="names").withColumnRenamed("n_id", "nation")


@query("SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def graph_count(spark, d):
    g = load(spark, d)
    df = graph.bind(graph.relate(graph.relation(g, "c", "o", "placed"), g, "c", "n", "located_in"), g, "n", "Nation")
    return df.groupBy(F.col("n_name").alias("nation")).agg(F.countDistinct("c_id").alias("customers"), F.count("*").alias("orders"))


@query("SELECT p_brand AS brand, round(sum(l_quantity), 4) AS total, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 4) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def graph_scalar(spark, d):
    g = load(spark, d)
    df = graph.bind(graph.relation(g, "o", "p", "contains", "e"), g, "p", "Part")
    return df.groupBy(F.col("p_label").alias("brand")).agg(_round(F.sum("e_quantity"), "total"), F.min("e_quantity").alias("least"), F.max("e_quantity").alias("most"), _round(F.avg("e_quantity"), "mean"))


@query("SELECT count(*) > 0 AS answer FROM supplier WHERE s_acctbal < 0")
def graph_condition(spark, d):
    return graph.entity(load(spark, d), "s", "Supplier").filter("s_amount < 0").agg((F.count("*") > 0).alias("answer"))


@query("SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM part) AS parts")
def graph_targets(spark, d):
    nodes = load(spark, d).nodes.filter("type IN ('Nation', 'Part')")
    return nodes.agg(F.count_if(F.col("type") == "Nation").alias("nations"), F.count_if(F.col("type") == "Part").alias("parts"))


@query("SELECT 'n' || n_nationkey AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND (s_acctbal > 0) IS NOT TRUE)")
def graph_all(spark, d):
    g = load(spark, d)
    domain = graph.relate(graph.entity(g, "s", "Supplier"), g, "s", "n", "located_in")
    return graph.every(graph.entity(g, "n", "Nation"), domain, F.col("s_amount") > 0, "n").select(F.col("n_id").alias("nation"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def graph_exists(spark, d):
    g = load(spark, d)
    dear = graph.relation(g, "c", "o", "placed", "e").filter("e_price > 100000")
    return graph.some(graph.entity(g, "c", "Customer"), dear, "c").select(F.col("c_id").alias("id"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def graph_none(spark, d):
    g = load(spark, d)
    return graph.none(graph.entity(g, "c", "Customer"), graph.relation(g, "c", "o", "placed"), "c").select(F.col("c_id").alias("id"))


@query("SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 3 OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 7)")
def graph_or_edges(spark, d):
    g = load(spark, d)
    ways = [graph.relation(load(spark, d, dst="n3"), "s", "n", "located_in"), graph.relation(load(spark, d, dst="p7"), "s", "p", "supplies")]
    return graph.any_of(graph.entity(g, "s", "Supplier"), ways, "s").select(F.col("s_id").alias("id"))


@query("SELECT 'p' || p_partkey AS id FROM part WHERE contains(p_name, 'a') AND regexp_matches(p_brand, '^Brand#[12]') AND NOT p_retailprice < 1000")
def graph_text(spark, d):
    p = graph.entity(load(spark, d), "p", "Part")
    return p.filter(F.col("p_name").contains("a") & F.col("p_label").rlike("^Brand#[12]") & ~(F.col("p_amount") < 1000)).select(F.col("p_id").alias("id"))


@query("SELECT DISTINCT p_brand AS brand FROM part ORDER BY brand DESC OFFSET 2 LIMIT 5")
def graph_page(spark, d):
    return graph.entity(load(spark, d), "p", "Part").select(F.col("p_label").alias("brand")).distinct().orderBy(F.desc("brand")).offset(2).limit(5)


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')")
def graph_literals(spark, d):
    o = graph.entity(load(spark, d), "o", "Order")
    return o.filter((F.col("o_at") >= F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("o_label").isin("F", "O")).select(F.col("o_id").alias("id"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def graph_self_pair(spark, d):
    g = load(spark, d)
    pair = graph.relate(graph.relation(g, "a", "r", "part_of"), g, "b", "r", "part_of")
    return graph.bind(graph.bind(pair, g, "a", "Nation"), g, "b", "Nation").filter("a_name < b_name").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))


@query("SELECT 'p' || p_partkey AS id, p_retailprice AS price FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
def graph_argmax(spark, d):
    return graph.nth_value(graph.entity(load(spark, d), "p", "Part"), "p_amount", 1).select(F.col("p_id").alias("id"), F.col("p_amount").alias("price"))


@query("SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey < 10 AND s_acctbal > (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey < 10)")
def graph_above_average(spark, d):
    g = load(spark, d)
    near = graph.relate(graph.entity(g, "s", "Supplier"), g, "s", "n", "located_in").filter(F.length("n_id") == 2)
    return graph.against(near, F.avg("s_amount"), F.col("s_amount") > F.col("_total")).select(F.col("s_id").alias("id"))


@query("SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
def graph_above_average_all(spark, d):
    return graph.against(graph.entity(load(spark, d), "s", "Supplier"), F.avg("s_amount"), F.col("s_amount") > F.col("_total")).select(F.col("s_id").alias("id"))


@query("SELECT 's' || s_suppkey AS start_id, 'r' || n_regionkey AS end_id, 2 AS hops, ['s' || s_suppkey, 'n' || n_nationkey, 'r' || n_regionkey] AS nodes FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def graph_path(spark, d):
    g = load(spark, d)
    starts = graph.entity(g, "s", "Supplier").select(F.col("s_id").alias("start_id"))
    return graph.paths(g, starts, 2, 2, ["located_in", "part_of"]).select("start_id", "end_id", "hops", "nodes")


@query(
    """WITH e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)
SELECT c, hops, count(*) AS ends FROM (SELECT s AS c, 1 AS hops, t FROM e WHERE s LIKE 'c%' UNION ALL SELECT a.s, 2, b.t FROM e a JOIN e b ON a.t = b.s WHERE a.s LIKE 'c%') GROUP BY c, hops"""
)
def graph_bounded_path(spark, d):
    g = load(spark, d)
    starts = graph.entity(g, "c", "Customer").select(F.col("c_id").alias("start_id"))
    return graph.paths(g, starts, 2, 1, ["located_in", "part_of", "placed"]).groupBy(F.col("start_id").alias("c"), "hops").agg(F.count("*").alias("ends"))


@query("SELECT 's' || s_suppkey AS start_id, 'n' || s_nationkey AS end_id, 1 AS hops FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier")
def graph_shortest(spark, d):
    g = load(spark, d)
    starts = graph.entity(g, "s", "Supplier").select(F.col("s_id").alias("start_id"))
    return graph.reach(g, starts, 3, 0, ["located_in", "part_of"])


@query("SELECT 'traded_with' AS role, 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_totalprice > 300000 AND l_partkey < 50 GROUP BY ALL")
def graph_construct(spark, d):
    """The supplier of a line is on the table alone, as several suppliers supply one part; so new edges come from typed rows."""
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(key("o", "o_orderkey").alias("o_id"), key("c", "o_custkey").alias("c_id"))
    lines = table(spark, d, "lineitem").filter("l_partkey < 50").select(key("o", "l_orderkey").alias("o_id"), key("s", "l_suppkey").alias("s_id"))
    return graph.constructed(o.join(lines, "o_id"), "c", "s", "traded_with")


@query("SELECT DISTINCT 'traded_with' AS role, 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def graph_construct_all(spark, d):
    """The edges of all orders and lines; graph_construct keeps to the few that its SQL names."""
    lines = table(spark, d, "lineitem").select(key("o", "l_orderkey").alias("o_id"), key("s", "l_suppkey").alias("s_id"))
    return graph.constructed(graph.relation(load(spark, d), "c", "o", "placed").join(lines, "o_id"), "c", "s", "traded_with")


@query("SELECT c_name AS name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def graph_optional(spark, d):
    g = load(spark, d)
    df = graph.relate(graph.entity(g, "c", "Customer"), g, "c", "o", "placed", how="left")
    return df.groupBy("c_id", F.col("c_name").alias("name")).agg(F.count("o_id").alias("orders")).drop("c_id")


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderdate = (SELECT DISTINCT o_orderdate FROM orders ORDER BY o_orderdate DESC OFFSET 1 LIMIT 1)")
def graph_ordinal(spark, d):
    return graph.nth_value(graph.entity(load(spark, d), "o", "Order"), "o_at", 2).select(F.col("o_id").alias("id"))


@query("SELECT 'c' || o_custkey AS id, count(*) AS orders FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
def graph_at_least(spark, d):
    g = load(spark, d)
    return graph.relation(g, "c", "o", "placed").groupBy(F.col("c_id").alias("id")).agg(F.count("*").alias("orders")).filter("orders >= 12")


@query("SELECT 'o' || l_orderkey AS id, round(sum(l_extendedprice / l_quantity), 6) AS units FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 GROUP BY l_orderkey")
def graph_arithmetic(spark, d):
    e = graph.relation(load(spark, d), "o", "p", "contains", "e").filter(F.col("e_quantity").between(10, 12))
    return e.groupBy(F.col("o_id").alias("id")).agg(F.round(F.sum(F.col("e_price") / F.col("e_quantity")), 6).alias("units"))


@query("SELECT 'n3' AS id, 'located_in' AS role, 'c' || c_custkey AS other, false AS forward FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'n3', 'located_in', 's' || s_suppkey, false FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'n3', 'part_of', 'r' || n_regionkey, true FROM nation WHERE n_nationkey = 3")
def graph_describe(spark, d):
    out, into = load(spark, d, src="n3"), load(spark, d, dst="n3")
    return graph.leaving(out.edges).unionByName(graph.arriving(into.edges))


@query(
    """SELECT 'n' || n_nationkey AS id, 'located_in' AS role, 'c' || c_custkey AS other, false AS forward FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE contains(n_name, '1')
UNION ALL SELECT 'n' || n_nationkey, 'located_in', 's' || s_suppkey, false FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE contains(n_name, '1') UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, true FROM nation WHERE contains(n_name, '1')"""
)
def graph_describe_many(spark, d):
    """The edges of all nodes that a condition finds."""
    g = load(spark, d)
    return graph.described(g, graph.entity(g, "n", "Nation").filter(F.col("n_name").contains("1")).select(F.col("n_id").alias("id")))


@query(
    """WITH said AS (SELECT DISTINCT 's' || s_suppkey AS src, 'c' || c_custkey AS dst FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000 AND c_mktsegment = 'BUILDING'),
home AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
SELECT 'serves' AS role, src, dst FROM said UNION ALL SELECT 'located_in', src, dst FROM home UNION ALL SELECT DISTINCT 'placed', 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'part_of', 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE NOT contains(n_name, '1')"""
)
def graph_updates(spark, d):
    """Assertions and retractions: rich suppliers serve the building customers of their nation; suppliers in debt leave it; some nations leave all regions; no supplies and contents are kept. What is asserted twice is there once."""
    g = load(spark, d)
    by_home = lambda kind, condition: graph.relate(graph.entity(g, "x", kind).filter(condition), g, "x", "n", "located_in").select("n_id", F.col("x_id").alias("id"))
    said = graph.coordinated(by_home("Supplier", "x_amount > 5000"), "serves", by_home("Customer", "x_label = 'BUILDING'"), ["n_id"])
    known = graph.relation(g, "c", "o", "placed").select(F.lit("placed").alias("role"), F.col("c_id").alias("src"), F.col("o_id").alias("dst"))
    nothing = F.lit(None).cast("string")
    in_debt = graph.entity(g, "s", "Supplier").filter("s_amount < 0").select(F.lit("located_in").alias("role"), F.col("s_id").alias("src"), nothing.alias("dst"))
    leaving = graph.entity(g, "n", "Nation").filter(F.col("n_name").contains("1")).select(F.lit("part_of").alias("role"), F.col("n_id").alias("src"), nothing.alias("dst"))
    roles = spark.range(1).select(F.explode(F.array(F.lit("supplies"), F.lit("contains"))).alias("role"), nothing.alias("src"), nothing.alias("dst"))
    after = graph.retracted(graph.asserted(graph.asserted(g, known), said, fresh=True), in_debt.unionByName(leaving).unionByName(roles))
    return after.edges.select("role", "src", "dst")


@query("SELECT n_name || ' in ' || r_name AS said FROM nation JOIN region ON n_regionkey = r_regionkey WHERE starts_with(r_name, 'A') AND NOT ends_with(n_name, 'A')")
def graph_concat(spark, d):
    g = load(spark, d)
    df = graph.bind(graph.bind(graph.relation(g, "n", "r", "part_of"), g, "n", "Nation"), g, "r", "Region")
    return df.filter(F.col("r_name").startswith("A") & ~F.col("n_name").endswith("A")).select(F.concat("n_name", F.lit(" in "), "r_name").alias("said"))


@query("SELECT 'n' || k AS id FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def graph_sets(spark, d):
    g = load(spark, d)

    def home(kind, condition="true"):
        return graph.relate(graph.entity(g, "x", kind).filter(condition), g, "x", "n", "located_in").select(F.col("n_id").alias("id"))

    return home("Customer", "x_amount > 9000").intersect(home("Supplier")).subtract(home("Supplier", "x_amount > 9000"))


@query("SELECT 'n' || n_nationkey AS id, count(s_suppkey) AS degree FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(s_suppkey) < 3")
def graph_degree(spark, d):
    g = load(spark, d)
    homes = graph.relate(graph.entity(g, "s", "Supplier"), g, "s", "n", "located_in")
    return graph.with_degree(graph.entity(g, "n", "Nation"), homes, "n").filter("degree < 3").select(F.col("n_id").alias("id"), "degree")


@query("SELECT 's' || s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, 's' || s_suppkey LIMIT 5")
def graph_top(spark, d):
    return graph.entity(load(spark, d), "s", "Supplier").orderBy(F.desc("s_amount"), "s_id").limit(5).select(F.col("s_id").alias("id"))


@query("SELECT 'o' || l_orderkey AS o, l_extendedprice AS price FROM lineitem WHERE l_quantity = 50 AND l_partkey = 7")
def graph_qualifier(spark, d):
    e = graph.relation(load(spark, d, dst="p7"), "o", "p", "contains", "e").filter("e_quantity = 50")
    return e.select(F.col("o_id").alias("o"), F.col("e_price").alias("price"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('5|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL) WHERE r <= round_even(n * 0.25, 0)")
def train_val_split(spark, d):
    """The validation quarter of each language, by exact ranks of a hash. Ranks are counted by leading hash digits first, so no language meets in one task."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").filter("lang IS NOT NULL")
    docs = docs.withColumn("_h", F.md5(F.concat(F.lit("5|"), F.col("doc_id").cast("string")))).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_w", F.lit(1))
    ranked = running_total(docs, "lang", "_b", [F.col("_h"), F.col("doc_id")], "_w", "_before")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("_n"))
    return spread_join(ranked, sizes, ["lang"], F.col("doc_id")).filter(F.col("_before") < F.bround(F.col("_n") * F.lit(0.25), 0)).select("doc_id", "lang", "source")


@query("SELECT 'c' || o_custkey AS start_id, 'p' || l_partkey AS end_id, 2 AS hops, ['c' || o_custkey, min('o' || o_orderkey), 'p' || l_partkey] AS nodes, ['placed', 'contains'] AS roles FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey")
def graph_shortest_path(spark, d):
    """One shortest path from every customer to every part that it has ever ordered."""
    g = load(spark, d)
    starts = graph.entity(g, "c", "Customer").select(F.col("c_id").alias("start_id"))
    return graph.shortest_paths(g, starts, graph.entity(g, "p", "Part").select(F.col("p_id").alias("end_id")), 2, ["placed", "contains"])


@query(
    """WITH p AS (SELECT 's' || s_suppkey AS start_id, s_name, 'n' || n_nationkey AS n, n_name, 'r' || r_regionkey AS r, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM (SELECT start_id, 0 AS place, start_id AS x_id, s_name AS x_name FROM p UNION ALL SELECT start_id, 1, n, n_name FROM p UNION ALL SELECT start_id, 2, r, r_name FROM p) WHERE contains(x_name, '1') OR contains(x_name, 'AS')"""
)
def graph_path_elements(spark, d):
    """Nodes along the paths from suppliers to regions, as a variable with its own condition."""
    g = load(spark, d)
    starts = graph.entity(g, "s", "Supplier").select(F.col("s_id").alias("start_id"))
    found = graph.along(graph.paths(g, starts, 2, 2, ["located_in", "part_of"]), "nodes", "x", "place")
    return graph.bind(found, g, "x").filter(F.col("x_name").contains("1") | F.col("x_name").contains("AS")).select("start_id", "place", "x_id", "x_name")


def by_status(spark, d) -> graph.Graph:
    """Orders and their lines as named graphs, one for each order status."""
    status = table(spark, d, "orders").select(key("c", "o_custkey").alias("c"), "o_orderkey", F.col("o_orderstatus").alias("graph"))
    placed = status.select(F.lit("placed").alias("role"), F.col("c").alias("src"), key("o", "o_orderkey").alias("dst"), "graph")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(status, F.col("l_orderkey") == F.col("o_orderkey"))
    contains = lines.select(F.lit("contains").alias("role"), key("o", "o_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), "graph")
    return graph.Graph(load(spark, d).nodes, placed.unionByName(contains))


@query("SELECT o_orderstatus AS g_graph, count(DISTINCT o_custkey) AS customers, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11' GROUP BY o_orderstatus")
def graph_in_named(spark, d):
    """In which graph customers have placed orders with parts of a brand: both edges in one graph."""
    g = graph.named(by_status(spark, d), "g")
    df = graph.bind(graph.relate(graph.relation(g, "c", "o", "placed"), g, "o", "p", "contains"), g, "p", "Part").filter("p_label = 'Brand#11'")
    return df.groupBy("g_graph").agg(F.countDistinct("c_id").alias("customers"), F.count("*").alias("lines"))


@query("WITH x AS (SELECT DISTINCT o_custkey, l_partkey, o_orderstatus AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'c' || a.o_custkey AS c, 'p' || a.l_partkey AS p, a.s AS g_graph, b.s AS h_graph FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.l_partkey = b.l_partkey AND a.s < b.s")
def graph_across_named(spark, d):
    """Customers that have ordered a part in two graphs."""
    g = graph.named(by_status(spark, d), "g")
    bought = graph.relate(graph.relation(g, "c", "o", "placed"), g, "o", "p", "contains").drop("o_id")
    return graph.across(bought, "g", "h").select(F.col("c_id").alias("c"), F.col("p_id").alias("p"), "g_graph", "h_graph")
