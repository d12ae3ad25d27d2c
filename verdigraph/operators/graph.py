"""Patterns, paths and quantifiers over a property graph of two DataFrames, nodes and edges.

A pattern is a DataFrame with the columns ``<variable>_<attribute>`` for each variable bound so far. Binding is an equi-join; rows are a bag until ``distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut
from verdigraph.plans.skew import pairs_join

#: Parts of a key whose first values are kept apart.
SALTS = 16


class Graph(NamedTuple):
    """nodes(id, type, attributes) and edges(role, src, dst, attributes); parallel edges are rows of their own."""

    nodes: DataFrame
    edges: DataFrame


def entity(g: Graph, var: str, kind: str | None = None) -> DataFrame:
    nodes = g.nodes if kind is None else g.nodes.filter(F.col("type") == kind)
    return nodes.select(*[F.col(c).alias(f"{var}_{c}") for c in nodes.columns])


def relation(g: Graph, src: str, dst: str, role: str = "", edge: str | None = None) -> DataFrame:
    """Edges as a pattern; an empty role is any role. With ``edge`` their attributes are bound too."""
    edges = g.edges.filter(F.col("role") == role) if role else g.edges
    within = [c for c in edges.columns if c.endswith("_graph")]
    extra = [F.col(c).alias(f"{edge}_{c}") for c in edges.columns if c not in ("src", "dst", *within)] if edge else []
    return edges.select(F.col("src").alias(f"{src}_id"), F.col("dst").alias(f"{dst}_id"), *within, *extra)


def relate(df: DataFrame, g: Graph, src: str, dst: str, role: str = "", edge: str | None = None, how: str = "inner") -> DataFrame:
    """``df`` along an edge from ``src`` to ``dst``, of which one at least is bound; ``left`` keeps rows without one."""
    keys = [c for c in (f"{src}_id", f"{dst}_id", *g.edges.columns) if c in df.columns and c.endswith(("_id", "_graph"))]
    return df.join(relation(g, src, dst, role, edge), keys, how)


def bind(df: DataFrame, g: Graph, var: str, kind: str | None = None, how: str = "inner") -> DataFrame:
    """Adds the attributes of a variable of which the id is bound."""
    return df.join(entity(g, var, kind), f"{var}_id", how)


def some(df: DataFrame, pattern: DataFrame, *variables: str) -> DataFrame:
    keys = [f"{v}_id" for v in variables]
    return df.join(pattern.select(*keys), keys, "left_semi")


def none(df: DataFrame, pattern: DataFrame, *variables: str) -> DataFrame:
    keys = [f"{v}_id" for v in variables]
    return df.join(pattern.select(*keys), keys, "left_anti")


def every(df: DataFrame, domain: DataFrame, satisfied: Column, *variables: str) -> DataFrame:
    """Rows of which all partners in ``domain`` satisfy the condition; true where there is none, unmet where the condition is null."""
    return none(df, domain.filter(~F.coalesce(satisfied, F.lit(False))), *variables)


def any_of(df: DataFrame, patterns: Sequence[DataFrame], var: str) -> DataFrame:
    """Rows for which one pattern at least holds: conditional edges joined by OR."""
    return some(df, reduce(DataFrame.unionByName, [p.select(f"{var}_id") for p in patterns]), var)


def blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def lists(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column] = (), skip: int = 0, limit: int | None = None, distinct: bool = False, to: str = "list") -> DataFrame:
    """A sorted list of ``value`` for each key; nulls are left out. ``order`` are ascending sort values that go before the value itself.

    With a limit no key's values meet as a whole: each of SALTS parts of a key keeps its first values, of which the list is made.
    """
    ways = [*[c.alias(f"_{i}") for i, c in enumerate(order)], F.col(value).alias("_v")]
    items = df.select(*keys, F.when(F.col(value).isNotNull(), F.struct(*ways)).alias("_item"))
    items = items.distinct() if distinct else items
    shown = F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["_v"])
    if limit is None:
        return items.groupBy(*keys).agg((F.slice(shown, skip + 1, 2**31 - 1) if skip else shown).alias(to))
    # A key of which all values are null keeps one of its rows, and so an empty list.
    parts = Window.partitionBy(*keys, "_salt").orderBy(F.asc_nulls_last("_item"))
    first = items.withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(SALTS))).withColumn("_rank", F.row_number().over(parts)).filter(F.col("_rank") <= skip + limit)
    return first.groupBy(*keys).agg(F.slice(shown, skip + 1, limit).alias(to))


def nth_value(df: DataFrame, value: str, n: int, largest: bool = True) -> DataFrame:
    """Rows with the n-th largest (or smallest) distinct value, ties included. Only that one value is broadcast, and no window runs over all rows."""
    ways = (F.desc, F.asc) if largest else (F.asc, F.desc)
    best = df.filter(F.col(value).isNotNull()).select(value).distinct().orderBy(ways[0](value)).limit(n)
    counted = best.agg(F.count("*").alias("_n"), (F.min if largest else F.max)(value).alias(value))
    return df.join(F.broadcast(counted.filter(F.col("_n") == n).select(value)), value, "left_semi")


def against(df: DataFrame, total: Column, condition: Column) -> DataFrame:
    """Rows that meet a condition on ``_total``, an aggregate of all rows of the pattern, which is one row."""
    one = df.agg(total.alias("_total")).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").filter(condition).drop("_one", "_total")


def with_degree(df: DataFrame, pattern: DataFrame, var: str, to: str = "degree") -> DataFrame:
    """``df`` with the number of rows of ``pattern`` for each value of ``var``, 0 for none."""
    counts = pattern.groupBy(f"{var}_id").agg(F.count("*").alias(to))
    return df.join(counts, f"{var}_id", "left").withColumn(to, F.coalesce(F.col(to), F.lit(0)))


def paths(g: Graph, starts: DataFrame, longest: int, shortest: int = 1, roles: Sequence[str] = (), attributes: bool = False) -> DataFrame:
    """start_id, end_id, hops, nodes, roles of each path of ``shortest`` to ``longest`` hops from ``starts(start_id)`` that takes no edge twice.

    With ``attributes`` it has ``edges`` too, each relationship with all its attributes.
    A path may come back to a node; parallel edges are edges of their own. One join for each hop; the starts are filtered before the first. The number of paths can grow with the degree at each hop; ``reach`` keeps one row an end.
    """
    parallel = F.row_number().over(Window.partitionBy("src", "role", "dst").orderBy(*g.edges.columns))
    edges = (g.edges.filter(F.col("role").isin(*roles)) if roles else g.edges).withColumn("nth", parallel).select(F.col("src").alias("end_id"), F.struct("src", "role", "dst", "nth", *[c for c in g.edges.columns if attributes and c not in ("src", "role", "dst")]).alias("edge"))
    kind = dict(edges.dtypes)["edge"]
    level = starts.select("start_id", F.col("start_id").alias("end_id"), F.lit(0).alias("hops"), F.array("start_id").alias("nodes"), F.array().cast(f"array<{kind}>").alias("taken"))
    found = [level] if shortest == 0 else []
    for hop in range(1, longest + 1):
        step = level.join(edges, "end_id").filter(~F.array_contains("taken", F.col("edge")))
        level = step.select("start_id", F.col("edge.dst").alias("end_id"), F.lit(hop).alias("hops"), F.array_append("nodes", F.col("edge.dst")).alias("nodes"), F.array_append("taken", F.col("edge")).alias("taken"))
        if hop >= shortest:
            found.append(level)
    every = reduce(DataFrame.unionByName, found)
    more = [F.col("taken").alias("edges")] if attributes else []
    return every.select("start_id", "end_id", "hops", "nodes", F.transform("taken", lambda e: e["role"]).alias("roles"), *more)


def reach(g: Graph, starts: DataFrame, longest: int | None = None, shortest: int = 1, roles: Sequence[str] = ()) -> DataFrame:
    """start_id, end_id, hops: each node within reach of ``starts(start_id)`` with the hops of its shortest way of ``shortest`` (0 or 1) hops or more.

    So the closure of a role is ``*`` from 0 hops and ``+`` from 1. Each round follows only the ends that were new in the one before, and writes what it
    adds; it ends when nothing is new, or after ``longest`` hops.
    """
    edges = (g.edges.filter(F.col("role").isin(*roles)) if roles else g.edges).select(F.col("src").alias("end_id"), F.col("dst").alias("to")).distinct()
    level = cut(starts.select("start_id", F.col("start_id").alias("end_id"), F.lit(0).alias("hops")).distinct(), "reach")
    # From one hop on, a start isn't reached before a way comes back to it.
    found = [level] if shortest == 0 else []
    hop = 0
    while longest is None or hop < longest:
        hop += 1
        level = level.join(edges, "end_id").select("start_id", F.col("to").alias("end_id"), F.lit(hop).alias("hops")).distinct()
        if found:
            level = level.join(reduce(DataFrame.unionByName, found), ["start_id", "end_id"], "left_anti")
        level = cut(level, "reach")
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found) if found else level


def shortest_paths(g: Graph, starts: DataFrame, ends: DataFrame | None = None, longest: int | None = None, roles: Sequence[str] = ()) -> DataFrame:
    """start_id, end_id, hops, nodes, roles: one shortest path of at least one hop from each of ``starts(start_id)`` to each end in reach, or to ``ends(end_id)`` alone.

    The search keeps one row for each start and end, with its path; of several that reach an end first the one over the least node, then the least role, is taken. Ties are so decided at the
    last hop first. Paths grow as the search goes, so nothing is read backwards, and parallel edges meet in the grouping. What the last of ``longest`` hops adds isn't written.
    """
    edges = (g.edges.filter(F.col("role").isin(*roles)) if roles else g.edges).select(F.col("src").alias("at"), "role", F.col("dst").alias("to"))
    kind = dict(edges.dtypes)
    level = cut(starts.select("start_id", F.col("start_id").alias("at")).distinct(), "shortest")
    level = level.select("*", F.array().cast(f"array<{kind['at']}>").alias("nodes"), F.array().cast(f"array<{kind['role']}>").alias("roles"))
    found, hop = [], 0
    while longest is None or hop < longest:
        hop += 1
        new = level.join(edges, "at").groupBy("start_id", "to").agg(F.min(F.struct("at", "role", "nodes", "roles")).alias("by"))
        if found:
            new = new.join(reduce(DataFrame.unionByName, found).select("start_id", "to"), ["start_id", "to"], "left_anti")
        new = new.select("start_id", "to", F.lit(hop).alias("hops"), F.array_append("by.nodes", F.col("by.at")).alias("nodes"), F.array_append("by.roles", F.col("by.role")).alias("roles"))
        found.append(new)
        if hop == longest:
            break
        found[-1] = new = cut(new, "shortest")
        if new.isEmpty():
            break
        level = new.select("start_id", F.col("to").alias("at"), "nodes", "roles")
    if not found:
        found = [level.select("start_id", F.col("at").alias("to"), F.lit(0).alias("hops"), "nodes", "roles").limit(0)]
    every = reduce(DataFrame.unionByName, found)
    wanted = every if ends is None else every.join(ends.select(F.col("end_id").alias("to")).distinct(), "to", "left_semi")
    return wanted.select("start_id", F.col("to").alias("end_id"), "hops", F.array_append("nodes", F.col("to")).alias("nodes"), "roles")


def along(df: DataFrame, nodes: str, var: str, place: str | None = None) -> DataFrame:
    """``df`` with each node of the path in the column ``nodes`` as the variable ``var``, a row each; ``place`` gets its number on the path from 0."""
    out = df.select("*", F.posexplode(nodes).alias(place or "_place", f"{var}_id"))
    return out if place else out.drop("_place")


def named(g: Graph, var: str) -> Graph:
    """A graph of which the edges tell in ``<var>_graph`` which named graph they are in: patterns with one ``var`` hold inside one graph, with several across graphs.

    ``g.edges`` has a column ``graph``; nodes are in every graph.
    """
    return Graph(g.nodes, g.edges.withColumnRenamed("graph", f"{var}_graph"))


def across(pattern: DataFrame, first: str, second: str) -> DataFrame:
    """``pattern`` over one named graph, bound by ``<first>_graph``, as pairs of graphs in which the same of its rows stand, each once: the lesser graph is ``<first>_graph``, the other ``<second>_graph``.

    The graphs of a row meet in one group, so the pattern is found once and not joined to itself.
    """
    own = [c for c in pattern.columns if c != f"{first}_graph"]
    graphs = pattern.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in pattern.columns)).groupBy(*own).agg(F.collect_set(f"{first}_graph").alias("_graphs")).filter(F.size("_graphs") > 1)
    one = graphs.select(*own, "_graphs", F.explode("_graphs").alias(f"{first}_graph"))
    return one.select(*own, f"{first}_graph", F.explode("_graphs").alias(f"{second}_graph")).filter(F.col(f"{first}_graph") < F.col(f"{second}_graph"))


def leaving(edges: DataFrame) -> DataFrame:
    """id, role, other, forward for each edge, seen from its source."""
    return edges.select(F.col("src").alias("id"), "role", F.col("dst").alias("other"), F.lit(True).alias("forward"))


def arriving(edges: DataFrame) -> DataFrame:
    """id, role, other, forward for each edge, seen from its end."""
    return edges.select(F.col("dst").alias("id"), "role", F.col("src").alias("other"), F.lit(False).alias("forward"))


def described(g: Graph, ids: DataFrame) -> DataFrame:
    """id, role, other, forward for each edge at the nodes ``ids(id)``."""
    return leaving(g.edges).join(ids, "id").unionByName(arriving(g.edges).join(ids, "id"))


def coordinated(subjects: DataFrame, role: str, objects: DataFrame, by: Sequence[str]) -> DataFrame:
    """role, src, dst: an assertion of ``role`` from each of ``subjects(by, id)`` to each of ``objects(by, id)`` that belongs to the same statement ``by``, each once.

    Only subjects of several statements can meet an object twice, so only their pairs are made distinct. Rows without a statement or an id make none.
    """
    own = lambda df, to: df.select(*by, F.col("id").alias(to)).dropna().distinct()
    counted = own(subjects, "src").withColumn("_n", F.count("*").over(Window.partitionBy("src")))
    met = lambda which: pairs_join(own(objects, "dst"), counted.filter(which).drop("_n"), by, F.col("dst")).select(F.lit(role).alias("role"), "src", "dst")
    return met("_n = 1").unionByName(met("_n > 1").distinct())


def asserted(g: Graph, edges: DataFrame, fresh: bool = False) -> Graph:
    """The graph with the edges ``edges(role, src, dst)`` and any of its edges' attributes: each once, and only if it has no such edge yet. Ends that aren't there become nodes without a type.

    An edge that is there stays as it is, whatever attributes are asserted of it. Of several assertions of one edge one is taken. Null ends or roles are no assertion.
    With ``fresh`` the caller says that no edge is asserted twice and that the graph has none of them, as when their role is new: they are neither grouped nor compared to its edges.
    """
    own = ["role", "src", "dst"]
    more = [c for c in g.edges.columns if c not in own]
    given = [F.col(c) if c in edges.columns else F.lit(None).cast(g.edges.schema[c].dataType).alias(c) for c in more]
    known = edges.dropna(subset=own)
    if fresh:
        new = known.select(*own, *given)
    else:
        known = known.groupBy(*own).agg(F.max(F.struct(*given, F.lit(0).alias("_"))).alias("_more"))
        new = known.join(g.edges.select(*own).distinct(), own, "left_anti").select(*own, *[F.col(f"_more.{c}").alias(c) for c in more])
    ends = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct()
    unknown = ends.join(g.nodes.select("id"), "id", "left_anti")
    return Graph(g.nodes.unionByName(unknown, allowMissingColumns=True), g.edges.unionByName(new.select(*g.edges.columns)))


def retracted(g: Graph, edges: DataFrame) -> Graph:
    """The graph without the edges ``edges(role, src, dst)``, parallel ones included; where one of these is null, any value is meant. Nodes stay.

    Statements are dealt by which of their columns are given, so each kind is one equi-join.
    """
    own = ["role", "src", "dst"]
    left = g.edges
    for given in ([*own], ["role", "src"], ["role", "dst"], ["src", "dst"], ["src"], ["dst"], ["role"]):
        fits = edges.filter(" AND ".join(f"{c} IS {'NOT ' if c in given else ''}NULL" for c in own))
        left = left.join(fits.select(*given).distinct(), given, "left_anti")
    return Graph(g.nodes, left.select(*g.edges.columns))


def constructed(pattern: DataFrame, src: str, dst: str, role: str) -> DataFrame:
    """New edges from a pattern, each once."""
    return pattern.select(F.lit(role).alias("role"), F.col(f"{src}_id").alias("src"), F.col(f"{dst}_id").alias("dst")).distinct()
