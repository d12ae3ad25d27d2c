"""Query documents over a property graph: each hypothesis of a JSON document becomes one DataFrame.

A document says what is asked: entities, relationships, paths, a constraint, targets. Here it is turned into the patterns of ``graph``; joins, filters
and their order are left to Catalyst. How variables are scoped:

- Declared relationships all hold, so they are inner joins. One whose id stands as a condition is asked for instead: a flag by a join on its ends.
- The outer pattern is what the targets and the sort keys reach over declared relationships. An entity that only a list collects is local to that list,
  with all that hangs on it: the list ranges over its own pattern, and is tied to the outer one where relationships cross between them. Conjuncts that only
  have local variables filter that pattern.
- A list over an entity of the outer pattern ranges over all rows that meet the other conjuncts, for each combination of the other targets.
- Lists are bags unless distinct. ALL holds for an empty list. Comparisons with a missing attribute are unknown, which a constraint doesn't accept.
- Targets that nothing connects are answered beside each other: rows of one have nulls for the others, so no cross product arises.
- What hangs at one entity of the pattern and is only compared to the rest by one inequality isn't joined to it: its values are counted for each row by
  their order, and the row is repeated that often, so pairs aren't compared. A distinct answer needs the least or largest of these values alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.operators import graph
from verdigraph.operators.graph import Graph
from verdigraph.plans.skew import count_passed, repeated

AGGREGATES = {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "AVG": F.avg}
OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "CONTAINS": lambda a, b: a.contains(b),
    "MATCHES_REGEX": lambda a, b: F.regexp_like(a, b),
}
#: Inequalities, and what each is with its sides changed.
MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def hypotheses(document: str | Sequence[dict], g: Graph, most_hops: int = 4) -> list[DataFrame]:
    """One DataFrame for each hypothesis of the document. They are alternatives, so they aren't put together.

    Columns: an entity's id under the entity's name, an attribute as ``<of>_<attribute>``, a relationship as ``<id>_src``, ``<id>_role`` and ``<id>_dst``, a path as
    ``<id>`` (its nodes) and ``<id>_roles``, anything else as ``target_<place>``. A path without a bound on its relationships has at most ``most_hops`` of them.
    A document with ids that are missing or declared twice, or a part that would need a cross product, is a ValueError.
    """
    found = json.loads(document) if isinstance(document, str) else list(document)
    if not isinstance(found, list) or not found:
        raise ValueError("a document is a list of at least one query")
    return [_Query(q, g, most_hops).answer() for q in found]


def _conjuncts(condition: Any) -> list:
    if condition in (None, {}):
        return []
    if isinstance(condition, dict) and "and_conditions" in condition:
        return [c for part in condition["and_conditions"] for c in _conjuncts(part)]
    return [condition]


def _dicts(value: Any) -> Iterator[dict]:
    if isinstance(value, dict):
        yield value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from _dicts(inner)


def _source(expression: dict) -> dict:
    """The LIST of a count, an aggregate, a quantifier, or of a list itself."""
    found = expression.get("count", expression.get("source", expression))
    return found if isinstance(found.get("list"), dict) else found["list"]


def _is_list(x: Any) -> bool:
    return isinstance(x, dict) and ("count" in x or "aggregate_kind" in x or "quantifier_kind" in x or "list" in x)


class _Query:
    def __init__(self, query: dict, g: Graph, most_hops: int) -> None:
        self.query, self.g, self.most_hops = query, g, most_hops
        self.entities = {e["id"]: e.get("type") for e in query.get("entities") or []}
        self.edges = {r["id"]: r for r in query.get("relationships") or []}
        self.paths = {p["id"]: p for p in query.get("paths") or []}
        self.parts = {}
        for d in _dicts(query):
            if "nodes_of" in d:
                self.parts[d["node_id"]] = d["nodes_of"]
            if "rels_of" in d:
                self.parts[d["rel_id"]] = d["rels_of"]
        declared = [*(e["id"] for e in query.get("entities") or []), *(r["id"] for r in query.get("relationships") or []), *(p["id"] for p in query.get("paths") or [])]
        if len(set(declared)) < len(declared) or set(self.parts) & set(declared):
            raise ValueError("an id is declared twice")
        ends = [r[k] for r in self.edges.values() for k in ("from", "to")] + [p[k] for p in self.paths.values() for k in ("start", "end") if p.get(k)]
        if missing := sorted({e for e in ends if e not in self.entities} | {d["of"] for d in _dicts(query) if "of" in d and d["of"] not in {*declared, *self.parts}} | {p for p in self.parts.values() if p not in self.paths}):
            raise ValueError(f"not declared: {', '.join(missing)}")
        if not query.get("target"):
            raise ValueError("a query needs a target")
        self.conjuncts = _conjuncts(query.get("constraint"))
        self.conditional = {e for c in [*self.conjuncts, *query["target"]] for e in self._asked(c, isinstance(c, dict))}
        self.serial = 0

    # Names and scopes.

    def _asked(self, condition: Any, inside: bool = True) -> set[str]:
        """Ids that stand as conditions. A bare target is none."""
        if isinstance(condition, str):
            return {condition} & self.edges.keys() if inside else set()
        if not isinstance(condition, dict):
            return set()
        inner = [*condition.get("and_conditions", []), *condition.get("or_conditions", []), condition.get("not_condition"), condition.get("condition"), condition.get("filter")]
        inner += [x for k in ("left", "right", "count", "source", "list", "map_expression") if isinstance(x := condition.get(k), dict)]
        return set().union(*(self._asked(x) for x in inner))

    def _variables(self, x: Any) -> set[str]:
        """Entities, relationships and paths that are named outside of lists over entities and relationships."""
        if isinstance(x, str):
            return {self.edges[x]["from"], self.edges[x]["to"]} if x in self.edges else set()
        if not isinstance(x, dict):
            return set()
        if _is_list(x):
            inner = _source(x)["list"]
            path = inner.get("nodes_of") or inner.get("rels_of")
            return {path} if path else set()
        if "of" in x:
            return {self.parts.get(x["of"], x["of"])}
        inner = [*x.get("and_conditions", []), *x.get("or_conditions", []), x.get("not_condition")]
        # Plain strings beside an operator are literals.
        sides = [s for k in ("left", "right") if isinstance(s := x.get(k), dict)]
        return set().union(*(self._variables(i) for i in [*inner, *sides]))

    def _elements(self, x: Any) -> set[str]:
        """What lists inside collect."""
        return {d["list_elements"] for d in _dicts(x) if "list_elements" in d}

    def _links(self) -> list[tuple[str, set[str]]]:
        """Declared relationships and paths with the entities that they tie."""
        edges = [(i, {r["from"], r["to"]}) for i, r in self.edges.items() if i not in self.conditional]
        return edges + [(i, {e for e in (p.get("start"), p.get("end")) if e}) for i, p in self.paths.items()]

    def _closure(self, start: set[str], stop: set[str]) -> set[str]:
        """All that ``start`` reaches over declared relationships and paths, with these, without going through ``stop``."""
        found = set(start) - stop
        found |= {e for i, ends in self._links() if i in found for e in ends - stop}
        while True:
            more = {x for i, ends in self._links() if i not in stop and ends & found and not ends & stop for x in (i, *ends)} - found
            if not more:
                return found
            found |= more

    # Patterns.

    def _pattern(self, variables: set[str], crossing: Sequence[str] = ()) -> list[tuple[set[str], DataFrame]]:
        """The connected parts of the pattern over ``variables``; ``crossing`` relationships end at entities outside, of which only the id is bound."""
        entities = [e for e in self.entities if e in variables]
        links = [i for i in [*self.edges, *self.paths] if i in variables or i in crossing]
        out = []
        while entities or links:
            bound: set[str] = set()
            if entities:
                first = entities.pop(0)
                bound, df = {first}, graph.entity(self.g, first, self.entities[first])
            else:
                first = links.pop(0)
                r = self.edges.get(first)
                if r is None:
                    raise ValueError(f"path {first} starts nowhere")
                bound, df = {first, r["from"], r["to"]}, graph.relation(self.g, r["from"], r["to"], r.get("role", ""), first)
            while True:
                for i in links:
                    ends = {self.edges[i]["from"], self.edges[i]["to"]} if i in self.edges else {e for e in (self.paths[i].get("start"), self.paths[i].get("end")) if e}
                    if ends & bound:
                        break
                else:
                    break
                links.remove(i)
                if i in self.edges:
                    r = self.edges[i]
                    df = graph.relate(df, self.g, r["from"], r["to"], r.get("role", ""), i)
                else:
                    df = self._along(df, i)
                for e in sorted(ends - bound):
                    if e in entities:
                        df = graph.bind(df, self.g, e, self.entities[e])
                        entities.remove(e)
                bound |= {i, *ends}
            out.append((bound, df))
        return out

    def _hops(self, path: str) -> tuple[int, int]:
        """Least and most relationships of a path, by the conjuncts that count them."""
        least, most = 1, self.most_hops
        for c in self.conjuncts:
            left, right = (c.get("left"), c.get("right")) if isinstance(c, dict) else (None, None)
            if isinstance(left, dict) and "count" in left and _source(left)["list"].get("rels_of") == path and not _source(left).get("filter") and isinstance(right, int):
                low, high = {"=": (right, right), "<": (1, right - 1), "<=": (1, right), ">": (right + 1, most), ">=": (right, most)}.get(c["operator"], (1, most))
                least, most = max(least, low), high if c["operator"] in ("=", "<", "<=") else most
        return least, most

    def _along(self, df: DataFrame, path: str) -> DataFrame:
        """``df`` with each path from its bound start, or each that ends at its bound end."""
        p = self.paths[path]
        start, end = p.get("start"), p.get("end")
        if not start or f"{start}_id" not in df.columns:
            raise ValueError(f"path {path} needs a start that is bound before it")
        least, most = self._hops(path)
        starts = df.select(F.col(f"{start}_id").alias("start_id")).distinct()
        found = graph.paths(self.g, starts, most, least, p.get("roles") or (), attributes=True)
        end = end or f"{path}_end"
        names = {"start_id": f"{start}_id", "end_id": f"{end}_id", "nodes": f"{path}_nodes", "edges": f"{path}_edges"}
        found = found.select(*[F.col(a).alias(b) for a, b in names.items()])
        return df.join(found, [c for c in (f"{start}_id", f"{end}_id") if c in df.columns])

    # Expressions and conditions. Each returns the frame, with what lists add, and a column.

    def _column(self, df: DataFrame, of: str, name: str) -> Column:
        if f"{of}_{name}" not in df.columns:
            raise ValueError(f"{of} has no attribute {name} here")
        return F.col(f"{of}_{name}")

    def expression(self, df: DataFrame, bound: set[str], x: Any) -> tuple[DataFrame, Column]:
        if not isinstance(x, dict):
            return df, F.lit(x)
        if "attribute_name" in x:
            return df, self._column(df, x["of"], x["attribute_name"])
        if not _is_list(x):
            raise ValueError(f"not an expression: {json.dumps(x)[:80]}")
        if "list_elements" not in _source(x)["list"]:
            return self._path_value(df, x)
        return self._attached(df, bound, x)

    def _comparison(self, a: Column, operator: str, right: Any, b: Column) -> Column:
        if operator not in OPERATORS:
            raise ValueError(f"no operator {operator}")
        # An empty text stands for a missing one.
        if right == "" and operator in ("=", "!="):
            return graph.blank(a) if operator == "=" else ~graph.blank(a)
        return OPERATORS[operator](a, b)

    def condition(self, df: DataFrame, bound: set[str], c: Any) -> tuple[DataFrame, Column]:
        if isinstance(c, dict) and ("or_conditions" in c or "not_condition" in c):
            columns = []
            for part in c.get("or_conditions") or [c["not_condition"]]:
                df, column = self.conjunction(df, bound, _conjuncts(part))
                columns.append(column)
            return df, reduce(Column.__or__, columns) if "or_conditions" in c else ~columns[0]
        if isinstance(c, dict) and "quantifier_kind" in c:
            return self._quantified(df, bound, c) if "list_elements" in _source(c)["list"] else self._path_value(df, c)
        if isinstance(c, dict) and "operator" in c:
            df, a = self.expression(df, bound, c["left"])
            df, b = self.expression(df, bound, c["right"])
            return df, self._comparison(a, c["operator"], c["right"], b)
        if isinstance(c, str) and c in self.edges:
            r = self.edges[c]
            return self._flag(df, graph.relation(self.g, r["from"], r["to"], r.get("role", "")), [f"{r['from']}_id", f"{r['to']}_id"])
        raise ValueError(f"not a condition: {json.dumps(c)[:80]}")

    def conjunction(self, df: DataFrame, bound: set[str], conditions: list) -> tuple[DataFrame, Column]:
        """All of ``conditions``. Those with entities that aren't bound are taken together: there must be such entities."""
        far, near = [], []
        for c in conditions:
            alone = isinstance(c, dict) and self._asked(c)
            (far if self._variables(c) - bound and not alone else near).append(c)
        columns = []
        for c in near:
            df, column = self.condition(df, bound, c)
            columns.append(column)
        if far:
            inner = self._closure({v for c in far for v in self._variables(c)} - bound, bound)
            ties = [c for c in far if isinstance(c, str)] + [i for i, ends in self._links() if i not in inner and ends & inner and ends & bound]
            found = self._pattern(inner, ties)
            if len(found) > 1:
                raise ValueError("entities of one condition aren't connected")
            there, sub = found[0]
            keys = sorted(f"{e}_id" for e in there & bound & self.entities.keys())
            rest = [c for c in far if not isinstance(c, str)]
            if rest:
                sub, column = self.conjunction(self._with_outer(sub, df, there, bound, rest, keys), there | bound, rest)
                sub = sub.filter(column)
            df, column = self._flag(df, sub, keys)
            columns.append(column)
        return df, reduce(Column.__and__, columns, F.lit(True))

    def _with_outer(self, sub: DataFrame, df: DataFrame, there: set[str], bound: set[str], uses: Any, keys: list[str]) -> DataFrame:
        """``sub`` with the attributes of outer variables that ``uses`` names; their ids become keys."""
        named = set().union(*(self._variables(u) for u in uses), *({d["of"]} for u in uses for d in _dicts(u) if "of" in d)) & bound
        wanted = [c for c in df.columns for v in sorted(named) if c.startswith(f"{v}_") and c not in sub.columns]
        if not wanted:
            return sub
        if not keys:
            raise ValueError("a condition between variables that nothing connects would need a cross product")
        ids = [f"{v}_id" for v in named if v in self.entities and f"{v}_id" in df.columns]
        outer = df.select(*dict.fromkeys([*keys, *ids, *wanted])).distinct()
        sub = sub.join(outer, list(keys))
        keys += [i for i in ids if i not in keys]
        return sub

    def _name(self) -> str:
        self.serial += 1
        return f"_{self.serial}"

    def _tied(self, df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        """Left join to ``found``, one row for each value of ``keys``; without keys it is one row in all."""
        if keys:
            return df.join(found, keys, "left")
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(found.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")

    def _flag(self, df: DataFrame, sub: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
        name = self._name()
        found = sub.select(*keys).distinct().withColumn(name, F.lit(True)) if keys else sub.agg((F.count("*") > 0).alias(name))
        return self._tied(df, found, keys), F.coalesce(F.col(name), F.lit(False))

    # Lists.

    def _domain(self, df: DataFrame, bound: set[str], x: dict, uses: Sequence[Any] = ()) -> tuple[DataFrame, set[str], list[str], list[Column]]:
        """Rows that the list ranges over, what they bind, the keys that tie them to ``df``, and the columns that name an element."""
        source = _source(x)
        element = source["list"]["list_elements"]
        if element not in self.entities and element not in self.edges:
            raise ValueError(f"not declared: {element}")
        if element in bound:
            sub, there = df, set(bound)
            keys = sorted(f"{v}_id" for v in self.keys - {element} if v in self.entities)
        else:
            inner = self._closure({element}, bound)
            ties = [i for i, ends in self._links() if (i not in inner or i == element) and ends & inner and ends & bound] + ([element] if element in self.edges else [])
            found = [p for p in self._pattern(inner, ties) if element in p[0]]
            there, sub = found[0]
            keys = sorted(f"{e}_id" for e in there & bound & self.entities.keys())
            local = [c for c in self.conjuncts if (named := self._variables(c)) and named <= there - bound and not self._asked(c)]
            for c in local:
                sub, column = self.condition(sub, there, c)
                sub = sub.filter(column)
        sub = self._with_outer(sub, df, there, bound, [source.get("filter"), *uses], keys) if element not in bound else sub
        for c in _conjuncts(source.get("filter")):
            sub, column = self.conjunction(sub, there | bound, [c])
            sub = sub.filter(column)
        names = [F.col(f"{element}_id")] if element in self.entities else [F.col(c) for c in sub.columns if c.startswith(f"{element}_")] + [F.col(f"{self.edges[element][k]}_id") for k in ("from", "to")]
        return self._cut(sub, there | bound, source, keys, names), there, keys, names

    def _cut(self, sub: DataFrame, bound: set[str], source: dict, keys: list[str], names: list[Column]) -> DataFrame:
        """The list's distinct, skip and limit."""
        if source.get("distinct"):
            sub = sub.withColumn("_element", F.struct(*names)).dropDuplicates([*keys, "_element"]).drop("_element")
        if source.get("limit") is None and not source.get("skip"):
            return sub
        skip, limit = source.get("skip") or 0, source.get("limit")
        by = [*self._order(sub, bound, source), *names]
        if not keys:
            sub = sub.orderBy(*by).offset(skip)
            return sub if limit is None else sub.limit(limit)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        sub = sub.withColumn("_rank", rank).filter(F.col("_rank") > skip)
        return (sub if limit is None else sub.filter(F.col("_rank") <= skip + limit)).drop("_rank")

    def _order(self, sub: DataFrame, bound: set[str], source: dict) -> list[Column]:
        return [(F.desc_nulls_last if o.get("direction") == "DESC" else F.asc_nulls_last)(self.expression(sub, bound, o["expression"])[1]) for o in source.get("order_by") or []]

    def _value(self, sub: DataFrame, bound: set[str], x: dict, names: list[Column]) -> tuple[DataFrame, Column]:
        """The aggregate over the rows of one list."""
        if "count" in x:
            return sub, F.count("*")
        if "aggregate_kind" in x:
            sub, column = self.expression(sub, bound, x["map_expression"])
            return sub, AGGREGATES[x["aggregate_kind"]](column)
        source, place = _source(x), []
        for o in source.get("order_by") or []:
            column = self.expression(sub, bound, o["expression"])[1]
            place.append((o.get("direction") == "DESC", column))
        shown = names[0] if len(names) == 1 else F.struct(*names)
        if not place:
            return sub, F.array_sort(F.collect_list(shown))
        item = F.struct(*[c.alias(f"k{i}") for i, (_, c) in enumerate(place)], shown.alias("v"))

        def compare(a: Column, b: Column) -> Column:
            out = F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0)
            for i, (down, _) in reversed([*enumerate(place)]):
                u, v = a[f"k{i}"], b[f"k{i}"]
                out = F.when(u.isNull() & v.isNotNull(), 1).when(u.isNotNull() & v.isNull(), -1).when(u < v, 1 if down else -1).when(u > v, -1 if down else 1).otherwise(out)
            return out

        return sub, F.transform(F.array_sort(F.collect_list(item), compare), lambda i: i["v"])

    def _empty(self, x: dict, column: Column) -> Column:
        if "count" in x:
            return F.coalesce(column, F.lit(0))
        return column if "aggregate_kind" in x else F.coalesce(column, F.array())

    def _attached(self, df: DataFrame, bound: set[str], x: dict) -> tuple[DataFrame, Column]:
        name = self._name()
        sub, there, keys, names = self._domain(df, bound, x, [x.get("map_expression")])
        sub, value = self._value(sub, there | bound, x, names)
        found = (sub.groupBy(*keys) if keys else sub).agg(value.alias(name))
        return self._tied(df, found, keys), self._empty(x, F.col(name))

    def _quantified(self, df: DataFrame, bound: set[str], x: dict) -> tuple[DataFrame, Column]:
        kind, conditions = x["quantifier_kind"], _conjuncts(x["condition"])
        if kind not in ("ALL", "EXISTS", "NONE"):
            raise ValueError(f"no quantifier {kind}")
        element = _source(x)["list"]["list_elements"]
        over = [c for c in conditions if isinstance(c, str) and c in self.edges and element in (r := self.edges[c], r["from"], r["to"])[1:]]
        other = [c for c in conditions if c not in over]
        sub, there, keys, names = self._domain(df, bound, x, other)
        if not over:
            sub, column = self.conjunction(sub, there | bound, other)
            if kind == "ALL":
                df, flag = self._flag(df, sub.filter(~F.coalesce(column, F.lit(False))), keys)
                return df, ~flag
            df, flag = self._flag(df, sub.filter(column), keys)
            return df, flag if kind == "EXISTS" else ~flag
        # The condition is a relationship to the outer pattern: elements that have it are counted for each of its ends there.
        met, ends = sub, list(keys)
        for c in over:
            r = self.edges[c]
            met = graph.relate(met, self.g, r["from"], r["to"], r.get("role", ""))
            ends += [f"{e}_id" for e in (r["from"], r["to"]) if e != element and f"{e}_id" not in ends]
        if other:
            met = self._with_outer(met, df, there, bound, other, ends)
            met, column = self.conjunction(met, there | bound, other)
            met = met.filter(column)
        some, total = self._name(), self._name()
        df = self._tied(df, met.groupBy(*ends).agg(F.count_distinct(F.struct(*names)).alias(some)), ends)
        count = F.coalesce(F.col(some), F.lit(0))
        if kind != "ALL":
            return df, count > 0 if kind == "EXISTS" else count == 0
        every = F.count_distinct(F.struct(*names)).alias(total)
        df = self._tied(df, (sub.groupBy(*keys) if keys else sub).agg(every), keys)
        return df, count == F.coalesce(F.col(total), F.lit(0))

    def _path_value(self, df: DataFrame, x: dict) -> tuple[DataFrame, Column]:
        """A list of a path's nodes or relationships, or a value over it. Relationships carry their attributes; of nodes the id alone."""
        source = _source(x)
        of_nodes = "nodes_of" in source["list"]
        path = source["list"].get("nodes_of") or source["list"]["rels_of"]
        own = source["list"].get("node_id") or source["list"].get("rel_id")
        items = self._column(df, path, "nodes" if of_nodes else "edges")

        def at(item: Column, e: Any) -> Column:
            if not isinstance(e, dict):
                return F.lit(e)
            if e.get("of") == own:
                if of_nodes and e["attribute_name"] != "id":
                    raise ValueError("of the nodes of a path only the id is there")
                return item if of_nodes else item[e["attribute_name"]]
            return self._column(df, e["of"], e["attribute_name"])

        def holds(item: Column, c: Any) -> Column:
            if "and_conditions" in c or "or_conditions" in c:
                return reduce(Column.__and__ if "and_conditions" in c else Column.__or__, [holds(item, p) for p in c.get("and_conditions") or c["or_conditions"]])
            if "not_condition" in c:
                return ~holds(item, c["not_condition"])
            return self._comparison(at(item, c["left"]), c["operator"], c["right"], at(item, c["right"]))

        if source.get("filter"):
            items = F.filter(items, lambda i: holds(i, source["filter"]))
        if source.get("distinct"):
            items = F.array_distinct(items)
        if order := source.get("order_by"):
            if len(order) > 1:
                raise ValueError("the elements of a path are sorted by one expression")
            keyed = F.transform(items, lambda i: F.struct(at(i, order[0]["expression"]).alias("k"), i.alias("v")))
            items = F.transform(F.sort_array(keyed, order[0].get("direction") != "DESC"), lambda i: i["v"])
        if source.get("limit") is not None or source.get("skip"):
            items = F.slice(items, (source.get("skip") or 0) + 1, source["limit"] if source.get("limit") is not None else 2**31 - 1)
        if "count" in x:
            return df, F.size(items)
        if "quantifier_kind" in x:
            test = lambda i: F.coalesce(holds(i, x["condition"]), F.lit(False))
            some = F.exists(items, test)
            return df, F.forall(items, test) if x["quantifier_kind"] == "ALL" else some if x["quantifier_kind"] == "EXISTS" else ~some
        if "aggregate_kind" not in x:
            return df, items if of_nodes else F.transform(items, lambda i: i["role"])
        values = F.filter(F.transform(items, lambda i: at(i, x["map_expression"]).cast("double")), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        kinds = {"SUM": total, "MIN": F.array_min(values), "MAX": F.array_max(values), "AVG": total / F.nullif(F.size(values), F.lit(0))}
        return df, F.when(F.size(values) > 0, kinds[x["aggregate_kind"]])

    # The answer.

    def answer(self) -> DataFrame:
        target, order = self.query["target"], self.query.get("order_by") or []
        plain = [t for t in target if isinstance(t, str) or isinstance(t, dict) and "attribute_name" in t]
        self.keys = set()
        for t in plain:
            name = t if isinstance(t, str) else self.parts.get(t["of"], t["of"])
            if name not in {*self.entities, *self.edges, *self.paths}:
                raise ValueError(f"not declared: {name}")
            self.keys |= {name, *({self.edges[name]["from"], self.edges[name]["to"]} if name in self.edges else ())}
        path_lists = [v for t in target for v in self._variables(t) & self.paths.keys()]
        listed = self._elements([t for t in target if _is_list(t)])
        sorted_by = set().union(*(self._variables(o["expression"]) for o in order))
        anchors = self.keys | set(path_lists) | sorted_by | set().union(*(self._variables(t) for t in target if not _is_list(t)))
        # Without any other target a list's rows are the pattern's.
        anchors |= set() if self.keys else listed
        local = (self._elements(self.query.get("constraint")) | self._elements([o["expression"] for o in order]) | listed) - anchors
        outer = self._closure(anchors, local) if anchors else set()
        if (df := self._compared(outer)) is not None:
            return df
        found = self._merged(self._pattern(outer)) if outer else []
        # Only conditions are asked for, and their own variables are all that there is.
        found = found or self._pattern(self._closure({v for c in self.conjuncts for v in self._variables(c)}, local))
        every = set().union(*(bound for bound, _ in found))
        parts = [self._answered(df, bound, every) for bound, df in found]
        if len(parts) > 1:
            if not self.keys:
                ones = [p.withColumn("_one", F.lit(1)) for p in parts]
                return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), ones).drop("_one")
            return self._paged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
        return parts[0]

    def _loose(self, outer: set[str]) -> tuple | None:
        """A branch of the pattern that only one inequality ties to the rest, but for its hub: hub, branch, its links to the hub, the inequality as (attribute of the
        branch, operator, attribute of the rest), conjuncts of the branch and of the rest. None if there is none, or if lists, paths or relationships as conditions are asked for."""
        plain = all(isinstance(t, str) or isinstance(t, dict) and "attribute_name" in t for t in self.query["target"])
        if not plain or self.paths or self.conditional or self._elements(self.query) or self.query.get("order_by") or any(self._variables(c) - outer for c in self.conjuncts):
            return None
        found = []
        for c in self.conjuncts:
            if not isinstance(c, dict) or c.get("operator") not in MIRRORED or not all(isinstance(c[k], dict) and c[k].get("of") in self.entities for k in ("left", "right")):
                continue
            for x, operator, y in ((c["left"], c["operator"], c["right"]), (c["right"], MIRRORED[c["operator"]], c["left"])):
                # At one of the two that are compared, the branch would hold their pairs.
                for hub in [e for e in self.entities if e in outer - {x["of"], y["of"]}]:
                    inner = self._closure({x["of"]}, {hub})
                    ties = {i for i, ends in self._links() if i not in inner and ends & inner}
                    own = [o for o in self.conjuncts if self._variables(o) and self._variables(o) <= inner]
                    rest = [o for o in self.conjuncts if o is not c and o not in own and not (operator in "<>" and self._unlike(o, x["of"], y["of"]))]
                    if ties and not (inner | ties) & (self.keys | {y["of"]}).union(*(self._variables(o) for o in rest)):
                        found.append((hub, inner, ties, (x, operator, y), own, rest))
        return max(found, key=lambda f: len(f[1]), default=None)

    def _unlike(self, c: Any, a: str, b: str) -> bool:
        """Whether ``c`` only says that two entities aren't the same, which holds for all that differ in an attribute."""
        return isinstance(c, dict) and c.get("operator") == "!=" and all(isinstance(c[k], dict) and c[k].get("attribute_name") == "id" for k in ("left", "right")) and {c[k].get("of") for k in ("left", "right")} == {a, b}

    def _compared(self, outer: set[str]) -> DataFrame | None:
        """The answer if a branch is loose; None if there is none."""
        if (loose := self._loose(outer)) is None:
            return None
        hub, inner, ties, (x, operator, y), own, rest = loose
        branch, main = self._pattern(inner, tuple(ties)), self._pattern(outer - inner - ties)
        if len(branch) > 1 or len(main) > 1:
            return None
        (there, sub), (bound, df) = branch[0], main[0]
        sub, column = self.conjunction(sub, there, own)
        sub = sub.filter(column)
        df, column = self.conjunction(df, bound, rest)
        df = df.filter(column)
        theirs, mine = self._column(sub, x["of"], x["attribute_name"]), self._column(df, y["of"], y["attribute_name"])
        sub, df = sub.select(f"{hub}_id", theirs.alias("_value")), df.withColumn("_value", mine)
        if dict(sub.dtypes)["_value"] != dict(df.dtypes)["_value"]:
            return None
        if self.query.get("distinct"):
            best = sub.groupBy(f"{hub}_id").agg((F.min if operator[0] == "<" else F.max)("_value").alias("_theirs"))
            met = df.join(best, f"{hub}_id").filter(OPERATORS[operator](F.col("_theirs"), F.col("_value")))
            return self._selected(met, bound, self.query["target"], [], False)
        counts = count_passed(df, sub, f"{hub}_id", "_value", operator, "_times")
        return self._selected(repeated(df.join(counts, [f"{hub}_id", "_value"]), "_times"), bound, self.query["target"], [], False)

    def _merged(self, found: list[tuple[set[str], DataFrame]]) -> list[tuple[set[str], DataFrame]]:
        """Parts that an equality of attributes connects become one."""
        for c in self.conjuncts:
            if isinstance(c, dict) and c.get("operator") == "=" and all(isinstance(c[k], dict) and "of" in c[k] for k in ("left", "right")):
                sides = [next((p for p in found if c[k]["of"] in p[0]), None) for k in ("left", "right")]
                if None not in sides and sides[0] is not sides[1]:
                    (a, left), (b, right) = sides
                    pair = self._column(left, c["left"]["of"], c["left"]["attribute_name"]) == self._column(right, c["right"]["of"], c["right"]["attribute_name"])
                    found = [p for p in found if p not in sides] + [(a | b, left.join(right, pair))]
        return found

    def _answered(self, df: DataFrame, bound: set[str], outer: set[str]) -> DataFrame:
        several = outer != bound
        asked = self._closure({v for c in self.conjuncts if isinstance(c, str) for v in self._variables(c)} - bound, bound)
        first, last = [], []
        for c in self.conjuncts:
            named = self._variables(c)
            if several and not self._touches(c, bound, outer):
                continue
            if named and not named & bound and not named <= asked and not self._asked(c):
                if not self._in_lists(c, bound):
                    raise ValueError("a condition is about variables that nothing connects to a target")
                continue
            (last if self._elements(c) & bound else first).append(c)
        # Conditions that stand together see each other's entities; lists over the pattern itself come after all others.
        for conditions in ([first], [[c] for c in last]):
            columns = []
            for some in conditions:
                df, column = self.conjunction(df, bound, some)
                columns.append(column)
            df = df.filter(reduce(Column.__and__, columns)) if columns else df
        return self._selected(df, bound, self.query["target"], self.query.get("order_by") or [], several)

    def _touches(self, c: Any, bound: set[str], outer: set[str]) -> bool:
        """Whether a condition is about this part of the pattern: about it or about none."""
        named = self._variables(c) | self._elements(c)
        for e in self._elements(c) - outer:
            inner = self._closure({e}, outer)
            named |= set().union(*(ends for _, ends in self._links() if ends & inner))
        return bool(named & bound) or not named & outer

    def _in_lists(self, c: Any, bound: set[str]) -> bool:
        """Whether some list's own pattern has the variables of ``c``."""
        lists = self._elements([self.query.get("constraint"), self.query["target"], self.query.get("order_by")])
        return any(self._variables(c) <= self._closure({e}, bound) for e in lists - bound)

    def _selected(self, df: DataFrame, bound: set[str], target: list, order: list, several: bool) -> DataFrame:
        columns: dict[str, Column] = {}
        lists, conditions = {}, {}
        for i, t in enumerate(target, 1):
            name = t if isinstance(t, str) else f"{t['of']}_{t['attribute_name']}" if "attribute_name" in t else f"target_{i}"
            if isinstance(t, str) and t in self.entities and t in bound:
                columns[name] = F.col(f"{t}_id")
            elif isinstance(t, str) and t in self.edges and t in bound:
                r = self.edges[t]
                columns |= {f"{t}_src": F.col(f"{r['from']}_id"), f"{t}_role": F.col(f"{t}_role"), f"{t}_dst": F.col(f"{r['to']}_id")}
            elif isinstance(t, str) and t in self.paths and t in bound:
                columns |= {t: F.col(f"{t}_nodes"), f"{t}_roles": F.transform(f"{t}_edges", lambda e: e["role"])}
            elif isinstance(t, dict) and "attribute_name" in t:
                if self.parts.get(t["of"], t["of"]) in bound:
                    columns[name] = self._column(df, t["of"], t["attribute_name"])
            elif _is_list(t) and "quantifier_kind" not in t:
                if "list_elements" not in _source(t)["list"]:
                    columns[name] = self._path_value(df, t)[1]
                elif not several or _source(t)["list"]["list_elements"] in bound:
                    lists[name] = t
            elif isinstance(t, dict):
                conditions[name] = t
        if conditions:
            for name, c in conditions.items():
                df, columns[name] = self.condition(df, bound, c)
            return df.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in columns.items()])
        if not columns:
            out = []
            for name, t in lists.items():
                sub, there, _, names = self._domain(df, bound, t, [t.get("map_expression")])
                sub, value = self._value(sub, there | bound, t, names)
                out.append(sub.agg(self._empty(t, value).alias(name)).withColumn("_one", F.lit(1)))
            return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), out).drop("_one")
        ids = [c for c in df.columns if any(c == f"{v}_id" for v in self.keys) or any(c.startswith(f"{v}_") for v in self.keys & self.edges.keys())]
        sorts = {}
        for i, o in enumerate(order):
            e = o["expression"]
            if _is_list(e) and "list_elements" in _source(e)["list"]:
                lists[f"_sort{i}"] = e
            else:
                sorts[f"_sort{i}"] = self.expression(df, bound, e)[1]
        rows = df.select(*ids, *[c.alias(n) for n, c in {f"={n}": c for n, c in columns.items()}.items()], *[c.alias(n) for n, c in sorts.items()])
        if lists:
            # One row for each combination of the other targets.
            rows = rows.dropDuplicates(ids)
        for name, t in lists.items():
            sub, there, ties, names = self._domain(df, bound, t, [t.get("map_expression")])
            if ties and set(ties) != set(ids):
                sub = df.select(*dict.fromkeys([*ids, *ties])).distinct().join(sub, ties)
            sub, value = self._value(sub, there | bound, t, names)
            found = (sub.groupBy(*ids) if ties else sub).agg(value.alias(f"={name}"))
            rows = self._tied(rows, found, ids if ties else [])
            rows = rows.withColumn(f"={name}", self._empty(t, F.col(f"={name}")))
        shown = [*columns, *(n for n in lists if not n.startswith("_sort"))]
        out = rows.select(*[F.col(f"={n}").alias(n) for n in shown], *[F.col(n if n in sorts else f"={n}").alias(n) for i in range(len(order)) for n in [f"_sort{i}"]])
        return out if several else self._paged(out)

    def _paged(self, rows: DataFrame) -> DataFrame:
        """distinct, order_by, skip and limit; rows that the sort keys leave equal come by their values."""
        order = self.query.get("order_by") or []
        names = [f"_sort{i}" for i in range(len(order))]
        shown = [c for c in rows.columns if c not in names]
        if self.query.get("distinct"):
            best = [(F.max if o.get("direction") == "DESC" else F.min)(n).alias(n) for n, o in zip(names, order, strict=True)]
            rows = rows.groupBy(*shown).agg(*best) if best else rows.distinct()
        limit, skip = self.query.get("limit"), self.query.get("skip") or 0
        if order or limit is not None or skip:
            rows = rows.orderBy(*[(F.desc_nulls_last if o.get("direction") == "DESC" else F.asc_nulls_last)(n) for n, o in zip(names, order, strict=True)], *shown)
        rows = rows.offset(skip) if skip else rows
        rows = rows if limit is None else rows.limit(int(limit))
        return rows.select(*shown)

