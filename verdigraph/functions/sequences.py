"""Sequence patterns in arrays: what a pattern of values, variables and gaps binds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any one element; any run of elements, an empty one too.
ANY, RUN = "_", "..."


def _advanced(states: Column, items: Column, part: list[str], known: set[str], shown: list[str], kind: str, first: bool, last: bool) -> Column:
    """The states behind ``part``: the first part stands at the start, the last at the end, others anywhere behind the one before."""
    size = F.size(items)

    def fits(s: Column, at: Column) -> Column:
        bound, values = set(known), {}
        good = (at >= s["at"]) & (at + len(part) <= size)
        for i, p in enumerate(part):
            own = F.get(items, (at + i).cast("int"))
            if p.startswith("?") and p[1:] in bound:
                good = good & values.get(p[1:], s[p[1:]]).eqNullSafe(own)
            elif p.startswith("?"):
                values[p[1:]] = own
                bound.add(p[1:])
            elif p != ANY:
                good = good & F.coalesce(own == F.lit(p).cast(kind), F.lit(False))
        return good

    def behind(s: Column, at: Column) -> Column:
        values = {n: s[n] for n in shown}
        values |= {p[1:]: F.get(items, (at + i).cast("int")) for i, p in reversed([*enumerate(part)]) if p.startswith("?") and p[1:] not in known}
        return F.struct((at + len(part)).cast("int").alias("at"), *[values[n].alias(n) for n in shown])

    if first or last:
        at = F.lit(0) if first else size - len(part)
        whole = size == len(part) if first and last else F.lit(True)
        return F.transform(F.filter(states, lambda s: fits(s, at) & whole), lambda s: behind(s, at))

    def spread(s: Column) -> Column:
        upto = size - len(part)
        places = F.when(upto >= s["at"], F.sequence(s["at"], upto)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, lambda at: fits(s, at)), lambda at: behind(s, at))

    return F.flatten(F.transform(states, spread))


def matches(items: Column, pattern: Sequence[str], kind: str = "string") -> Column:
    """All ways in which ``pattern`` matches the whole array, as an array of structs of its variables (of ``matched`` if there are none).

    ``?name`` is a variable, ANY and RUN are gaps, anything else is a value. A variable that stands several times is one value. A null array has no match, and a null element
    matches ANY and a variable but no value. Parts between two runs are tried at every place, so two runs give as many tries as the array has places,
    three that many squared; ways that bind the same are all returned.
    """
    shown = list(dict.fromkeys(p[1:] for p in pattern if p.startswith("?"))) or ["matched"]
    parts: list[list[str]] = [[]]
    for p in pattern:
        parts.append([]) if p == RUN else parts[-1].append(p)
    none = F.lit(True) if shown == ["matched"] else F.lit(None).cast(kind)
    states, known = F.array(F.struct(F.lit(0).alias("at"), *[none.alias(n) for n in shown])), set()
    for i, part in enumerate(parts):
        states = _advanced(states, items, part, set(known), shown, kind, i == 0, i == len(parts) - 1)
        known |= {p[1:] for p in part if p.startswith("?")}
    out = F.transform(states, lambda s: F.struct(*[s[n].alias(n) for n in shown]))
    return F.when(items.isNotNull(), out).otherwise(F.slice(out, F.lit(1), F.lit(0)))
