"""Element tags of Cypher texts: which parts of the document grammar a query would need.

A text is read without its literals. What it returns is followed through the aliases of its WITH and RETURN clauses, item by item; its conditions are those of
WHERE clauses, of values inside patterns and of bounds on paths, branch by branch of a union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigraph.functions.cypher import listed, once, returned, without_literals

# Tags and the patterns that tell them, case ignored.
PATTERNS = {
    "limit": r"\bLIMIT\b",
    "order_by": r"\bORDER\s+BY\b",
    "Query distinct": r"\b(RETURN|WITH)\s+DISTINCT\b",
    "LIST.distinct": r"\b(count|collect|sum|avg|min|max)\s*\(\s*DISTINCT\b",
    "Query skip": r"\bSKIP\b",
    "SUM": r"\bsum\s*\(",
    "AVG": r"\bavg\s*\(",
    "MIN": r"\bmin\s*\(",
    "MAX": r"\bmax\s*\(",
    "OR": r"(?<![\[.:])\bOR\b(?!\s*[:.])",
    "NOT": r"(?<!IS )\bNOT\b",
    "!=": r"<>",
    "PATH": r"-\s*\[[^\]]*\*[^\]]*\]",
    "PATH with a role list": r"-\s*\[\s*\w*\s*:[^\]]*\*[^\]]*\]",
    "PATH with an empty role list": r"-\s*\[\s*\w*\s*\*[^\]]*\]",
    "Relationship with a role": r"-\s*\[\s*\w*\s*:[^\]*]*\]\s*-",
    "NODES": r"\bnodes\s*\(",
    "RELATIONS": r"\brelationships\s*\(|\blength\s*\(\s*(?!\w+\.\w+\s*\))",
    "Relationship with any role": r"-\s*\[\s*\w*\s*(\{[^}]*\})?\s*\]\s*-|-->|<--|\)--\(",
    "COUNT": r"\bcount\s*[({]|\bsize\s*\(\s*(?!keys\b|\w+\.\w+\s*\))|\blength\s*\(\s*(?!\w+\.\w+\s*\))",
    "CREATE_LIST": r"\b(collect|count|sum|avg|min|max)\s*[({]|\bsize\s*\(\s*(?!keys\b|nodes\b|relationships\b|\w+\.\w+\s*\))",
    "CONTAINS": r"(?<![:|.])\bCONTAINS\b",
    "QUANTIFIER EXISTS": r"(?<!NOT )\bexists\s*[({]|\bany\s*\(\s*\w+\s+IN\s+(?!keys\b)",
    "QUANTIFIER ALL": r"\ball\s*\(",
    "QUANTIFIER NONE": r"\bnone\s*\(",
    "LIST.skip": r"[\])]\s*\[\s*[1-9]\d*\s*\.\.",
    "DATE_TIME": r"\b(date|datetime|localdatetime)\s*\(\s*(''|\{)",
    "BOOLEAN value": r"(?:[=:]|<>)\s*(true|false)\b",
    "ANY(key IN keys(n))": r"\bany\s*\(\s*\w+\s+IN\s+keys\b",
    "size() or length() of a property": r"\b(size|length)\s*\(\s*\w+\.\w+\s*\)",
    "Several role types or labels": r"-\s*\[[^\]]*:\s*\w+\s*\||\(\s*\w*\s*:\s*\w+\s*\|",
    "STARTS WITH or ENDS WITH": r"\b(STARTS|ENDS)\s+WITH\b",
    "=~": r"=~",
    "IS NULL or IS NOT NULL": r"\bIS\s+(NOT\s+)?NULL\b",
    "UNION": r"\bUNION\b",
}
# Comparisons inside WHERE clauses, and bounds on the relationships of a path, which are comparisons too.
COMPARISONS = {"=": r"(?<![<>=!~])=(?![~=])\s*(?!\(|shortestPath|allShortestPaths)", ">": r"(?<![-<=])>(?![=-])\s*[\w'(-]", ">=": r">=", "<": r"(?<![<])<(?![-=>])\s*[\w'(-]", "<=": r"<="}
HOPS = {"=": r"-\s*\[[^\]]*\*\s*\d+\s*(?:\{[^}]*\}\s*)?\]", ">=": r"-\s*\[[^\]]*\*\s*\d+\s*\.\.", "<=": r"-\s*\[[^\]]*\*\s*\d*\s*\.\.\s*\d+"}
# How clauses, values inside patterns, predicates and variables look.
WHERE = r"(?i)\bWHERE\b(.*?)(?=\bRETURN\b|(?<!STARTS )(?<!ENDS )\bWITH\b|\bMATCH\b|\bORDER\b|\bUNION\b|$)"
ORDER = r"(?i)\bORDER\s+BY\b(.*?)(?=\bLIMIT\b|\bSKIP\b|\bRETURN\b|\bWITH\b|$)"
BRANCH = r"(?i)\bUNION\b(?:\s+ALL\b)?"
INLINE, CALLED_MAP = r"(?i)(?<!\()[{,]\s*\w+\s*:\s*(?:''|-?\d|true|false)", r"(?i)\b\w+\s*\(\s*\{[^}]*\}"
COUNTED = r"(?i)\b(?:count\s*\{[^}]*\}|size\s*\((?:[^()]|\([^()]*\))*\))"
PREDICATE, EXISTS_IN_WHERE = r"\)\s*<?-\s*[\[-]", r"(?i)\bWHERE\b.*?\bexists\s*[({]"
CONJUNCTION, IN_LIST = r"(?i)(?<![\[.:])\bAND\b(?!\s*[:.])", r"(?i)\bIN\s*\[\s*(?:''|-?\d)[^\]]*,"
NAMED_PATH = r"(?i)(?:\bMATCH\b|,)\s*\w+\s*=\s*(?:(?:all)?shortestPath\s*\(\s*)?\(.*?(?=\bRETURN\b|\bWITH\b|\bWHERE\b|\bMATCH\b|$)"
ROLE, EDGE = r"-\s*\[\s*\w*\s*:", r"\)\s*<?-\s*\[\s*\w*\s*(:[^\]*]*)?(\{[^}]*\})?\s*\]\s*-?>?\s*\(|\)\s*(?:<--|--?>|--)\s*\("
EDGE_VARIABLE, EDGE_VALUE = r"-\s*\[\s*([A-Za-z_]\w*)\s*[:\]\*{]", r"-\s*\[\s*\w*\s*:?\s*\w*\s*\{"
PATH_VARIABLE = r"(?i)\b(\w+)\s*=\s*(?:shortestPath\s*\(|allShortestPaths\s*\(|\()"
AGGREGATE, ISO_DATE = r"(?i)\b(collect|count|sum|avg|min|max)\s*[({]", r"['\"]\d{4}-\d{2}(?:-\d{2}(?:T[\d:.Z+-]*)?)?['\"]"
NUMBER, NO_NUMBERS = r"(?<![\w.])\d+(\.\d+)?(?![\w.])", r"(?i)\[[^\]{}]*\]|\bLIMIT\s+\d+|\bSKIP\s+\d+"
# What a returned expression is, by what it looks like, the first that fits.
TARGETS = [
    ("Target CONDITION", r"(?i)^exists\s*[({]"),
    ("Target LIST", r"(?i)^(collect|nodes|relationships)\s*\("),
    ("Target SCALAR_AGGREGATE", r"(?i)\b(sum|avg|min|max)\s*\("),
    ("Target COUNT", r"(?i)\bcount\s*[({]|\bsize\s*\(\s*(?!keys\b|\w+\.\w+\s*\))"),
    ("Target properties(), labels(), type() or keys()", r"(?i)^(size\s*\(\s*)?(properties|keys|labels|type)\s*\("),
]
# Tags that follow from others, in this order.
UMBRELLAS = [
    ("MATCHES_REGEX", ("=~", "STARTS WITH or ENDS WITH")),
    ("COMPARISON", ("=", "!=", ">", "<", ">=", "<=", "CONTAINS", "MATCHES_REGEX")),
    ("SCALAR_AGGREGATE", ("SUM", "MIN", "MAX", "AVG")),
    ("QUANTIFIER_PREDICATE", ("QUANTIFIER ALL", "QUANTIFIER EXISTS", "QUANTIFIER NONE")),
    ("LIST (any kind)", ("COUNT", "SUM", "AVG", "MIN", "MAX", "NODES", "RELATIONS")),
]
#: Words that end the list of a WITH or RETURN clause.
ENDS = ("SKIP", "LIMIT", "UNION", "WHERE", "MATCH", "OPTIONAL", "UNWIND", "CALL")


def _has(text: Column, pattern: str, fold: bool = False) -> Column:
    return F.regexp_like(text, F.lit(f"(?i){pattern}" if fold else pattern))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _if(test: Column, *tags: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>"))


def targets(text: Column) -> Column:
    """The kinds of what a text without literals returns. An alias stands for the last expression that a clause gave that name."""
    edges, paths = _all(text, EDGE_VARIABLE, 1), _all(text, PATH_VARIABLE, 1)
    # The WITH of a comparison is no clause.
    clauses = F.regexp_replace(text, r"(?i)\b(STARTS|ENDS)\s+WITH\b", "$1_WITH")
    alias = r"(?is)^(.*)\s+AS\s+(\w+)$"
    given = F.filter(listed(clauses, ("WITH", "RETURN"), ENDS), lambda i: _has(i, alias))
    named = F.transform(given, lambda i: F.struct(F.regexp_extract(i, alias, 2).alias("name"), F.trim(F.regexp_extract(i, alias, 1)).alias("is")))

    def meant(item: Column, named: Column) -> Column:
        own = F.trim(F.regexp_replace(item, r"(?is)\s+AS\s+\w+$", ""))
        return once(own, lambda own: F.coalesce(F.try_element_at(F.filter(named, lambda a: a["name"] == own), F.lit(-1))["is"], own))

    def kind(e: Column) -> Column:
        word, owner = _has(e, r"^\w+$"), F.regexp_extract(e, r"^(\w+)\.", 1)
        plain = F.when(F.array_contains(edges, e), "Target RELATIONSHIP_ID").when(F.array_contains(paths, e), "Target PATH_ID").otherwise("Target ENTITY_ID")
        attribute = F.when(owner != "", F.when(F.array_contains(edges, owner), "Target relationship attribute").otherwise("Target ATTRIBUTE"))
        return reduce(lambda rest, t: F.when(_has(e, t[1]), t[0]).otherwise(rest), reversed(TARGETS), F.when(word, plain).otherwise(attribute))

    several = F.exists(F.split(text, BRANCH), lambda b: F.size(returned(b)) > 1)
    said = once(named, lambda named: F.transform(returned(text), lambda item: meant(item, named)))
    return F.concat(F.array_compact(F.transform(said, kind)), _if(several, "Several targets"))


def conditions(text: Column) -> Column:
    """The tags of what a text without literals asks for: its comparisons, their conjunction, and predicates that are patterns."""
    clauses = _all(text, WHERE, 1)
    where, inline = F.array_join(clauses, " "), F.regexp_count(F.regexp_replace(text, CALLED_MAP, ""), F.lit(INLINE))
    bounds = [_has(text, p) for p in HOPS.values()]

    def joined(branch: Column) -> Column:
        own = _all(branch, WHERE, 1)
        values = F.regexp_count(F.regexp_replace(branch, CALLED_MAP, ""), F.lit(INLINE))
        n_bounds = reduce(Column.__add__, [_has(branch, p).cast("int") for p in HOPS.values()])
        return _has(F.array_join(own, " "), CONJUNCTION) | (values + F.size(own) + n_bounds >= 2)

    outside = F.regexp_replace(where, COUNTED, "")
    return F.concat(
        *[_if(_has(where, p, True), name) for name, p in COMPARISONS.items()],
        *[_if(b, name) for name, b in zip(HOPS, bounds, strict=True)],
        _if(reduce(Column.__or__, bounds), "constraint", "COUNT", "RELATIONS", "NUMBER value"),
        _if(inline > 0, "=", "constraint"), _if(F.size(clauses) > 0, "constraint"), _if(_has(where, IN_LIST), "OR", "="),
        _if(F.exists(F.split(text, BRANCH), joined), "AND"), _if(_has(outside, PREDICATE) | _has(text, EXISTS_IN_WHERE), "RELATIONSHIP_ID as a condition"),
    )


def directions(text: Column) -> Column:
    """ASC and DESC, as the sort keys of a text say; a key that says nothing is ASC."""
    ways = F.flatten(F.transform(_all(text, ORDER, 1), lambda c: listed(F.concat(F.lit("ORDERED "), c), ("ORDERED",), ())))
    return F.transform(ways, lambda k: F.when(_has(k, r"(?i)\bDESC(ENDING)?\s*$"), "DESC").otherwise("ASC"))


def elements(cypher: Column) -> Column:
    """The sorted tags of a Cypher text; null of null. Every text has ``ENTITY`` and ``One hypothesis``."""
    return F.when(cypher.isNotNull(), once(without_literals(cypher), lambda text: _tags(cypher, text)))


def _tags(cypher: Column, text: Column) -> Column:
    paths = _all(text, NAMED_PATH, 0)
    edges = _all(text, EDGE_VARIABLE, 1)
    owners = _all(text, r"(?<![\w.])(\w+)\.\w", 1)
    inline = F.regexp_count(F.regexp_replace(text, CALLED_MAP, ""), F.lit(INLINE)) > 0
    before = F.get(F.split(text, AGGREGATE, 2), F.lit(0))
    filtered = _has(text, AGGREGATE) & (_has(before, r"(?i)\bWHERE\s+\S") | _has(F.regexp_replace(before, CALLED_MAP, ""), INLINE))
    own = F.concat(
        F.array(F.lit("ENTITY"), F.lit("One hypothesis")), targets(text), conditions(text), directions(text),
        *[_if(_has(text, p, True), name) for name, p in PATTERNS.items()],
        _if(F.size(paths) > 0, "PATH"), _if(F.exists(paths, lambda p: _has(p, ROLE)), "PATH with a role list"), _if(F.exists(paths, lambda p: ~_has(p, ROLE)), "PATH with an empty role list"),
        _if(_has(text, EDGE), "relationships"), _if(_has(cypher, ISO_DATE), "DATE_TIME"), _if(_has(text, r"(?i)\bcollect\s*\("), "LIST (any kind)"),
        _if(_has(text, r"\.\w+\b") | inline, "ATTRIBUTE (anywhere)"), _if(F.contains(text, F.lit("''")), "STRING value"), _if(_has(F.regexp_replace(text, NO_NUMBERS, ""), NUMBER), "NUMBER value"),
        _if(_has(text, EDGE_VALUE) | F.arrays_overlap(edges, owners), "Relationship attribute"), _if(filtered, "LIST.filter"),
        _if(_has(text, r"(?i)\bIS\s+NOT\s+NULL\b"), "!=", "STRING value"), _if(_has(text, r"(?i)\bIS\s+NULL\b"), "=", "STRING value"),
    )
    for name, parts in UMBRELLAS:
        own = _also(own, name, parts)
    return F.array_sort(F.array_distinct(own))


def _also(tags: Column, name: str, parts: tuple[str, ...]) -> Column:
    return once(tags, lambda t: F.concat(t, _if(F.arrays_overlap(t, F.array(*map(F.lit, parts))), name)))
