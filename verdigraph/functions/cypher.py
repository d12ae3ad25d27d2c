"""Construct tags and clauses of Cypher texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constructs and the patterns that tell them, case ignored.
CONSTRUCTS = {
    "aggregation": r"\b(count|sum|avg|min|max|stdev|percentile\w*)\s*\(",
    "order_by": r"\bORDER\s+BY\b",
    "limit": r"\bLIMIT\b",
    "skip": r"\bSKIP\b",
    "distinct": r"\bDISTINCT\b",
    "var_length_path": r"\[[^\]]*\*[^\]]*\]",
    "shortest_path": r"\b(all)?shortestPath\s*\(",
    "path_variable": r"\b\w+\s*=\s*(\(|(all)?shortestPath)",
    "optional_match": r"\bOPTIONAL\s+MATCH\b",
    "collect": r"\bcollect\s*\(",
    "unwind": r"\bUNWIND\b",
    "list_index_slice": r"\]\s*\[\s*-?\d*\s*(\.\.\s*-?\d*)?\s*\]|\)\s*\[\s*-?\d+\s*\]|\w\[\s*-?\d+\s*(\.\.\s*-?\d*)?\s*\]",
    "negation": r"\bNOT\b|<>",
    "union": r"\bUNION\b",
    "exists_or_subquery": r"\bEXISTS\s*[\{\(]|\bCALL\s*\{|\bCOUNT\s*\{",
    "with_stage": r"\bWITH\b",
}
# Clauses that write.
WRITES = ("CREATE", "DELETE", "DETACH", "MERGE", "SET", "REMOVE", "DROP")


def writes(text: Column) -> Column:
    """Whether a writing clause's name stands anywhere, string literals included."""
    return text.rlike(rf"(?i)\b({'|'.join(WRITES)})\b")


#: What a text is read as: string literals, sort clauses, words, white space, and single characters.
TOKEN = r"""(?is)'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*"|\border\s+by\b|\w+|\s+|."""
QUOTES, OPENING, CLOSING = ("'", '"'), ("(", "[", "{"), (")", "]", "}")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _is_literal(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(*QUOTES) & (F.length(token) > 1)


def _is_space(token: Column) -> Column:
    return F.trim(F.regexp_replace(token, r"\s", "")) == ""


def _neighbours(found: Column) -> Column:
    """Structs of each token with the one before and the one after, empty at the ends."""
    none = F.array(F.lit(""))
    pairs = F.zip_with(F.slice(F.concat(none, found), F.lit(1), F.size(found)), found, lambda before, own: F.struct(before.alias("before"), own.alias("own")))
    return F.zip_with(pairs, F.concat(F.slice(found, F.lit(2), F.size(found)), none), lambda p, after: F.struct(p["before"].alias("before"), p["own"].alias("own"), after.alias("after")))


def once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def relationship_returned(text: Column) -> Column:
    """Whether the last RETURN names a relationship variable on its own, not for one of its attributes.

    Any word that begins a bracket counts as a variable, so an index such as [0] in the RETURN does too. The words that stand alone there are compared with
    the variables as sets, so no pattern is made from the data.
    """
    word = lambda t: F.regexp_like(t, F.lit(r"^\w+$"))
    own = lambda items: F.transform(items, lambda x: x["own"])

    def overlap(found: Column) -> Column:
        dense = once(F.filter(found, lambda t: ~_is_space(t)), _neighbours)
        variables = own(F.filter(dense, lambda x: (x["before"] == "[") & word(x["own"]) & x["after"].isin(":", "]", "*")))
        last = F.array_max(F.filter(F.transform(found, lambda t, i: F.when(F.upper(t) == "RETURN", i)), lambda i: i.isNotNull()))
        said = once(F.slice(found, last + 2, F.size(found)), _neighbours)
        alone = own(F.filter(said, lambda x: word(x["own"]) & (x["before"] != ".") & ~x["after"].isin(".", "(")))
        return F.coalesce(F.arrays_overlap(variables, alone), F.lit(False))

    # Only texts with a bracket and a RETURN are read token by token.
    return F.when(F.contains(text, F.lit("[")) & text.rlike(r"(?i)\bRETURN\b"), once(tokens(text), overlap)).otherwise(F.lit(False))


def constructs(text: Column) -> Column:
    """The sorted tags of a text; null and empty texts have none."""
    tests = {tag: text.rlike(f"(?i){pattern}") for tag, pattern in CONSTRUCTS.items()}
    tests["multiple_match"] = F.regexp_count(text, F.lit(r"(?i)\bMATCH\b")) >= 2
    tests["relationship_returned"] = relationship_returned(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(test, tag) for tag, test in tests.items()])))


def without_literals(text: Column) -> Column:
    """On one line, with '' for each string literal."""
    shown = F.transform(tokens(text), lambda t: F.when(_is_literal(t), "''").when(_is_space(t), " ").otherwise(t))
    return F.trim(F.array_join(shown, ""))


def _put(acc: Column, to: str) -> Column:
    """The items so far with the open one, if there is any text in it."""
    item = F.trim(acc["open"])
    return F.when(item != "", F.array_append(acc[to], item)).otherwise(acc[to])


def returned(text: Column) -> Column:
    """What the RETURN clauses of a text list, without DISTINCT."""
    return listed(text, ("RETURN",), ("SKIP", "LIMIT", "UNION"))


def listed(text: Column, clauses: tuple[str, ...], ends_at: tuple[str, ...]) -> Column:
    """What clauses of these names list, without DISTINCT: one pass over the tokens that knows literals and brackets.

    A clause ends where sorting or one of ``ends_at`` begins, where a bracket closes that was open before it, or at the next such clause.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("depth"), F.lit("").alias("open"), nothing.alias("done"))
    begin, end, comma, opening, closing, silent = range(1, 7)

    def kind(t: Column) -> Column:
        word = lambda name: F.when(name.isin(*clauses), begin).when(name.isin(*ends_at) | F.regexp_like(name, F.lit(r"^ORDER\s+BY$")), end).when(name == "DISTINCT", silent).otherwise(0)
        mark = F.when(t == ",", comma).when(t.isin(*OPENING), opening).when(t.isin(*CLOSING), closing).otherwise(0)
        return F.struct(t.alias("t"), F.when(F.length(t) == 1, mark).otherwise(once(F.upper(t), word)).alias("kind"))

    def step(acc: Column, x: Column) -> Column:
        token, k = x["t"], x["kind"]
        depth = acc["depth"] + F.when(k == opening, 1).when(k == closing, -1).otherwise(0)
        begins, level = k == begin, acc["depth"] == 0
        ends = acc["inside"] & ((depth < 0) | begins | (level & (k == end)))
        parts = acc["inside"] & level & (k == comma)
        quiet = level & (k == silent) & (F.trim(acc["open"]) == "")
        return F.struct(
            ((acc["inside"] & ~ends) | begins).alias("inside"),
            F.when(begins | ends | ~acc["inside"], 0).otherwise(depth).alias("depth"),
            F.when(ends | begins | parts | ~acc["inside"], "").when(quiet, acc["open"]).otherwise(F.concat(acc["open"], token)).alias("open"),
            F.when(ends | parts, _put(acc, "done")).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(F.transform(tokens(text), kind), start, step, lambda acc: F.when(acc["inside"], _put(acc, "done")).otherwise(acc["done"]))
