"""Queries of patterns in sequences, of tags in questions and Cypher texts, and of answers in JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigraph.functions import cypher, elements, questions, sequences, text
from verdigraph.operators import runs
from verdigraph.plans import cypher_queries
from verdigraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def priorities(spark, d):
    """c, items: the priorities of a customer's orders, in the order of their keys."""
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    return own.select("c", F.transform("o", lambda x: x["o_orderpriority"]).alias("items"))


PRIORITIES = "(SELECT o_custkey AS c, list(o_orderpriority ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey)"


@query(f"SELECT c, items[2] AS second FROM {PRIORITIES} WHERE len(items) >= 3 AND items[1] = '1-URGENT'")
def sequence_bindings(spark, d):
    """The second order of customers that began with an urgent one and have a third."""
    return priorities(spark, d).select("c", F.inline(sequences.matches(F.col("items"), ["1-URGENT", "?second", "...", "_"])))


@query(f"SELECT c, x, count(*) AS times FROM (SELECT c, unnest(items) AS x, unnest(list_concat(items[2:], [NULL])) AS y FROM {PRIORITIES}) WHERE x = y GROUP BY c, x")
def sequence_repeats(spark, d):
    """Priorities that come twice in a row, wherever in the sequence."""
    found = priorities(spark, d).select("c", F.inline(sequences.matches(F.col("items"), ["...", "?x", "?x", "..."])))
    return found.groupBy("c", "x").agg(F.count("*").alias("times"))


@query(f"SELECT c, last, count(*) AS times FROM (SELECT c, items[-1] AS last, items, unnest(range(2, len(items))) AS i FROM {PRIORITIES} WHERE items[1] = '5-LOW') WHERE items[i] = last GROUP BY c, last")
def sequence_ends(spark, d):
    """How often the last priority has come before, but for the first place, of customers that began with a low one."""
    found = priorities(spark, d).select("c", F.inline(sequences.matches(F.col("items"), ["5-LOW", "...", "?last", "...", "?last"])))
    return found.groupBy("c", "last").agg(F.count("*").alias("times"))


#: Texts with each function in more than one form; a customer's segment fills the gap.
TEXTS = (
    "MATCH (n:?) WHERE size(n.name) > 3 AND n.seen IS NOT NULL RETURN properties(n), keys(n)",
    "MATCH (n)-[r]->(m) WHERE type(r) = '?' AND date(n.born) < date('1990-01-01') RETURN labels(m), id(m)",
    "MATCH (n:?) WHERE n.name STARTS WITH 'size(a.b)' RETURN size(collect(n)) AS many, toLower(n.name)",
    "MATCH p = shortestPath((a:?)-[*]-(b)) RETURN length(p), n.id (x)",
    "MATCH (n:?) UNWIND n.tags AS t RETURN split(t, 'keys('), [x IN n.tags | x] LIMIT 2",
    "MATCH (n:?) RETURN n",
)
_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS)
_BARE = rf"(SELECT c_custkey AS id, regexp_replace(replace(list_extract([{_LIST}], (1 + c_custkey % {len(TEXTS)})::INT), '?', c_mktsegment), '''[^'']*''', '''''', 'g') AS t FROM customer)"
_PATTERNS = {name: pattern.replace(r"(?<![\w.])", r"(?:^|[^\w.])") for _, name, pattern in questions.FUNCTIONS}
_FOUND = ", ".join(f"CASE WHEN regexp_matches({'b' if name in ('size(list)', 'length(path)', 'date() or datetime() without a value') else 't'}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i') THEN '{name}' END" for name, pattern in _PATTERNS.items())
# What an earlier pattern has taken is gone before the later one looks.
_LEFT = "regexp_replace(regexp_replace(t, '(size|length)\\s*\\(\\s*\\w+\\.\\w+\\s*\\)', '', 'gi'), '(date|datetime)\\s*\\(\\s*(''''|\\{)', '', 'gi')"


@query(f"SELECT id, list_sort(list_filter([{_FOUND}], lambda x: x IS NOT NULL)) AS functions FROM (SELECT id, t, {_LEFT} AS b FROM {_BARE})")
def cypher_functions(spark, d):
    """The functions in each text, by one scan for all of them."""
    template = F.element_at(F.array(*map(F.lit, TEXTS)), (F.lit(1) + F.col("c_custkey") % len(TEXTS)).cast("int"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.replace(template, F.lit("?"), F.col("c_mktsegment")).alias("t"))
    return own.select("id", questions.functions(cypher.without_literals(F.col("t"))).alias("functions"))


def asked(spark, d):
    """id, tags: a graph question for each customer; its nodes and edges follow from the customer's numbers."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    function = F.element_at(F.array(*map(F.lit, ("none", "count", "argmax", "argmin", ">", "<="))), (k % 6 + 1).cast("int"))
    literal = k % 4 < 2
    node = lambda nid, kind, f: F.struct(F.lit(nid).alias("nid"), F.lit(kind).alias("node_type"), f.alias("function"))
    none = F.lit("none")
    nodes = F.concat(F.array(node(0, "class", none)), F.when(n % 2 == 0, F.array(node(1, "entity", none))).otherwise(F.slice(F.array(node(1, "entity", none)), 1, 0)), F.when(literal, F.array(node(2, "literal", function))).otherwise(F.slice(F.array(node(2, "literal", function)), 1, 0)))
    edges = F.transform(F.filter(nodes, lambda x: x["nid"] > 0), lambda x: F.struct(F.lit(0).alias("start"), x["nid"].alias("end")))
    expression = F.when(literal, F.element_at(F.array(F.lit("2^^XMLSchema#float"), F.lit("1999^^XMLSchema#gYear"), F.lit("x")), (k % 3 + 1).cast("int"))).otherwise("")
    return table(spark, d, "customer").select(k.alias("id"), questions.question_tags(function, expression, nodes, edges).alias("tags"))


_ASKED = """(SELECT c_custkey AS id, list_sort(list_distinct(list_filter(list_concat(['ENTITY', 'ATTRIBUTE (anywhere)', 'One hypothesis'],
  CASE f WHEN 1 THEN ['Target COUNT', 'COUNT', 'LIST (any kind)', 'CREATE_LIST'] ELSE ['Target ENTITY_ID'] END,
  CASE f WHEN 2 THEN ['order_by', 'limit', 'DESC', 'MAX', 'LIST (any kind)', 'CREATE_LIST', 'SCALAR_AGGREGATE'] WHEN 3 THEN ['order_by', 'limit', 'ASC', 'MIN', 'LIST (any kind)', 'CREATE_LIST', 'SCALAR_AGGREGATE'] WHEN 4 THEN ['>', 'COMPARISON'] WHEN 5 THEN ['<=', 'COMPARISON'] ELSE [] END,
  [CASE WHEN e THEN 'relationships' END, CASE WHEN e THEN 'Relationship with a role' END, CASE WHEN e THEN 'STRING value' END, CASE WHEN e OR l THEN 'constraint' END, CASE WHEN (e OR l) AND f IN (1, 2, 3) THEN 'LIST.filter' END,
   CASE WHEN e AND l THEN 'AND' END, CASE WHEN e OR (l AND f = 0) THEN '=' END, CASE WHEN e OR (l AND f = 0) THEN 'COMPARISON' END, CASE WHEN lit AND k % 3 = 0 THEN 'NUMBER value' END, CASE WHEN lit AND k % 3 = 1 THEN 'DATE_TIME' END]), lambda x: x IS NOT NULL))) AS tags
  FROM (SELECT c_custkey, c_custkey AS k, c_custkey % 6 AS f, c_nationkey % 2 = 0 AS e, c_custkey % 4 < 2 AS lit, c_custkey % 4 < 2 AND c_custkey % 6 NOT IN (2, 3) AS l FROM customer))"""


@query(f"SELECT id, tags FROM {_ASKED}")
def question_elements(spark, d):
    return asked(spark, d)


_X, _Y = f"(SELECT {cypher_queries.TAGS} AS tags FROM {cypher_queries.TEXTS})", f"(SELECT tags FROM {_ASKED})"


@query(
    f"""WITH x AS (SELECT element, count(*) AS n FROM (SELECT unnest(tags) AS element FROM {_X}) GROUP BY element), y AS (SELECT element, count(*) AS n FROM (SELECT unnest(tags) AS element FROM {_Y}) GROUP BY element),
e AS (SELECT element FROM x UNION SELECT element FROM y UNION SELECT unnest(['PATH', 'limit', 'skip']))
SELECT element, coalesce(x.n, 0) AS n_x, coalesce(y.n, 0) AS n_y, round_even(100.0 * coalesce(x.n, 0) / (SELECT count(*) FROM customer), 1)::DOUBLE AS share_x, round_even(100.0 * coalesce(y.n, 0) / (SELECT count(*) FROM customer), 1)::DOUBLE AS share_y,
  CASE WHEN x.n > 0 AND y.n > 0 THEN 'both' WHEN x.n > 0 THEN 'x_only' WHEN y.n > 0 THEN 'y_only' ELSE 'neither' END AS side FROM e LEFT JOIN x USING (element) LEFT JOIN y USING (element)"""
)
def element_populations(spark, d):
    """Cypher texts and graph questions side by side. Equal texts are tagged once, and equal tags counted before they are taken apart."""
    x = cypher_queries.texts(spark, d).groupBy("t").agg(F.count("*").alias("n")).select(cypher.constructs(F.col("t")).alias("tags"), "n")
    y = asked(spark, d).groupBy("tags").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("PATH",), ("limit",), ("skip",)], "element string")
    return questions.populations(x, y, every, rows="n")


def json_runs(spark, d):
    """source, run, position, normal: an answer in fenced JSON for each document, with its keys and spaces in either order, some broken, some with 1.0 for 1."""
    k, n = F.col("doc_id"), F.col("n_chars") % 3
    number = F.when(k % 5 == 0, F.format_string("%d.0", n)).otherwise(F.format_string("%d", n))
    pair = [F.concat(F.lit('"b": "'), F.col("lang"), F.lit('"')), F.concat(F.lit('"a":['), number, F.lit("]"))]
    body = F.when(k % 2 == 0, F.concat(F.lit("{"), pair[0], F.lit(", "), pair[1], F.lit("}"))).otherwise(F.concat(F.lit("{\n  "), pair[1], F.lit(","), pair[0], F.lit(" }")))
    body = F.when(k % 7 == 0, F.concat(F.lit('{"a":  '), F.col("lang"))).otherwise(body)
    said = F.concat(F.lit("First:\n```json\n{}\n```\nBetter:\n```json\n"), body, F.lit("\n```"))
    normal = text.normal_form(F.lit("semgir_apo"), said)
    return table(spark, d, "documents").filter("lang IS NOT NULL AND source IS NOT NULL").select("source", k.alias("run"), k.alias("position"), normal.alias("normal"))


_JSON = """(SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN '{"a": ' || lang ELSE '{"a":[' || (n_chars % 3) || CASE WHEN doc_id % 5 = 0 THEN '.0' ELSE '' END || '],"b":"' || lang || '"}' END AS answer FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"""
_GROUPS = f"(SELECT source, answer, count(*) AS group_size, min(doc_id) AS first, list_transform(list_sort(list(doc_id)), lambda x: x::VARCHAR) AS runs FROM {_JSON} GROUP BY source, answer)"


@query(f"SELECT source, answer, group_size, first, runs, row_number() OVER (PARTITION BY source ORDER BY group_size DESC, first)::INTEGER AS place FROM {_GROUPS}")
def json_answer_groups(spark, d):
    """Answers that are one JSON value, whatever their spaces and keys' order; 1 and 1.0 differ, as do broken ones by their text."""
    found = runs.grouped_runs(json_runs(spark, d), ["source"], F.col("normal"))
    return found.select("source", "answer", "group_size", F.col("first.position").alias("first"), "runs", "place")


@query(
    f"""WITH g AS {_GROUPS} SELECT g.source, g.answer, g.group_size, CASE WHEN o.answer IS NOT NULL AND g.group_size <= 2 AND (o.group_size > 2 OR o.first < g.first) THEN o.answer ELSE g.answer END AS "into"
FROM g LEFT JOIN g o ON g.source = o.source AND g.answer LIKE '%.0]%' AND o.answer = replace(g.answer, '.0]', ']')"""
)
def json_merged_groups(spark, d):
    """Groups of one or two runs whose answer only writes 1.0 for 1 go into the group that has 1."""
    groups = runs.grouped_runs(json_runs(spark, d), ["source"], F.col("normal"))
    same = groups.filter(F.contains("answer", F.lit(".0]"))).select("source", "answer", F.replace("answer", F.lit(".0]"), F.lit("]")).alias("other"))
    return runs.merged_groups(groups, same, ["source"], 2).select("source", "answer", "group_size", "into")


#: Texts and their element tags, worked out by hand; a customer's segment stands in a literal of each.
TAGGED = {
    "MATCH (p:Person)-[r:KNOWS {since: 2001}]->(q) WHERE q.name = '?' AND q.age >= 30 RETURN p.name, r.since ORDER BY p.name DESC, q.age LIMIT 5": ["=", ">=", "AND", "ASC", "ATTRIBUTE (anywhere)", "COMPARISON", "DESC", "ENTITY", "NUMBER value", "One hypothesis", "Relationship attribute", "Relationship with a role", "STRING value", "Several targets", "Target ATTRIBUTE", "Target relationship attribute", "constraint", "limit", "order_by", "relationships"],
    "MATCH p = shortestPath((a:City {name: '?'})-[*1..4]-(b)) RETURN p, length(p)": ["<=", "=", ">=", "AND", "ATTRIBUTE (anywhere)", "COMPARISON", "COUNT", "ENTITY", "LIST (any kind)", "NUMBER value", "One hypothesis", "PATH", "PATH with an empty role list", "RELATIONS", "STRING value", "Several targets", "Target PATH_ID", "constraint"],
    "MATCH (a) WHERE NOT (a)-[:FINED]->() AND a.x STARTS WITH '?' RETURN collect(a.name) AS names UNION MATCH (b) RETURN sum(b.v) AS names": ["AND", "ATTRIBUTE (anywhere)", "COMPARISON", "CREATE_LIST", "ENTITY", "LIST (any kind)", "LIST.filter", "MATCHES_REGEX", "NOT", "One hypothesis", "RELATIONSHIP_ID as a condition", "Relationship with a role", "SCALAR_AGGREGATE", "STARTS WITH or ENDS WITH", "STRING value", "SUM", "Target LIST", "Target SCALAR_AGGREGATE", "UNION", "constraint", "relationships"],
    "MATCH (m:Movie)<-[:ACTED_IN]-(a) WITH m, count(DISTINCT a) AS actors WHERE actors > 3 RETURN m.title, actors, 'LIMIT ?'": [">", "ATTRIBUTE (anywhere)", "COMPARISON", "COUNT", "CREATE_LIST", "ENTITY", "LIST (any kind)", "LIST.distinct", "NUMBER value", "One hypothesis", "Relationship with a role", "STRING value", "Several targets", "Target ATTRIBUTE", "Target COUNT", "constraint", "relationships"],
}
_CASES = " ".join(f"WHEN {i} THEN [{', '.join(chr(39) + t + chr(39) for t in tags)}]" for i, tags in enumerate(TAGGED.values()))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(CASE c_custkey % {len(TAGGED)} {_CASES} END) AS tag FROM customer) GROUP BY tag")
def cypher_elements(spark, d):
    """How many texts have each element tag. Equal texts are tagged once."""
    template = F.element_at(F.array(*map(F.lit, TAGGED)), (F.lit(1) + F.col("c_custkey") % len(TAGGED)).cast("int"))
    own = table(spark, d, "customer").select(F.replace(template, F.lit("?"), F.col("c_mktsegment")).alias("t"))
    once = own.groupBy("t").agg(F.count("*").alias("n"))
    return once.select(F.explode(elements.elements(F.col("t"))).alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))
