"""What query documents are made of: their parts as rows, structural tags, hops from the target, and violations of the format.

Documents are JSON texts of unknown depth. They are taken apart level by level, all documents at once: each round opens the objects and arrays that the
round before found. Everything after that is grouping and joining of these rows by document. Equal texts are taken apart once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.plans.lineage import cut

#: The fields of a query.
FIELDS = ("target", "entities", "relationships", "paths", "constraint", "distinct", "order_by", "limit", "skip")
#: The tags in their order, and that of a document without any.
TAGS = ("multi_hypothesis", "relationships", "multi_hop", "relationship_attributes", "paths", "aggregations", "quantifiers", "modifiers", "complex_constraints", "negation", "string_matching")
PLAIN = "simple_structures"
#: Fields that must be there in every part of a list of this name.
REQUIRED = {"entities": ("id", "type"), "relationships": ("id", "role", "from", "to"), "paths": ("id", "roles")}
#: Names that an operator, a quantifier, an aggregate and a direction may have.
NAMES = {
    "operator": ("=", "!=", ">", "<", "<=", ">=", "CONTAINS", "MATCHES_REGEX"),
    "quantifier_kind": ("ALL", "EXISTS", "NONE"),
    "aggregate_kind": ("SUM", "MIN", "MAX", "AVG"),
    "direction": ("ASC", "DESC"),
}


def _kind(value: Column) -> Column:
    """O, A, N or S for objects, arrays, numbers and everything else."""
    head = F.substring(F.schema_of_variant(value), 1, 5)
    return F.when(head == "OBJEC", "O").when(head == "ARRAY", "A").when(head.isin("BIGIN", "DECIM", "DOUBL"), "N").otherwise("S")


def parts(docs: DataFrame) -> DataFrame:
    """doc, node, above, key, key_above, key_top, kind, text, n: each value inside the documents ``docs(doc, text)``, the whole one included.

    ``node`` names a value by its way from the root, ``above`` the one that holds it. ``key`` is the field that it stands in, null in an array; ``key_above`` and
    ``key_top`` are those of the two values around it. ``text`` is a plain value as text, ``n`` the number of values inside. Text that isn't JSON, and null, have no rows;
    an object in which a field stands twice isn't read as JSON. Each round is written to the shared folder; there are as many as the deepest document has levels.
    """
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    root = docs.select("doc", F.try_parse_json("text").alias("value")).filter("value IS NOT NULL")
    level = root.select("doc", F.lit("$").alias("node"), none.alias("above"), none.alias("key"), none.alias("key_above"), none.alias("key_top"), "value")
    found = []
    while True:
        level = cut(level.withColumn("kind", _kind(F.col("value"))).withColumn("json", F.to_json("value")).drop("value"), "document-level")
        found.append(level)
        if level.filter("kind IN ('O', 'A')").isEmpty():
            break
        open_ = level.filter("kind IN ('O', 'A')").select("doc", F.col("node").alias("above"), F.col("key").alias("key_above"), F.col("key_above").alias("key_top"), F.parse_json("json").alias("whole"))
        inner = open_.lateralJoin(spark.tvf.variant_explode(F.col("whole").outer()))
        node = F.concat("above", F.lit("/"), F.coalesce("key", F.lit("")), F.lit("#"), F.col("pos").cast("string"))
        level = inner.select("doc", node.alias("node"), "above", "key", "key_above", "key_top", "value")
    every = reduce(DataFrame.unionByName, found)
    sizes = every.filter("above IS NOT NULL").groupBy("doc", F.col("above").alias("node")).agg(F.count("*").alias("n"))
    plain = F.when(F.col("kind").isin("N", "S"), F.try_variant_get(F.try_parse_json("json"), "$", "string")).alias("text")
    every = every.select("doc", "node", "above", "key", "key_above", "key_top", "kind", plain)
    return every.join(sizes, ["doc", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def hops(found: DataFrame) -> DataFrame:
    """doc, query, hops: for each object with a target, how many relationships its farthest entity is from the nearest target.

    A relationship that is a target starts at both of its ends. Entities that no target reaches don't count. The frontiers of all documents move together,
    one join a round; what a round adds is written, and nothing more is done when no frontier moved.
    """
    queries = found.filter("key = 'target'").select("doc", F.col("above").alias("query")).distinct()
    targets = found.filter("key IS NULL AND key_above = 'target' AND kind IN ('N', 'S')").select("doc", F.col("above").alias("node"), "text")
    holder = found.filter("key = 'target'").select("doc", "node", F.col("above").alias("query"))
    targets = targets.join(holder, ["doc", "node"]).select("doc", "query", F.col("text").alias("at"))
    # One row for each relationship: its fields by the object that holds them, and that object's list by the query.
    fields = found.filter("key IN ('id', 'from', 'to') AND key_top = 'relationships' AND key_above IS NULL")
    fields = fields.groupBy("doc", F.col("above").alias("node")).agg(*[F.max(F.when(F.col("key") == k, F.col("text"))).alias(k) for k in ("id", "from", "to")])
    inside = found.filter("key IS NULL AND key_above = 'relationships' AND kind = 'O'").select("doc", "node", F.col("above").alias("list"))
    lists = found.filter("key = 'relationships'").select("doc", F.col("node").alias("list"), F.col("above").alias("query"))
    edges = cut(fields.join(inside, ["doc", "node"]).join(lists, ["doc", "list"]).select("doc", "query", "id", "from", "to"), "document-edges")
    ends = edges.join(targets.withColumnRenamed("at", "id"), ["doc", "query", "id"], "left_semi")
    ends = ends.select("doc", "query", F.explode(F.array("from", "to")).alias("at"))
    level = cut(targets.unionByName(ends).filter("at IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "document-hops")
    steps = edges.select("doc", "query", F.col("from").alias("at"), F.col("to").alias("next")).unionByName(edges.select("doc", "query", F.col("to").alias("at"), F.col("from").alias("next")))
    known, hop = [level], 0
    while not level.isEmpty():
        hop += 1
        new = level.join(steps, ["doc", "query", "at"]).filter("next IS NOT NULL").select("doc", "query", F.col("next").alias("at")).distinct()
        new = new.join(reduce(DataFrame.unionByName, known), ["doc", "query", "at"], "left_anti")
        level = cut(new.withColumn("hops", F.lit(hop)), "document-hops")
        known.append(level)
    far = reduce(DataFrame.unionByName, known).groupBy("doc", "query").agg(F.max("hops").alias("hops"))
    return queries.join(far, ["doc", "query"], "left").withColumn("hops", F.coalesce("hops", F.lit(0)))


def _texts(docs: DataFrame) -> DataFrame:
    """doc, text: each different text of ``docs`` under a number of its own; null counts as empty. Written, as another run could number them otherwise."""
    return cut(docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select(F.monotonically_increasing_id().alias("doc"), "text"), "document-texts")


def _owners(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """_owner, doc: each document with the number of its text."""
    return docs.select(F.col("doc").alias("_owner"), F.coalesce("text", F.lit("")).alias("text")).join(texts, "text").select("_owner", "doc")


def tags(docs: DataFrame) -> DataFrame:
    """doc, tags, hops for each row of ``docs(doc, text)``, with different ``doc``: what a document's structure uses, in the order of TAGS, and its largest hops.

    A document that is empty or no JSON, or uses nothing of this, has the tag PLAIN alone.
    """
    texts = _texts(docs)
    return _owners(docs, texts).join(cut(_tags(texts), "document-tags"), "doc").select(F.col("_owner").alias("doc"), "tags", "hops")


def _tags(docs: DataFrame) -> DataFrame:
    found = cut(parts(docs), "document-parts")
    has = lambda *keys: F.col("key").isin(*keys)
    said = lambda key, *names: (F.col("key") == key) & F.col("text").isin(*names)
    far = hops(found).groupBy("doc").agg(F.max("hops").alias("hops"))
    own = F.when((F.col("key") == "id") & F.col("key_above").isNull() & (F.col("key_top") == "relationships"), F.col("text"))
    tests = {
        "multi_hypothesis": (F.col("node") == "$") & (F.col("kind") == "A") & (F.col("n") > 1),
        "relationships": own.isNotNull(),
        "paths": has("paths") & (F.col("n") > 0),
        "aggregations": has("aggregate_kind", "count"),
        "quantifiers": has("quantifier_kind"),
        "modifiers": has("order_by", "limit", "skip"),
        "complex_constraints": has("and_conditions", "or_conditions"),
        "negation": has("not_condition") | said("operator", "!=") | said("quantifier_kind", "NONE"),
        "string_matching": said("operator", "CONTAINS", "MATCHES_REGEX"),
    }
    flags = [F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in tests.items()]
    ids, used = F.collect_set(own).alias("_ids"), F.collect_set(F.when(has("of"), F.col("text"))).alias("_of")
    each = found.groupBy("doc").agg(*flags, ids, used).withColumn("relationship_attributes", F.arrays_overlap("_ids", "_of"))
    each = docs.select("doc").join(each, "doc", "left").join(far, "doc", "left").withColumn("multi_hop", F.col("hops") >= 2)
    named = F.array_compact(F.array(*[F.when(F.col(t), t) for t in TAGS]))
    return each.select("doc", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(PLAIN))).alias("tags"), F.coalesce("hops", F.lit(0)).alias("hops"))


def violations(docs: DataFrame) -> DataFrame:
    """doc, query, problem, detail: a row for each fault of a document in ``docs(doc, text)``; ``query`` names the object it is in, null for the whole document.

    Faults: ``not flat`` (no array of objects, or no JSON), ``unknown field``, ``missing field`` (of a query or of a declared part), ``declared twice``, ``not declared``
    (an id that is used, but not declared in the same query), ``unknown name`` (of an operator, quantifier, aggregate or direction), ``no number`` (a limit or skip).
    """
    texts = _texts(docs)
    return _owners(docs, texts).join(cut(_violations(texts), "document-faults"), "doc").select(F.col("_owner").alias("doc"), "query", "problem", "detail")


def _violations(docs: DataFrame) -> DataFrame:
    found = cut(parts(docs), "document-parts")
    none = F.lit(None).cast("string")
    roots = found.filter("node = '$'").select("doc", F.col("kind").alias("root"))
    stray = found.filter("above = '$' AND kind <> 'O'").select("doc").distinct().withColumn("stray", F.lit(True))
    flat = docs.select("doc").join(roots, "doc", "left").join(stray, "doc", "left").withColumn("flat", F.coalesce((F.col("root") == "A") & F.col("stray").isNull(), F.lit(False)))
    out = [flat.filter("NOT flat").select("doc", none.alias("query"), F.lit("not flat").alias("problem"), none.alias("detail"))]
    found = found.join(flat.filter("flat").select("doc"), "doc", "left_semi")
    inside = found.filter("node <> '$'").withColumn("query", F.regexp_extract("node", r"^(\$/#\d+)", 1))
    fault = lambda df, problem, detail: df.select("doc", "query", F.lit(problem).alias("problem"), detail.alias("detail"))
    tops = inside.filter("above = '$'").select("doc", "query")
    fields = inside.filter(F.col("above") == F.col("query"))
    out.append(fault(fields.filter(~F.col("key").isin(*FIELDS)), "unknown field", F.col("key")))
    named = lambda df, keys: df.withColumn("field", F.explode(F.array(*[F.lit(k) for k in keys])))
    missing = named(tops, ("target", "entities")).join(fields.select("doc", "query", F.col("key").alias("field")), ["doc", "query", "field"], "left_anti")
    out.append(fault(missing, "missing field", F.col("field")))
    items = inside.filter(F.col("key").isNull() & F.col("key_above").isin(*REQUIRED) & (F.col("kind") == "O"))
    wanted = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    there = inside.select("doc", F.col("above").alias("node"), F.col("key").alias("field")).filter("field IS NOT NULL")
    lacking = items.withColumn("field", F.explode(F.element_at(wanted, F.col("key_above")))).join(there, ["doc", "node", "field"], "left_anti")
    out.append(fault(lacking, "missing field", F.concat_ws(".", "key_above", "field")))
    # Ids: of entities, relationships and paths, and those that lists of a path's parts introduce.
    fresh = F.col("key").isin("node_id", "rel_id") | ((F.col("key") == "id") & F.col("key_above").isNull() & F.col("key_top").isin(*REQUIRED))
    ids = inside.filter(fresh).select("doc", "query", F.col("text").alias("id"))
    out.append(fault(ids.groupBy("doc", "query", "id").agg(F.count("*").alias("n")).filter("n > 1"), "declared twice", F.col("id")))
    bare = F.col("key").isNull() & (F.col("kind") == "S") & F.col("key_above").isin("target", "and_conditions", "or_conditions")
    refers = F.col("key").isin("of", "from", "to", "start", "end", "list_elements", "nodes_of", "rels_of") | (F.col("key").isin("condition", "not_condition", "constraint", "filter") & (F.col("kind") == "S"))
    used = inside.filter((bare | refers) & F.col("text").isNotNull()).select("doc", "query", F.col("text").alias("id")).distinct()
    out.append(fault(used.join(ids, ["doc", "query", "id"], "left_anti"), "not declared", F.col("id")))
    for key, names in NAMES.items():
        out.append(fault(inside.filter((F.col("key") == key) & ~F.coalesce(F.col("text").isin(*names), F.lit(False))), "unknown name", F.concat(F.lit(f"{key} "), F.coalesce("text", F.lit("null")))))
    out.append(fault(inside.filter(F.col("key").isin("limit", "skip") & (F.col("kind") != "N")), "no number", F.concat_ws(" ", "key", "text")))
    return reduce(DataFrame.unionByName, out)


def tag_counts(tagged: DataFrame, least: int = 8) -> DataFrame:
    """tag, n, below: how many documents have each tag, and whether these are fewer than ``least``."""
    counts = tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.withColumn("below", F.col("n") < least)
