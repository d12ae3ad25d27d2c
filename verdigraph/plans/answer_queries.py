"""Queries over answers, verdicts and metrics.

Documents stand for recorded answers (lang for grammar, source for model, doc_id for run), labels for verdicts, events for attempts (a purchase is a correct one).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigraph.functions import stats, text
from verdigraph.operators import answers, similarity
from verdigraph.plans.skew import running_total
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


NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
QNORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
KEY = f"substr(sha1(lang || '|' || source || '|' || {NORM}), 1, 16)"


def docs(spark, d):
    return table(spark, d, "documents")


def attempts(spark, d):
    """user_id, n, c"""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))


ATTEMPTS = "(SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id)"


@query(f"SELECT lang, answer, count(*) AS size, min(doc_id) AS first_pos, list_sort(list(doc_id)) AS runs FROM (SELECT *, sha1({NORM}) AS answer FROM documents) GROUP BY lang, answer")
def answer_groups(spark, d):
    return answers.group_answers(docs(spark, d).select("lang", "text", "doc_id"), ["lang"], F.sha1(text.collapse(F.col("text"))), "doc_id")


@query(f"SELECT doc_id, {KEY} AS output_key FROM documents")
def answer_keys(spark, d):
    return docs(spark, d).select("doc_id", text.output_key(F.col("lang"), F.col("source"), text.collapse(F.col("text"))).alias("output_key"))


@query(f"SELECT output_key, sum(size)::BIGINT AS runs, arg_max(source, (size, -first_pos)) AS representative, list_sort(list(DISTINCT source)) AS models FROM (SELECT sha1({NORM}) AS output_key, source, count(*) AS size, min(doc_id) AS first_pos FROM documents GROUP BY ALL) GROUP BY output_key")
def answer_pool(spark, d):
    each = docs(spark, d).groupBy(F.sha1(text.collapse(F.col("text"))).alias("output_key"), "source").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_pos"))
    return each.groupBy("output_key").agg(F.sum("size").alias("runs"), F.max_by("source", F.struct(F.col("size"), -F.col("first_pos"))).alias("representative"), F.array_sort(F.collect_set("source")).alias("models"))


@query(f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY {QNORM} ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents) WHERE r = 1")
def question_dedupe(spark, d):
    df = docs(spark, d).select("doc_id", "lang", "source", F.sha1(text.question_form(F.col("text"))).alias("q"))
    return answers.one_per(df, F.col("q"), [answers.seeded(7, "doc_id"), F.col("doc_id")]).drop("q")


@query(f"SELECT doc_id FROM documents WHERE left({QNORM}, 30) NOT IN (SELECT left({QNORM}, 30) FROM benchmark)")
def template_anti_join(spark, d):
    head = F.left(text.question_form(F.col("text")), F.lit(30))
    return answers.anti_join(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"), head, head).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {QNORM} NOT IN (SELECT {QNORM} FROM benchmark)")
def question_anti_join(spark, d):
    form = F.sha1(text.question_form(F.col("text")))
    return answers.anti_join(docs(spark, d).select("doc_id", "text"), table(spark, d, "benchmark"), form, form).select("doc_id")


@query(
    """WITH n AS (SELECT count(*) AS total FROM documents), k AS (SELECT doc_id, lang, source, md5('3|' || doc_id) AS o FROM documents),
r AS (SELECT k.*, row_number() OVER (PARTITION BY lang, source ORDER BY o, doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS size FROM k)
SELECT doc_id, lang, source FROM (SELECT r.*, row_number() OVER (ORDER BY (r <= greatest(1, least(size, round_even(size * 200 / total::DOUBLE, 0)))) DESC, o, doc_id) AS p, total FROM r, n) WHERE p <= 200 OR total <= 200"""
)
def stratified_sample(spark, d):
    return answers.stratified_sample(docs(spark, d).select("doc_id", "lang", "source"), ["lang", "source"], 200, 3, "doc_id")


@query("SELECT lang, source, count(*) AS runs, round(avg(n_chars), 4) AS mean_chars, round(stddev_samp(n_chars), 4) AS std_chars FROM documents GROUP BY lang, source")
def run_summary(spark, d):
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("runs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.stddev_samp("n_chars"), 4).alias("std_chars"))


@query("SELECT lang, count(DISTINCT source) AS queries, count(*) AS runs, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang")
def overall_summary(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.countDistinct("source").alias("queries"), F.count("*").alias("runs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT d.doc_id, lang, quality, toxic, quality <> 1 - toxic AS discrepancy FROM documents d JOIN labels l USING (doc_id)")
def verdict_join(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("discrepancy", F.col("quality") != 1 - F.col("toxic"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce(quality, 0) = 1 AS correct, CASE WHEN quality IS NULL THEN 'no ground truth' ELSE '' END AS rationale FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_truth(spark, d):
    joined = docs(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("correct"), F.when(F.col("quality").isNull(), "no ground truth").otherwise("").alias("rationale"))


@query("SELECT user_id, event_type, n, round_even(100.0 * n / sum(n) OVER (PARTITION BY user_id), 2) AS percentage FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL)")
def error_distribution(spark, d):
    counts = table(spark, d, "events").filter("event_type <> 'purchase'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.bround(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 2))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY user_id")
def error_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "error", "click", "signup"]).count().na.fill(0)


@query(f"SELECT user_id, n, c, c / n::DOUBLE AS success_rate FROM {ATTEMPTS}")
def success_rate(spark, d):
    return attempts(spark, d).withColumn("success_rate", F.col("c") / F.col("n"))


PASS = "CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1.0 - list_reduce(list_transform(range({k}), lambda i: (n - c - i) / (n - i)::DOUBLE), lambda a, b: a * b) END"


@query("SELECT user_id, " + ", ".join(f"round({PASS.format(k=k)}, 9) AS pass_{k}" for k in (1, 3, 5, 10, 30)) + f" FROM {ATTEMPTS}")
def pass_at_k(spark, d):
    return attempts(spark, d).select("user_id", *[F.round(stats.pass_at_k(F.col("n"), F.col("c"), k), 9).alias(f"pass_{k}") for k in (1, 3, 5, 10, 30)])


@query("SELECT user_id, " + ", ".join(f"round(pow(c / n::DOUBLE, {k}), 9) AS power_{k}" for k in (1, 3, 5, 10, 30)) + f" FROM {ATTEMPTS}")
def pass_power_k(spark, d):
    return attempts(spark, d).select("user_id", *[F.round(stats.pass_power_k(F.col("n"), F.col("c"), k), 9).alias(f"power_{k}") for k in (1, 3, 5, 10, 30)])


@query("SELECT lang, round(coalesce(sum(h * size) FILTER (correct) / nullif(sum(size) * 2, 0)::DOUBLE, 0), 9) AS coverage FROM (SELECT lang, quality = 1 AS correct, count(*) AS size, 1 + toxic AS h FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality, toxic) GROUP BY lang")
def hypothesis_coverage(spark, d):
    j = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("size"))
    covered = F.sum(F.when(F.col("quality") == 1, (F.col("toxic") + 1) * F.col("size")))
    return j.groupBy("lang").agg(F.round(F.coalesce(covered / F.nullif(F.sum("size") * 2, F.lit(0)), F.lit(0.0)), 9).alias("coverage"))


@query("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS runs, coalesce(sum(quality), 0)::BIGINT AS correct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def eval_rollup(spark, d):
    j = docs(spark, d).select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("runs"), F.coalesce(F.sum("quality"), F.lit(0)).alias("correct"))


@query("SELECT lang, printf('%.4f', round_even(avg(r), 4)) AS avg_rate FROM (SELECT lang, source, avg(quality) AS r FROM documents JOIN labels USING (doc_id) GROUP BY lang, source) GROUP BY lang")
def macro_summary(spark, d):
    j = docs(spark, d).select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "source").agg(F.avg("quality").alias("r"))
    return j.groupBy("lang").agg(F.format_string("%.4f", F.bround(F.avg("r"), 4)).alias("avg_rate"))


PAIRS = "(SELECT source, avg(quality) FILTER (lang = 'en') AS a, avg(quality) FILTER (lang <> 'en') AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)"


def paired(spark, d):
    j = docs(spark, d).select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(F.avg(F.when(F.col("lang") == "en", F.col("quality"))).alias("a"), F.avg(F.when(F.col("lang") != "en", F.col("quality"))).alias("b"))


@query(f"SELECT b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c)::DOUBLE END, 9) AS chi2 FROM (SELECT count(*) FILTER (a >= 0.9 AND b < 0.9) AS b, count(*) FILTER (a < 0.9 AND b >= 0.9) AS c FROM {PAIRS})")
def mcnemar_counts(spark, d):
    counts = paired(spark, d).agg(F.count_if((F.col("a") >= 0.9) & (F.col("b") < 0.9)).alias("b"), F.count_if((F.col("a") < 0.9) & (F.col("b") >= 0.9)).alias("c"))
    return counts.withColumn("chi2", F.round(stats.mcnemar_statistic(F.col("b"), F.col("c")), 9))


@query()
def mcnemar_test(spark, d):
    return mcnemar_counts(spark, d).withColumn("p", stats.chi_square_tail("chi2"))


@query(f"WITH x AS (SELECT round(a - b, 9) AS diff FROM {PAIRS} WHERE a IS NOT NULL AND b IS NOT NULL), r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS r FROM x WHERE diff <> 0) SELECT count(*) AS n, coalesce(least(coalesce(sum(r) FILTER (diff > 0), 0), coalesce(sum(r) FILTER (diff < 0), 0)), 0)::DOUBLE AS w FROM r")
def wilcoxon_w(spark, d):
    x = paired(spark, d).dropna().select(F.round(F.col("a") - F.col("b"), 9).alias("diff")).filter("diff <> 0").withColumn("size", F.abs("diff"))
    # Ranks by the distinct sizes, which are at most 1, counted by thousandths first.
    tied = x.groupBy("size").agg(F.count("*").alias("t"), F.count_if(F.col("diff") > 0).alias("up"))
    counted = running_total(tied.withColumn("_all", F.lit(1)).withColumn("_part", F.floor(F.col("size") * 1000)), "_all", "_part", [F.col("size")], "t", "_before")
    ranks = counted.withColumn("r", F.col("_before") + (F.col("t") + 1) / 2)
    return ranks.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.least(F.sum(F.col("r") * F.col("up")), F.sum(F.col("r") * (F.col("t") - F.col("up")))), F.lit(0.0)).alias("w"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'purchase' GROUP BY ALL)) WHERE r = 1")
def majority_error(spark, d):
    return answers.most_frequent(table(spark, d, "events").filter("event_type <> 'purchase'"), ["user_id"], "event_type", "event_id")


@query(f"SELECT count(*) FILTER (a < 0.8 AND b >= 0.8) AS gained, count(*) FILTER (a >= 0.8 AND b < 0.8) AS lost, count(*) FILTER (a < 0.8 AND b >= 0.8) - count(*) FILTER (a >= 0.8 AND b < 0.8) AS net FROM {PAIRS}")
def net_change(spark, d):
    df = paired(spark, d)
    gained, lost = F.count_if((F.col("a") < 0.8) & (F.col("b") >= 0.8)), F.count_if((F.col("a") >= 0.8) & (F.col("b") < 0.8))
    return df.agg(gained.alias("gained"), lost.alias("lost"), (gained - lost).alias("net"))


WORDS = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: length(w) > 3)))"


@query(f"SELECT item_id, {WORDS} AS words FROM benchmark")
def content_words(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.content_words(F.col("text")).alias("words"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word")
def tag_counts(spark, d):
    return docs(spark, d).select(F.explode(text.content_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH t AS (SELECT item_id, unnest({WORDS}) AS tag FROM benchmark), c AS (SELECT tag, count(*) AS n FROM t GROUP BY tag) SELECT item_id, tag FROM (SELECT item_id, tag, row_number() OVER (PARTITION BY item_id ORDER BY n, tag) AS r FROM t JOIN c USING (tag)) WHERE r = 1")
def rarest_tag(spark, d):
    tags = table(spark, d, "benchmark").select("item_id", F.explode(text.content_words(F.col("text"))).alias("tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    return tags.join(counts, "tag").groupBy("item_id").agg(F.min_by("tag", F.struct("n", "tag")).alias("tag"))


@query(f"WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) AS total FROM w a JOIN w b ON a.item_id < b.item_id) SELECT a, b, round(shared / (total - shared)::DOUBLE, 9) AS jaccard FROM p WHERE shared > 0 AND shared >= 0.1 * (total - shared)")
def jaccard_pairs(spark, d):
    """Pairs that share a word, by an equi-join on words rather than all pairs."""
    words = table(spark, d, "benchmark").select("item_id", text.content_words(F.col("text")).alias("w"))
    each = words.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = each.select(F.col("item_id").alias("a"), F.col("n").alias("na"), "word"), each.select(F.col("item_id").alias("b"), F.col("n").alias("nb"), "word")
    both = a.join(b, "word").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    return both.filter("both >= 0.1 * (na + nb - both)").select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 9).alias("jaccard"))


SETS = f"""WITH s AS (SELECT doc_id, {WORDS} AS w FROM documents), k AS (SELECT w, min(doc_id) AS class_id, count(*) AS copies, row_number() OVER () AS c FROM s WHERE len(w) > 0 GROUP BY w),
e AS (SELECT c, len(w) AS n, unnest(w) AS word FROM k), p AS (SELECT a.c AS a, b.c AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS j FROM e a JOIN e b ON a.word = b.word AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n),
l AS (SELECT a, sum(copies) AS n, max(j) AS best FROM p JOIN k ON k.c = b WHERE j >= 0.8 GROUP BY a)"""


@query(f"{SETS} SELECT doc_id AS id, class_id, copies, (copies - 1 + coalesce(n, 0))::BIGINT AS links, round(best, 9) AS best FROM s JOIN k USING (w) LEFT JOIN l ON a = c")
def similar_documents(spark, d):
    """Documents whose sets of content words are at least 0.8 alike."""
    sets = docs(spark, d).select("doc_id", text.content_words(F.col("text")).alias("w"))
    return similarity.linked(sets, "doc_id", "w", 0.8).withColumn("best", F.round("best", 9))


TURNS = f"(SELECT conv_id * 1000 + turn AS id, {WORDS} AS w FROM conversations WHERE role = 'user')"


@query(f"WITH s AS {TURNS}, e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM s), b AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id, {WORDS} AS w FROM benchmark)), p AS (SELECT e.id, item_id AS match, count(*) / (e.n + b.n - count(*))::DOUBLE AS j FROM e JOIN b USING (word) GROUP BY e.id, item_id, e.n, b.n) SELECT id, match, round(j, 9) AS jaccard FROM p WHERE j >= 0.03")
def similar_items(spark, d):
    """User turns beside benchmark items that share a few content words with them."""
    turns = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.content_words(F.col("text")).alias("w"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), text.content_words(F.col("text")).alias("w"))
    return similarity.best_matches(turns, items, "id", "w", 0.03).withColumn("jaccard", F.round("jaccard", 9))


@query(f"SELECT DISTINCT lang, sha1({NORM}) AS output FROM documents WHERE sha1({NORM}) NOT IN (SELECT sha1({NORM}) FROM documents JOIN labels USING (doc_id))")
def verdict_cache_miss(spark, d):
    df = docs(spark, d).select("doc_id", "lang", F.sha1(text.collapse(F.col("text"))).alias("output"))
    judged = df.join(table(spark, d, "labels"), "doc_id", "left_semi").select("output").distinct()
    return df.select("lang", "output").distinct().join(judged, "output", "left_anti").select("lang", "output")


@query("SELECT user_id, event_type AS verdict, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def state_upsert(spark, d):
    log = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("verdict"), "value")
    return answers.latest(log, ["user_id"], ["ts", "event_id"]).select("user_id", "verdict", "value")


@query("SELECT c_custkey AS id, replace(replace(replace('m.' || c_nationkey || '12 knows m.' || c_nationkey || '1 and m.' || c_nationkey, 'm.' || c_nationkey || '12', c_name), 'm.' || c_nationkey || '1', c_mktsegment), 'm.' || c_nationkey, 'Cy') AS named FROM customer")
def friendly_replace(spark, d):
    """Ids that begin with each other, by names of the customer."""
    ids = [F.concat(F.lit("m."), F.col("c_nationkey").cast("string"), F.lit(more)) for more in ("", "12", "1")]
    said = F.concat(ids[1], F.lit(" knows "), ids[2], F.lit(" and "), ids[0])
    names = F.create_map(ids[0], F.lit("Cy"), ids[1], F.col("c_name"), ids[2], F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.replace_longest_first(said, names).alias("named"))


@query("SELECT user_id * 1000000 + event_id AS id, CASE event_id % 5 WHEN 0 THEN true WHEN 2 THEN event_type = 'click' ELSE false END AS correct, CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN '' WHEN 4 THEN event_type ELSE '' END AS error_category, event_id % 5 = 3 AS judge_failed FROM events")
def verdict_parse(spark, d):
    """A judge's words for each event: fenced, between others, broken, without a verdict, and with one that is null."""
    kind = F.col("event_type")
    said = [
        F.concat(F.lit('So: ```json\n{"correct": true, "rationale": "'), kind, F.lit('"}\n```')),
        F.concat(F.lit('I say {"correct": false, "error_category": "'), kind, F.lit('"} here')),
        F.concat(F.lit('broken "correct": "'), F.when(kind == "click", "true").otherwise("false"), F.lit('", and')),
        F.concat(F.lit("no idea about "), kind),
        F.concat(F.lit('```json\n{"correct": null, "error_category": "'), kind, F.lit('"}\n```')),
    ]
    pick = F.element_at(F.array(*said), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select((F.col("user_id") * 1_000_000 + F.col("event_id")).alias("id"), pick.alias("t"))
    return rows.withColumn("v", text.verdict_fields(F.col("t"), known_only=False)).select("id", "v.correct", "v.error_category", "v.judge_failed")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 2 THEN c_name || ' says' ELSE c_name END AS answer, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS blocks FROM customer")
def code_block_extract(spark, d):
    """The last of two fenced blocks, of one, or a text without any."""
    k, name = F.col("c_custkey"), F.col("c_name")
    two = F.concat(F.lit("```\nfirst\n``` then ```sparql\n"), name, F.lit("\n```"))
    said = F.when(k % 3 == 0, two).when(k % 3 == 1, F.concat(F.lit("So:\n```SQL  "), name, F.lit(" ```"))).otherwise(F.concat(F.lit("  "), name, F.lit(" says\n")))
    own = table(spark, d, "customer").select(k.alias("id"), said.alias("t"))
    return own.select("id", text.answer_text(F.col("t")).alias("answer"), F.size(text.fenced(F.col("t"))).alias("blocks"))


@query("SELECT lang, bool_and(quality = 1) AS done, count(*) FILTER (quality = 1) AS reviewed, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def review_progress(spark, d):
    j = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.bool_and(F.col("quality") == 1).alias("done"), F.count_if(F.col("quality") == 1).alias("reviewed"), F.count("*").alias("total"))
