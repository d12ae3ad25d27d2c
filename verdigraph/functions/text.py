"""Text normalisation and extraction as column expressions."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories a judge may name; others count as the last one.
CATEGORIES = (
    "Semantic omission", "Wrong relation", "Wrong variable binding", "Aggregation error", "Structural error", "Topology bypass", "Ambiguity/hypothesis error", "Hallucination", "Syntax/format error", "Other",
)
#: How a verdict's fields are found where it isn't JSON.
LOOSE_FIELDS = {"correct": r'(?i)"correct"\s*:\s*"?(true|false)', "error_category": r'"error_category"\s*:\s*"([^"]*)"', "rationale": r'(?s)"rationale"\s*:\s*"(.*?)"\s*,', "hypotheses_covered": r'"hypotheses_covered"\s*:\s*(\d+)'}
#: A fenced block, with KINDS for the names that its mark may have; what stands between the first and the last brace; and how an unreadable verdict's rationale begins.
FENCED, BRACES, UNREADABLE = r"(?i)```(?:KINDS)?\s*([\s\S]*?)\s*```", r"(\{[\s\S]*\})", "Unparseable judge response: "
#: The heading of a prompt's section, and the headings of ground truths in a judge's message.
SECTION = "## INSTRUCTIONS"
TRUTH_HEADINGS = {"ambrosia": "[GROUND TRUTH SQL]", "semgir": "[GROUND TRUTH JSON IR]", "text2cypher": "[GROUND TRUTH CYPHER]", "grailqa": "[GROUND TRUTH LISP]"}


def collapse(text: Column, unicode_spaces: bool = False) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+" if unicode_spaces else r"\s+", " "))


def question_form(text: Column) -> Column:
    return collapse(F.lower(text))


def output_key(grammar: Column, qid: Column, normal: Column) -> Column:
    """16 hex digits that name an answer: of the SHA-1 of grammar|qid|normal form."""
    return F.substring(F.sha1(F.concat_ws("|", grammar, qid, normal)), 1, 16)


def fenced(text: Column, kinds: str = r"\w+") -> Column:
    """The contents of all fenced blocks whose mark names one of ``kinds`` or nothing, in order."""
    return F.regexp_extract_all(text, F.lit(FENCED.replace("KINDS", kinds)), F.lit(1))


def answer_text(text: Column, language: str = r"\w+") -> Column:
    """The last fenced block, or the whole text without white space at the ends; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(F.try_element_at(fenced(text, language), F.lit(-1)), F.regexp_replace(text, r"^\s+|\s+$", ""))


def _canonical(text: str) -> str:
    try:
        out = json.dumps(json.loads(text.strip()), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        out.encode()
    except (ValueError, RecursionError):  # broken JSON, half a surrogate pair, numbers too long or nesting too deep for the parser
        return " ".join(text.split())
    return out


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; other text with white space runs as one space, its case kept. Null stays null."""

    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical, na_action="ignore")

    return F.pandas_udf(canonical, "string")(text)


def is_semgir(grammar: Column) -> Column:
    """Of SemGIR or a variant such as semgir_apo."""
    return F.lower(grammar).rlike("sem_?gir")


def normal_form(grammar: Column, response: Column) -> Column:
    """The answer in a response, by which responses are grouped: canonical JSON for SemGIR, collapsed white space for code-like grammars."""
    semgir = F.coalesce(is_semgir(grammar), F.lit(False))
    # The null of other grammars passes the helper untouched.
    return F.when(semgir, canonical_json(F.when(semgir, answer_text(response, "json")))).otherwise(collapse(answer_text(response), unicode_spaces=True))


def content_words(text: Column) -> Column:
    """The set of words of more than three characters."""
    return F.sort_array(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) > 3)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def replace_longest_first(text: Column, names: Column) -> Column:
    """Each key of the map ``names`` by its value, longer keys first, so that a key inside another does no harm."""
    entries = F.array_sort(F.map_entries(names), lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(b["key"]) - F.length(a["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)) == "true"


def padded_id(prefix: str, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def category(text: Column) -> Column:
    """The category that is meant, whatever its case; the last one if none is."""
    named = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.lower(), c)])
    return F.coalesce(F.try_element_at(named, F.lower(F.trim(F.coalesce(text, F.lit(""))))), F.lit(CATEGORIES[-1]))


def verdict_fields(text: Column, known_only: bool = True) -> Column:
    """correct, error_category, rationale, hypotheses_covered, judge_failed of a judge's answer.

    The verdict is the last JSON block that says whether the answer is correct, else the whole text, else what stands from its first to its last brace;
    line breaks inside strings are allowed. Where none can be read, the fields are looked for one by one in the last block or the text. A correct answer has
    no category, a wrong one a known one (or, if not ``known_only``, any); hypotheses are 1 if they aren't a whole number; an answer without a verdict is a judge's failure and
    is its own rationale, up to 200 characters.
    """
    schema = "correct string, error_category string, rationale string, hypotheses_covered string"
    text = F.coalesce(text, F.lit(""))
    blocks, bare = fenced(text, "json"), F.regexp_replace(text, r"^\s+|\s+$", "")
    tries = F.concat(F.reverse(blocks), F.array(bare, F.regexp_extract(bare, BRACES, 1)))
    read = F.transform(tries, lambda t: F.from_json(t, schema, {"allowUnquotedControlChars": "true"}))
    # The field counts where it is there, even as null.
    both = F.zip_with(tries, read, lambda t, v: F.struct(v.alias("v"), F.array_contains(F.json_object_keys(F.when(v.isNotNull(), t)), "correct").alias("has")))
    whole = F.get(F.filter(both, lambda b: F.coalesce(b["has"], F.lit(False)) | b["v"]["correct"].isNotNull()), F.lit(0))["v"]
    where = F.coalesce(F.try_element_at(blocks, F.lit(-1)), bare)
    loose = {k: F.when(F.regexp_like(where, F.lit(p)), F.regexp_extract(where, p, 1)) for k, p in LOOSE_FIELDS.items()}
    loose["rationale"] = F.coalesce(loose["rationale"], where)
    failed = whole.isNull() & loose["correct"].isNull()
    field = lambda k: F.when(whole.isNotNull(), whole[k]).otherwise(loose[k])
    correct = ~failed & F.coalesce(F.lower(F.trim(field("correct"))) == "true", F.lit(False))
    reason = F.when(failed, F.concat(F.lit(UNREADABLE), F.substring(text, 1, 200))).otherwise(F.regexp_replace(F.coalesce(field("rationale"), F.lit("")), r"^\s+|\s+$", ""))
    return F.struct(
        correct.alias("correct"), F.when(failed | correct, "").otherwise(category(field("error_category")) if known_only else F.coalesce(field("error_category"), F.lit(""))).alias("error_category"), reason.alias("rationale"),
        F.when(failed, F.lit(1)).otherwise(F.coalesce(F.floor(field("hypotheses_covered").try_cast("double")).try_cast("int"), F.lit(1))).alias("hypotheses_covered"), failed.alias("judge_failed"),
    )


def friendly_names(graph_query: Column) -> Column:
    """A map from raw ids of a question's nodes, classes and relations to names without spaces; of several names of an id the last counts.

    Literals have their value without its type; a class has its node's name unless the node is an entity.
    """
    joined = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("_"))
    entry = lambda k, v: F.struct(F.coalesce(k, F.lit("")).alias("key"), v.alias("value"))

    def of_node(n):
        name = F.when(n["node_type"] == "literal", F.get(F.split(n["id"], r"\^\^"), F.lit(0))).otherwise(joined(n["friendly_name"]))
        own_class = (n["class"] != n["id"]) & (F.coalesce(n["node_type"], F.lit("")) != "entity")
        return F.array(entry(n["id"], name), entry(F.when(own_class, n["class"]), name))

    nodes = F.flatten(F.transform(F.coalesce(graph_query["nodes"], F.array()), of_node))
    edges = F.transform(F.coalesce(graph_query["edges"], F.array()), lambda e: entry(e["relation"], joined(e["friendly_name"])))
    found = F.filter(F.concat(nodes, edges), lambda e: (e["key"] != "") & (e["value"] != ""))
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def judge_section(dataset: Column, content: Column, readings: Column) -> Column:
    """A ground truth as a judge reads it; ``readings`` (meaning, sql) count only for questions with several."""
    numbered = F.array_join(F.transform(readings, lambda r, i: F.concat(F.lit("Interpretation "), (i + 1).cast("string"), F.lit(":\nMeaning: "), r["meaning"], F.lit("\nSQL: "), r["sql"], F.lit("\n"))), "\n")
    heading = F.create_map(*[F.lit(x) for pair in TRUTH_HEADINGS.items() for x in pair])
    title = F.coalesce(F.try_element_at(heading, dataset), F.lit(TRUTH_HEADINGS["grailqa"]))
    return F.concat(title, F.lit("\n"), F.when(dataset == "ambrosia", numbered).otherwise(content), F.lit("\n"))


def truth_hash(text: Column) -> Column:
    """12 hex digits that change with a ground truth: of the SHA-1 of its canonical text."""
    return F.substring(F.sha1(text), 1, 12)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, in any case, without white space at the ends; null without such a pair."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""))


def sections(prompt: Column) -> Column:
    """prefix, instructions, suffix: what stands before the section's heading, under it up to the next heading of its rank, and after; null without it.

    The heading may have any case and stand anywhere. A rule of dashes right before the next heading goes with that heading.
    """
    multi = rf"(?msi)\A(.*?){SECTION.replace(' ', chr(92) + 's*')}[ \t]*\n?(.*?)((?:^---\s*\n)?^##\s.*|\z)"
    parts = F.struct(*[F.regexp_extract(prompt, multi, i).alias(name) for i, name in enumerate(("prefix", "instructions", "suffix"), 1)])
    return F.when(F.regexp_like(prompt, F.lit(multi)), parts)


def with_instructions(parts: Column, instructions: Column) -> Column:
    """A prompt put together again from its sections with other instructions."""
    return F.concat(parts["prefix"], F.lit(SECTION + "\n"), instructions, F.when(F.endswith(instructions, F.lit("\n")), F.lit("")).otherwise(F.lit("\n")), parts["suffix"])


def assembled(parts: Column, instructions: Column) -> Column:
    """A prompt from its sections and other instructions, with one empty line between the parts."""
    ends = lambda c, pattern: F.regexp_replace(c, pattern, "")
    return F.concat(ends(parts["prefix"], r"\s+$"), F.lit(f"\n\n{SECTION}\n\n"), ends(instructions, r"^\s+|\s+$"), F.lit("\n\n"), ends(parts["suffix"], r"^\s+"))


def unified_diff(before: Column, after: Column, names: tuple[str, str] = ("champion", "rejected")) -> Column:
    """Lines that differ, as a unified diff; an empty text for equal ones. For prompts, a few rows."""

    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), *names, lineterm="")) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=object)

    return F.pandas_udf(diff, "string")(before, after)


def iso_time(text: Column) -> Column:
    """A time without a zone from ISO text, null where it isn't one."""
    return F.try_to_timestamp(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
