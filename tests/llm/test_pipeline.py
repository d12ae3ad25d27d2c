"""Each stage of the pipeline on what the one before kept, and the whole, against plain versions."""

import random

import duckdb
import pytest
import test_near
import test_substrings
from pyspark.sql import functions as F

import corpus_pipeline
from verdigraph.llm import mix, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("doc", "row", "who", "slot", "found", "cls", "takes", "component")


def made():
    rng = random.Random(11)
    passage = test_substrings.prose(1, 70)
    own = [test_substrings.prose(100 + i, rng.randint(1, 200)) for i in range(60)]
    near = test_substrings.prose(500, 150).split()
    texts = [*own, *[f"{own[i]} {passage} {test_substrings.prose(900 + i, 80)}" for i in range(20, 40)]]
    for i in range(8):
        copy = list(near)
        copy[i * 10] = "zebra"
        texts.append(" ".join(copy))
    texts += [own[5], own[5], None, "", "12 34 !", " \n", "x", f"  {own[7]}\n\n{own[8]}  ", test_substrings.bare(3, 900)]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["hot", "hot", "hot", "b", None, ""]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "a row without an id, of some words", "en", "b", 5)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name to (rows before, rows after, columns after), each stage written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(made(), SCHEMA)
    for name in EXTRA:
        docs = docs.withColumn(name, F.lit("clash"))
    docs.coalesce(3).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(at)).write.parquet(f"{at}/{name}")
        after = spark.read.parquet(f"{at}/{name}")
        out[name] = docs.collect(), after.collect(), docs.columns, after.columns
        docs = after
    return out, at


def test_all_but_the_last_keep_the_columns(stages):
    for name, (_, after, columns, now) in stages[0].items():
        assert after and (name == "pieces" or now == columns)
        assert name == "pieces" or all(r[e] == "clash" for r in after for e in EXTRA)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_language_id_drops_texts_without_letters(stages):
    before, after, *_ = stages[0]["language_id"]
    assert sorted(after, key=key) == sorted((r for r in before if any(c.isalpha() for c in r.text or "")), key=key)


def test_near_copies_keep_one_of_each(stages):
    before, after, *_ = stages[0]["near_copies"]
    ids = [(r.doc_id if r.doc_id is not None else 10**6, r.text) for r in before]
    want = {c for i, c, *_ in test_near.brute(ids) if i == c}
    assert sorted(r.doc_id if r.doc_id is not None else 10**6 for r in after) == sorted(want)
    assert {r for r in after} <= {r for r in before} and len(before) - len(after) > 7


def test_repeated_passages_go(stages):
    before, after, *_ = stages[0]["substrings"]
    left = test_substrings.brute([(r.doc_id if r.doc_id is not None else 10**6, r.text) for r in before], 18)
    want = {i: t for i, t in left.items() if t.split() or not any(r.doc_id == i and r.text.split() for r in before)}
    assert {(r.doc_id if r.doc_id is not None else 10**6): r.text for r in after} == want
    changed = [r for r in after if r not in before]
    assert len(changed) > 15 and all(r.n_chars == len(r.text) for r in changed)


def test_mix_takes_what_it_should(stages):
    before, after, *_ = stages[0]["source_mix"]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[r.doc_id, r.text, r.source] for r in before])
    names = con.sql(mix.OP1_SQL).columns
    want = {r[names.index("doc_id")]: r[names.index("taken")] for r in con.sql(mix.OP1_SQL).fetchall()}
    got = dict.fromkeys(want, 0)
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        got[r.doc_id] += len(r.text.split())
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    assert got == want


def test_pieces_are_the_encoders(stages):
    before, after, *_ = stages[0]["pieces"]
    encoder = pieces.Encoder(pieces.model_bytes())
    want = sorted((r.doc_id or -1, len(r.text), ids.tolist()) for r, ids in zip(before, encoder.encode([r.text for r in before]), strict=True))
    assert sorted((r.doc_id or -1, r.n_chars, r.ids) for r in after) == want and all(r.round_trip for r in after)


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, str(stages[1])).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in got) == sorted((r.doc_id or -1, r.ids) for r in stages[0]["pieces"][1])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_missing_language_is_filled_in(spark):
    rng = random.Random(21)
    say = {"en": "the and house with water stone", "de": "der und haus mit wasser stein"}
    rows = [(i, " ".join(rng.choice(say[lang].split()) for _ in range(15)), None if i % 10 == 0 else lang, "s", 60) for i in range(120) for lang in [("en", "de")[i % 3 % 2]]]
    docs = spark.createDataFrame(rows, SCHEMA)
    after = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert after == {i: ("en", "de")[i % 3 % 2] for i in range(120)}


def test_a_language_is_found_once_a_text(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    plan = corpus_pipeline.identify_language(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
