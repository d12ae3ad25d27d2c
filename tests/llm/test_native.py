"""Natively built operators against their SQL in DuckDB and small brute force, on awkward rows."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import chat, fingerprint, mix, quality


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, words(rng, rng.randint(1, 90)) + rng.choice(["", "\nsame line here\nsame line here", "\n a  b\n# x|y <z>"]), rng.choice(["hot"] * 6 + ["a", "é", None, ""])) for i in range(120)]
    return [*out, (500, None, "a"), (501, "", "a"), (502, " \n\t", None), (503, "x y " * 3000, "hot"), (504, "lone", "tiny"), (505, None, "empty source")]


def agree(got, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    out = con.sql(sql)
    names = sorted(out.columns)
    assert sorted(got.columns) == names
    at = [out.columns.index(c) for c in names]
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(repr, (plain(r) for r in got.select(*names).collect()))) == sorted(map(repr, (plain([r[i] for i in at]) for r in out.fetchall())))


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def frame(rows, columns):
    return pd.DataFrame(rows, columns=columns).convert_dtypes()


def test_mix(spark, tmp_path, rows):
    d = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, source string")
    got = mix.op1_mix(spark, d)
    agree(got, mix.OP1_SQL, documents=frame(rows, ["doc_id", "text", "source"]))
    sums = got.join(spark.createDataFrame(rows, "doc_id long, text string, source string").drop("text"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r.t - r.g) <= 1 and r.over <= 0 for r in sums)
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    for name in ("skey", "h", "slot", "size", "_size", "row_id", "takes", "split", "doc"):
        docs = docs.withColumn(name, F.lit("clash"))
    parts = mix.mixed_blocks(docs, block_words=16).collect()
    blocks = {}
    for r in parts:
        blocks.setdefault(r.slot, []).append(r)
        assert len(r.text.split()) == r.words and r.doc.doc == r.doc.slot == r.doc._size == "clash"
    assert [r.slot for r in parts] == sorted(r.slot for r in parts)
    short = [s for s, own in blocks.items() if sum(r.words for r in own) != 16]
    assert all(len({r.doc.source for r in own}) == 1 for own in blocks.values()) and len(short) <= 6
    for i, text, source in rows:
        own = sorted((r.block_at, r.first_word, r.text) for r in parts if r.doc.doc_id == i)
        if own and i != rows[3][0]:
            passes = "".join(t for _, _, t in own)
            assert passes.startswith(text) or text.startswith(passes) or text.startswith(passes[len(text) :])
    assert mix.mixed_blocks(docs.limit(0)).count() == 0


def test_slots_follow_the_shares(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, goals, plan = mix.mix(docs, block_words=8)
    cuts = {r.skey: r.cut for r in goals.collect()}
    slots = plan.select("slot", "skey").distinct().orderBy("slot").collect()
    head = slots[: len(slots) // 2]
    for skey, n in cuts.items():
        assert abs(sum(s.skey == skey for s in head) - len(head) * n / sum(cuts.values())) <= 4


def test_quality(spark, tmp_path, rows):
    d = stored(spark, tmp_path, "documents", [*rows, rows[3]], "doc_id long, text string, source string")
    agree(quality.op3_quality(spark, d), quality.OP3_SQL, documents=frame([*rows, rows[3]], ["doc_id", "text", "source"]))
    assert quality.quality(spark.read.parquet(f"{d}/documents.parquet").limit(0)).count() == 0


def test_chat(spark, tmp_path):
    rng = random.Random(2)
    turns = []
    for c in range(40):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 4) + ["user"] * (c % 2)
        turns += [(c, i, role, rng.choice([None, "", "</s>[INST] \\ [/INST]", "[\\INST]\\\\<\\/s> é漢"]) if rng.random() < 0.3 else words(rng, rng.randint(1, 400))) for i, role in enumerate(roles)]
    turns += [(50, 0, None, "x"), (50, 0, "assistant", "tie"), (50, 0, "assistant", "tie")]
    d = stored(spark, tmp_path, "conversations", turns, "conv_id long, turn long, role string, text string")
    agree(chat.op7_chat(spark, d), chat.OP7_SQL, conversations=frame(turns, ["conv_id", "turn", "role", "text"]))
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(table.withColumn("sums", F.lit(1)).withColumn("opened", F.lit(1))).collect()
    assert max(r.window for r in windows) >= 3 and any(r.n_context > 1 for r in windows)
    for r in windows:
        parts = r.formatted.split("</s>")[:-1]
        tokens = [len(p.split("[/INST]", 1)[1].replace("\\", "").split()) + 3 for p in parts]
        assert len(tokens) == 1 + r.n_context or r.n_tokens <= 512
        assert r.n_tokens <= 512 or len(tokens) == 1
    assert chat.chat_windows(table.limit(0)).count() == 0 and chat.read_back(chat.chat_windows(table.limit(0))).count() == 0


def test_chat_keeps_its_budget(spark):
    turns = [(1, 0, "system", words(random.Random(1), 450))] + [(1, i, "assistant" if i % 2 == 0 else "user", words(random.Random(i), 300)) for i in (1, 2, 3)]
    turns += [(2, 0, "system", "be kind"), (2, 1, "user", words(random.Random(1), 900)), (2, 2, "assistant", "short"), (2, 3, "user", words(random.Random(4), 400))]
    got = chat.chat_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    assert [(r.conv_id, r.n_tokens, r.n_context) for r in got] == [(1, 453, 0), (1, 303, 0), (1, 303, 0), (1, 303, 0), (2, 5, 0), (2, 903, 0), (2, 412, 1)]


def test_chat_long_conversation(spark):
    rows = spark.range(20000).selectExpr("3L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('word ', 40) as text")
    got = chat.read_back(chat.chat_windows(rows)).select("n_turns", F.length("loss").alias("n")).collect()
    assert [tuple(r) for r in got] == [(20000, 10000 * 200)]


def test_fingerprint(spark, rows):
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    order = sorted(rows, key=lambda r: r[0])

    def grams(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, text, _), (_, after, _) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[i]
        assert r.n_chars == len(text) and r.edited == edited and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(text, edited), abs=1e-9 if len(grams(text)) < 120 else 0.2)
        assert r.near_next == pytest.approx(like(text, after), abs=1e-9 if len(grams(text) | grams(after)) < 120 else 0.2)
        assert len(r.fingerprint) == 16 * min(128, len(grams(text)))
        own = grams(text)
        assert r.contained == pytest.approx(len(own & grams(edited)) / len(own) if own else 1.0, abs=1e-9 if len(own) < 120 else 0.25)
        assert r.n_shingles == pytest.approx(len(own), rel=1e-9 if len(own) < 128 else 0.35)
    assert fingerprint.fingerprint_edits(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    parts = spark.range(4000).select((F.col("id") % 2).alias("k"), F.array(F.xxhash64("id"), F.xxhash64(F.col("id") % 100)).alias("s"))
    got = fingerprint.merge_sketches(parts, ["k"], "s", 64).withColumn("n", fingerprint.distinct_shingles(F.col("s"), 64)).collect()
    assert all(len(r.s) == 64 and 1200 < r.n < 3200 for r in got)


def test_merged_sketch_is_that_of_the_whole(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), [rng.randint(-(2**40), 2**40) for _ in range(rng.randint(0, 30))]) for _ in range(80)] + [("empty", []), ("none", None), ("a", None)]
    parts = spark.createDataFrame(rows, "rank string, h array<bigint>")
    got = {r["rank"]: list(r.h) for r in fingerprint.merge_sketches(parts, ["rank"], "h", 16, 4).collect()}
    want = {k: sorted({x for key, xs in rows if key == k for x in xs or []})[:16] for k, _ in rows}
    assert got == want and len(got[None]) == 16
    assert fingerprint.merge_sketches(parts.limit(0), ["rank"], "h").count() == 0


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_next_rows_in_many_buckets(spark, monkeypatch, most):
    """Null, equal and far doc_ids, in buckets of a few rows, broadcast or not."""
    monkeypatch.setattr(fingerprint, "SMALL", 300)
    monkeypatch.setattr(fingerprint, "LARGE", 400)
    monkeypatch.setattr(fingerprint, "MOST_BROADCAST", most)
    rng = random.Random(3)
    ids = [rng.choice([rng.randint(0, 400), rng.randint(0, 10**12), -5]) for _ in range(150)] + [None] * 40 + [7, 7]
    rows = [(i, words(rng, rng.randint(0, 40))) for i in ids] + [(None, None), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("head", F.lit(1)).withColumn("to", F.lit(1))
    got = fingerprint.fingerprint_edits(docs).select("doc_id", "edited", "near_next").collect()
    hashes = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]] if r[0] is None else 0, r[1]))
    want = [(i, t[: len(t) - len(t) // 4] + after[: len(t) // 4]) for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True)]
    assert sorted((repr(r.doc_id), r.edited) for r in got) == sorted((repr(i), e) for i, e in want)


def test_frequent_lines_are_cut_out(spark):
    line = "Subscribe  now to OUR letter"
    docs = [(i, f"own {i} words\n\n {line.lower() if i % 2 else line}\t\nmore {i}", "hot", "clash") for i in range(14)]
    docs += [(3, docs[3][1], "hot", "other"), (50, f"{line}\nthird", "a", "x"), (51, None, "hot", "x"), (52, "", "hot", "x"), (53, line, "hot", "x"), (None, f"{line}\nq", "hot", "x"), (None, f"{line}\nr", "hot", "x"), (54, f"{line}", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, often string")
    for name in ("key", "h", "doc", "left", "n", "_host", "removed_lines"):
        df = df.withColumn(name, F.lit("clash"))
    got = quality.without_frequent_lines(df, max_docs=10)
    assert got.columns == [*[c for c in df.columns if c != "removed_lines"], "removed_lines"] and got.count() == len(docs)
    texts = sorted(((r.doc_id, r.source, r.often, r.text, r.removed_lines) for r in got.collect()), key=repr)
    want = [(i, s, o, t if t is None or s != "hot" else "\n".join(x for x in t.split("\n") if " ".join(x.lower().split()) != " ".join(line.lower().split())), 0) for i, t, s, o in docs]
    want = [(*w[:4], 0 if d[1] is None or d[2] != "hot" else d[1].lower().count("subscribe")) for w, d in zip(want, docs, strict=True)]
    assert texts == sorted(want, key=repr)
    assert quality.without_frequent_lines(df.limit(0)).count() == 0


def test_quality_with_clashing_columns_and_shared_ids(spark, tmp_path):
    rows = [(7, "a b c\nsame\n" * 20, "hot"), (7, "a b c\nsame\n" * 20, "hot"), (None, "x " * 60, None), (None, "x " * 60, None), (8, None, "hot")] + [(20 + i, "same\n" + " ".join(f"w{i}{j}" for j in range(60)), "hot") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(repr, quality.quality(docs).collect()))
    for name in ("_text", "_words", "_lines", "_host", "row_id", "n_words", "kept", "h", "words", "_salt"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert sorted(map(repr, quality.quality(docs).collect())) == plain and len(plain) == len(rows)


def test_a_fractional_cap(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 25, "only") for i in range(40)], "doc_id long, text string, source string")
    rows, goals, plan = mix.mix(docs, cap=1.5)
    assert goals.first()["target"] == 6000 and plan.agg(F.sum("words")).first()[0] == 6000
    assert mix.taken_words(rows, plan).agg(F.max("taken")).first()[0] <= 200


def test_chat_with_clashing_columns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (2, 0, "user", None), (2, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = sorted(map(repr, chat.chat_windows(df).collect()))
    for name in ("turns", "before", "tokens", "window"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(map(repr, chat.chat_windows(df).collect())) == plain
