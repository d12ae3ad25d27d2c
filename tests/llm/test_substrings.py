import random

from pyspark.sql import functions as F

from verdigraph.llm import substrings as s


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 9))) for _ in range(n))


def bare(seed, n):
    rng = random.Random(seed)
    return "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))


def brute(rows, min_run):
    """What is left of each text: chunks by a plain loop over bytes, kept where they stand first."""

    def pieces(data):
        out, at = [], 0
        for i in range(len(data)):
            h = sum(int(s.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
            spaces = [c in b" \t\n\x0b\x0c\r" for c in data[max(0, i - 31) : i + 1]]
            whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
            if (spaces[-1] and (h >> 12 & 0xFF) % 5 == 0) or (len(spaces) == 32 and not any(spaces) and whole and (h >> 12 & 31) == 0) or i + 1 == len(data):
                out.append(data[at : i + 1])
                at = i + 1
        return out

    def size(chunks):
        joined, n = b"".join(chunks), 0
        for c in chunks:
            n += max(len([w for w in c.split()]), len(c) // 16)
        return n

    seen, out = set(), {}
    for i, text in sorted(rows):
        own, kept, run = pieces((text or "").encode()), [], []
        known, mine = set(seen), set()
        for c in [*own, None]:
            if c is not None and (c in known or c in mine):
                run.append(c)
                continue
            kept += [] if size(run) >= min_run else run
            run = []
            if c is not None:
                kept.append(c)
                mine.add(c)
        seen |= set(own)
        out[i] = b"".join(kept).decode()
    return out


def test_like_a_plain_loop(spark):
    rng = random.Random(5)
    shared = [prose(50 + i, 60) for i in range(3)] + [bare(60, 200), bare(61, 90)]
    rows = [(i, " ".join(rng.choice([prose(1000 + 7 * i + j, 25), rng.choice(shared), bare(2000 + 7 * i + j, 20)]) for j in range(6))) for i in range(40)]
    rows += [(40, ""), (41, rows[3][1]), (42, f"{shared[0]} {shared[0]} {shared[3]}{shared[3]}")]
    got = {r.doc_id: r.text for r in s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, s.MIN_RUN) and sum(got[i] != t for i, t in rows) > 20


def test_texts_without_spaces(spark):
    passage = bare(9, 1280)
    rows = [(i, f"{bare(10 + i, 100)}{passage}{bare(20 + i, 100)}") for i in range(3)]
    got = {r.doc_id: r for r in s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].removed_words > 150 and got[i].text.startswith(bare(10 + i, 100)) and got[i].text.endswith(bare(20 + i, 100)) for i in (1, 2))


def test_awkward_rows(spark):
    passage = prose(3, 70)
    rows = [("b", f"{prose(1, 40)} {passage}"), ("a", f"{prose(2, 40)} {passage}"), (None, f"{prose(4, 40)} {passage}"), (None, f"{prose(5, 40)} {passage}"), ("c", None), ("b", f"{prose(1, 40)} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for name in ("who", "_who", "doc", "elsewhere", "r", "changed", "removed_words", "n", "owner"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = s.dedup_substrings(docs)
    assert got.columns == [*[c for c in docs.columns if c != "removed_words"], "removed_words", "removed_spans"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.who == r._who == r.doc == r.r == r.owner == "clash" for r in out)
    # The passage stays in one document: that of one id, whether its row is repeated or not.
    assert len({(r.doc_id, r.text) for r in out if r.text and passage in r.text}) == 1
    assert [r.text for r in out if r.doc_id == "c"] == [None]
    hot = spark.range(3000).selectExpr("id as doc_id", f"concat('{passage} ', array_join(transform(sequence(1, 30), x -> concat('w', id, 'x', x)), ' ')) as text")
    assert s.dedup_substrings(hot).filter("removed_words between 45 and 75").count() == 2999


def test_chunks_cover_the_text_and_resist_shifts():
    data = prose(1, 3000).encode()
    ends, words = s.chunk_ends(data)
    assert ends[-1] == len(data) and (ends[1:] > ends[:-1]).all() and words.sum() == len(data.split())
    assert max(b - a for a, b in zip([0, *ends], ends, strict=False)) < 500
    moved = s.digests(b"shift " + data, s.chunk_ends(b"shift " + data)[0])
    assert len(set(s.digests(data, ends)) - set(moved)) <= 2


def test_blocks_change_nothing(monkeypatch):
    data = (prose(2, 2000) + bare(3, 3000) + " é " + bare(4, 500)).encode()
    want = s.chunk_ends(data)
    monkeypatch.setattr(s, "BLOCK", 1000)
    got = s.chunk_ends(data)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_passages_go_and_clean_texts_stay(spark):
    passage = prose(3, 70)
    rows = [(i, f"{prose(100 + i, 60)} {passage} {prose(200 + i, 60)}") for i in range(6)] + [(i, prose(300 + i, 150)) for i in range(6, 12)]
    rows += [(12, None), (13, ""), (14, prose(306, 150)), (15, prose(400, 15)), (16, prose(400, 15)), (None, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = {r.doc_id: r for r in s.dedup_substrings(docs).collect()}
    text = dict(rows)
    for i in range(1, 6):
        assert passage not in got[i].text and got[i].removed_words > 40
        assert got[i].text.startswith(prose(100 + i, 50)) and got[i].text.endswith(prose(200 + i, 60)[-250:])
        out = text[i]
        for span in reversed(got[i].removed_spans):
            out = out[: span.start] + out[span.end :]
        assert out == got[i].text
    for i in [0, *range(6, 12), 12, 13, 15, 16]:
        assert got[i].text == text[i] and got[i].removed_words == 0
    assert s.dedup_substrings(docs.limit(0)).count() == 0


def test_rows_of_one_doc_id(spark):
    passage = prose(31, 60)
    rows = [(1, f"{prose(32, 30)} {passage} {prose(33, 30)}"), (1, f"{prose(34, 30)} {passage} {prose(35, 30)}"), (1, f"{prose(34, 30)} {passage} {prose(35, 30)}"), (2, f"{prose(36, 30)} {passage} {prose(37, 30)}")]
    got = s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    ones = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.removed_words)
    # One has the passage still, one lost it, and of the two equal rows one lost all.
    whole, cut_down, empty = ones
    assert whole.removed_words == 0 and 40 < cut_down.removed_words < 90 and empty.removed_words >= 115 and not empty.text.strip()
    assert [r.removed_words > 40 for r in got if r.doc_id == 2] == [True]


def test_a_third_of_the_rows_on_one_doc_id(spark):
    rows = [(5, prose(40 + i % 7, 40)) for i in range(60)] + [(100 + i, prose(200 + i, 40)) for i in range(120)]
    got = s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    left = sorted(r.text for r in got if r.doc_id == 5 and r.text.strip())
    assert left == sorted({t for i, t in rows if i == 5}) and all(r.removed_words == 0 for r in got if r.doc_id != 5)
