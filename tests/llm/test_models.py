"""Trained operators by held-out accuracy, scans against plain loops."""

import random
from collections import Counter
from re import _parser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import langid, licenses, toxicity

SF = "/root/testdata/sf0.01"


def test_langid(spark):
    from verdigraph.llm.langid import op10_langid

    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op10_langid(spark, SF).filter("held_out").join(truth, "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_langid_edges(spark):
    model = langid.fit(["the cat", "der hund", "le chat", "el perro"] * 5, ["en", "de", "fr", "es"] * 5)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "der hund")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de"
    assert langid.fit([], []).predict("abc") == ("und", 0.0)
    assert langid.identify(docs.limit(0), model).count() == 0


def test_langid_learns_all_languages(spark):
    names = [f"q{chr(97 + i)}" for i in range(12)]
    docs = spark.createDataFrame([(100 * i + j, chr(0x4E00 + i) * (j + 1), lang) for i, lang in enumerate(names) for j in range(30 if i else 90)], "doc_id long, text string, lang string")
    model = langid.train(docs, rows=40)
    assert sorted(v for langs in model.langs.values() for v in langs) == names
    assert [model.predict(chr(0x4E00 + i) * 5)[0] for i in range(12)] == names


def plain_features(text):
    """Square roots of shares of hashed n-grams, by loops over the whole text."""
    codes = [32]
    for c in "".join(x.lower() for x in text).replace("ς", "σ"):
        code = ord(c) if c.isalpha() else 32
        if code != 32 or codes[-1] != 32:
            codes.append(code)
    codes += [32] if codes[-1] != 32 else []
    k, top = (0x9E3779B1, 0x85EBCA77, 0x27D4EB2F, 0xC2B2AE3D, 0x165667B1), 0xFFFFFFFF
    counts = Counter()
    for i, c in enumerate(codes):
        one = c * k[0] & top
        counts[one >> 19] += 1
        if i + 1 < len(codes):
            two = one ^ (codes[i + 1] * k[1] & top)
            counts[(two * k[4] & top) >> 19] += 1
            if i + 2 < len(codes):
                three = (two * k[2] & top) ^ (codes[i + 2] * k[3] & top)
                counts[(three * k[0] & top) >> 19] += 1
    return {b: (n / sum(counts.values())) ** 0.5 for b, n in counts.items()}


@pytest.mark.parametrize("chunk", [1 << 18, 1000, 7, 1])
def test_langid_features_like_a_plain_loop(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ["Élève où ça " * 200, "a", "  x1 y!\n", "ΣΑΣ σας İstanbul 漢字", "ab" * 3, " . . a . . "]:
        buckets, values = langid.features(text)
        assert dict(zip(buckets.tolist(), values.tolist(), strict=True)) == pytest.approx(plain_features(text))
    assert langid.features(" 12 . ") is langid.features("") is langid.features(None) is None


def test_langid_awkward_rows(spark):
    rows = [(None, "der hund und die katze", "de"), (1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, None, "en"), (3, "le chat", None), (4, "z" * 600_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("found", "doc", "draw", "score", "lang_pred", "held_out"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = langid.identify(docs, langid.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "found", "doc", "draw", "held_out", "lang_pred", "score"]
    out = got.collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id == 1} == {"en"} and {(r.found, r.doc) for r in out} == {("clash", "clash")}
    assert langid.identify(docs, langid.train(docs.limit(0))).filter("lang_pred = 'und' and score = 0").count() == len(rows)


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(1)
    plain = lambda n: " ".join("".join(rng.choice("aeioutnrslmd") for _ in range(rng.randint(2, 8))) for _ in range(n))
    bad = ["idiot", "moron", "worthless", "pathetic"]
    made = [(f"{plain(rng.randint(5, 60))} {rng.choice(bad)} {plain(9)} {rng.choice(bad)} {plain(rng.randint(5, 60))}", 1) if i % 2 else (plain(rng.randint(8, 130)), 0) for i in range(700)]
    model = toxicity.fit([t for t, _ in made[:600]], [y for _, y in made[:600]])
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in made[600:])
    assert right >= 95
    assert model.score(f"{plain(30)} idiiot {plain(30)}") > model.score(plain(61))
    assert model.score(None) == model.score("") == model.score(" \n") == 0
    assert toxicity.fit([], []).score("x") < 0.5


def plain_logit(model, text):
    """The largest mean over 8 words of the mean over their n-grams, by loops; a word's buckets are those of the word alone."""
    words = []
    for w in "".join(" " if ord(c) <= 32 else c for c in text.lower()).split():
        words += [w] if not words or words[-1] != w else []
    if not words:
        return float("-inf")
    means = []
    for w in words:
        parts = list(toxicity.subwords(w))
        marked = f" {w} "
        grams = [marked[i : i + n] for n in toxicity.SIZES for i in range(len(marked) - n + 1)]
        assert sum(len(b) for b, _, _ in parts) == len(grams) + 1
        means.append(sum(model.bucket_logits[b].sum() for b, _, _ in parts) / (len(grams) + 1))
    return max(sum(means[i : i + 8]) for i in range(0, max(1, len(words) - 4), 4)) / 8 + model.bias


@pytest.mark.parametrize("chunk", [1 << 18, 50, 3])
def test_toxicity_like_a_plain_loop(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    model = toxicity.Model(np.random.default_rng(4).normal(0, 1, 1 << toxicity.BITS).astype(np.float32), 0.3, 1.0, 0.0)
    rng = random.Random(3)
    for n in (0, 1, 4, 8, 9, 100):
        text = " \n".join(rng.choice(["no", "no", "Élan", "x", "漢字漢字漢字", "y" * 90, "idiot!"]) for _ in range(n))
        assert model.logit(text) == pytest.approx(plain_logit(model, text), rel=1e-4)


def test_op4_on_held_out_labels(spark):
    """The query, train and score on labels that it hasn't learned from. Some labels of toxic rows have no word that tells it."""
    got = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").toPandas()
    caught, alarms = ((rows.predicted == 1) & (rows.toxic == 1)).sum(), ((rows.predicted == 1) & (rows.toxic == 0)).sum()
    order = rows.score.rank()
    n = int((rows.toxic == 1).sum())
    area = (order[rows.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))
    assert caught > 0.6 * n and alarms < 0.03 * len(rows) and area > 0.9 and ((rows.score >= 0.5) == (rows.predicted == 1)).all()


def test_toxicity_awkward_rows(spark):
    texts = [("you idiot moron", 1), ("a fine day at sea", 0)] * 40
    docs = spark.createDataFrame([*[(i, t) for i, (t, _) in enumerate(texts)], (None, "you idiot moron"), (500, None), (501, ""), (502, "fine " * 300_000), (0, texts[0][0])], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, y) for i, (_, y) in enumerate(texts)], (0, 0), (500, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for name in ("score", "predicted", "doc", "toxic", "_draw"):
        docs = docs.withColumn(name, F.lit("clash"))
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "doc", "toxic", "_draw", "score", "predicted"]
    out = got.collect()
    assert len(out) == 85 and all(0 <= r.score <= 1 and r.doc == "clash" for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[500] == score[501] and len({r.score for r in out if r.text == texts[0][0]}) == 1
    assert score[0] > score[1]
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels.limit(0))).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def plain_detections(lowered):
    """Every rule on the whole text, without keywords; then, by priority, what lies inside an earlier one goes."""
    found = [licenses.Detection(r.label, r.priority, r.confidence, *m.span()) for r in licenses.rules() for m in r.pattern.finditer(lowered)]
    kept = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return kept


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check_scan(rows, got):
    for i, text in rows:
        w = licenses.WORDS.findall(lowered(text))
        at = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want = plain_detections(lowered(text))
        r = got.loc[[i]].iloc[0]
        base = {x for _, x in at}
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted(base)))
        assert (pd.isna(r.first_word) and not at) or (r.first_word, r.last_word) == (min(p for p, _ in at), max(p for p, _ in at))
        assert r.labels == ",".join(sorted(base | {d.label for d in want})) and 0 <= r.score <= 1
        assert [tuple(s) for s in r.spans] == [(d.label, d.start, d.end) for d in want], text


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "mit-license, MIT  LICENSE; apache license"), (5, "SPDX-License-Identifier: GPL-3.0-or-later\nGNU General Public License, version 3"), (6, "permit license"), (7, "mité license mit\nlicense"), (1, "Released under the MIT License."), (8, "mit license " * 20_000 + "İ gpl v3"), (9, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")).withColumn("labels", F.lit(1))
    got = licenses.scan_licenses(docs).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and licenses.scan_licenses(docs.limit(0)).count() == 0
    check_scan([r for r in rows if r[0] != 8], got)
    assert (got.loc[8].n_base, got.loc[8].first_word, got.loc[8].last_word, got.loc[8].n_words) == (20_000, 0, 39_998, 40_003)
    assert "gpl-3.0" in got.loc[5].labels and len(licenses.rules()) > 400
    found = [licenses.Detection("a", 1, 0.5, 0, 9), licenses.Detection("b", 0, 0.9, 2, 5), licenses.Detection("c", 2, 0.4, 3, 8)]
    assert [d.label for d in licenses.resolve(found)] == ["b", "a"]


def test_licenses_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_scan([(r.doc_id, r.text) for r in docs.collect()], licenses.op8_licenses(spark, SF).toPandas().set_index("doc_id"))


def sample(rng, parsed):
    """A text that the parsed regex matches, but for what its look-aheads forbid."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, value = rng.choice(arg)
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: " " if "SPACE" in str(value) else "1"}[str(kind)]()
            case "BRANCH":
                out += sample(rng, rng.choice(arg[1]))
            case "SUBPATTERN":
                out += sample(rng, arg[-1])
            case "ANY":
                out += "y"
            case "MAX_REPEAT":
                out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
    return out


def test_keywords_let_all_rules_through(spark):
    rng = random.Random(6)
    texts = []
    for r in licenses.rules():
        own = [t for t in (sample(rng, _parser.parse(r.pattern.pattern)) for _ in range(40)) if r.pattern.search(t)]
        assert own, r
        texts += [f"é {t.upper() if rng.random() < 0.5 else t}, x" for t in own[:6]]
    texts += ["Released under the GPL v3.", "available under mpl 2.0", "released under the MIT", "https://mozilla.org/MPL/2.0/", "https://www.eclipse.org/legal/epl-2.0/"]
    rows = list(enumerate(texts))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    check_scan(rows, got)
    assert (got.labels != "").all() and len(got) > 1500


def labels_of(text):
    return sorted({d.label for d in licenses.detections(licenses.lower(text))})


@pytest.mark.parametrize(("text", "want"), [
    ("released under the vim editor", []),
    ("code available under ruby 3.2 and php 8", []),
    ("distributed under openssl, zlib and x11", []),
    ("released under the vim license", ["vim"]),
    ("dual license: MIT OR Apache-2.0", ["apache-2.0", "mit"]),
    ("SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0-only", ["gpl-2.0", "isc", "mit"]),
    ("license: mit", ["mit"]),
    ("license: the rest of this sentence", []),
])
def test_license_names_and_expressions(text, want):
    assert labels_of(text) == want


def test_langid_draws_rows_of_one_doc_id_apart(spark):
    rng = random.Random(8)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(12))
    rows = [(7, say("the and house with water stone"), "en") if i % 2 else (7, say("der und haus mit wasser stein"), "de") for i in range(400)]
    # A language that has only very long texts is learned too.
    rows += [(7, say("le et maison avec eau pierre") * 2000, "fr") for _ in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert {lang for two in model.langs.values() for lang in two} == {"en", "de", "fr"}
    assert [model.predict(t)[0] for t in ("the house and the water", "der stein und das haus", "la maison et la pierre avec eau")] == ["en", "de", "fr"]


def test_langid_bounds_its_languages(spark):
    rows = [(i, f"word{i % 50} text", f"l{i % 50:02d}" if i < 150 else "l03") for i in range(160)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=3)
    assert sorted(x for v in model.langs.values() for x in v) == ["l00", "l01", "l03"]


def plain_machine(rows, y, cost=10.0, rounds=12, seed=3):
    """Dual coordinate descent on dense vectors, as the textbook has it, in the same order of rows."""
    size = 1 << langid.BITS
    x = np.zeros((len(rows), size + 1))
    for i, (buckets, values) in enumerate(rows):
        x[i, buckets], x[i, size] = values, 1
    q, alpha, rng = x @ x.T * np.outer(y, y), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            gradient = q[i] @ alpha - 1 + alpha[i] / (2 * cost)
            alpha[i] = max(0.0, alpha[i] - gradient / (q[i, i] + 1 / (2 * cost)))
    return (alpha * y) @ x


def test_langid_machines_and_votes_like_plain_ones():
    rng = random.Random(12)
    stems = {"en": "the and house", "de": "der und haus", "nl": "het en huis", "fr": "le et maison", "es": "el y casa"}
    texts, langs = zip(*[(" ".join(rng.choice(stems[v].split()) + rng.choice("aeiou") for _ in range(8)), v) for v in stems for _ in range(8)], strict=True)
    model = langid.fit(list(texts), list(langs))
    rows = [langid.features(t) for t in texts]
    family = [{"en": 0, "de": 0, "nl": 0, "fr": 1, "es": 1}[v] for v in langs]
    for f, w in zip(model.families, model.family_weights, strict=True):
        y = np.where(np.array(family) == ["germanic", "romance"].index(f), 1.0, -1.0)
        assert np.allclose(plain_machine(rows, y), w, atol=1e-4)
    machines = {}
    for a, b in model.pairs:
        at = [i for i, v in enumerate(langs) if v in (a, b)]
        machines[a, b] = plain_machine([rows[i] for i in at], np.array([1.0 if langs[i] == a else -1.0 for i in at]))
        assert np.allclose(machines[a, b], model.pairs[a, b], atol=1e-4)
    for t in [*texts, "der casa haus", "y maison"]:
        buckets, values = langid.features(t)
        dot = lambda w, b=buckets, v=values: float(w[b] @ v + w[-1])
        best = max(model.families, key=lambda f: dot(model.family_weights[model.families.index(f)]))
        votes = {v: (0, 0.0) for v in model.langs[best]}
        for (a, b), w in machines.items():
            if a in votes:
                m = dot(w)
                votes[a] = (votes[a][0] + (m > 0), votes[a][1] + m)
                votes[b] = (votes[b][0] + (m <= 0), votes[b][1] - m)
        assert model.predict(t)[0] == max(votes, key=lambda v: (*votes[v], v))


def test_toxicity_sample_is_bounded_in_code_points(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, weights: got.update(texts=texts, toxic=toxic))
    docs = spark.createDataFrame([(i, f"t{i} " * 100) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(400)], "doc_id long, toxic int")
    toxicity.train(docs, labels, rows=60, most_chars=10_000)
    assert 0 < sum(map(len, got["texts"])) <= 10_000 and {0, 1} == set(got["toxic"])
