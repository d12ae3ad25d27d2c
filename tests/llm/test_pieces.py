import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from verdigraph.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world\n\nfoo 漢字 🎉 the", " a", "", "tab\tx\r\n", "aaaaaaaaaaaaaaaaaaaaaa", "    indent 1234567", "Das ist ein Straßenname; élève où ça?", "x" * 300, "\x00 control", "▁▁ marks"]


def test_ids_are_the_librarys():
    encoder, lib = pieces.Encoder(pieces.model_bytes(PATH), pieces.MERGES), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [*TEXTS, *documents()]
    assert [x.tolist() for x in encoder.encode(texts)] == lib.encode(texts)


def documents():
    return [r[0] or "" for r in duckdb.connect().sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]


def test_scores_are_the_librarys_best():
    """The public vocabulary as a unigram model in the library: the same ids, or others with an equal sum of scores."""
    encoder, proto = pieces.Encoder(pieces.model_bytes(PATH)), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pieces.model_bytes(PATH))
    proto.trainer_spec.model_type = 1
    for i, score in encoder.v.scores.items():
        proto.pieces[i].score = score
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts, same = [*TEXTS, *documents()], 0
    total = lambda ids: sum(encoder.v.scores.get(i, encoder.worst) for i in ids)
    for ids, other in zip(encoder.encode(texts), lib.encode(texts), strict=True):
        same += ids.tolist() == other
        assert total(ids.tolist()) == pytest.approx(total(other), rel=1e-6)
    assert same > 0.9 * len(texts)


def test_units_by_splitting_are_those_of_the_regex():
    encoder = pieces.Encoder(pieces.model_bytes(PATH))
    for text in [*TEXTS, "a \nb", "\n\n x\ty ", " ", "\r\n", "a\n\n\nb c\n"]:
        joined = lambda units: [u for unit in units for u in (unit if set(unit) <= set("\n\r\t") else [unit])]
        assert encoder.units(text) == joined(encoder.unit.findall(pieces.MARK + text.replace(" ", pieces.MARK))) if "  " not in text and text and pieces.MARK not in text else True


def test_modes():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.pieces.add(piece="<unk>", score=0, type=2)
    with pytest.raises(ValueError, match="no merges"):
        pieces.Encoder(proto.SerializeToString(), pieces.MERGES)


def test_unigram_is_viterbi():
    """A made unigram model against all segmentations."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = 1, True, False
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2.1, 1), ("ab", -3.5, 1), ("ba", -3.2, 1), ("▁ab", -4.4, 1), ("aba", -5.5, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    encoder = pieces.Encoder(proto.SerializeToString())

    def best(word):
        if not word:
            return 0.0, ()
        return max(((s := encoder.v.scores[encoder.v.pieces[word[:i]]]) + best(word[i:])[0], (encoder.v.pieces[word[:i]], *best(word[i:])[1])) for i in range(1, len(word) + 1) if word[:i] in encoder.v.pieces)

    words = sorted({"▁" + "".join("ab"[n >> i & 1] for i in range(length)) for length in range(1, 7) for n in range(1 << length)})
    for word, ids in encoder.walk(words):
        assert sum(encoder.v.scores[i] for i in ids) == pytest.approx(best(word)[0])


def test_round_trip_on_spark(spark):
    rows = [*enumerate(TEXTS), (99, None), (0, TEXTS[0]), (None, "no id"), (98, "long " * 200_000 + "x" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("doc", F.lit("clash")).withColumn("made", F.lit(7))
    out = pieces.encoded_documents(docs, PATH)
    assert out.count() == len(rows) and out.filter("not round_trip").count() == 0
    assert pieces.encoded_documents(docs.limit(0), PATH).count() == 0
    model = pieces.model_bytes(PATH)
    back = pieces.decode(pieces.encode(docs, model), model)
    assert back.columns == ["doc_id", "text", "doc", "made", "ids", "decoded"]
    for r in back.collect():
        assert r.decoded == (r.text or "").replace(pieces.MARK, " ") and (r.doc, r.made) == ("clash", 7)


def test_words_are_walked_once():
    """The 180,000 words of these texts all stay known, so none is walked twice."""
    encoder, walked, walk = pieces.Encoder(pieces.model_bytes(PATH)), [], pieces.Encoder.walk
    encoder.walk = lambda words: (walked.extend(words), walk(encoder, words))[1]
    made = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(3600)]
    for at in range(0, len(made), 300):
        encoder.encode(made[at : at + 300])
    encoder.encode(made[2000:2300])
    assert len(walked) == len(set(walked)) == 180_000
