"""SentencePiece encoding and decoding with a forward pass (Viterbi) that shares prefixes.

The distinct marked words of a batch are sorted, which is a depth-first walk of their trie; the forward scores of each prefix stand on a stack and are
reused by all words that begin with it. A unigram model brings the scores of its pieces. Those of a BPE model only order its merges; for it, pieces get the
logarithm of their probability under Zipf's law by that order, so its vocabulary serves as a unigram model. ``MERGES`` encodes as a BPE model itself
does: the state of a prefix is then the last piece of its encoding, the one piece that ends there and stays apart from the piece before.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise
from math import log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts

MARK = "▁"
#: Words that a task remembers between batches, of which the first ones stay when it begins anew, and texts, or code
#: points of texts, of which the words are walked together.
REMEMBERED, STAYING = 300_000, 100_000
TEXTS, CHARACTERS = 250, 1_000_000
SHORT = (2, 1)
NEVER = float("-inf")
VITERBI, MERGES = "viterbi", "merges"
#: Added to a piece's place in the order of merges, so that the first isn't certain.
ZIPF_SHIFT = 2


class Vocabulary(NamedTuple):
    pieces: dict[str, int]
    scores: dict[int, float]
    texts: list[str]
    byte_ids: list[int] | None
    unknown: int
    unigram: bool
    dummy_prefix: bool
    squeeze: bool


@cache
def load(model: bytes, mode: str = VITERBI) -> Vocabulary:
    """The vocabulary of a serialised model. Refused with an error: user-defined symbols, normalisation rules, models other than BPE and unigram, and
    MERGES with a model that isn't BPE."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    kind = pb.ModelProto.SentencePiece
    if proto.normalizer_spec.precompiled_charsmap or proto.trainer_spec.model_type not in (1, 2) or any(p.type == kind.USER_DEFINED for p in proto.pieces):
        raise ValueError("only BPE and unigram models without normalisation rules and user-defined symbols are supported")
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    held = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
    texts = ["" if p.type == kind.CONTROL else p.piece for p in proto.pieces]
    texts[unknown] = proto.trainer_spec.unk_surface
    own = {i: proto.pieces[i].score for i in normal.values()}
    if proto.trainer_spec.model_type == 1:
        if mode == MERGES:
            raise ValueError("a unigram model has no merges")
    elif mode == VITERBI:
        own = {i: -log(place + ZIPF_SHIFT) for place, i in enumerate(sorted(own, key=lambda i: (-own[i], i)))}
    byte_ids = [held[f"<0x{b:02X}>"] for b in range(256)] if len(held) == 256 else None
    return Vocabulary(normal, own, texts, byte_ids, unknown, mode == VITERBI, proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces)


class Encoder:
    def __init__(self, model: bytes, mode: str = VITERBI):
        self.v = load(model, mode)
        self.score = {piece: self.v.scores[i] for piece, i in self.v.pieces.items()}
        #: Each ending of a piece; (id, score) if it is a piece itself, else nothing.
        self.endings: dict[str, tuple[int, float] | tuple[()]] = {}
        self.good, self.lengths = {}, {}
        if self.v.unigram:
            for piece in self.v.pieces:
                self.endings.update((piece[i:], ()) for i in range(1, len(piece)) if piece[i:] not in self.endings)
                self.endings[piece] = (self.v.pieces[piece], self.score[piece])
        else:
            # A piece that its own merges don't lead to is never the last one of a prefix.
            self.good = {piece: i for piece, i in self.v.pieces.items() if self.merged(piece) == [piece]}
            # The lengths of the pieces that end in the same three characters, longest first; two and one are tried after them.
            ends: dict[str, set[int]] = {}
            for piece in self.good:
                if len(piece) > 2:
                    ends.setdefault(piece[-3:], set()).add(len(piece))
            self.lengths = {end: (*sorted(found, reverse=True), *SHORT) for end, found in ends.items()}
        #: The ids of words, as the bytes of 32-bit numbers.
        self.known: dict[str, bytes] = {}
        self.staying: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        alphabet = set(chain.from_iterable(self.v.pieces))
        # Pieces don't go on from a word into the next mark, nor over characters that no piece has.
        alone = self.alone = "".join(c for c in "\n\r\t" if c not in alphabet)
        self.unit = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        if any(MARK in p[len(p) - len(p.lstrip(MARK)) :] for p in self.v.pieces):
            raise ValueError("a piece goes over the end of a word")
        self.of_byte = {i: b for b, i in enumerate(self.v.byte_ids or [])}
        self.is_byte = np.isin(np.arange(len(self.v.texts)), list(self.of_byte))
        self.worst = min(self.v.scores.values(), default=0.0) - 10

    def merged(self, text: str) -> list[str]:
        """Plain merging: the adjacent pair that makes the best piece, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b, NEVER) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def stay_apart(self, a: str, b: str, key: int) -> bool:
        if len(self.apart) > 2 * REMEMBERED:
            self.apart.clear()
        self.apart[key] = self.merged(a + b) == [a, b]
        return self.apart[key]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) for sorted distinct words. ``begin[i]`` is where the piece begins that ends the best way to the prefix of i characters, ``score[i]`` its sum.

        ``ident[i]`` is the id of that piece, None for a character that no piece has.
        """
        begin, ident, score, before = [0], [None], [0.0], ""
        forward = self._by_score if self.v.unigram else self._by_merges
        for word in words:
            i, n = 0, min(len(word), len(before))
            if word.startswith(before):
                i = n
            while i < n and word[i] == before[i]:
                i += 1
            del begin[i + 1 :], ident[i + 1 :], score[i + 1 :]
            forward(word, i, begin, ident, score)
            before = word
            ids, end = [], len(word)
            while end:
                start = begin[end]
                if ident[end] is None:
                    ids.extend(reversed(self.ids(word[start:end])))
                else:
                    ids.append(ident[end])
                end = start
            ids.reverse()
            yield word, ids

    def _by_score(self, word: str, done: int, begin: list, ident: list, score: list) -> None:
        """Forward scores of the prefixes of ``word`` with more than ``done`` characters: the best sum over all pieces that end there."""
        endings, worst = self.endings.get, self.worst
        for end in range(done + 1, len(word) + 1):
            best, found = end - 1, None
            top = score[best] + worst
            for start in range(best, -1, -1):
                if (entry := endings(word[start:end])) is None:
                    break
                if entry and (total := score[start] + entry[1]) >= top:
                    top, best, found = total, start, entry[0]
            begin.append(best)
            ident.append(found)
            score.append(top)

    def _by_merges(self, word: str, done: int, begin: list, ident: list, score: list) -> None:
        """The last piece of the encoding of each prefix of ``word`` with more than ``done`` characters; scores stay 0."""
        known, good, lengths, apart = self.v.pieces.get, self.good.get, self.lengths.get, self.apart.get
        for end in range(done + 1, len(word) + 1):
            best = end - 1
            if (found := known(word[best])) is not None:
                for n in lengths(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                    start = end - n
                    if start < 0 or (i := good(piece := word[start:end])) is None:
                        continue
                    if start and (prior := ident[start]) is not None:
                        key = prior << 24 | i
                        if (ok := apart(key)) is None:
                            ok = self.stay_apart(word[begin[start] : start], piece, key)
                        if not ok:
                            continue
                    best, found = start, i
                    break
            begin.append(best)
            ident.append(found)
            score.append(0.0)

    def ids(self, piece: str) -> tuple[int, ...]:
        if piece in self.v.pieces:
            return (self.v.pieces[piece],)
        return tuple(self.v.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")) if self.v.byte_ids else (self.v.unknown,)

    def units(self, text: str | None) -> list[str]:
        if text and self.v.squeeze:
            text = " ".join(text.split(" ")).strip(" ") if "  " not in text else re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            # The same units by plain splitting.
            text = (MARK if self.v.dummy_prefix else "") + text.replace(" ", f" {MARK}")
            for c in self.alone:
                text = text.replace(c, f" {c} ")
            return list(filter(None, text.split(" ")))
        return self.unit.findall((MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.units(t) for t in texts]
        if not self.staying and len(self.known) > STAYING:
            self.staying = dict(self.known)
        if len(self.known) > REMEMBERED:
            self.known = dict(self.staying)
        known = self.known
        fresh = set(chain.from_iterable(split)).difference(known)
        known.update((w, array("i", ids).tobytes()) for w, ids in self.walk(sorted(fresh)))
        return [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in split]

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        if ids is None:
            return None
        if isinstance(ids, np.ndarray) and not self.is_byte[ids].any():
            return self._shown("".join(map(self.v.texts.__getitem__, ids.tolist())))
        out, held = [], bytearray()
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.v.texts[i])
        out.append(held.decode("utf-8", "replace"))
        return self._shown("".join(out))

    def _shown(self, text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


@cache
def _encoder(model: bytes, mode: str) -> Encoder:
    return Encoder(model, mode)


def _beside(df: DataFrame, to: str, made: Column) -> DataFrame:
    """``df`` with ``made`` as its column ``to``, in place of one of that name."""
    rest = [c for c in df.columns if c != to]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), made.alias("made")).select("doc.*", F.col("made").alias(to))


def encode(docs: DataFrame, model: bytes, text: str = "text", to: str = "ids", mode: str = VITERBI) -> DataFrame:
    """``docs`` with ``to``: the ids of each whole text; none for a null or empty text. Rows don't depend on each other. A column of that name is replaced.

    ``model`` is the content of a model file, a few MB at most, which goes to the tasks with the plan. Very long words cost as their length times that of
    the longest piece. Of segmentations with equal scores that with the longer last piece is taken, at each step.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model, mode)
        for texts in parts(batches, TEXTS):
            yield pd.Series(encoder.encode(texts.tolist()), dtype=object)

    return _beside(docs, to, F.pandas_udf(run, "array<int>")(text))


def decode(df: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with ``to``: the text of ``ids``; null for null, empty for none. A text comes back as it was, but that U+2581, the mark of a space, is a space."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model, VITERBI)
        for each in parts(batches, TEXTS):
            yield pd.Series([encoder.decode(x) for x in each], dtype=object)

    return _beside(df, to, F.pandas_udf(run, "string")(ids))


def model_bytes(path: str | None = None) -> bytes:
    """A model file, by default the public one that the tokenizers' folder offers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded_documents(docs: DataFrame, path: str | None = None, mode: str = VITERBI) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, round_trip for each row of ``docs(doc_id, text)``; a null text counts as empty and has no ids. Other columns are
    not read, whatever their names. Repeated rows get equal results, an empty table an empty one.

    Encodes and decodes in one pass, texts of about CHARACTERS code points at a time, so that a task holds few ids whatever the size of its batches.
    """
    model = model_bytes(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model, mode)
        for batch in batches:
            group = np.cumsum(batch.text.str.len().to_numpy()) // CHARACTERS
            for at in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(group)) + 1):
                part = batch.iloc[at]
                texts = part.text.tolist()
                ids = encoder.encode(texts)
                same = [encoder.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pd.DataFrame({"doc_id": part.doc_id, "n_chars": [len(t) for t in texts], "n_tokens": [len(x) for x in ids], "ids": pd.Series(ids, part.index, object), "round_trip": same})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars long, n_tokens long, ids array<int>, round_trip boolean")


def op5_pieces(spark, sf_dir):
    return encoded_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
