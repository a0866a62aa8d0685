"""Unigram pieces and packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loadweave.llm import packing, pieces
from loadweave.llm.catalog import QUERIES
from tests.llm.helpers import empty_documents, odd_documents, odd_texts, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "日本 x\n\ny", "é ﬁ Ⅷ \U0001f600́", "tab\there", "a" * 300, "\n \n", "It's 12½ don't we'll İ ß ΟΔΟΣ \x1c ǅ x y"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def test_trie_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), bytes([0, 255]), b"ba"]
    trie = pieces.DoubleArray(keys, list(range(len(keys))))
    assert list(trie.matches(b"abcd", 0)) == [(1, 0), (2, 1), (3, 2)]
    assert list(trie.matches("xé".encode(), 1)) == [(3, 4)] and list(trie.matches(bytes([0, 255]), 0)) == [(2, 5)]
    assert not list(trie.matches(b"zz", 0)) and not list(trie.matches(bytes([0]), 0))


def test_viterbi_equals_the_library_on_the_same_scores(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1  # unigram
    for i, piece in enumerate(model.pieces):
        piece.score = vocabulary.scores[i] / pieces.GRAIN if piece.type == 1 else 0
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng, encode = random.Random(1), pieces.Encoder(vocabulary)
    texts = ODD + [prose(rng, 40) for _ in range(50)] + ["".join(rng.choice("thean ▁\ncé日") for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(encode(text), "<u4").tolist()
        assert ids == library.encode(text)
        assert pieces.decode_ids(ids, vocabulary) == text.replace(pieces.MARK, " ")


def test_encoding_in_one_run_is_the_same(vocabulary):
    whole = pieces.Vocabulary(**{**vars(vocabulary), "cut": None})
    for text in ODD + [prose(random.Random(3), 60)]:
        assert pieces.Encoder(whole)(text) == pieces.Encoder(vocabulary)(text)


def test_query_round_trip(spark):
    rows = QUERIES["op4_unigram_viterbi"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.round_trip and r.decoded_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in rows)


def test_encode_odd_rows(spark):
    docs = odd_documents(spark).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = pieces.decoded(pieces.encoded(docs, PIECES), PIECES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in rows) == sorted((i is None, i or 0, t or "") for i, t in odd_texts())
    assert pieces.encoded(empty_documents(spark), PIECES).count() == 0


def test_tokens_equal_the_tokenizer():
    tokens, rng = packing.Tokens(WORDS), random.Random(5)
    texts = ODD + ["a<|endoftext|>b <|x", "é ́x", prose(rng, 50)] + [
        "".join(rng.choice("abÉç'sßİΣσ日 \n\t.,-_1½<|>́") for _ in range(80)) for _ in range(200)]
    for text, want in zip(texts, tokens.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(tokens(text), "<u4").tolist() == want.ids


def packed_right(rows, docs, length=4096) -> None:
    tokens, want = packing.Tokens(WORDS), []
    for doc, text in docs:
        ids = np.r_[np.frombuffer(tokens(text), "<u4"), 1].astype("<u4")
        want += [(doc, k, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for k, s in enumerate(range(0, len(ids), length))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    total = sum(w[3] for w in want)
    assert len(by_sequence) <= 1.1 * total / length + 2


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    packed_right(QUERIES["op8_vector_best_fit"](spark, "/root/testdata/sf0.001").collect(), docs)


def test_packing_odd_rows(spark):
    docs = odd_documents(spark).withColumn("sequence_id", F.lit("x")).withColumn("piece", F.lit(1))
    packed_right(packing.packed(packing.pieces(docs, WORDS)).collect(), odd_texts())
    assert packing.packed(packing.pieces(empty_documents(spark), WORDS)).count() == 0
    with_ids = packing.pieces(docs, WORDS, keep_ids=True).collect()
    assert all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in with_ids)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_obeys_every_constraint(rule):
    lengths = np.random.default_rng(4).integers(1, 900, 2000)
    capacity = packing.Capacity(tokens=2000, documents=4, attention=1_500_000, weights=(1, 1, 1), rule=rule)
    at = packing.best_fit(lengths, capacity)
    for s in range(at.max() + 1):
        own = lengths[at == s]
        assert own.sum() <= 2000 and 1 <= len(own) <= 4 and (own**2).sum() <= 1_500_000
    assert at.max() + 1 <= 1.25 * max(lengths.sum() / 2000, len(lengths) / 4, (lengths**2).sum() / 1_500_000)


def test_piece_beyond_a_capacity_is_alone():
    at = packing.best_fit(np.array([10, 3, 3]), packing.Capacity(tokens=16, documents=9, attention=50))
    assert at[0] not in at[1:] and at[1] == at[2]
