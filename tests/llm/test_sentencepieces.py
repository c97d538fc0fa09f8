"""SentencePiece encoding against the library: ids, spans, decoded texts, and normalisers with a compiled character map."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from docspark.llm.queries import QUERIES
from docspark.llm.sentencepieces import SPACE, Normaliser, Pieces, compiled_rules, sentencepiece_decode, sentencepiece_encode

PATH = str(P.path("piece_bpe_32k.model"))
FIXED = ["", " ", "   ", SPACE, f"a{SPACE}b {SPACE}", "<s></s><unk><0x41>", "﻿abc", "the  quick   brown" + " " * 40 + "fox", "�", "\x00", "é" * 300, "ab" * 200, "  x  "]
ALPHABET = f" {SPACE}\t\n\x00abcdeéßñ漢字😀①ﬁ.,<s>0x41́"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return Pieces(file.read())


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    some = ["".join(dice.choice(ALPHABET) for _ in range(dice.randint(0, 150))) for _ in range(400)]
    wide = ["".join(chr(dice.choice([dice.randint(1, 0xD7FF), dice.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(200)]
    return FIXED + some + wide


def test_ids_spans_and_texts_are_the_library_s(model, library, texts):
    for text in texts:
        ids, bounds = model.encode(text)
        assert ids.tolist() == library.encode(text)
        assert list(zip(bounds[:-1].tolist(), bounds[1:].tolist())) == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert model.decode([1, *ids.tolist(), 2]) == library.decode([1, *ids.tolist(), 2])


def test_long_chunks_merge_alike_by_queue(model, texts):
    for text in texts:
        assert model._merged_by_queue(list(text)) == [s for s in model._merged_by_queue(list(text))]
        if 1 < len(text) <= 100:
            assert model._merged_by_queue(list(text)) == model._merged(text)


def test_any_ids_decode_as_in_the_library(model, library):
    dice = random.Random(6)
    for _ in range(1000):
        ids = [dice.randint(0, 31_999) if dice.random() < 0.5 else dice.randint(0, 300) for _ in range(20)]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_character_maps(rule, texts):
    from sentencepiece import sentencepiece_model_pb2

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec
    ours = Normaliser(compiled_rules(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    for text in texts:
        made, place = ours(text)
        want, offsets = theirs.normalize(text, with_offsets=True)
        assert made == want
        assert [len(text.encode()[:p].decode()) for p in place] == list(offsets)


def test_operator_on_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (5, "one"), (6, "word  " * 30_000), (7, "Ünï 😀"), (None, "no id"), (8, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("bounds", F.lit(1))
    got = sentencepiece_decode(sentencepiece_encode(docs, PATH), PATH).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((i, np.array([1, *library.encode(t or ""), 2], "<u4").tobytes()) for i, t in rows), key=key)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=key) == want
    texts = {r.doc_id: r for r in got}
    for i, text in rows:
        row = texts[i]
        assert row.decoded == (text or "")
        assert row.bounds[0] == row.bounds[1] == 0 and row.bounds[-1] == row.bounds[-2] == len((text or "").encode()) and len(row.bounds) == len(row.ids) // 4 + 1
    assert sentencepiece_decode(sentencepiece_encode(docs.limit(0), PATH), PATH).count() == 0


def test_query_covers_every_byte(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_sentencepiece"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in got} == {i: (len(library.encode(t or "")) + 2, len((t or "").encode())) for i, t in docs.items()}
