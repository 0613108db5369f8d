"""Encoding, spans, decoding and normalisation against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lodestone.llm import sentence_pieces
from lodestone.llm.sentence_pieces import MODEL, CharacterMap, Pieces, decode_texts, encode_texts, op12_sentence_pieces, pieces

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n, longest=80):
    draw = random.Random(3)
    letters = " a▁b\n\téﬁ🙂日\0　<s>0x1.-  ▁▁'the of und"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def test_ids_spans_and_decoded_texts_equal_the_library(spark, sf, library):
    known = pieces(PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + odd_texts(3000) + [" " * n for n in range(70)] + ["the" * 30 + " " * 40 + "x" * 50]
    for text, (ids, starts, ends) in zip(texts, known.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert known.decode(ids) == library.decode(ids.tolist())
        assert list(zip(starts[1:-1], ends[1:-1])) == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert (starts[1:] == ends[:-1]).all() and (len(ids) == 2 or ends[-1] == len(text.encode()))


def test_any_ids_decode_as_in_the_library(library):
    known, draw = pieces(PATH), random.Random(4)
    for _ in range(4000):
        ids = [draw.choice([draw.randint(0, 300), draw.randint(0, 31999), 259, 29871, 1, 2, 0]) for _ in range(draw.randint(0, 12))]
        assert known.decode(ids) == library.decode(ids)
    for wrong in ([-1], [32000]):
        with pytest.raises(ValueError):
            known.decode(wrong)


@pytest.mark.parametrize("unit", [" ", "a", "x ", "▁", "\n", "é"])
def test_long_runs(library, unit):
    text = (unit * 200_000)[:200_000]
    assert pieces(PATH).encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


RULES = [dict(), dict(add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=False), dict(add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True), dict(add_dummy_prefix=True, escape_whitespaces=False, remove_extra_whitespaces=False)]


@pytest.mark.parametrize("rule", RULES)
def test_longest_prefix_normalisation_equals_the_library(rule):
    """The library's own compiled map of compatibility forms, under each setting."""
    plain = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", **rule)
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    model.normalizer_spec.CopyFrom(sentencepiece_model_pb2.ModelProto.FromString(plain.serialized_model_proto()).normalizer_spec)
    ours, draw = Pieces(model.SerializeToString()), random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice(" aeﬁｱ½́ 　\t\nÅ가가…ｶﾞé\u200b한") for _ in range(draw.randint(0, 20)))
        want, places = plain.Normalize(text, with_offsets=True)
        got, aligned = ours.normalise(text)
        bytes_before = np.cumsum([0] + [len(c.encode()) for c in text])
        at = np.cumsum([0] + [len(c.encode()) for c in got])
        assert got == want and aligned[at].tolist() == bytes_before[places].tolist()


def test_spans_are_those_of_the_source_where_the_map_changes_lengths():
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = sentencepiece_model_pb2.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    assert CharacterMap(blob).longest("ﬁx".encode(), 0) == (3, b"fi") and not CharacterMap()
    ids, starts, ends = Pieces(model.SerializeToString(), blob).encode("ﬁne ½")
    source = "ﬁne ½".encode()
    assert b"".join(source[a:b] for a, b in zip(starts, ends)) == source
    assert pieces(PATH).decode(ids) == "fine 1⁄2"


def test_unsuitable_models_are_an_error():
    model = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        Pieces(model.SerializeToString())


def test_a_full_table_of_parts_is_emptied(monkeypatch, library):
    monkeypatch.setattr(sentence_pieces, "KEPT", 50)
    known = Pieces(open(PATH, "rb").read())
    for text in odd_texts(200, 400):
        assert known.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "a  b é"), (3, "a  b é"), (4, "word " * 100_000)]
    df = spark.createDataFrame([(i, t, "c", [1]) for i, t in rows], "doc_id long, text string, source_text string, ids array<int>")
    got = encode_texts(df, keep=("doc_id", "source_text")).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 3), (1, 2), (2, 2), (3, 6), (3, 6), (4, 100_003)]
    assert all(r.source_text == "c" and len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    assert encode_texts(df.limit(0)).count() == 0
    packed = encode_texts(df, packed=True, decode=True)
    assert all(r.decoded == r.again for r in packed.select("decoded", decode_texts(packed.ids).alias("again")).collect())
    assert encode_texts(df, keep=("text", "doc_id")).filter("doc_id = 2").first().text == ""


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op12_sentence_pieces(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
