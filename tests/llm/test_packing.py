import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing


def test_ids_equal_the_tokenizers_library(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "\n\n  x\t\t", "a<|endoftext|>b", "<|endoftext|>", "日本語 ñandú 🙂‍", "don't I'LL we've", "x" * 5_000, "1234567890 " * 50]
    for t in texts:
        assert packing.ids_of(t, path) == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "\u00a0", "a", "7", "!", " a", "\n \t", "<|endoftext|>", "x      "])
def test_two_million_characters_of_a_kind(unit):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = (unit * 2_000_000)[:2_000_000]
    assert packing.ids_of(text, path) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_long_white_space_repeated_rows_and_null_ids_are_packed(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, " " * 1_500_000), (None, "no id"), (None, "no id")] + [(7, "copy of a row")] * 500
    got = packing.pack_documents(spark.createDataFrame([(i, t, 3, 0.5) for i, t in rows], "doc_id long, text string, salt int, offset double")).collect()
    assert sum(r.length for r in got) == sum(len(packing.ids_of(t, path)) + 1 for _, t in rows)
    assert sum(r.doc_id == 7 for r in got) == 500 and sum(r.doc_id is None for r in got) == 2
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(s)[-1][0] + sorted(s)[-1][1] == sum(n for _, n in s) <= 2048 and len({o for o, _ in s}) == len(s) for s in spans.values())


def test_cut():
    for n in (1, 5, 2047, 2048, 2049, 4096, 5000):
        parts = packing.cut(n, 2048)
        assert [s for s, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))]
        assert sum(x for _, x in parts) == n and all(x == 2048 for _, x in parts[1:])


def test_combinations_use_up_all_and_fill():
    draw = random.Random(2)
    for capacity in (10, 64, 2048):
        counts = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(60)}
        made = packing.combinations(counts, capacity)
        used = {}
        for bins, lengths in made:
            assert bins > 0 and sum(n * t for n, t in lengths) <= capacity
            for n, t in lengths:
                used[n] = used.get(n, 0) + bins * t
        assert used == counts
        least = -(-sum(n * c for n, c in counts.items()) // capacity)
        assert sum(b for b, _ in made) <= least * 1.25 + 2
    assert packing.combinations({}, 8) == []


def test_fullest_is_best():
    draw = random.Random(9)
    for _ in range(300):
        have = sorted({draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}.items())
        room = draw.randint(0, 70)
        sums = {0}
        for n, c in have:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = packing._fullest(room, have)
        assert sum(n * t for n, t in used) == max(s for s in sums if s <= room)
        assert all(t <= dict(have)[n] for n, t in used)


def check(rows, docs, ids_of, capacity):
    """Every token of every document is in one place of one sequence."""
    by_doc, spans = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = ids_of(text)
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(p.start, p.length) for p in parts] == packing.cut(len(ids), capacity)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans), sum(n for p in spans.values() for _, n in p)


def test_documents(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(1)
    texts = [None, "", "same text"] + ["same text"] * 40 + [" ".join(draw.choice("lorem ipsum dolor sit amet".split()) for _ in range(draw.randint(1, 300))) for _ in range(80)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in docs], "doc_id long, text string, piece int, length int")
    ids_of = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [0]
    n, tokens = check(packing.pack_documents(df, capacity=64).collect(), docs, ids_of, 64)
    assert n <= 1.05 * tokens / 64 + 2
    whole = packing.sequences(packing.pack_documents(df, capacity=64, ids=True))
    assert sum(len(r.ids) for r in whole.collect()) == tokens
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_query_is_tight(spark, sf):
    rows = packing.op5_packing(spark, sf).collect()
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-tokens // 2048) + 2
