import random
import re

import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.graphs import components

SCHEMA = "doc_id long, text string, fp string, node string"


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_documents_equal_brute_force(spark):
    draw = random.Random(3)
    base = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \t", "One", "one", "a b c", "A B C D", "é É ß x", "long " * 40_000]
    for b in base:
        for _ in range(6):
            words = b.split()
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == classes(prints, 4)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 2**63, 300, dtype=np.uint64)
    for i in range(150):  # chains of small changes
        prints[150 + i] = prints[draw.integers(0, 150 + i)] ^ np.uint64(sum(1 << int(k) for k in draw.integers(0, 63, draw.integers(1, 6))))
    prints = np.unique(prints)
    rows = [(int(p).to_bytes(8, "big"), int(p.astype(np.int64)), int(p).bit_count()) for p in prints]
    table = spark.createDataFrame(rows, "fp binary, node long, ones int")
    for tile in (65536, 40):
        links = simhash.fingerprint_links(table, 4, tile=tile)
        root = {r.node: r.root for r in components(links).collect()}
        want = classes([int(p) for p in prints], 4)
        mine = [root.get(r[1], r[1]) for r in rows]
        pairs = lambda c: {frozenset(i for i in range(len(c)) if c[i] == v) for v in set(c)}
        assert pairs(mine) == pairs(want)


def test_wide_prints(spark):
    draw = random.Random(4)
    words = [f"v{draw.randint(0, 10_000)}" for _ in range(400)]
    near, far = list(words), list(words)
    for k in range(0, 400, 100):
        near[k] = "changed"
    for k in range(0, 400, 10):
        far[k] = "changed"
    rows = [(5, " ".join(words)), (9, " ".join(near)), (7, " ".join(far)), (5, " ".join(words)), (11, None), (12, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [5, 7, 11]


def test_rows_that_share_an_id(spark):
    text = " ".join(f"q{k}" for k in range(40))
    rows = [(1, text, "a"), (1, "something else of five words", "b"), (3, text, "c"), (3, "yet another text of more words", "d"), (None, text + " end", "e"), (None, "a text without an id here", "f"), (None, "a text without an id here", "g")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    found = sorted(r.node for r in kept.collect())
    assert found in (["b", "d", "e", "f"], ["b", "d", "e", "g"])
    assert simhash.keep_one(kept.limit(0)).count() == 0


def test_sieve_flags_all_that_is_listed(spark):
    ids = spark.range(0, 5000, 7).toDF("id")
    docs = spark.range(5000).toDF("doc_id")
    got = {r.doc_id: r.hit for r in simhash.sieve(ids, docs, "doc_id", "hit").collect()}
    assert len(got) == 5000 and all(got[i] for i in range(0, 5000, 7)) and sum(got.values()) < 800
    assert not any(r.hit for r in simhash.sieve(ids.limit(0), docs, "doc_id", "hit").collect())


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 90)] + [(3, 3), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(90)}


def five_words(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows, similarity=0.8):
    """The smallest id of each group that pairs of such a Jaccard similarity
    connect, with the number of pairs from 0.7 to 0.9 on both sides."""
    sets = [five_words(t) for _, t in rows]
    group, below, above = list(range(len(rows))), 0, 0
    for i in range(len(rows)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            below += 0.7 * every <= both < similarity * every
            above += similarity * every <= both < 0.9 * every
            if both >= similarity * every:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted({min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in group}), below, above


def test_kept_rows_equal_brute_force_jaccard(spark):
    draw = random.Random(8)
    texts = ["one two three four five six seven eight", "one two three four five six seven eight nine"]  # 4 of 5 shingles
    for _ in range(150):
        n = draw.choice((30, 60, 300))
        words = [f"x{draw.randint(0, 100_000)}" for _ in range(n)]
        other = list(words)
        for k in draw.sample(range(2, n - 2), max(1, round(n * draw.uniform(0.011, 0.036)))):
            other[k] = f"y{draw.randint(0, 100_000)}"
        texts += [" ".join(words), " ".join(other)]
    rows = list(enumerate(texts))
    want, below, above = kept_by_brute_force(rows)
    assert below > 20 and above > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for part_bytes in (simhash.PART, 1500):  # and with components dealt into parts
        assert sorted(r.doc_id for r in simhash.keep_one(docs, part_bytes=part_bytes).collect()) == want


def test_pages_with_one_repeated_line_stay(spark):
    draw = random.Random(9)
    line = " ".join(f"menu{k}" for k in range(8))
    texts = []
    for _ in range(20):
        own = [f"z{draw.randint(0, 100_000)}" for _ in range(336)]
        texts.append("\n".join(" ".join(own[k * 18 : k * 18 + 18]) + " " + line + " ." for k in range(18)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 20
