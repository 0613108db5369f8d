import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import neighbours


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    out = {}
    for i, q in queries:
        far = np.sqrt(((v - np.array(q, np.float64)) ** 2).sum(axis=1))
        best = [b for b in np.lexsort((ids, far)) if ids[b] != i][:k]
        out[i] = [(int(ids[b]), float(far[b])) for b in best]
    return out


def test_small_table_is_exact(spark):
    """Fewer rows than candidates wanted: the forest ascends to the root."""
    draw = np.random.default_rng(0)
    rows = [(i, [float(x) for x in draw.standard_normal(8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # one vector, many rows
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [1.0] * 6), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] * 8), (905, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd + rows[:1]], "vec_id long, embedding array<double>, shard string, rank int")
    got = neighbours.nearest(neighbours.forest_index(df), df.filter("vec_id % 3 = 0"), miss=0.0).collect()
    want = exact(rows, [r for r in rows if r[0] % 3 == 0], 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.isclose(a[1], b[1], rtol=1e-12) for q in want for a, b in zip(found[q], want[q]))
    assert neighbours.nearest(neighbours.forest_index(df.limit(0)), df.limit(0)).count() == 0


def test_prefixes_descend_and_ascend():
    draw = np.random.default_rng(2)
    v = draw.standard_normal((500, 16))
    forest = neighbours.Forest.build(np.arange(500), v, trees=6)
    q = neighbours.hash_strings(v[:20], 6)
    assert (forest.longest(q) == neighbours.BITS).all()  # each finds itself
    for depth in (0, 3, 9):
        lo, hi = forest.ranges(q, depth)
        for t in range(6):
            for j in range(20):
                same = {int(i) for i in range(500) if int(neighbours.hash_strings(v[i : i + 1], 6)[t, 0]) >> (64 - depth) == int(q[t, j]) >> (64 - depth)} if depth < 9 and j < 2 else None
                mine = {int(i) for i in forest.order[t][lo[t, j] : hi[t, j]]}
                assert same is None or mine == same
    again = neighbours.Forest.unpack(forest.pack())
    assert (again.strings == forest.strings).all() and (again.vectors == v).all()


def test_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    index = neighbours.forest_index(vectors, shard=700)
    got = neighbours.nearest(index, vectors.filter(F.col("vec_id") % 100 == 0)).collect()
    hits = sum((r.vec_id in {i for i, _ in want[r.query_id]}) for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def _recall_and_share(x):
    """Recall of ten and the share of rows ranked, in one production shard."""
    forest, ids = neighbours.Forest.build(np.arange(len(x)), x), np.arange(0, len(x), 40)
    got, ranked = forest.search(ids, x[ids], 10)
    want = exact(list(enumerate(x)), [(i, x[i]) for i in ids], 10)
    hits = sum(i in {w for w, _ in want[q]} for q, i, _ in got)
    return hits / sum(map(len, want.values())), ranked / len(ids) / len(x)


def test_recall_of_a_full_shard():
    """As many vectors as a production shard has, of one norm and of many."""
    draw = np.random.default_rng(5)
    v = draw.standard_normal((neighbours.SHARD, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for scale in (np.ones(len(v)), draw.lognormal(0, 0.5, len(v))):
        recall, share = _recall_and_share(v * scale[:, None])
        assert recall >= 0.9


def test_near_neighbours_end_the_ascent_early():
    draw = np.random.default_rng(6)
    centres = draw.standard_normal((neighbours.SHARD // 32, 64))
    v = np.repeat(centres, 32, axis=0) + 0.2 * draw.standard_normal((neighbours.SHARD, 64))
    recall, share = _recall_and_share(v)
    assert recall >= 0.9 and share < 0.1


def test_recall_of_the_query(spark, tmp_path):
    """The registered query on more vectors than one shard holds."""
    draw = np.random.default_rng(7)
    v = draw.standard_normal((neighbours.SHARD + 2000, 32))
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = neighbours.op1_prefix_forest(spark, str(tmp_path)).collect()
    want = exact(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert len(got) == 10 * len(want) and all(1 <= r.rank <= 10 for r in got)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * len(got)
    true = {(q, i): far for q, near in want.items() for i, far in near}
    assert all(abs(r.score - true[r.query_id, r.vec_id]) < 1e-9 for r in got if (r.query_id, r.vec_id) in true)


def test_a_shard_goes_once_to_a_group_of_query_blocks(spark, monkeypatch):
    """No join repeats the packed shards for each block of queries."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "MEET", 3)
    draw = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.standard_normal((150, 8)))], "vec_id long, embedding array<double>")
    index = neighbours.written(neighbours.forest_index(vectors, shard=40), "index")
    found = neighbours.nearest(index, vectors, k=3, miss=0.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
    base = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: sorted((i for i in base if i != q), key=lambda i: (np.linalg.norm(base[i] - v), i))[:3] for q, v in base.items()}
