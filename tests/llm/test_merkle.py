"""The manifest against a plain tree and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from lodestone.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, at long, tree int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """The root, and for each leaf its sibling digests (before, after) by level."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, k in enumerate(at):
            run = runs[k // fanout]
            paths[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [k // fanout for k in at]
    return level[0], paths


def plain(rows, fanout=8):
    """Rows (doc_id, source, lang, n_chars, text) as the query gives them."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[k] = plain_tree([plain_leaf(r) for r in groups[k]], fanout)
    root, tops = plain_tree([trees[k][0] for k in order], fanout)
    out = []
    for k, top in zip(order, tops):
        for r, path in zip(groups[k], trees[k][1]):
            folded = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                folded = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            proof = sha("".join(b + a for b, a in path + top))
            for b, a in path + top:
                folded = sha(b + folded + a)
            out.append((r[0], plain_leaf(r), trees[k][0], root, proof, folded, folded == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("fanout, part, sizes", [(8, 100_000, (1, 8, 9, 63)), (8, 7, (1, 64, 65, 130)), (2, 5, (1, 2, 3, 33)), (3, 1, (27, 28))])
def test_unaligned_partitions_equal_a_plain_tree(spark, fanout, part, sizes):
    draw = random.Random(fanout)
    rows = [(draw.randrange(10**6), "s", f"l{i}", 3, f"Text {draw.random()} É") for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert ordered(merkle.manifest(df, part=part, fanout=fanout).collect()) == ordered(plain(rows, fanout))


def test_odd_rows(spark):
    long = "Long " * 200_000
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (2, "a", "de", 1, long)] + [(3, "a", "en", 2, "Copy")] * 40 + [(3, "a", "en", 2, "Other"), (-5, "ü", "én", -7, "X")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert ordered(merkle.manifest(df, part=10).collect()) == ordered(plain(rows))
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df.filter("doc_id = 1")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_node_records_are_all_nodes(spark):
    rows = spark.range(0, 300).selectExpr("'t' tree", "id", "unhex(sha2(cast(id as string), 256)) leaf")
    forest = merkle.Forest(rows, ["id"], part=23)
    got = {(r.level, r.idx): r.node for r in forest.nodes().collect()}
    level, want, depth = [sha(str(i)) for i in range(300)], {}, 0
    while len(level) > 1:
        level, depth = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], depth + 1
        want |= {(depth, i): h for i, h in enumerate(level)}
    assert got == want and forest.nodes().count() == len(want) and forest.roots.first().root == level[0]


def test_mountain_range():
    whole = merkle.MountainRange()
    for i in range(70):
        whole.push(i, sha(str(i)))
    whole.close()
    assert [(level, i) for level, i, _ in whole.nodes] == [(1, i) for i in range(8)] + [(2, 0)]
    assert sorted((level, i) for level, i, _ in whole.edges) == [(0, i) for i in range(64, 70)] + [(2, 0)]
    later = merkle.MountainRange()
    for i in range(5, 17):
        later.push(i, sha(str(i)))
    later.close()
    assert [(level, i) for level, i, _ in later.nodes] == [(1, 1)]
    assert sorted((level, i) for level, i, _ in later.edges) == [(0, 5), (0, 6), (0, 7), (0, 16), (1, 1)]


def test_query_equals_a_plain_tree_and_its_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = merkle.op13_merkle(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert ordered(got.collect()) == ordered(plain(rows)) == ordered(con.sql(merkle.oracle_op13()).select(*got.columns).fetchall())
    assert {r[-1] for r in plain(rows)} == {True, False}
