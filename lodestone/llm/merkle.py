"""Merkle manifest of a dataset: one tree of digests for each group of rows, and
a tree over the groups.

Rows are put in order by ranges, so each partition holds consecutive leaves, and
counts of the partitions give every leaf its index. A partition pushes its
leaves onto a mountain range: a stack with one open run of nodes a level, as the
digits of a number in base FANOUT. A run that fills up carries: its digest is a
node record and joins the run above. Runs that began in an earlier partition, or
are open at the partition's end, are its edges: a few nodes a level. Edges of
all partitions meet level by level in joins of a run's nodes, where short last
runs close too, without padding. What a leaf needs for its proof is then the
runs that its partition closed and the few that it shares with others.

Digests are lower-case hex of SHA-256; those of a run are joined as text. Ranges
are cut by group, order, leaf and a written random number, so that neither a
group nor a row that a third of all rows repeat is a task of its own. The number
of levels, and so of rounds, is the logarithm of the rows.

Defined cases: a null field is "-", unlike an empty one; rows without an id come
first in their group, and rows of one id go by their leaf; a repeated row is a
leaf each time, with a proof of its own; a null group is the first one; a group
of one row has that leaf as its root, and a table of one group has that group's;
an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, written

FANOUT = 8
#: Leaves of an indexed partition, on average at most.
PART = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows are picked for the tampering test by this divisor of their id's checksum.
TAMPER = 3
#: The part of Spark's increasing ids that is the place within a partition.
PLACE = (1 << 33) - 1
PATH = "array<struct<before:string,after:string>>"
KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), PATH: pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """Byte count, colon and value; a null is a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


class MountainRange:
    """The stack of a partition's part of one tree: an open run for each level."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.open: list[list[str]] = []
        self.first: list[int] = []
        #: (level, index, digest) of completed nodes, and of nodes whose run
        #: another partition shares.
        self.nodes: list[tuple[int, int, str]] = []
        self.edges: list[tuple[int, int, str]] = []

    def push(self, index: int, node: str) -> None:
        level = 0
        while True:
            if level == len(self.open):
                self.open.append([])
                self.first.append(index)
            run = self.open[level]
            if not run:
                self.first[level] = index
            run.append(node)
            if (index + 1) % self.fanout:
                return
            if len(run) < self.fanout:  # it began in an earlier partition
                self._leave(level)
                return
            node = digest("".join(run))
            run.clear()
            level, index = level + 1, index // self.fanout
            self.nodes.append((level, index, node))

    def _leave(self, level: int) -> None:
        self.edges += [(level, self.first[level] + i, node) for i, node in enumerate(self.open[level])]
        self.open[level].clear()

    def close(self) -> None:
        for level in range(len(self.open)):
            self._leave(level)


def climb(leaves: list[str], start: int, total: int, shared: dict[tuple[int, int], list[str]], fanout: int = FANOUT) -> Iterator[list[tuple[str, str]]]:
    """For each of these consecutive leaves of a tree, level by level the
    digests of its run before and after its own node, joined. shared: runs by
    level and number that reach beyond these leaves."""
    levels: list[tuple[int, list[list[str]]]] = []
    nodes, at, width = leaves, start, total
    while width > 1:
        first, runs = at // fanout, []
        for run in range(first, (at + len(nodes) - 1) // fanout + 1):
            own = nodes[max(run * fanout - at, 0) : (run + 1) * fanout - at]
            runs.append(shared.get((len(levels), run), own))
            if len(runs[-1]) != min(fanout, width - run * fanout):
                raise ValueError("a run of the tree is incomplete")
        levels.append((first, runs))
        nodes, at, width = [digest("".join(r)) for r in runs], first, -(-width // fanout)
    path: list[tuple[str, str]] = []
    for index in range(start, start + len(leaves)):
        known, mine, here = path, [], index
        for level, (first, runs) in enumerate(levels):
            run, place = divmod(here, fanout)
            if level and index > start and here == (index - 1) // fanout**level:  # the ancestors from here on are those of the leaf before
                mine += known[level:]
                break
            members = runs[run - first]
            mine.append(("".join(members[:place]), "".join(members[place + 1 :])))
            here = run
        path = mine
        yield path


class Forest:
    """Trees of the rows (tree, leaf, order..., others): written tables of the
    ordered leaves, of all nodes above them, of shared runs and of roots."""

    def __init__(self, rows: DataFrame, order: list[str], part: int = PART, fanout: int = FANOUT):
        self.fanout = fanout
        rows = written(rows.withColumn("salt", F.rand()), "leaves")
        parts = max(-(-rows.count() // part), rows.sparkSession.sparkContext.defaultParallelism)
        keys = ["tree", *order, "leaf", "salt"]
        ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
        self.leaves = written(ordered.withColumn("part", F.shiftright("at", 33).cast("int")).drop("salt"), "ordered")
        many = self.leaves.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("at"))
        tree = Window.partitionBy("tree")  # a row for each partition of a tree
        start = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        self.segments = written(many.select("tree", "part", "at", "n", start.alias("start"), F.sum("n").over(tree).alias("total")), "segments")
        self._records = written(self._ranges(), "nodes")
        self._merge()

    def _ranges(self) -> DataFrame:
        """(tree, total, level, idx, node, edge) of every partition."""
        fanout = self.fanout
        schema = "tree string, total bigint, level int, idx bigint, node string, edge boolean"
        names = [f.split()[0] for f in schema.split(", ")]

        def push(key, leaves: pa.Table, segments: pa.Table) -> pa.Table:
            leaves, out = leaves.sort_by("at")["leaf"].to_pylist(), []
            for seg in segments.sort_by("at").to_pylist():
                ranges, first = MountainRange(fanout), seg["at"] & PLACE
                for i in range(seg["n"]):
                    ranges.push(seg["start"] + i, leaves[first + i].hex())
                ranges.close()
                out += [(seg["tree"], seg["total"], *n, edge) for found, edge in ((ranges.nodes, False), (ranges.edges, True)) for n in found]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)

        return self.leaves.select("part", "at", "leaf").groupBy("part").cogroup(self.segments.groupBy("part")).applyInArrow(push, schema)

    def _merge(self) -> None:
        """Level by level, edges and the nodes made of edges below them become
        runs; a level of one node is a root."""
        fanout, edges = self.fanout, self._records.filter("edge").drop("edge")
        many = lambda level: F.expr(f"total > {fanout**level}")
        most = self.segments.agg(F.max("total")).first()[0] or 0
        self.runs = edges.sparkSession.createDataFrame([], "tree string, level int, run bigint, members array<string>")
        roots, now, self.depth = [], edges.filter("level = 0"), 0
        while True:
            level = self.depth
            roots.append(now.filter(~many(level)).select("tree", F.col("node").alias("root")))
            if most <= fanout**level:
                break
            members = F.sort_array(F.collect_list(F.struct("idx", "node")))  # FANOUT at most
            met = now.filter(many(level)).groupBy("tree", "total", F.expr(f"idx div {fanout}").alias("run")).agg(F.transform(members, lambda m: m["node"]).alias("members"))
            met = written(met, "runs")
            self.runs = self.runs.union(met.select("tree", F.lit(level), "run", "members"))
            self.depth += 1
            above = met.select("tree", "total", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.sha2(F.array_join("members", ""), 256).alias("node"))
            now = above.unionByName(edges.filter(F.col("level") == level + 1))
        self.roots = written(reduce(DataFrame.union, roots), "roots")

    def nodes(self) -> DataFrame:
        """(tree, level, idx, node): every node above the leaves."""
        closed = self._records.filter("not edge").select("tree", "level", "idx", "node")
        return closed.union(self.runs.select("tree", F.col("level") + 1, "run", F.sha2(F.array_join("members", ""), 256)))

    def frames(self) -> DataFrame:
        """(part, tree, at, n, start, total, shared): the shared runs that a
        partition's part of a tree needs, two a level at most."""
        ends = [F.struct(F.lit(level).alias("level"), F.expr(f"{end} div {self.fanout ** (level + 1)}").alias("run")) for level in range(self.depth) for end in ("start", "(start + n - 1)")]
        if not ends:
            return self.segments.withColumn("shared", F.lit(None).cast("array<struct<level:int,run:bigint,members:array<string>>>"))
        need = self.segments.select("tree", "part", F.explode(F.array_distinct(F.array(*ends))).alias("end")).select("tree", "part", "end.*")
        shared = need.join(self.runs, ["tree", "level", "run"]).groupBy("tree", "part").agg(F.collect_list(F.struct("level", "run", "members")).alias("shared"))
        return self.segments.join(shared, ["tree", "part"], "left")

    def walk(self, frames: DataFrame, columns: list[str], made: Callable[[dict, list, dict], tuple], schema: dict[str, str]) -> DataFrame:
        """The rows made(row, path, frame) of all leaves: row has the leaf and
        these columns of it, path is that of climb()."""
        fanout, kinds = self.fanout, pa.schema([(name, KINDS[kind]) for name, kind in schema.items()])

        def proofs(key, leaves: pa.Table, frames: pa.Table) -> pa.Table:
            rows, out = leaves.sort_by("at").select(["leaf", *columns]).to_pylist(), []
            for frame in frames.sort_by("at").to_pylist():
                first = frame["at"] & PLACE
                mine = rows[first : first + frame["n"]]
                shared = {(s["level"], s["run"]): s["members"] for s in frame["shared"] or []}
                paths = climb([r["leaf"].hex() for r in mine], frame["start"], frame["total"], shared, fanout)
                out += [made(row, path, frame) for row, path in zip(mine, paths)]
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds.types)], schema=kinds)

        ddl = ", ".join(f"{name} {kind}" for name, kind in schema.items())
        return self.leaves.select("part", "at", "leaf", *columns).groupBy("part").cogroup(frames.groupBy("part")).applyInArrow(proofs, ddl)


def tree_key(column: str) -> Column:
    """Groups by name, a null one first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def manifest(docs: DataFrame, id: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS, text: str = "text", tamper: int = TAMPER, part: int = PART, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the place
    of each row in the tree, and whether the row still leads to the root after
    the text of those whose id's checksum `tamper` divides is lower-cased."""
    values = [F.col(c) for c in fields]
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in fields]
    picked = F.crc32(F.col(id).cast("string").cast("binary")) % tamper == 0
    rows = docs.select(tree_key(tree).alias("tree"), F.col(id).alias("id"), leaf(values).alias("leaf"), F.when(picked, leaf(changed)).alias("tampered"))
    forest = Forest(rows, ["id"], part, fanout)
    top = Forest(forest.roots.select(F.lit("").alias("tree"), F.unhex("root").alias("leaf"), F.col("tree").alias("of")), ["of"], part, fanout)
    above = top.walk(top.frames(), ["of"], lambda row, path, frame: (row["of"], row["leaf"].hex(), [{"before": b, "after": a} for b, a in path]), {"tree": "string", "subroot": "string", "above": PATH})
    frames = forest.frames().join(above, "tree").crossJoin(F.broadcast(top.roots.select("root")))  # one row

    def prove(row: dict, path: list, frame: dict) -> tuple:
        path = path + [(p["before"], p["after"]) for p in frame["above"]]
        folded = (row["tampered"] or row["leaf"]).hex()
        for before, after in path:
            folded = digest(before + folded + after)
        proof = digest("".join(before + after for before, after in path))
        return row["id"], row["leaf"].hex(), frame["subroot"], frame["root"], proof, folded, folded == frame["root"]

    names = dict(id=docs.schema[id].dataType.simpleString(), leaf="string", subroot="string", root="string", proof_sha256="string", folded_root="string", verified="boolean")
    return forest.walk(frames, ["id", "tampered"], prove, names).withColumnRenamed("id", id)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def oracle_op13() -> str:
    made = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    # the checksum by shifts, eight for each digit
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, d: list_reduce(list_prepend(xor(a, d), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
    grown = lambda name, base: f"""
{name}(k, level, idx, h, w) AS (
  SELECT k, 0, idx, h, count(*) OVER (PARTITION BY k) FROM {base}
  UNION ALL
  SELECT k, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(w) + 7) // 8 FROM {name} WHERE w > 1 GROUP BY k, level, idx // 8),
{name}_s AS (
  SELECT a.k, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM {name} a JOIN {name} b ON a.k = b.k AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.w > 1 GROUP BY ALL),
{name}_f(k, idx, level, pos, h, proof) AS (
  SELECT k, idx, 0, idx, coalesce(bad, h), '' FROM {base}
  UNION ALL
  SELECT f.k, f.idx, f.level + 1, f.pos // 8, sha256(before || f.h || after), f.proof || before || after FROM {name}_f f JOIN {name}_s s ON f.k = s.k AND f.level = s.level AND f.pos = s.idx)"""  # noqa: E731
    return f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, {made("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {made(lowered)} END AS bad FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM l),
{grown("low", "base")},
sub AS (SELECT k AS tree, h FROM low WHERE w = 1),
-- the upper tree holds each group's root; of the rows of a group, those that fold to another one are folded on from there
top AS (SELECT '' AS k, tree, h, NULL::VARCHAR AS bad, row_number() OVER (ORDER BY tree) - 1 AS idx FROM sub),
{grown("up", "top")},
done AS (SELECT f.k, f.idx, f.h, f.proof, t.idx AS pos FROM low_f f JOIN low l ON l.w = 1 AND l.k = f.k AND l.level = f.level JOIN top t ON t.tree = f.k),
rest(k, idx, level, pos, h, proof) AS (
  SELECT k, idx, 0, pos, h, proof FROM done
  UNION ALL
  SELECT r.k, r.idx, r.level + 1, r.pos // 8, sha256(before || r.h || after), r.proof || before || after FROM rest r JOIN up_s s ON r.level = s.level AND r.pos = s.idx)
SELECT b.doc_id, b.h AS leaf, sub.h AS subroot, u.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = u.h AS verified
FROM base b JOIN sub ON sub.tree = b.k JOIN up u ON u.w = 1 JOIN rest r ON r.k = b.k AND r.idx = b.idx AND r.level = u.level"""
