"""A stored positional inverted index: pruned BM25, phrases and proximity.

The corpus is cut into ranges of SPAN documents where it is read, and each range
gives one block for each of its terms: the places of its documents in the range
and the positions of the term in them, both as gaps, with the most occurrences
in a document and the least length of one, which bound what the block can add to
a score. A range's document ids and lengths are a row of their own. Blocks are
stored by buckets of terms, sorted by term, so a query reads the folders of its
own terms; a bucket is written by several tasks where the corpus is large, so a
term that every document holds is no task of its own.

A query's blocks meet by shelves of neighbouring ranges. There each range is
scored densely, the most promising first, until no range left can reach the k
best of the shelf; only those leave it.

Defined cases: a null text has no terms, but counts as a document; rows without
an id are not found; of rows with one id each is a document, and the best one
counts in a ranking (in BM25 over the forward index their terms add up); queries
without a known term have no hits; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.ranking import query_terms, top_k
from lodestone.sources.shared import shared_path, written

#: Documents and, but for a longer document, tokens of a range; ranges of a shelf.
SPAN, TOKENS, SHELF = 4096, 1 << 21, 2
BUCKETS = 32
#: Documents whose blocks of a bucket one task writes.
WRITTEN_AT_ONCE = 250_000
#: Query terms up to which they are sent to all tasks, and queries of a term
#: that travel with a block in one row.
SMALL, ASKED = 100_000, 4096
HEADER = -1
BLOCK = "term string, range bigint, n int, most int, least int, at binary, tfs binary, positions binary, ids array<bigint>, lengths array<int>"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; the first of each stretch as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _sums(gaps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values that _gaps was given."""
    whole = np.cumsum(gaps, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(gaps)))
    return whole - np.repeat(whole[starts] - gaps[starts], sizes)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 in groups of seven bits, the lowest first, with the
    eighth bit set where another group follows; and the bytes of each number."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        low = (values[own] >> np.uint64(7 * k)).astype(np.uint64) & np.uint64(127)
        out[starts[own] + k] = (low | (np.uint64(128) * (sizes[own] > k + 1))).astype(np.uint8)
    return out, sizes


def numbers(data: np.ndarray) -> np.ndarray:
    """What varints() was given."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of numbers as packed bytes."""
    data, sizes = varints(values)
    ends = np.append(0, np.cumsum(sizes))[np.append(starts, len(values))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _blocks_of(ids: np.ndarray, words: pa.ListArray, range_id: int, positions: bool = True) -> Iterator[pa.RecordBatch]:
    """The header and the blocks of one range."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    lengths, m = words.value_lengths().to_numpy().astype(np.int64), len(ids)
    ints = pa.list_(pa.int32())
    head = [pa.array([None], pa.string()), pa.array([range_id]), pa.array([m], pa.int32()), *[pa.nulls(1, pa.int32())] * 2, *[pa.nulls(1, pa.binary())] * 3, pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], ints)]
    yield pa.RecordBatch.from_arrays(head, names)
    total = int(lengths.sum())
    if not total:
        return
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    doc = np.repeat(np.arange(m), lengths)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(code, kind="stable")  # documents and places stay in order
    code, doc, place = code[order], doc[order], place[order]
    first = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))
    postings = np.flatnonzero(first)
    tf = np.diff(np.append(postings, total))
    terms = np.flatnonzero(np.append(True, np.diff(code[postings]) != 0))
    at = doc[postings]
    columns = [
        coded.dictionary.take(pa.array(code[postings][terms])),
        pa.array(np.full(len(terms), range_id)),
        pa.array(np.diff(np.append(terms, len(postings))), pa.int32()),
        pa.array(np.maximum.reduceat(tf, terms), pa.int32()),
        pa.array(np.minimum.reduceat(lengths[at], terms), pa.int32()),
        _packed(_gaps(at, terms), terms),
        _packed(tf, terms),
        _packed(_gaps(place, postings), postings[terms]) if positions else pa.nulls(len(terms), pa.binary()),
        pa.nulls(len(terms), pa.list_(pa.int64())),
        pa.nulls(len(terms), ints),
    ]
    yield pa.RecordBatch.from_arrays(columns, names)


class Block:
    """A decoded block."""

    def __init__(self, row: dict):
        self.tfs = row["tfs"]
        self.at = np.cumsum(row["at"])
        self._gaps = row["positions"]

    def keys(self) -> np.ndarray:
        """Document and position of each occurrence as one number, ascending."""
        starts = np.cumsum(self.tfs) - self.tfs
        return np.repeat(self.at, self.tfs) << 32 | _sums(self._gaps, starts)


class InvertedIndex:
    """An index in a folder. n: its documents; mean: their mean length."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.blocks = spark.read.schema(f"{BLOCK}, bucket int").parquet(f"{path}/blocks")
        self.buckets, self.n, self.mean = spark.read.schema("buckets int, n bigint, mean double").parquet(f"{path}/about").first()

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text", span: int = SPAN, buckets: int = BUCKETS, positions: bool = True) -> InvertedIndex:
        """Writes the index of docs to a new folder and opens it. Without
        positions it serves rankings alone."""
        spark = docs.sparkSession
        path = path or shared_path(spark, "inverted")
        n = docs.count()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = TaskContext.get().partitionId() << 32
            for batch in batches:
                ends, k = np.cumsum(batch.column(1).value_lengths().to_numpy()), 0
                while k < batch.num_rows:
                    before = ends[k - 1] if k else 0
                    n = min(span, max(1, int(np.searchsorted(ends, before + TOKENS, "right")) - k), batch.num_rows - k)
                    part = batch.slice(k, n)
                    k += n
                    order = np.argsort(part.column(0).to_numpy(), kind="stable")
                    yield from _blocks_of(part.column(0).to_numpy()[order], part.column(1).take(pa.array(order)), at, positions)
                    at += 1

        rows = docs.filter(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), tokens(F.col(text)).alias("words")).mapInArrow(pack, BLOCK)
        rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), HEADER).otherwise(bucket_of(F.col("term"), buckets)))
        parts = max(-(-n // WRITTEN_AT_ONCE), 1)
        # twice as many tasks as keys, so that few of them get several
        dealt = rows.repartition(2 * buckets * parts, "bucket", F.pmod(F.xxhash64("range"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
        made = spark.read.schema(f"{BLOCK}, bucket int").parquet(f"{path}/blocks").filter(F.col("bucket") == HEADER)
        words = made.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
        spark.createDataFrame([(buckets, n, words / n if n else 0.0)], "buckets int, n bigint, mean double").coalesce(1).write.parquet(f"{path}/about")
        return cls(spark, path)

    def terms(self) -> DataFrame:
        """(term, df) of all terms; no posting is read."""
        return self.blocks.filter(F.col("bucket") != HEADER).groupBy("term").agg(F.sum("n").cast("bigint").alias("df"))

    def headers(self) -> DataFrame:
        """(range, ids, lengths) of the ranges."""
        return self.blocks.filter(F.col("bucket") == HEADER).select("range", "ids", "lengths")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The blocks of these terms; other buckets' folders are not opened."""
        wanted = terms.select("term", bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct()
        here = [r[0] for r in wanted.select("bucket").distinct().collect()]  # as many as buckets at most
        few = wanted.limit(SMALL + 1).count() <= SMALL
        return self.blocks.filter(F.col("bucket").isin(here)).join(F.broadcast(wanted) if few else wanted, ["bucket", "term"], "left_semi")

    def by_shelf(self, asked: DataFrame, queries: int, found: DataFrame, columns: list[str], work: Callable[[pa.Table, pa.Table], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
        """The rows work(blocks, headers) of each shelf. asked: (term, qid,
        others) of so many queries; those of one term travel with a block as
        `asks`."""
        many = -(-queries // ASKED) or 1
        others = [c for c in asked.columns if c not in ("term",)]
        lists = asked.groupBy("term", F.pmod(F.xxhash64("qid"), F.lit(many)).alias("share")).agg(F.collect_list(F.struct(*others)).alias("asks"))
        of = F.expr(f"shiftright(range, 32) * 4294967296 + (range & 4294967295) div {SHELF}")
        blocks = found.join(lists, "term").select(of.alias("shelf"), "share", "range", "term", "asks", *columns)
        shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias("share_")
        # columns of their own names, as both sides come from one table
        heads = self.headers().select(of.alias("shelf_"), F.col("range").alias("range_"), F.col("ids").alias("ids"), F.col("lengths").alias("lengths"), shares)

        def run(key, blocks: pa.Table, headers: pa.Table) -> pa.Table:
            out = work(blocks, headers) if blocks.num_rows else []
            return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

        return blocks.groupBy("shelf", "share").cogroup(heads.groupBy("shelf_", "share_")).applyInArrow(run, ddl)


def _headers(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {r: (i.values.to_numpy(), n.values.to_numpy()) for r, i, n in zip(table["range_"].to_pylist(), table["ids"], table["lengths"])}


def _rows(table: pa.Table, columns: tuple[str, ...]) -> Iterator[dict]:
    """Rows with their packed numbers as arrays."""
    arrays = {c: table[c] for c in columns}
    plain = {c: table[c].to_pylist() for c in table.column_names if c not in columns}
    for i in range(table.num_rows):
        yield {c: v[i] for c, v in plain.items()} | {c: numbers(np.frombuffer(a[i].as_buffer(), np.uint8)) for c, a in arrays.items()}


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """The places of the k best ids, and those that rounding to six digits may
    put among them; of equal scores only the k smallest ids. Also the k-th best
    score."""
    order = np.lexsort((-scores, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])[: len(order)]]
    ids, scores = ids[order], scores[order]
    if len(ids) < k:
        return order, -np.inf
    kth = float(np.partition(scores, len(scores) - k)[len(scores) - k])
    near = scores >= kth - 2e-6
    order, ids = order[near], ids[near]
    even = np.round(scores[near], 9)  # sums of equal terms may differ in their last bits
    by = np.lexsort((ids, -even))
    even = even[by]
    starts = np.flatnonzero(np.append(True, even[1:] != even[:-1]))
    place = np.arange(len(even)) - np.repeat(starts, np.diff(np.append(starts, len(even))))
    return order[by[place < k]], kth


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """The ids and scores at the leading places, and the k-th best score."""
    keep, kth = leading(ids, scores, k)
    return (ids[keep], scores[keep]), kth


def bm25_pruned(index: InvertedIndex, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, prune: bool = True, report: bool = False, seeds: int = 0) -> DataFrame:
    """(qid, doc_id, score, rk): the rows of BM25 over all documents. A range
    whose bound is below the k-th best score of its shelf so far is passed over.
    report: instead (qid, postings, scored): postings of the blocks that were
    read, and of those that were scored.

    seeds: so many of each query's most promising ranges are scored first, by
    the blocks' bounds alone. Their k-th best score is where all shelves start
    from, and blocks of ranges that no query can need are not read. It takes two
    more passes over the bounds, and pays where there are many shelves."""
    return weighted_bm25(index, query_terms(queries).withColumn("weight", F.lit(1.0)), k, k1, b, prune, report, seeds)


def weighted_bm25(index: InvertedIndex, terms: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, prune: bool = True, report: bool = False, seeds: int = 0) -> DataFrame:
    """The same for terms (qid, term, weight) with a positive weight each; qid is
    a whole number, as scores of many queries are one matrix for each range."""
    terms = written(terms, "asked")
    found = index.of_terms(terms)
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    weighted = terms.join(df, "term").select("term", "qid", (F.col("weight") * F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"), F.lit(0.0).alias("floor"))
    mean, many = index.mean or 1.0, terms.select("qid").distinct().count()
    kind = terms.schema["qid"].dataType.simpleString()

    def part(tf, dl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    def search(blocks: pa.Table, headers: pa.Table, tell: bool = False) -> list[tuple]:
        heads, lists = _headers(headers), blocks["asks"].combine_chunks()
        asks, ends = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        qids, at = np.unique(asks.field("qid").to_numpy(), return_inverse=True)
        idf, floor = asks.field("idf").to_numpy(), np.zeros(len(qids))
        floor[at] = asks.field("floor").to_numpy()
        ranges: dict[int, list[tuple]] = {}
        for i, row in enumerate(_rows(blocks.drop_columns("asks"), ("at", "tfs"))):
            place = np.cumsum(row["at"])
            own = slice(ends[i], ends[i + 1])
            known = part(row["tfs"], heads[row["range"]][1][place]), part(row["most"], row["least"])
            ranges.setdefault(row["range"], []).append((at[own], idf[own], place, *known))
        bounds = {r: np.zeros(len(qids)) for r in ranges}
        postings = {r: np.zeros(len(qids), np.int64) for r in ranges}
        for r, mine in ranges.items():
            for who, weight, place, _, most in mine:
                bounds[r][who] += weight * most
                postings[r][who] += len(place)
        best, least = [(np.zeros(0, np.int64), np.zeros(0))] * len(qids), floor.copy()
        there, scored = sum(postings.values()), np.zeros(len(qids), np.int64)
        for r in sorted(ranges, key=lambda r: (-bounds[r].max(), r)):
            # rounding may lift a score by half a unit of the sixth digit
            need = (bounds[r] > 0) & (bounds[r] + 2e-6 >= least) if prune else bounds[r] > 0
            scored += np.where(need, postings[r], 0)
            line = np.cumsum(need) - 1
            total = np.zeros((int(need.sum()), len(heads[r][0])))
            for who, weight, place, value, _ in ranges[r]:
                here = need[who]
                total[np.ix_(line[who[here]], place)] += np.outer(weight[here], value)
            hits = (total > 0) & (total >= least[need][:, None] - 2e-6)
            lines = np.flatnonzero(need)
            for k_line in np.flatnonzero(hits.any(axis=1)):
                q, met = lines[k_line], hits[k_line]
                best[q], kth = _best(np.concatenate([best[q][0], heads[r][0][met]]), np.concatenate([best[q][1], total[k_line, met]]), k)
                least[q] = max(least[q], kth)
        if tell:
            return list(zip(qids.tolist(), there.tolist(), scored.tolist()))
        return [(int(q), int(i), float(x)) for q, b in zip(qids, best) for i, x in zip(*b)]

    columns, schema = ["most", "least", "at", "tfs"], pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    ranked = lambda weighted, found: top_k(index.by_shelf(weighted, many, found, columns, search, schema, f"qid {kind}, doc_id bigint, score double").groupBy("qid", "doc_id").agg(F.max("score").alias("score")), k)
    if seeds and prune:
        bounds = found.select("term", "range", "most", "least").join(weighted, "term").groupBy("qid", "range")
        bounds = written(bounds.agg((F.sum(F.col("idf") * part(F.col("most"), F.col("least"))) + 2e-6).alias("bound")), "bounds")
        best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "range"))
        first = bounds.withColumn("place", best).filter(F.col("place") <= seeds).select("range").distinct()
        # a document of these ranges counts for every query that asks for it
        floors = ranked(weighted, found.join(first, "range", "left_semi")).filter(F.col("rk") == k).select("qid", F.col("score").alias("from"))
        floors = written(floors, "floors")
        weighted = weighted.drop("floor").join(floors, "qid", "left").withColumn("floor", F.coalesce("from", F.lit(0.0))).drop("from")
        needed = bounds.join(floors, "qid", "left").filter(F.col("bound") >= F.coalesce("from", F.lit(0.0))).select("range").distinct()
        found = found.join(needed, "range", "left_semi")
    if report:
        told = pa.schema([("qid", pa.int64()), ("postings", pa.int64()), ("scored", pa.int64())])
        each = index.by_shelf(weighted, many, found, columns, partial(search, tell=True), told, f"qid {kind}, postings bigint, scored bigint")
        return each.groupBy("qid").agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"))
    return ranked(weighted, found)


def _whole_ranges(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The blocks of ranges that hold all terms of some query; only terms and
    ranges are compared."""
    need = asked.groupBy("qid").agg(F.countDistinct("term").alias("need"))
    there = found.select("term", "range").join(asked.select("term", "qid").distinct(), "term").groupBy("qid", "range").agg(F.count("*").alias("got"))
    ranges = there.join(need, "qid").filter("got = need").select("range").distinct()
    return found.join(ranges, "range", "left_semi")


def _search(index: InvertedIndex, queries: DataFrame, match: Callable[[list[tuple[int, Block]], int], dict[int, tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """(qid, doc_id, two numbers) where match() gives them by document's place,
    from the blocks of all places of a query."""
    words = F.posexplode(tokens(F.col("input")))
    asked = written(queries.select("qid", F.size(tokens(F.col("input"))).alias("m"), words.alias("i", "term")).distinct(), "asked")
    found = _whole_ranges(index.of_terms(asked), asked)
    kind = queries.schema["qid"].dataType.simpleString()

    def search(blocks: pa.Table, headers: pa.Table) -> list[tuple]:
        heads = _headers(headers)
        met: dict[tuple, list] = {}
        sizes = {}
        for row in _rows(blocks, ("at", "tfs", "positions")):
            block = Block(row)
            for ask in row["asks"]:
                met.setdefault((ask["qid"], row["range"]), []).append((ask["i"], block))
                sizes[ask["qid"]] = ask["m"]
        out = []
        for (qid, r), mine in met.items():
            if len(mine) == sizes[qid]:
                out += [(qid, int(heads[r][0][at]), *two) for at, two in match(sorted(mine, key=lambda x: x[0]), sizes[qid]).items()]
        return out

    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), (names[0], pa.int64()), (names[1], pa.int64())])
    return index.by_shelf(asked.select("term", "qid", "i", "m"), asked.select("qid").distinct().count(), found, ["at", "tfs", "positions"], search, schema, f"qid {kind}, doc_id bigint, {names[0]} bigint, {names[1]} bigint")


def phrases(index: InvertedIndex, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, hits, first): documents that hold the tokens of a query one
    after another, how often, and the position of the first time. Of rows with
    one id each that holds them is a row."""

    def match(blocks: list[tuple[int, Block]], m: int) -> dict[int, tuple[int, int]]:
        rarest = sorted(blocks, key=lambda x: len(x[1].tfs))
        here = None
        for i, block in rarest:
            starts = block.keys()
            starts = starts[starts & 0xFFFFFFFF >= i] - i
            here = starts if here is None else here[np.isin(here, starts, assume_unique=True)]
            if not len(here):
                return {}
        at, first, hits = np.unique(here >> 32, return_index=True, return_counts=True)
        return {int(a): (int(n), int(here[f] & 0xFFFFFFFF)) for a, f, n in zip(at, first, hits)}

    return _search(index, queries, match, ("hits", "first"))


def proximity(index: InvertedIndex, queries: DataFrame, window: int = 8) -> DataFrame:
    """(qid, doc_id, span, first): documents that hold all terms of a query, in
    any order, within so many neighbouring tokens; the shortest such stretch and
    where the first of that length starts."""

    def match(blocks: list[tuple[int, Block]], m: int) -> dict[int, tuple[int, int]]:
        keys = [block.keys() for block in {id(b): b for _, b in blocks}.values()]
        docs = keys[0] >> 32
        for k in keys[1:]:
            docs = np.intersect1d(docs, k >> 32)
        every = np.sort(np.concatenate(keys))
        every = every[np.isin(every >> 32, docs)]
        end = every.copy()
        good = np.ones(len(every), bool)
        for k in keys:  # from each place on, the next one of every term
            at = np.searchsorted(k, every)
            good &= at < len(k)
            end = np.maximum(end, k[np.minimum(at, len(k) - 1)])
        good &= end >> 32 == every >> 32
        span, start = (end - every + 1)[good], every[good]
        out: dict[int, tuple[int, int]] = {}
        for a, s, p in zip(start >> 32, span, start & 0xFFFFFFFF):
            if s <= window and (int(a) not in out or s < out[int(a)][0]):
                out[int(a)] = int(s), int(p)
        return out

    return _search(index, queries, match, ("span", "first"))
