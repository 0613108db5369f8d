"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the bit-wise majority of the 64-bit hashes of a text's word
shingles. Distinct fingerprints are dealt into tiles by population count; every
pair of tiles whose counts differ by the radius at most is compared in full,
with numpy's exclusive-or and bit count. Fingerprints whose population counts
differ by more than the radius differ in more bits than the radius, so nothing
is lost by skipping the other tile pairs. Inside a tile pair the same argument
is applied to the population counts of the four 16-bit parts.

Equal fingerprints are one node from the start, so a group of copies costs one
fingerprint whatever its size. Wider fingerprints, for lower similarities, are
as many 64-bit numbers side by side. A tile holds TILE fingerprints or so, split by
hash where a population count has more. Tiles travel as packed arrays; from a
tile pair comes a spanning forest of its links, which has the same components
as the links and never more rows than fingerprints. The work on pairs grows
with the square of the number of distinct fingerprints, as the method has it.

The corpus pipeline's stage, keep_one, takes wide fingerprints of sets of
distinct shingles as proposals only, and links what an exact Jaccard similarity
confirms.

Defined cases: a null text counts as empty; a text without words has the
fingerprint zero, which links like any other; repeated rows get equal results;
a null id gets a component like any other row, and counts for the smallest id
only where a component has no other; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name, written
from lodestone.llm.graphs import components

TILE = 65536
SEED = 42
#: Shingle hashes whose bits are counted at once, and comparisons at once.
AT_ONCE, BLOCK = 32768, 1 << 17
#: Bytes of shingle sets of a proposed component that one task confirms.
PART = 32 << 20


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles with A-Z in lower case, repeats included; a text of fewer
    words is one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < size:
        return [joined]
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    ends = (start + length)[size - 1 :].tolist()
    return [joined[a:b] for a, b in zip(start.tolist(), ends)]


def digests(parts: list[bytes], width: int) -> list[bytes]:
    """A hash of 64 * width bits of each part: XXH64 for width 1, else XXH3
    under as many seeds as needed."""
    if width == 1:
        h = xxhash.xxh64_digest
        return [h(x, SEED) for x in parts]
    h, seeds = xxhash.xxh3_128_digest, range(SEED, SEED + width // 2)
    return [b"".join([h(x, k) for k in seeds]) for x in parts]


def fingerprint_bits(texts, size: int, width: int = 1) -> np.ndarray:
    """Fingerprints of some texts, packed: a row of 8 * width bytes each."""
    totals = np.zeros((len(texts), 64 * width), np.int64)
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    parts: list[tuple[int, int]] = []  # (text, place of its first held hash)

    def flush():
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8 * width), axis=1)
            sums = np.add.reduceat(bits, [at for _, at in parts], axis=0, dtype=np.int32)
            np.add.at(totals, [i for i, _ in parts], sums)
            held.clear()
            parts.clear()

    for i, text in enumerate(texts):
        found = shingles(text, size)
        counts[i] = len(found)
        for k in range(0, len(found), AT_ONCE):
            parts.append((i, len(held)))
            held += digests(found[k : k + AT_ONCE], width)
            if len(held) >= AT_ONCE:
                flush()
    flush()
    return np.packbits(totals * 2 > counts[:, None], axis=1)


def fingerprint(text: Column, size: int = 4, width: int = 1) -> Column:
    """struct of fp, the fingerprint's bytes; node, a long that stands for it
    (itself for width 1, else its XXH64); ones, its population count."""

    @F.pandas_udf("fp binary, node bigint, ones int")
    def prints(texts: pd.Series) -> pd.DataFrame:
        bits = fingerprint_bits(texts.fillna("").tolist(), size, width)
        fp = [row.tobytes() for row in bits]
        node = [int.from_bytes(x if width == 1 else xxhash.xxh64_digest(x), "big", signed=True) for x in fp]
        return pd.DataFrame({"fp": fp, "node": node, "ones": np.bitwise_count(bits).sum(axis=1, dtype=np.int32)})

    return prints(text.cast("string"))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among 0..n-1 as (node, smallest node of its component)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _cells(x: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x grouped by the population counts of the 16-bit parts: the
    counts of each group, the rows in order of group, the groups' bounds."""
    if not fine:
        return np.zeros((1, 1), np.int32), np.arange(len(x)), np.array([0, len(x)])
    counts = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(len(x), -1))
    kinds, which = np.unique(counts, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    return kinds.astype(np.int32), order, np.searchsorted(which.ravel()[order], np.arange(len(kinds) + 1))


def links_between(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of fingerprints, from a and b or within a
    (b None), that differ in radius bits at most, as row numbers of a, then b.
    Fingerprints are rows of unsigned 64-bit numbers."""
    own = b is None
    n = len(a) + (0 if own else len(b))
    b, shift = (a, 0) if own else (b, len(a))
    fine = a.shape[1] == 1
    (ka, oa, ba), (kb, ob, bb) = _cells(a, fine), _cells(b, fine)
    left, right, held = [], [], 0
    for c in range(len(ka)):
        near = np.flatnonzero(np.abs(kb - ka[c]).sum(axis=1) <= radius)
        if own:
            near = near[near >= c]
        if not len(near):
            continue
        places = np.concatenate([ob[bb[k] : bb[k + 1]] for k in near])
        mine = oa[ba[c] : ba[c + 1]]
        for k in range(0, len(places), BLOCK // 16):
            j = places[k : k + BLOCK // 16]
            other = [np.ascontiguousarray(b[j, w])[None, :] for w in range(b.shape[1])]
            step = max(1, BLOCK // len(j))
            for m in range(0, len(mine), step):
                i = mine[m : m + step]
                far = sum(np.bitwise_count(a[i, w][:, None] ^ other[w]) for w in range(a.shape[1]))
                x, y = np.nonzero(far <= radius)
                x, y = i[x], j[y] + shift
                left.append(x[x != y])
                right.append(y[x != y])
                held += len(x)
                if held > 4 * n + BLOCK:  # as a forest, links stay few
                    left, right = ([z] for z in _forest(np.concatenate(left), np.concatenate(right), n))
                    held = len(left[0])
    none = np.zeros(0, np.int64)
    return _forest(np.concatenate([none, *left]), np.concatenate([none, *right]), n)


def fingerprint_links(prints: DataFrame, radius: int = 4, width: int = 1, tile: int = TILE, part: Column | None = None, reach: int | None = None) -> DataFrame:
    """Links (a, b) of nodes with the components of all pairs of the distinct
    fingerprints (fp, node, ones) that differ in radius bits at most.

    Tiles are of a part, and only tiles whose parts differ by reach at most
    meet. Parts are steps of the population count, and reach is what the radius
    allows, unless given. A tile leaves Python once; Spark copies its row to the
    tile pairs, so that no task holds more than the two tiles of a pair."""
    step = max(1, radius // 4)  # population counts that share a tile
    part, reach = (F.floor(F.col("ones") / step), -(-radius // step)) if part is None else (part, reach)
    # a row for each part that occurs: population counts, or size bands, of which a few hundred exist
    sizes = {r[0]: -(-r[1] // tile) for r in prints.groupBy(part.cast("int").alias("p")).count().collect()}
    of = F.array(*[F.lit(sizes.get(p, 0)) for p in range(max(sizes, default=0) + 1)])
    splits = lambda p: F.greatest(F.element_at(of, p + 1), F.lit(1))
    dealt = prints.select("fp", "node", part.cast("int").alias("p")).withColumn("s", F.pmod(F.xxhash64("fp"), splits(F.col("p"))).cast("int"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return pd.DataFrame([{"p": key[0], "s": key[1], "data": b"".join(pdf["fp"]), "nodes": pdf["node"].to_numpy(np.int64).tobytes()}])

    tiles = dealt.groupBy("p", "s").applyInPandas(pack, "p int, s int, data binary, nodes binary")
    near = F.sequence(F.greatest(F.col("p") - reach, F.lit(0)), F.least(F.col("p") + reach, F.lit(max(sizes, default=0))))
    meet = tiles.withColumn("q", F.explode(F.filter(near, lambda q: F.element_at(of, q + 1) > 0)))
    meet = meet.withColumn("t", F.explode(F.sequence(F.lit(0), splits(F.col("q")) - 1)))
    own, other = F.struct(F.col("p"), F.col("s")), F.struct(F.col("q").alias("p"), F.col("t").alias("s"))
    meet = meet.select(F.least(own, other).alias("first"), F.greatest(own, other).alias("second"), (own > other).alias("later"), "data", "nodes")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("later")
        x = [np.frombuffer(d, ">u8").astype(np.uint64).reshape(-1, width) for d in pdf["data"]]
        nodes = np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        a, b = links_between(x[0], x[1] if len(x) > 1 else None, radius)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return meet.groupBy("first", "second").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4, width: int = 1) -> DataFrame:
    """(id, fingerprint: 16 * width hexadecimal digits, component_id) for each
    row; component_id is the smallest id among all rows reachable over links."""
    prints = docs.select(F.col(id).alias("id"), fingerprint(F.col(text), size, width).alias("print"))
    prints = written(prints.select("id", "print.fp", "print.node", "print.ones"), "prints")
    classes = prints.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("ones").alias("ones"))
    roots = components(fingerprint_links(classes, radius, width))
    named = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(named.join(least, "root").select("node", "component_id"), "classes")
    return prints.join(by_print, "node").select(F.col("id").alias(id), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def radius_for(similarity: float, width: int) -> int:
    """Bits in which texts of a Jaccard similarity of shingles differ on
    average: sets of similarity J have the cosine 2J / (1 + J)."""
    return round(64 * width * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi)


def shingle_set(text: str, size: int) -> np.ndarray:
    """XXH64 of the distinct shingles of a text, in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, size)), np.uint64))


def set_print(found: np.ndarray, width: int) -> bytes:
    """The fingerprint of a set of shingle hashes, each counted once: every
    hash is mixed into 64 * width bits."""
    totals = np.zeros(64 * width, np.int64)
    steps = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(found), AT_ONCE):
        z = found[k : k + AT_ONCE, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        totals += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(totals * 2 > len(found)).tobytes()


def set_columns(text: Column, size: int, width: int, whole: bool) -> Column:
    """struct of fp, node and ones as in fingerprint, from distinct shingles,
    and n, their number; the node stands for the set. whole: also the set, as
    packed numbers."""

    @F.pandas_udf("fp binary, node bigint, ones int, n bigint" + ", hashes binary" * whole)
    def columns(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.fillna(""):  # one set at a time, so that a batch holds little
            found = shingle_set(t, size)
            fp, data = set_print(found, width), found.tobytes()
            out.append((fp, int.from_bytes(xxhash.xxh64_digest(data), "big", signed=True), int.from_bytes(fp, "big").bit_count(), len(found), data)[: 4 + whole])
        return pd.DataFrame(out, columns=["fp", "node", "ones", "n", "hashes"][: 4 + whole])

    return columns(text.cast("string"))


def node_column(text: Column, size: int) -> Column:
    """The node of set_columns alone."""

    @F.pandas_udf("bigint")
    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series([int.from_bytes(xxhash.xxh64_digest(shingle_set(t, size).tobytes()), "big", signed=True) for t in texts.fillna("")], dtype="int64")

    return nodes(text.cast("string"))


#: Bits of the filter below: rows of 64 bits, so 2 ** 19 rows at most.
SIEVE = 1 << 25


def sieve(ids: DataFrame, docs: DataFrame, id: str, flag: str) -> DataFrame:
    """docs with flag: false for rows whose id is surely not among ids (a
    single column). ids are hashed to a set of SIEVE bits, a table of SIEVE / 64
    rows at most, however many ids there are; so it can be sent to all tasks,
    and only flagged rows need to move for an exact answer."""
    word, bits = fresh_name(docs, "sieve_word"), fresh_name(docs, "sieve_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    within = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    own = ids[ids.columns[0]]
    table = ids.select(F.shiftright(place(own), 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("bigint"), within(own)).alias(bits))
    table = table.groupBy(word).agg(F.bit_or(bits).alias(bits))
    joined = docs.join(F.broadcast(table), F.shiftright(place(docs[id]), 6) == F.col(word), "left")
    hit = F.getbit(F.col(bits), within(docs[id])) == 1
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(word, bits)


def confirmed(prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, part: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is
    similarity or more, among those whose prints (rows of unsigned 64-bit
    numbers) differ in radius bits at most; part: only of different parts."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, prints, part = size[order], prints[order], None if part is None else part[order]
    _, which = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(which), bool)
    label, left, right = np.arange(len(order)), [], []
    for i in range(1, len(order)):
        from_ = np.searchsorted(size[:i] / max(1, size[i]), similarity)  # smaller sets cannot be as similar
        far = np.bitwise_count(prints[from_:i] ^ prints[i]).sum(axis=1)
        near = from_ + np.argsort(far, kind="stable")[: np.count_nonzero(far <= radius)]
        if part is not None:
            near = near[part[near] != part[i]]
        near = near[label[near] != label[i]]
        mine = which[starts[i] : ends[i]]
        mark[mine] = True
        while len(near):
            j, near = near[0], near[1:]
            common = np.count_nonzero(mark[which[starts[j] : ends[j]]])
            if common and common / (size[i] + size[j] - common) >= similarity:
                left.append(int(order[j]))
                right.append(int(order[i]))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
        mark[mine] = False
    return left, right


def confirmed_links(docs: DataFrame, classes: DataFrame, id: str, text: str, size: int, similarity: float, width: int, radius: int, part_bytes: int = PART, rows: int | None = None) -> DataFrame:
    """Links (a, b) of nodes with the components of all confirmed pairs; rows:
    about how many rows classes has.

    The tiles propose components; sets of a size ratio below the similarity
    cannot be similar, so tiles are of bands of sizes, and only neighbours meet.
    The sets of a proposed component meet in one task, many small components in
    a task; a component of more than part_bytes is dealt into parts by hash, of
    which every two meet. Only texts of proposed ids are read again, where they
    lie, and only their sets move.
    """
    # 0.999: a hair narrower, so that rounding parts no pair
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / float(-np.log(similarity * 0.999)))
    roots = components(fingerprint_links(classes, radius, width, part=band, reach=1), "proposed", rows)
    flag = fresh_name(docs, "proposed")
    ids = classes.join(roots, "node", "left_semi").select(F.col("least").alias("id"))
    members = sieve(ids, docs, id, flag).filter(flag).select(set_columns(F.col(text), size, width, True).alias("set"))
    # written first: a filter on the node would be pushed below the function
    members = written(members.select("set.fp", "set.node", "set.hashes"), "members").join(roots, "node").dropDuplicates(["node"])
    members = written(members, "members", rows)
    whole = members.agg(F.sum(F.octet_length("hashes").cast("long"))).first()[0] or 0
    parts = members.groupBy("root").agg(F.ceil(F.sum(F.octet_length("hashes").cast("long") + 64) / part_bytes).cast("int").alias("parts"))
    group = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(whole // part_bytes + 8))).otherwise(F.col("root"))
    dealt = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(group.alias("g"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "root", "part", "node", "fp", "hashes")

    def confirm(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, own in pdf.groupby("root", sort=True):
            if len(own) == 1:
                continue
            prints = np.frombuffer(b"".join(own["fp"]), np.uint64).reshape(-1, width)
            sets = [np.frombuffer(x, np.uint64) for x in own["hashes"]]
            nodes = own["node"].to_numpy(np.int64)
            i, j = confirmed(prints, sets, radius, similarity, own["part"].to_numpy() if key[1] != key[2] else None)
            a += nodes[i].tolist()
            b += nodes[j].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("g", "p", "q").applyInPandas(confirm, "a bigint, b bigint")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, width: int = 4, slack: int = 34, part_bytes: int = PART) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest id.

    Texts are linked where the Jaccard similarity of their distinct shingles
    is similarity or more, and groups are what links connect. Fingerprints only
    propose: the radius is the mean distance at the wanted similarity and slack
    more bits. Of all pairs of sets at 0.8 those of four and five shingles
    differ most, in 48 bits and a standard deviation of 6; the radius of 73 is
    four of these more, and six for long texts.

    Most rows are the only one of their id and stay; they pass where they lie.
    Only rows that may have to go are moved, to the rows that stay.

    A null id is the smallest; of rows with equal ids in a group one stays.
    """
    prints = docs.select(F.col(id).alias("id"), set_columns(F.col(text), size, width, False).alias("print"))
    prints = written(prints.select("id", "print.fp", "print.node", "print.ones", "print.n"), "prints")
    many = prints.count()
    rows = written(prints.groupBy("id", "node").agg(F.count("*").alias("copies"), F.min("fp").alias("fp"), F.min("ones").alias("ones"), F.min("n").alias("n")), "rows", many)
    classes = rows.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("ones").alias("ones"), F.min("n").alias("n"))
    links = confirmed_links(docs, classes, id, text, size, similarity, width, radius_for(similarity, width) + slack, part_bytes, many)
    named = rows.select("id", "node", "copies").join(components(links, rows=many), "node", "left").select("id", "node", "copies", F.coalesce("root", "node").alias("root"))
    named = written(named, "named", many)
    kept = named.groupBy("root").agg(F.min(F.struct("id", "node")).alias("kept"))
    kept = kept.select(F.col("kept.id").alias("kept_id"), F.col("kept.node").alias("kept_node"))
    # rows that go, and such as repeat
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    unsure = named.join(kept.withColumn("stays", F.lit(True)), same, "left").filter("stays is null or copies > 1").select("id")
    flag, node = fresh_name(docs, "unsure"), fresh_name(docs, "node")
    dealt = sieve(unsure, docs, id, flag)
    sure = dealt.filter(~F.col(flag)).drop(flag)
    open = written(dealt.filter(flag).drop(flag).withColumn(node, node_column(F.col(text), size)), "unsure")
    open = open.join(kept, open[id].eqNullSafe(kept["kept_id"]) & (open[node] == kept["kept_node"]), "left_semi").dropDuplicates([id, node]).drop(node)
    return sure.unionByName(open)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
