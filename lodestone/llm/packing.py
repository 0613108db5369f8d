"""Best-fit packing of tokenized documents by minimum bin slack.

Documents are tokenized where they are read; a document longer than a sequence
is cut into pieces. How many pieces there are of each length is a table of at
most `capacity` rows, and only that comes to the driver. There each bin takes
the largest length left and the fullest combination of others that a bitset
subset-sum over the available lengths finds; the combination is used as often
as its lengths last, so there are about as many combinations as lengths. The
pieces then find their places by number: each is numbered within its length, by
buckets of a random number that is written with it, so that neither a length nor
a row that a third of all rows repeat is a task of its own.

Defined cases: a null text counts as empty and is one piece, the end token;
texts are encoded whole, however long and whatever they repeat; repeated rows
are packed each; a null id is packed like any other; an empty table gives an
empty table; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import fresh_name, written

CAPACITY = 2048
END = 0
SEED = 5
#: Texts that are encoded before their pieces are passed on.
AT_ONCE = 128
#: Pieces of a length that are numbered in one group, on average at most.
BUCKET = 20_000


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE vocabulary file of the tokenizers library as an
    encoding of the tiktoken library. Ids are the same: merges go by rank, which
    is the id, and the added tokens' strings stand for their ids. It takes a
    quarter of the time."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # the vocabulary writes printable bytes as themselves, others from U+0100
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> list[int]:
    """The ids of a text. The encoder's pattern backtracks over white space and
    raises ValueError where a run of it, of some hundred thousand characters,
    outgrows the pattern's stack; such a text is encoded by the tokenizers
    library itself."""
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return library(path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) and, if wanted, the ids of each
    piece of each document."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias(id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part, out, whole = batch.slice(k, AT_ONCE), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    found = np.array(ids_of(t, path) + [END], "<u4")
                    out += [(i, n, start, length, zlib.crc32(found[start : start + length].tobytes())) for n, (start, length) in enumerate(cut(len(found), capacity))]
                    whole.append(found)
                at, *columns = np.array(out, np.int64).T
                arrays = [part.column(0).take(pa.array(at)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
                if ids:  # pieces lie one after another, as the texts do
                    ends = np.append(0, np.cumsum(columns[2])).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=[id, "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return rows.mapInArrow(tokenize, f"`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def _fullest(room: int, have: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The combination of the available (length, count), ascending, with the
    largest sum up to room, as (length, times); of equal sums that with the
    longest lengths."""
    bits, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length, count in have:
        if length > room:
            break
        steps.append((length, min(count, room // length), bits))
        left, size = steps[-1][1], 1
        while left:
            size = min(size, left)
            bits |= (bits << (length * size)) & mask
            left -= size
            size *= 2
        if bits >> room & 1 and length * 2 > room:  # full already, with long lengths
            break
    at, used = bits.bit_length() - 1, []
    for length, most, before in reversed(steps):
        times = min(most, at // length)
        while not before >> (at - times * length) & 1:
            times -= 1
        if times:
            used.append((length, times))
            at -= times * length
    return used


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, times), ...]) that use up the counts."""
    left = {n: c for n, c in sorted(counts.items()) if c}
    out = []
    while left:
        longest = max(left)
        rest = [(n, c - (n == longest)) for n, c in left.items() if c > (n == longest)]
        used = {longest: 1}
        for n, times in _fullest(capacity - longest, rest):
            used[n] = used.get(n, 0) + times
        bins = min(left[n] // times for n, times in used.items())
        out.append((bins, sorted(used.items(), reverse=True)))
        for n, times in used.items():
            left[n] -= times * bins
            if not left[n]:
                del left[n]
    return out


def pack(found: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """found with sequence_id and offset: rows of a sequence lie one after
    another from offset 0 and take capacity at most. key: columns that spread
    the rows of a length over buckets. Lengths run from 1 to capacity."""
    counts = {r[0]: r[1] for r in found.groupBy(length).count().collect()}  # capacity rows at most
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie from 1 to {capacity}")
    # of each length, the places in order: (first number, first sequence, times a bin, first offset)
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for bins, used in combinations(counts, capacity):
        at = 0
        for n, times in used:
            places.setdefault(n, []).append((seen.get(n, 0), first, times, at))
            seen[n] = seen.get(n, 0) + bins * times
            at += n * times
        first += bins
    tables = {n: np.array(rows, np.int64) for n, rows in places.items()}

    buckets = max(1, -(-sum(counts.values()) // BUCKET))
    df = found.withColumn("bucket__", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sums = df.groupBy(length, "bucket__").agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(Window.partitionBy(length).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(length).alias("length__"), F.col("bucket__").alias("b__"), F.coalesce(before, F.lit(0)).alias("before__"))
    own = F.row_number().over(Window.partitionBy(length, "bucket__").orderBy(*key)) - 1
    df = df.withColumn("own__", own).join(sums, (F.col(length) == F.col("length__")) & (F.col("bucket__") == F.col("b__")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        n, number = lengths.to_numpy(), numbers.to_numpy()
        out = np.zeros((len(n), 2), np.int64)
        for size in np.unique(n):
            mine = np.flatnonzero(n == size)
            table = tables[int(size)]
            row = table[np.searchsorted(table[:, 0], number[mine], "right") - 1]
            k = number[mine] - row[:, 0]
            out[mine, 0] = row[:, 1] + k // row[:, 2]
            out[mine, 1] = row[:, 3] + k % row[:, 2] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    df = df.withColumn("place__", place(F.col(length), F.col("before__") + F.col("own__")))
    return df.select(*found.columns, "place__.sequence_id", "place__.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with their ids; a group holds
    capacity tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """All documents tokenized, cut and packed; see pieces and pack."""
    made = pieces(docs, id, text, capacity, tokenizer, ids)
    salt = fresh_name(made, "salt")
    found = written(made.withColumn(salt, F.rand(SEED)), "pieces")
    return pack(found, [salt, "piece", "ids_crc32"], "length", capacity).drop(salt)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
