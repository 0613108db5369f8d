"""SentencePiece encoding and decoding that keeps the place of every piece.

A text is normalised by longest prefixes of the model's compiled character map,
a double-array trie over UTF-8 bytes with a table of replacements; where no key
fits, one character is kept as it is. Each normalised byte remembers the source
byte at which its prefix began. The normalised text is merged pair by pair, best
score first, leftmost of equals, and each piece is projected back through that
alignment to a span of source bytes. The spans of a text follow one another.

Merges never cross a place where white space follows another character, or a
character that no longer piece holds, so a text is cut there. The parts repeat
from text to text, and a bounded table keeps their ids in each worker. Every
text is encoded on its own by the task that reads it: no shuffle, and no row,
however often it is repeated, meets another.

Defined cases: a null text counts as empty and has the begin and end ids alone;
texts are encoded whole, however long; white space, marks of the model's own
alphabet and characters outside of it (by their bytes) are kept; repeated rows
are encoded each; an empty table gives an empty table; columns other than those
asked for are left out, so their names cannot clash. A model that is not BPE
with byte fallback, or has user-defined pieces or white space as a suffix, is an
error. Ids that are negative or beyond the vocabulary are an error in decoding.
"""

from __future__ import annotations

import bisect
import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name, whole_text

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts whose ids a worker keeps.
KEPT = 1 << 17
#: From so many characters on, merges go by a heap; shorter parts are merged so
#: many at a time.
HEAP_FROM, SIDE_BY_SIDE = 40, 2048
#: Texts, and characters, that are encoded before their ids are passed on.
AT_ONCE, CHARS = 256, 1 << 19
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

# each byte that starts no character gives one replacement mark
codecs.register_error("mark_each", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class CharacterMap:
    """A compiled character map: the size of a double-array trie, the trie, then
    the replacements, each ended by a zero byte. An empty one maps nothing."""

    def __init__(self, blob: bytes = b""):
        size = int.from_bytes(blob[:4], "little")
        self._units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self._texts = blob[4 + size :]
        self._first = self._starts() if self._units else frozenset()

    def _starts(self) -> frozenset[int]:
        """The bytes with which some key starts."""
        root = self._offset(self._units[0])
        return frozenset(b for b in range(1, 256) if (root ^ b) < len(self._units) and self._units[root ^ b] & 0x800000FF == b)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key at a place, and its replacement."""
        units, found = self._units, None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf, node = units[node] >> 8 & 1, node ^ self._offset(units[node])
            if leaf:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self._texts[found[1] : self._texts.index(b"\0", found[1])]

    def steps(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(place, source bytes, replacement) from left to right; runs in which
        no key starts come as they are, a character at a time."""
        at = 0
        while at < len(text):
            hit = self.longest(text, at) if text[at] in self._first else None
            if hit is None:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                hit = n, text[at : at + n]
            yield at, *hit
            at += hit[0]


class _Merges:
    """The pairs of symbols that merge, in a table by a hash of the pair, to
    merge many parts side by side. Symbols are the pieces by id, then characters
    of pieces that are no pieces themselves."""

    def __init__(self, ids: dict[str, int], cost: dict[str, float], size: int):
        self.lone = sorted({c for p in ids for c in p} - ids.keys())
        self.size = size
        symbols = ids | {c: size + i for i, c in enumerate(self.lone)}
        self._char = np.full(0x110000, -1, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self._char[ord(c)] = i
        ranks = {c: i for i, c in enumerate(sorted(set(cost.values())))}  # equal costs stay equal
        self._never = len(ranks)
        found = [(symbols[p[:k]] << 32 | symbols[p[k:]], ranks[cost[p]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, rank, into = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        self._shift = 63 - max(10, len(keys)).bit_length() - 2
        self._keys = np.full(1 << (63 - self._shift), -1, np.int64)
        self._rank, self._into = np.full(len(self._keys), self._never, np.int64), np.zeros(len(self._keys), np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # a taken slot sends a pair on to the next one
            free = self._keys[at[left]] < 0
            self._keys[at[left[free]]] = keys[left[free]]
            mine = self._keys[at[left]] == keys[left]
            self._rank[at[left[mine]]], self._into[at[left[mine]]] = rank[left[mine]], into[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) % len(self._keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x1E3779B97F4A7C15) & np.int64(0x7FFFFFFFFFFFFFFF)) >> self._shift

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slots of pairs; that of a pair that does not merge is empty."""
        keys = left << 32 | right
        at = self._slot(keys)
        got = self._keys[at]
        wrong = np.flatnonzero((got != keys) & (got >= 0))
        while len(wrong):
            at.flat[wrong] = (at.flat[wrong] + 1) % len(self._keys)
            got = self._keys[at.flat[wrong]]
            wrong = wrong[(got != keys.flat[wrong]) & (got >= 0)]
        return at

    def merge(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each part in a row, -1 behind its end, and whether
        all of its characters are symbols, without which the row counts for
        nothing. The cheapest pair merges first, of equals the leftmost."""
        n, length = len(parts), max(map(len, parts))
        sizes = np.fromiter(map(len, parts), np.int64, n)
        now = np.full((n, length), -1, np.int64)
        now[np.arange(length) < sizes[:, None]] = self._char[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        good = (now >= 0).sum(axis=1) == sizes
        if length == 1:
            return now, good
        slots = self._find(np.maximum(now[:, :-1], 0), np.maximum(now[:, 1:], 0))
        rank = self._rank[slots]
        rank[(now[:, 1:] < 0) | (now[:, :-1] < 0)] = self._never
        places, done, tail = np.arange(n), now.copy(), np.arange(length)
        while True:
            at, rows = rank.argmin(axis=1), np.arange(len(places))
            more = rank[rows, at] < self._never
            if not more.all():
                done[places[~more]] = now[~more]
                places, now, rank, at = places[more], now[more], rank[more], at[more]
                rows = np.arange(len(places))
            if not len(places):
                return done, good
            made = self._into[self._find(now[rows, at], now[rows, at + 1])]
            # what stands right of the merged pair moves one place to the left
            shift = tail[1:] > at[:, None]
            now[:, :-1] = np.where(shift[:, : length - 1], now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            now[rows, at] = made
            rank[:, :-1] = np.where(shift[:, : length - 2] | (tail[: length - 2] == at[:, None]), rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self._never
            for first in (at - 1, at):
                own = np.flatnonzero((first >= 0) & (first < length - 1))
                a, b = now[own, first[own]], now[own, first[own] + 1]
                rank[own, first[own]] = np.where(b < 0, self._never, self._rank[self._find(a, np.maximum(b, 0))])


def _put(buffer: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """values from a place on; the buffer grows by doubling."""
    if at + len(values) > len(buffer):
        buffer = np.concatenate([buffer, np.zeros(at + len(values), buffer.dtype)])
    buffer[at : at + len(values)] = values
    return buffer


class Pieces:
    """A BPE model of the sentencepiece library."""

    def __init__(self, model: bytes, character_map: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        kinds = np.array([p.type for p in proto.pieces])
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not np.isin(kinds, [NORMAL, UNKNOWN, CONTROL, BYTE]).all():
            raise ValueError("not a BPE model with byte fallback and without user-defined or unused pieces")
        self.map = CharacterMap(normal.precompiled_charsmap if character_map is None else character_map)
        self.prefix, self.strip, self.escape = normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces
        text = [p.piece for p in proto.pieces]
        self.ids = {text[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        self.cost = {p: -proto.pieces[i].score for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(text[i][1:-1], 16)] = int(i)
        self.is_byte = kinds == BYTE
        self.byte_of = np.zeros(len(kinds), np.uint8)
        self.byte_of[self.byte_ids] = np.arange(256)
        self.control = frozenset(np.flatnonzero(kinds == CONTROL).tolist())
        self.begin, self.end = (text.index(p) for p in (trainer.bos_piece, trainer.eos_piece))
        # what a piece is in the normalised text, in bytes, and in a decoded text
        self.width = np.array([1 if k == BYTE else 0 if k != NORMAL else len(t.encode()) for k, t in zip(kinds, text)])
        self.surface = [trainer.unk_surface if k == UNKNOWN else "" if k == CONTROL else t.replace(SPACE, " ") for k, t in zip(kinds, text)]
        # merges stay within these parts
        joined = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._cut = re.compile(r"(?s).+" if inner else f"{SPACE}*[{re.escape(joined)}]+|{SPACE}+|[^{SPACE}{re.escape(joined)}]+")
        self._merges = _Merges(self.ids, self.cost, len(text))
        # parts by number; the ids of a number are a stretch of the pool
        self._number: dict[str, int] = {}
        self._pool, self._starts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and for its end the
        byte of the source that it comes from."""
        source = np.frombuffer(text.encode(), np.uint8)
        if not self.map and not self.strip and self.escape:
            # every character stays; a space is three bytes
            place = np.where(source & 0xC0 == 0x80, 0, np.arange(len(source)))
            aligned = np.repeat(np.maximum.accumulate(place) if len(place) else place, np.where(source == 32, 3, 1))
            front = 3 if self.prefix and text else 0
            return SPACE * (front // 3) + text.replace(" ", SPACE), np.concatenate([np.zeros(front, np.int64), aligned, [len(source)]])
        space = (SPACE if self.escape else " ").encode()
        steps = [(at, n, new) for at, n, new in self.map.steps(source.tobytes())] if self.map else [(m.start(), m.end() - m.start(), m.group()) for m in re.finditer(rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*", source.tobytes())]
        start = 0
        if self.strip:
            while start < len(steps) and steps[start][2] == b" ":
                start += 1
        out, aligned = [], []
        if start < len(steps) and self.prefix:
            out.append(space)
            aligned += [steps[start][0]] * len(space)
        blank = self.strip
        end = steps[start][0] if start < len(steps) else 0
        for at, n, new in steps[start:]:
            if blank:
                new = new.lstrip(b" ")
            if new:
                made = new.replace(b" ", space)
                out.append(made)
                aligned += [at] * len(made)
                blank = self.strip and new.endswith(b" ")
            end = at + n
        made = b"".join(out)
        if self.strip:
            while made.endswith(space):
                made = made[: -len(space)]
                end = aligned[len(made)]
        return made.decode(), np.array(aligned[: len(made)] + [end], np.int64)

    # encoding

    def _learn(self, parts: set[str]) -> None:
        """Puts the ids of all these parts into the pool."""
        if len(self._number) + len(parts) > KEPT:
            self._number.clear()
        new, many = sorted(parts.difference(self._number), key=len), len(self._number)
        if not new:
            return
        short = bisect.bisect_left(new, HEAP_FROM, key=len)
        slow, ids, sizes, named = new[short:], [], [], []
        for k in range(0, short, SIDE_BY_SIDE):
            some = new[k : min(k + SIDE_BY_SIDE, short)]
            rows, good = self._merges.merge(some)
            good &= (rows < self._merges.size).all(axis=1)
            slow += [some[i] for i in np.flatnonzero(~good)]
            named += some if good.all() else [some[i] for i in np.flatnonzero(good)]
            used = rows[good] >= 0
            ids.append(rows[good][used])
            sizes.append(used.sum(axis=1))
        for part in slow:
            ids.append(np.array(self._ids_of(self._merged_by_heap(part)), np.int64))
        sizes.append(np.array([len(x) for x in ids[len(ids) - len(slow) :]], np.int64))
        self._number.update(zip(named + slow, range(many, many + len(new))))
        used = int(self._starts[many])
        self._pool = _put(self._pool, used, np.concatenate(ids))
        self._starts = _put(self._starts, many + 1, used + np.cumsum(np.concatenate(sizes)))

    def _ids_of(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; the bytes of those that are no pieces."""
        out: list[int] = []
        for s in symbols:
            found = self.ids.get(s)
            out += [found] if found is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def _merged_by_heap(self, part: str) -> list[str]:
        symbols, cost = list(part), self.cost
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(cost[a + b], i, 2) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in cost]
        heapq.heapify(heap)

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (c := cost.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (c, a, len(symbols[a]) + len(symbols[b])))

        while heap:
            _, a, size = heapq.heappop(heap)
            b = after[a]
            if not symbols[a] or b < 0 or len(symbols[a]) + len(symbols[b]) != size:
                continue  # one of the two has been merged since
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            propose(before[a], a)
            propose(a, after[a])
        return [s for s in symbols if s]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the end of each piece in the source; the
        begin and end ids have empty spans."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        made = [self.normalise(t) for t in texts]
        cut = [self._cut.findall(m) for m, _ in made]
        parts = list(chain.from_iterable(cut))
        self._learn(set(parts))
        number = np.fromiter(map(self._number.__getitem__, parts), np.int64, len(parts))
        sizes = self._starts[number + 1] - self._starts[number]
        behind = np.append(0, np.cumsum(sizes))
        every = self._pool[np.repeat(self._starts[number] - behind[:-1], sizes) + np.arange(behind[-1])]
        borders = behind[np.cumsum([0, *map(len, cut)])]
        out = []
        for a, b, (_, aligned) in zip(borders, borders[1:], made):
            ids = every[a:b]
            first, last = aligned[:1], aligned[-1:]
            ends = aligned[np.cumsum(self.width[ids])]
            starts = np.concatenate([first, ends[:-1]]) if len(ids) else ends
            out.append((np.concatenate([[self.begin], ids, [self.end]]), np.concatenate([first, starts, last]), np.concatenate([first, ends, last])))
        return out

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.surface):
            raise ValueError("ids outside of the vocabulary")
        surface = self.surface
        words = [surface[i] for i in ids.tolist()]
        # runs of bytes are characters, or replacement marks
        flags = np.concatenate([[0], self.is_byte[ids], [0]])
        edges = np.flatnonzero(np.diff(flags))
        for a, b in zip(edges[::2], edges[1::2]):
            words[a:b] = [self.byte_of[ids[a:b]].tobytes().decode("utf-8", "mark_each"), *[""] * (b - a - 1)]
        if self.prefix or self.strip:  # the white space that encoding put in front
            for k, i in enumerate(ids.tolist()):
                if self.is_byte[i]:
                    break
                stripped = i not in self.control and words[k].startswith(" ") and self.ids.get(words[k].replace(" ", SPACE)) == i
                if stripped:
                    words[k] = words[k][1:]
                if words[k] or (stripped and not self.strip):
                    break
        return "".join(words)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def encode_texts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model: str | None = None, packed: bool = False, decode: bool = False) -> DataFrame:
    """(keep..., ids, starts, ends) of each row: arrays of int, or packed as
    little-endian 32-bit numbers. starts and ends are bytes of the source.
    decode adds `decoded`, the text that the ids stand for."""
    path = model or public_tokenizers.path(MODEL)
    # a name of its own for the text, which may be among the kept columns
    source = fresh_name(docs, "source_text")
    rows = docs.select(*keep, whole_text(text).alias(source))
    kind, names = "binary" if packed else "array<int>", [*keep, "ids", "starts", "ends", *["decoded"] * decode]

    def column(parts: list[np.ndarray]) -> pa.Array:
        if packed:
            return pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for batch in batches:
            texts, k = batch.column(len(keep)), 0
            while k < batch.num_rows:
                n, chars = 0, 0
                while k + n < batch.num_rows and n < AT_ONCE and chars < CHARS:
                    chars += len(texts[k + n].as_buffer())
                    n += 1
                made = known.encode_all(texts.slice(k, n).to_pylist())
                arrays = [*batch.slice(k, n).columns[: len(keep)], *(column([m[i] for m in made]) for i in range(3))]
                if decode:
                    arrays.append(pa.array([known.decode(m[0]) for m in made], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                k += n

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(encode, f"{kept}, ids {kind}, starts {kind}, ends {kind}" + ", decoded string" * decode)


def decode_texts(ids: Column, model: str | None = None) -> Column:
    """The decoded text of a column of packed ids."""
    path = model or public_tokenizers.path(MODEL)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        known = pieces(path)
        return pa.array([None if x is None else known.decode(np.frombuffer(x, "<u4")) for x in column.to_pylist()], pa.string())

    return decode(ids)


def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """The ids and spans of every text, and the text that the ids decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = encode_texts(docs, packed=True, decode=True)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )
