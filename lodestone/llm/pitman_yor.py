"""Language-model scores by a hierarchical Pitman-Yor model.

A word is drawn in the restaurant of its context, the preceding word. Contexts
of words with equal endings share a parent restaurant, and these share the one
without context, whose base gives each known word the same probability and the
unknown word, one event as in the base score, UNKNOWN. A context is a room: one
of ENDINGS classes of the preceding word's last two bytes, and within it one of
INNER classes by hash. Rooms are 2 ** 20 at most, at any size of the corpus.

Seating is sampled by Gibbs. A restaurant keeps, for each dish (word), its
customers c and tables t; how the customers sit at the t tables is summed out.
A customer leaves, and closes a table with the probability S(c-1, t-1) / S(c, t)
of generalized Stirling numbers; then sits down again, at a new table with a
weight of (strength + discount * tables of the room) * probability in the
parent, else at an old one with c - 1 - discount * t. New tables are customers
of the parent. A sweep has as many such moves for each dish of each room as it
has customers, each of a customer picked at random. At first, customers come in
and sit down one by one, as do those that a parent gets or loses. Moves that
change no number of tables are passed over by the law of how many there are, so
the work goes by tables. The averaged predictive probabilities of the last
round's sweeps score the texts.

Words are dealt to buckets by hash, so all rooms' tables for a word, and their
parents', are in one task. What tasks must know of each other is the number of
customers and tables of each room: bounded arrays, which go round between
rounds, so within a round a room's total is that of the round's start. Random
numbers are hashes of word, room, sweep and step: a task that runs again, or a
later job, seats alike; so no seating is stored.

The texts are read once. A task tokenizes, and sends to each bucket a packed
cell: the pairs (room, word) of a chunk of documents and the documents' places
in it. A table read from files gives its rows in the same order when a task runs
again; write any other table first. A bucket merges its cells, is written, and is read by each job
without another shuffle. Words that have more than a bucket's share of a sample
(a hint for the dealing alone) get several buckets: each knows all counts of
the word, and the documents are split between them.

Defined cases: a null text counts as empty, and is its end token alone; a null
id is not held out; repeated rows get equal scores and are learned from each;
without training tokens only the base is left; words, and documents in the
sums, are told apart by 64-bit hashes; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, whole_text, words_of, written

FOLDS, HELD_OUT = 7, 2
STRENGTH = 1.0
#: The base's probability of the unknown word.
UNKNOWN = 0.5
ROUNDS, SWEEPS, MOVES = 2, 2, 8
ENDINGS, INNER = 1024, 1024
ROOMS = (1, ENDINGS, ENDINGS * INNER)  # of each level
#: Tokens of a cell's text; bytes of text for each bucket.
CHUNK, BUCKET_BYTES = 1 << 20, 4 << 20
#: Documents of the hint; the share of tokens that it can tell.
HINT, HINT_SHARE, LEAST_SEEN, LEAST_SHARE, HINT_SEED = 2000, 1e-4, 32, 1 / 4096, 9
#: Customers up to which closing a table has its exact probability.
EXACT = 256
#: Lines of the grid beyond: for a doubling of the customers, and across the tables.
FINE, ACROSS = 2, 256
#: Expected events from which a dish is sampled by itself; events drawn ahead for it.
LONG, AHEAD = 40, 128
END = np.uint64(xxhash.xxh64_intdigest(b"", 42))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def mixed(z: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, mixed (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(keys: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) from unsigned 64-bit keys."""
    return (mixed(keys + np.uint64((sweep * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) / float(1 << 53)


def uniforms(key: np.uint64, sweep: int, step: int, n: int) -> np.ndarray:
    """The same of one key, for n steps from step on."""
    steps = np.arange(step, step + n, dtype=np.uint64) + np.uint64(sweep * 1_000_003 + 1)
    return (mixed(key + steps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53)


def discount_of(n1: float, n2: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5


@lru_cache(maxsize=8)
def closing_table(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: the probability that a customer who leaves closes a table,
    S(c-1, t-1) / S(c, t). With q(c, t) = S(c, t-1) / S(c, t) it is
    1 / (1 + (c - 1 - d t) / q(c-1, t))."""
    out = np.zeros((most + 1, most + 1))
    t = np.arange(most + 1, dtype=float)
    q = np.full(most + 1, np.inf)  # of c = 1: S(1, t) is 0 beyond t = 1
    q[:2], out[1, 1] = 0.0, 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, most + 1):
            stay = np.where(t < c, (c - 1 - discount * t) / q, 0.0)  # S(c-1, t) (c-1-dt) / S(c-1, t-1)
            out[c] = np.where(t < 2, 0.0, np.where(t < c, 1 / (1 + stay), 1.0))
            before = np.append(0.0, q[:-1])
            new = (before + (c - 1 - discount * (t - 1))) / (1 + stay)
            q = np.where(t < 2, 0.0, np.where(t <= c, new, np.inf))
    return out


@lru_cache(maxsize=8)
def closing_grid(discount: float, octaves: int) -> np.ndarray:
    """[i, j]: the same probability, over discount * (t - 1) / c, at
    c = EXACT * 2 ** (i / FINE) and t = c ** (j / ACROSS), i below octaves * FINE.

    S(c, t) is c! / (t! d ** t) times the coefficient of x ** c in f(x) ** t, f(x) =
    1 - (1 - x) ** d. So the probability is t d / c times the mean of x / f over
    f ** t * x ** (-c - 1) on a path around the cut from 1. The path is a parabola of
    1 - x through the saddle point, or 1 / c, and its steps grow as sinh."""
    log_c = np.log(EXACT) + np.log(2) * np.arange(octaves * FINE + 1)[:, None, None] / FINE
    c = np.exp(log_c)
    t = np.clip(np.exp(log_c * np.arange(ACROSS + 1)[:, None] / ACROSS), 1 + 1e-5, c * (1 - 1e-9))
    low, high = np.full(t.shape, -40.0), np.full(t.shape, 400.0)  # logit of the saddle's x, by bisection
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for _ in range(60):
            y = (low + high) / 2
            log_z = -np.logaddexp(0, y)
            up = np.exp(np.log(discount) + (discount - 1) * log_z - np.logaddexp(0, -y)) / -np.expm1(discount * log_z) < c / t
            low, high = np.where(up, y, low), np.where(up, high, y)
        log_z = np.maximum(-np.logaddexp(0, low), -log_c)
        z, f = np.exp(log_z), -np.expm1(discount * log_z)
        x, slope = -np.expm1(log_z), discount * np.exp((discount - 1) * log_z)
        bend = t * (discount * (1 - discount) * np.exp((discount - 2) * log_z) / f - (slope / f) ** 2) + c / x**2
        u = np.minimum(1, 1 / (2 * z * np.sqrt(np.abs(bend)))) * np.sinh(np.linspace(0, 11, 221))
        log_1u = np.log(1 + 1j * u)
        log_z = log_z + 2 * log_1u
        x, f = -np.expm1(log_z), -np.expm1(discount * log_z)
        w = t * np.log(f) - (c + 1) * np.log(x) + log_1u
        w = np.exp(w - w[..., :1]) * np.cosh(np.linspace(0, 11, 221))
        w = np.where(np.isfinite(w), w, 0)
        w[..., 0] /= 2
        ratio = np.where(w == 0, 0, w * x / f).sum(axis=-1).real / w.sum(axis=-1).real
    t, c = t[..., 0], c[..., 0]
    return t / (t - 1) * ratio


class Dishes:
    """The dishes of all rooms of a level, in one bucket. Customers sit down,
    leave and change seats one by one; steps in which no table opens or closes
    are passed over together, by the law of their number."""

    def __init__(self, rooms, words, parents, keys, discount: float):
        self.rooms, self.words, self.parents, self.keys = rooms, words, parents, keys
        self.discount, self.closing = discount, closing_table(discount)
        self.c, self.t = np.zeros(len(rooms)), np.zeros(len(rooms))

    def closes(self, c, t):
        """The probability that one who leaves closes a table: beyond EXACT
        customers by cubic interpolation in closing_grid."""
        small = c <= EXACT
        out = self.closing[np.where(small, c, 0).astype(int), np.where(small, t, 0).astype(int)]
        large = np.flatnonzero(~small)
        if len(large):
            c, t = c[large], t[large]
            log_c = np.log(c)
            grid = closing_grid(self.discount, max(8, 4 * math.ceil(math.log2(c.max() / EXACT) / 4)))
            (i, x), (j, y) = (self._cubic(v, n) for v, n in ((np.log2(c / EXACT) * FINE, len(grid)), (np.log(np.maximum(t, 1)) / log_c * ACROSS, ACROSS + 1)))
            g = sum(x[a] * y[b] * grid[i + a, j + b] for a in range(4) for b in range(4))
            out[large] = np.where(t == c, 1.0, np.clip(g * self.discount * (t - 1) / c, 0, 1))
        return out

    @staticmethod
    def _cubic(at: np.ndarray, n: int):
        """The first of the four grid lines around a place, and their weights."""
        first = np.clip(at.astype(int) - 1, 0, n - 4)
        x = at - first
        return first, (-(x - 1) * (x - 2) * (x - 3) / 6, x * (x - 2) * (x - 3) / 2, -x * (x - 1) * (x - 3) / 2, x * (x - 1) * (x - 2) / 6)

    def _passed(self, p: np.ndarray, at: np.ndarray, sweep: int, step: int) -> np.ndarray:
        """Steps before the first that happens, each with the probability p."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(p > 0, np.floor(np.log1p(-uniform(self.keys[at], sweep, step)) / np.log1p(-p)), np.inf)

    def resize(self, customers: np.ndarray, new_table: np.ndarray, sweep: int) -> None:
        """Customers come or go, one by one, until each dish has the given
        number; new_table: the weight of a new table.

        One who comes opens a table with the probability new_table / (new_table +
        c - discount * t), which falls as they come; one who goes closes one with
        closes(c, t), which rises as they go. So the next who may is drawn by the
        largest probability ahead, and does by the ratio of the two."""
        first = (self.c == 0) & (customers > 0)
        self.c[first] = self.t[first] = 1
        self._come(np.flatnonzero(self.c < customers), customers, new_table, sweep)
        self._go(np.flatnonzero(self.c > customers), customers, sweep)

    def _come(self, at: np.ndarray, customers: np.ndarray, new_table: np.ndarray, sweep: int) -> None:
        a, step = new_table[at], 0
        long = a * np.log1p((customers[at] - self.c[at]) / (a + self.c[at])) > LONG
        for k in at[long]:
            self._come_to_one(k, float(customers[k]), float(new_table[k]), sweep)
        at = at[~long]
        while len(at):
            c, t, a = self.c[at], self.t[at], new_table[at]
            most = a / (a + c - self.discount * t)
            c = c + self._passed(most, at, sweep, step)
            opens = uniform(self.keys[at], sweep, step + 1) * most < a / (a + c - self.discount * t)
            self.t[at] = t + (opens & (c < customers[at]))
            self.c[at] = c = np.minimum(c + 1, customers[at])
            at, step = at[c < customers[at]], step + 2

    def _come_to_one(self, k: int, goal: float, a: float, sweep: int) -> None:
        """_come for a dish of many tables: plain numbers are quicker there."""
        c, t, d, step = float(self.c[k]), float(self.t[k]), self.discount, 0
        while c < goal:
            u = uniforms(self.keys[k], sweep, step, 2 * AHEAD)
            for passed, opens in zip(np.log1p(-u[::2]).tolist(), u[1::2].tolist()):
                most = a / (a + c - d * t)
                c += math.floor(passed / math.log1p(-most)) if most < 1 else 0
                if c < goal and opens * most < a / (a + c - d * t):
                    t += 1
                c = min(c + 1, goal)
                if c == goal:
                    break
            step += 2 * AHEAD
        self.c[k], self.t[k] = c, t

    def _go(self, at: np.ndarray, customers: np.ndarray, sweep: int) -> None:
        step = 0
        while len(at):
            c, t = self.c[at], self.t[at]
            ahead = np.minimum(np.minimum(c - customers[at], np.maximum(1, c // 8)), c - t + 1)
            most = self.closes(c - ahead + 1, t)
            passed = self._passed(most, at, sweep, step)
            some = passed < ahead
            c = c - np.minimum(passed, ahead - 1)
            closes = uniform(self.keys[at], sweep, step + 1) * most < self.closes(c, t)
            self.t[at] = t - (some & closes)
            self.c[at] = c = c - 1
            at, step = at[c > customers[at]], step + 2

    def sweep(self, new_table: np.ndarray, sweep: int) -> None:
        """As often as a dish has customers, one of them, picked at random,
        leaves and sits down again."""
        at = np.flatnonzero(self.c > 1)
        up, down = self._changes(self.c[at], self.t[at], new_table[at])
        long = (up + down) * self.c[at] > LONG
        for k in at[long]:
            self._sweep_one(k, float(new_table[k]), sweep)
        at = at[~long]
        left, step = self.c[at], 0
        while len(at):
            t = self.t[at]
            up, down = self._changes(self.c[at], t, new_table[at])
            passed = self._passed(up + down, at, sweep, step)
            change = np.where(uniform(self.keys[at], sweep, step + 1) * (up + down) < up, 1, -1)
            self.t[at] = t + np.where(passed < left, change, 0)
            left = left - passed - 1
            some = left > 0
            at, left, step = at[some], left[some], step + 2

    def _changes(self, c, t, a):
        """The probabilities that a move adds a table, and that it takes one."""
        closes = self.closes(c, t)
        rest = c - 1 - self.discount * t
        return (1 - closes) * a / (a + rest), closes * (1 - a / (a + rest + self.discount))

    def _sweep_one(self, k: int, a: float, sweep: int) -> None:
        """sweep for a dish of many changes, with their probabilities told for
        the numbers of tables around."""
        c, t, step = float(self.c[k]), int(self.t[k]), 0
        left, low, p = c, 0, []
        while left > 0:
            u = uniforms(self.keys[k], sweep, step, 2 * AHEAD)
            for passed, which in zip(np.log1p(-u[::2]).tolist(), u[1::2].tolist()):
                if not 0 <= t - low < len(p):
                    low = max(1, t - AHEAD // 2)
                    near = np.arange(low, min(c, t + AHEAD // 2) + 1)
                    up, down = self._changes(np.full(len(near), c), near, a)
                    with np.errstate(divide="ignore"):
                        p, up, logs = (up + down).tolist(), up.tolist(), np.log1p(-(up + down)).tolist()
                at = t - low
                passed = math.floor(passed / logs[at]) if logs[at] else left
                if passed < left:
                    t += 1 if which * p[at] < up[at] else -1
                left -= passed + 1
                if left <= 0:
                    break
            step += 2 * AHEAD
        self.t[k] = t


class GroupedDishes(Dishes):
    """A coarser way that no query takes: customers beyond 16 of a dish come and
    go in groups, a sweep re-seats MOVES of them at most, and closing a table
    beyond EXACT customers follows Sibuya's law. It is what the plain sampler of
    the first tests states."""

    def closes(self, c, t):
        """The probability that one who leaves closes a table. Beyond EXACT
        customers one table has nearly all of them and the others are as large
        as by Sibuya's law, so d (t - 1) of them have one customer."""
        small = c <= EXACT
        exact = self.closing[np.where(small, c, 0).astype(int), np.where(small, t, 0).astype(int)]
        return np.where(small, exact, np.minimum(1.0, self.discount * (t - 1) / np.maximum(c, 1)))

    def resize(self, customers: np.ndarray, new_table: np.ndarray, sweep: int) -> None:
        """Customers come or go until each dish has the given number;
        new_table: the weight of a new table. Up to 16 go one by one, then in
        groups of a sixteenth whose tables are their expectation, rounded at
        random."""
        active, step = np.flatnonzero(self.c != customers), 0
        while len(active):
            c, t = self.c[active], self.t[active]
            left = customers[active] - c
            group = np.minimum(np.maximum(1, c // 16), np.abs(left))
            come = new_table[active] / (new_table[active] + c - self.discount * t)
            p = np.where(left > 0, np.where(c > 0, come, 1.0), self.closes(c, t))
            tables = np.floor(group * p + uniform(self.keys[active], sweep, step))
            c = c + np.sign(left) * group
            t = np.clip(t + np.sign(left) * tables, np.minimum(c, 1), c)
            self.c[active], self.t[active] = c, t
            active = active[c != customers[active]]
            step += 1

    def sweep(self, new_table: np.ndarray, sweep: int) -> None:
        """Customers leave and sit down again, one of a dish at a time."""
        active = np.flatnonzero(self.c > 1)
        for step in range(MOVES):
            active = active[self.c[active] > step]
            if not len(active):
                break
            c, t, a = self.c[active], self.t[active], new_table[active]
            t = t - (uniform(self.keys[active], sweep, 2 * step) < self.closes(c, t))
            self.t[active] = t + (uniform(self.keys[active], sweep, 2 * step + 1) < a / (a + c - 1 - self.discount * t))


class Totals(NamedTuple):
    """Customers and tables of the rooms of each level, without context first."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]


class Rules(NamedTuple):
    """What holds for all tasks: discounts by level, known words."""

    discounts: tuple[float, ...]
    vocabulary: int


class Seating:
    """The three levels of a bucket's words, as sampled so far."""

    def __init__(self, words: np.ndarray, pair_word: np.ndarray, rooms: np.ndarray, counts: np.ndarray, rules: Rules, dishes: type[Dishes] = GroupedDishes):
        self.counts = counts.astype(float)
        ending, which = np.unique(pair_word.astype(np.int64) * ENDINGS + rooms // INNER, return_inverse=True)
        which, pair_word, rooms = (x.astype(np.int32) for x in (which, pair_word, rooms))
        key = lambda w, room, level: mixed(words[w] + room.astype(np.uint64) * np.uint64(8) + np.uint64(level))
        w1, r1 = (x.astype(np.int32) for x in np.divmod(ending, ENDINGS))
        w0, r0 = np.arange(len(words), dtype=np.int32), np.zeros(len(words), np.int32)
        self.levels = [
            dishes(r0, w0, None, key(w0, r0, 0), rules.discounts[0]),
            dishes(r1, w1, w1, key(w1, r1, 1), rules.discounts[1]),
            dishes(rooms, pair_word, which, key(pair_word, rooms, 2), rules.discounts[2]),
        ]
        known = np.bincount(pair_word, self.counts, len(words)) > 0
        self.base = np.where(known, (1 - UNKNOWN) / max(1, rules.vocabulary), UNKNOWN)

    def fewest(self) -> None:
        """One table for each dish."""
        customers = self.counts
        for level in (2, 1, 0):
            d = self.levels[level]
            d.c, d.t = customers.copy(), np.minimum(customers, 1.0)
            customers = self.to_parents(level)

    def to_parents(self, level: int):
        d = self.levels[level]
        return np.bincount(d.parents, d.t, len(self.levels[level - 1].c)) if level else None

    def predictive(self, totals: Totals) -> list[np.ndarray]:
        """The probability of each dish in its room, level by level."""
        out, below = [], self.base
        for level, d in enumerate(self.levels):
            all_c, all_t = totals.customers[level][d.rooms], totals.tables[level][d.rooms]
            up = below if d.parents is None else below[d.parents]
            seated = (np.maximum(d.c - d.discount * d.t, 0) + (STRENGTH + d.discount * all_t) * up) / (STRENGTH + all_c)
            below = np.where(all_c > 0, seated, up)
            out.append(below)
        return out

    def new_tables(self, totals: Totals) -> list[np.ndarray]:
        """The weight of a new table for each dish, level by level."""
        p = [self.base, *self.predictive(totals)]
        return [(STRENGTH + d.discount * totals.tables[k][d.rooms]) * (p[k] if d.parents is None else p[k][d.parents]) for k, d in enumerate(self.levels)]

    def come_in(self, totals: Totals) -> None:
        self.fewest()
        weights = self.new_tables(totals)
        customers = self.counts
        for level in (2, 1, 0):
            d = self.levels[level]
            d.c, d.t = np.zeros(len(d.c)), np.zeros(len(d.c))
            d.resize(customers, weights[level], 0)
            customers = self.to_parents(level)

    def sweep(self, totals: Totals, number: int) -> None:
        """From the contexts up; number: from 1, tells random numbers apart."""
        weights = self.new_tables(totals)
        for level in (2, 1, 0):
            self.levels[level].sweep(weights[level], 2 * number)
            if level:
                self.levels[level - 1].resize(self.to_parents(level), weights[level - 1], 2 * number + 1)

    def states(self, rounds: list[Totals]) -> Iterator[int]:
        """Seats everybody, then sweeps SWEEPS times on each totals; yields the
        round after each sweep."""
        self.come_in(rounds[0])
        for k, totals in enumerate(rounds):
            for s in range(SWEEPS):
                self.sweep(totals, 1 + k * SWEEPS + s)
                yield k


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed bytes: first bytes together, then second ones."""
    if not len(values):
        return bytes(8)
    data = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return len(data.tobytes()).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(data.T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Of a cell and of a merged bucket: distinct words, pairs of each word, room and
#: training tokens of each pair, listed tokens of each pair, their documents, as
#: the place of a chunk in a list and of the document in the chunk, and that list.
COLUMNS = {"words": "u8", "kinds": "i4", "rooms": "i4", "counts": "i8", "listed": "i4", "docs": "i8", "chunks": "i8"}
#: Bits of a document's place; a chunk has CHUNK tokens, and as many documents, at most.
PLACE = 21
#: Sums of hot words have the buckets from here down, FAN of each word; a task
#: adds up so many parts of a word at a time.
SUMS, FAN, HELD_PARTS = -(1 << 62), 64, 64
CELL = "bucket bigint, leads boolean, " + ", ".join(f"{c} binary" for c in COLUMNS)


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and room of each token of a text, the end token included; the room
    is that of the word before."""
    words = text.encode().lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    if not words:
        return np.append(hashes, END), np.zeros(1, np.int32)
    data = np.frombuffer(b"  " + b" ".join(words), np.uint8).astype(np.int64)
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the places of last bytes, less one
    ending = (data[last] * 31 + data[last - 1]) % ENDINGS
    rooms = ending * INNER + (hashes >> np.uint64(20)).astype(np.int64) % INNER
    return np.append(hashes, END), np.append(0, rooms).astype(np.int32)


def home(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word, not falling as the hashes rise."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cells(batches: Iterator[pd.DataFrame], buckets: int, hot: dict[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Packed cells of documents (key, text, held), and for each chunk of them a
    row of the bucket -1 - chunk with their keys. hot: word -> its first bucket
    and how many it has."""
    chunk = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    #: Of each hot word, rooms and counts of this task's chunks.
    sums: dict[int, list[tuple]] = {}

    def cell(bucket, leads, words, rooms, docs, train, listed=True):
        new = np.append(True, (words[1:] != words[:-1]) | (rooms[1:] != rooms[:-1]))
        at = np.flatnonzero(new)
        first = np.append(True, words[at][1:] != words[at][:-1])
        got = {
            "words": words[at][first], "kinds": np.diff(np.append(np.flatnonzero(first), len(at))), "rooms": rooms[at], "counts": np.add.reduceat(train, at),
            "listed": np.diff(np.append(at, len(words))) if listed else np.zeros(len(at)), "docs": docs if listed else docs[:0], "chunks": np.array([chunk]),
        }
        return {"bucket": bucket, "leads": leads, **{c: packed(got[c], kind) for c, kind in COLUMNS.items()}}

    def flush():
        nonlocal chunk
        keys = {**dict.fromkeys(COLUMNS, bytes(8)), "docs": packed(np.array([k for k, _, _, _ in held], np.int64), "i8")}
        words, rooms = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        docs = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        train = np.repeat([int(not h[3]) for h in held], [len(h[1]) for h in held]).astype(np.int64)
        order = np.lexsort((rooms, words))
        words, rooms, docs, train = words[order], rooms[order], docs[order], train[order]
        mixed = (chunk * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40
        many = np.isin(words, np.array(list(hot), np.uint64))
        rows = [{"bucket": -1 - chunk, "leads": False, **keys}]
        for w in np.unique(words[many]):
            mine = slice(np.searchsorted(words, w), np.searchsorted(words, w, "right"))
            first, n = hot[int(w)]
            k = mixed % n  # one bucket lists the chunk's documents; its rooms and counts go into sums
            rows.append(cell(first + k, k == 0, words[mine], rooms[mine], docs[mine], np.zeros_like(train[mine])))
            own = sums.setdefault(int(w), [])
            new = np.flatnonzero(np.append(True, np.diff(rooms[mine]) != 0))
            own.append((rooms[mine][new], np.add.reduceat(train[mine], new)))
            if len(own) > HELD_PARTS:
                own[:] = [summed(own)]
        words, rooms, docs, train = words[~many], rooms[~many], docs[~many], train[~many]
        ends = np.append(0, np.searchsorted(home(words, buckets), np.arange(buckets), "right"))
        for b in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[b], ends[b + 1])
            rows.append(cell(b, True, words[mine], rooms[mine], docs[mine], train[mine]))
        held.clear()
        chunk += 1
        return pd.DataFrame(rows)

    size = 0
    for batch in batches:
        for key, text, out in zip(batch["key"], batch["text"], batch["held"]):
            held.append((key, *tokens_of(text), out))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield flush()
                size = 0
    if held:
        yield flush()
    rows = []
    for w, own in sums.items():
        rooms, counts = summed(own)
        of = SUMS - (hot[w][0] * FAN + (chunk >> 32) % FAN)
        rows.append(cell(of, True, np.full(len(rooms), w, np.uint64), rooms, np.zeros(0, np.int64), counts, False))
    if rows:
        yield pd.DataFrame(rows)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(room, count) of a hot word, added up."""
    rooms, at = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return rooms, np.bincount(at, np.concatenate([c for _, c in parts]), len(rooms)).astype(np.int64)


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The cells of a bucket as one; what is of a chunk stays as it is."""
    if SUMS < pdf["bucket"].iloc[0] < 0:
        return pdf
    got = {c: [unpacked(x, kind) for x in pdf[c]] for c, kind in COLUMNS.items()}
    words = np.concatenate([np.repeat(w, k) for w, k in zip(got["words"], got["kinds"])])
    rooms, counts, listed = (np.concatenate(got[c]) for c in ("rooms", "counts", "listed"))
    lists = np.cumsum([0, *map(len, got["chunks"])])
    docs = np.concatenate([d + (k << PLACE) for k, d in zip(lists.tolist(), got["docs"])])
    order = np.lexsort((rooms, words))
    starts = np.cumsum(listed) - listed
    ends = np.cumsum(listed[order])
    docs = docs[np.arange(len(docs)) - np.repeat(ends - listed[order], listed[order]) + np.repeat(starts[order], listed[order])]
    words, rooms = words[order], rooms[order]
    at = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (rooms[1:] != rooms[:-1])))
    first = np.append(True, words[at][1:] != words[at][:-1])
    out = {
        "words": words[at][first], "kinds": np.diff(np.append(np.flatnonzero(first), len(at))), "rooms": rooms[at], "counts": np.add.reduceat(counts[order], at),
        "listed": np.add.reduceat(listed[order], at), "docs": docs, "chunks": np.concatenate(got["chunks"]),
    }
    return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], "leads": pdf["leads"].iloc[0], **{c: packed(out[c], kind) for c, kind in COLUMNS.items()}}])


def with_sums(dealt: DataFrame, hot: dict[int, tuple[int, int]]) -> DataFrame:
    """The merged buckets, each hot word's with its rooms and counts of all
    chunks. These are added up in three steps, in the task that reads them, by
    FAN groups of tasks and by word, before a sum goes to the word's buckets. So
    what a bucket gets is a number for each room, however many chunks there are."""
    merged = dealt.groupBy("bucket").applyInPandas(merge, CELL)
    if not hot:
        return merged
    merged = written(merged, "cells")
    firsts = {first: n for first, n in hot.values()}
    low, of = F.lit(min(firsts)), F.expr(f"({SUMS} - bucket) div {FAN}")
    many = F.lit(1)
    if firsts:  # a few words
        many = F.element_at(F.create_map(*[F.lit(x) for p in firsts.items() for x in p]), F.col("bucket").cast("int"))
    sums = merged.filter(F.col("bucket") <= SUMS).withColumn("bucket", of).groupBy("bucket").applyInPandas(merge, CELL)
    copies = sums.withColumn("k", F.explode(F.sequence(F.lit(0), many - 1))).withColumn("leads", F.col("k") == 0).withColumn("bucket", F.col("bucket") + F.col("k")).drop("k")
    lists = merged.filter(F.col("bucket") >= low)
    whole = lists.unionByName(copies).groupBy("bucket").applyInPandas(merge, CELL)
    return merged.filter((F.col("bucket") < low) & (F.col("bucket") > SUMS)).unionByName(whole)


def _seating(row, rules: Rules) -> Seating:
    words = unpacked(row["words"], "u8")
    return Seating(words, np.repeat(np.arange(len(words)), unpacked(row["kinds"], "i4")), unpacked(row["rooms"], "i4").astype(np.int64), unpacked(row["counts"], "i8"), rules, Dishes)


TOLD_COLUMNS = ["state", "level", "slice", "rooms", "customers", "tables", "ones", "twos"]
TOLD = "state int, level int, slice int, rooms binary, customers binary, tables binary, ones bigint, twos bigint"
SLICE = 1 << 14


def _told(seating: Seating, state: int) -> Iterator[dict]:
    """A bucket's part of the totals, by slices of rooms."""
    for level, d in enumerate(seating.levels):
        some = np.flatnonzero(d.c)
        rooms, which = np.unique(d.rooms[some], return_inverse=True)
        c, t = np.bincount(which, d.c[some], len(rooms)), np.bincount(which, d.t[some], len(rooms))
        ends = np.searchsorted(rooms, np.arange(0, ROOMS[level] + SLICE, SLICE))
        for k in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[k], ends[k + 1])
            lead = k == np.flatnonzero(np.diff(ends))[0]
            yield {"state": state, "level": level, "slice": k, "rooms": packed(rooms[mine] - k * SLICE, "i4"), "customers": packed(c[mine], "i8"), "tables": packed(t[mine], "i8"), "ones": int(lead and (d.c == 1).sum()), "twos": int(lead and (d.c == 2).sum())}


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    c, t = np.zeros(SLICE, np.int64), np.zeros(SLICE, np.int64)
    for rooms, customers, tables in zip(pdf["rooms"], pdf["customers"], pdf["tables"]):
        at = unpacked(rooms, "i4")
        c[at] += unpacked(customers, "i8")
        t[at] += unpacked(tables, "i8")
    some = np.flatnonzero(c)
    first = {c: int(pdf[c].iloc[0]) for c in TOLD_COLUMNS[:3]}
    return pd.DataFrame([{**first, "rooms": packed(some, "i4"), "customers": packed(c[some], "i8"), "tables": packed(t[some], "i8"), "ones": pdf["ones"].sum(), "twos": pdf["twos"].sum()}])


def gather(told: DataFrame) -> dict[int, tuple[Totals, list[list[int]]]]:
    """By state the totals of all buckets, and by level the dishes with one and
    two customers. A few numbers for each of ROOMS come to the driver."""
    out: dict = {}
    for r in told.groupBy("state", "level", "slice").applyInPandas(_add, TOLD).collect():
        totals, few = out.setdefault(r["state"], (Totals([np.zeros(n) for n in ROOMS], [np.zeros(n) for n in ROOMS]), [[0, 0] for _ in ROOMS]))
        at = r["slice"] * SLICE + unpacked(r["rooms"], "i4")
        totals.customers[r["level"]][at] = unpacked(r["customers"], "i8")
        totals.tables[r["level"]][at] = unpacked(r["tables"], "i8")
        few[r["level"]][0] += r["ones"]
        few[r["level"]][1] += r["twos"]
    return out


def nothing() -> Totals:
    return Totals([np.zeros(n) for n in ROOMS], [np.zeros(n) for n in ROOMS])


def learn(buckets: DataFrame) -> tuple[Rules, list[Totals], list[Totals]]:
    """The rules, the totals at the start of each round, and those after each
    sweep of the last one."""
    leading = buckets.filter("leads").select("words", "kinds", "rooms", "counts")
    any_rules = Rules((0.5, 0.5, 0.5), 1)

    def fewest(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                seating = _seating(row, any_rules)
                seating.fewest()
                yield pd.DataFrame([*_told(seating, 0)], columns=TOLD_COLUMNS)

    totals, few = gather(leading.mapInPandas(fewest, TOLD)).get(0, (nothing(), [[0, 0]] * 3))
    rules = Rules(tuple(discount_of(*f) for f in few), int(totals.tables[0][0]))
    rounds = [totals]
    for k in range(ROUNDS):
        shared = buckets.sparkSession.sparkContext.broadcast((rules, rounds))  # a few numbers for each of ROOMS

        def sweeps(batches, shared=shared, k=k):
            rules, rounds = shared.value
            for batch in batches:
                for row in batch.to_dict("records"):
                    seating = _seating(row, rules)
                    for n, at in enumerate(seating.states(rounds)):
                        if at == k and (k == ROUNDS - 1 or n % SWEEPS == SWEEPS - 1):
                            yield pd.DataFrame([*_told(seating, n)], columns=TOLD_COLUMNS)

        after = gather(leading.mapInPandas(sweeps, TOLD))
        if k < ROUNDS - 1:
            rounds.append(after.get(k * SWEEPS + SWEEPS - 1, (nothing(), None))[0])
    kept = [after.get(k * SWEEPS + s, (nothing(), None))[0] for s in range(SWEEPS)]
    for x in (*rounds[1:], *kept):  # the customers of contexts are the same in all
        x.customers[2] = totals.customers[2]
    return rules, rounds, kept


def averaged(seating: Seating, rounds: list[Totals], kept: list[Totals]) -> np.ndarray:
    """The probability of each pair's word in its room, averaged over the kept
    states."""
    p, last = np.zeros(len(seating.counts)), len(rounds) - 1
    for n, at in enumerate(seating.states(rounds)):
        if at == last:
            p += seating.predictive(kept[n - last * SWEEPS])[2]
    return p / len(kept)


PARTS = "chunk bigint, places binary, base binary, score binary, known binary, tokens binary"
#: Sums of logarithms travel as whole numbers of this.
GRAIN = 1e-9
#: Sums that a task holds before it passes them on.
HELD_SUMS = 1 << 20


class Sums:
    """Sums of base score, score, known and all tokens by document, of all the
    buckets that a task reads one after another."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, docs: np.ndarray, chunks: np.ndarray, values) -> None:
        own, which = np.unique(docs, return_inverse=True)
        self.held.append((chunks[own >> PLACE], own & ((1 << PLACE) - 1), *(np.bincount(which, x, len(own)) for x in values)))
        self.size += len(own)

    def flush(self) -> Iterator[pd.DataFrame]:
        if self.size:
            chunk, place, *values = (np.concatenate(x) for x in zip(*self.held))
            order = np.lexsort((place, chunk))
            chunk, place = chunk[order], place[order]
            at = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1])))
            chunk, place = chunk[at], place[at]
            base, score, known, tokens = (np.add.reduceat(x[order], at) for x in values)
            ends = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
            whole = lambda x: packed(np.rint(x / GRAIN), "i8")
            rows = [(chunk[a], packed(place[a:b], "i4"), whole(base[a:b]), whole(score[a:b]), packed(known[a:b], "i4"), packed(tokens[a:b], "i4")) for a, b in zip(ends[:-1], ends[1:])]
            yield pd.DataFrame(rows, columns=["chunk", "places", "base", "score", "known", "tokens"])
            self.held, self.size = [], 0


def _sums(parts: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """The parts of a chunk, summed by document."""
    keys = unpacked(docs["docs"].iloc[0], "i8")
    of = lambda c, kind: np.concatenate([unpacked(x, kind) for x in parts[c]])
    places = of("places", "i4")
    total = lambda c, kind: np.bincount(places, of(c, kind), len(keys))
    return pd.DataFrame({"key": keys, "base_score": total("base", "i8") * GRAIN, "score": total("score", "i8") * GRAIN, "n_known": total("known", "i4").astype(np.int64), "n_tokens": total("tokens", "i4").astype(np.int64)})


def hot_words(docs: DataFrame, buckets: int, rows: int) -> dict[int, tuple[int, int]]:
    """Words with more than a bucket's share of the tokens, or of eight buckets
    where these are many, with the numbers of their first bucket and of their
    buckets. They are counted in a sample of all partitions, which grows with
    the corpus; it is a hint for the dealing: results do not depend on it."""
    share = min(1.0, max(HINT / max(rows, 1), HINT_SHARE))
    some = docs.sample(False, share, HINT_SEED).select(F.explode(F.concat(words_of(ascii_lower(F.col("text"))), F.array(F.lit("")))).alias("w"))
    n = some.groupBy("w").agg(F.count("*").alias("n"))
    n = written(n, "hint")
    total = n.agg(F.sum("n")).first()[0] or 1
    share = (F.col("n") / total).alias("share")
    often = n.filter(F.col("n") >= LEAST_SEEN).select("w", share).filter(F.col("share") > max(1 / buckets, min(8 / buckets, LEAST_SHARE))).collect()
    out, at = {}, buckets
    for w, share in often:
        many = int(np.ceil(share * buckets))
        out[xxhash.xxh64_intdigest(w.encode(), 42)] = at, many
        at += many
    return out


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", held: Column | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    each row; rows for which held is true are not learned from."""
    held = held_out(F.col(id)) if held is None else held
    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"), held.alias("held"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("\0null")), "text", "held"))
    size, many = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    size = size or 0
    n_buckets = size // bucket_bytes + 1
    hot = hot_words(rows, n_buckets, many)

    dealt = rows.select("key", "text", "held").mapInPandas(lambda batches: cells(batches, n_buckets, hot), CELL)
    buckets = written(with_sums(dealt, hot), "buckets")
    rules, rounds, kept = learn(buckets)
    total = int(kept[0].customers[2].sum()) if kept else 0
    shared = docs.sparkSession.sparkContext.broadcast((rules, rounds, kept))

    def score(batches):
        rules, rounds, kept = shared.value
        sums = Sums()
        for batch in batches:
            for row in batch.to_dict("records"):
                seating = _seating(row, rules)
                own = seating.levels[2].words
                known = np.bincount(own, seating.counts, len(seating.base))[own]
                per_pair = (np.log10((known + 1) / (total + rules.vocabulary + 1)), np.log10(averaged(seating, rounds, kept)), known > 0, np.ones(len(own)))
                pair = np.repeat(np.arange(len(own)), unpacked(row["listed"], "i4"))
                sums.add(unpacked(row["docs"], "i8"), unpacked(row["chunks"], "i8"), [x[pair] for x in per_pair])
                if sums.size >= HELD_SUMS:
                    yield from sums.flush()
        yield from sums.flush()

    parts = buckets.filter("bucket >= 0").mapInPandas(score, PARTS)
    keys = buckets.filter("bucket < 0").select((-1 - F.col("bucket")).alias("chunk"), "docs")
    sums = parts.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInPandas(_sums, "key bigint, base_score double, score double, n_known bigint, n_tokens bigint")
    # rows that are equal in id and text have one key, and equal sums
    slim, each = rows.select("id", "key", "held"), sums.dropDuplicates(["key"])
    return slim.join(each, "key").select(F.col("id").alias(id), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) per token over all texts."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op4_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
