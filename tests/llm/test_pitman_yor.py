import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import pitman_yor as py


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = [*words_of(t), b""]
        out.append((i, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def test_base_equals_brute_force(spark):
    texts = [None, "", "A b a", "a B\x0bc é É", "x" * 30_000, "the cat sat", "the cat ran", "unseen words here"] + ["the cat sat on the mat"] * 30
    rows = list(enumerate(texts)) + [(2, "A b a"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, word string, n double")
    for bucket_bytes in (8 << 20, 9000):
        got = py.score_texts(df, bucket_bytes=bucket_bytes).collect()
        key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
        assert sorted(map(key, ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got))) == sorted(map(key, brute(rows)))
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert py.score_texts(df.limit(0)).count() == 0
    assert py.score_texts(spark.createDataFrame([(12, "all held out")], "doc_id long, text string")).count() == 1


def test_better_than_base_on_held_out_texts(spark, sf):
    got = {r.held_out: r for r in py.perplexity(py.op4_pitman_yor(spark, sf)).collect()}
    assert got[True].perplexity < 0.7 * got[True].base_perplexity
    assert got[False].perplexity < got[True].perplexity


def test_same_scores_however_it_is_dealt(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words {i % 5} and more {i % 3}") for i in range(60)], "doc_id long, text string")
    one = {r.doc_id: r.score for r in py.score_texts(df.repartition(1)).collect()}
    monkeypatch.setattr(py, "LEAST_SEEN", 1)  # a small table's common words have buckets of their own, too
    told = []
    plain_hot = py.hot_words
    monkeypatch.setattr(py, "hot_words", lambda *a: told.append(plain_hot(*a)) or told[-1])
    many = {r.doc_id: r.score for r in py.score_texts(df.repartition(4), bucket_bytes=100).collect()}
    assert told[0] and max(n for _, n in told[0].values()) > 1
    monkeypatch.setattr(py, "LEAST_SHARE", 1.0)  # no word has several buckets
    plain = {r.doc_id: r.score for r in py.score_texts(df, bucket_bytes=300).collect()}
    for i in one:
        assert math.isclose(one[i], many[i], abs_tol=1e-7) and math.isclose(one[i], plain[i], abs_tol=1e-7)


def test_the_order_of_words_counts(spark):
    draw = random.Random(1)
    follow = {w: draw.sample(range(40), 3) for w in range(40)}

    def text():
        w, out = draw.randrange(40), []
        for _ in range(60):
            out.append(f"word{w}")
            w = draw.choice(follow[w])
        return out

    rows = [(i, " ".join(text())) for i in range(200)]
    fluent = [text() for _ in range(10)]
    rows += [(1000 + i, " ".join(t)) for i, t in enumerate(fluent)] + [(2000 + i, " ".join(draw.sample(t, len(t)))) for i, t in enumerate(fluent)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in py.score_texts(df, held=F.col("doc_id") >= 1000).collect()}
    assert all(got[1000 + i] > got[2000 + i] + 10 for i in range(10))


def stirling(d, most):
    s = np.zeros((most + 1, most + 1))
    s[1, 1] = 1
    for c in range(2, most + 1):
        for t in range(1, c + 1):
            s[c, t] = s[c - 1, t - 1] + (c - 1 - d * t) * s[c - 1, t]
    return s


def test_closing_a_table():
    for d in (0.1, 0.5, 0.9):
        s, table = stirling(d, 60), py.closing_table(d)
        for c in range(2, 61):
            for t in range(1, c + 1):
                assert math.isclose(table[c, t], s[c - 1, t - 1] / s[c, t], rel_tol=1e-9, abs_tol=1e-12)
        for t in (2, 5, 12):  # the law beyond EXACT is near the exact value there
            assert d < 0.5 or abs(table[py.EXACT, t] / (d * (t - 1) / py.EXACT) - 1) < 0.3


def dishes(customers, d):
    n = len(customers)
    at = py.Dishes(np.zeros(n, int), np.arange(n), None, py.mixed(np.arange(n, dtype=np.uint64)), d)
    at.c, at.t = np.array(customers, float), np.ones(n)
    return at


def test_sweeps_reach_the_posterior_of_tables():
    d, a, c = 0.6, 1.7, 7
    rows = dishes([c] * 20_000, d)
    for k in range(25):
        rows.sweep(np.full(20_000, a), k)
    want = stirling(d, c)[c] * a ** np.arange(c + 1)
    got = np.bincount(rows.t.astype(int), minlength=c + 1) / 20_000
    assert np.abs(got - want / want.sum()).max() < 0.015


def test_customers_come_and_go():
    customers = np.array([0, 1, 2, 5, 100, 100_000], float)
    t = []
    for s in range(200):
        rows = dishes([0] * 6, 0.5)
        rows.t[:] = 0
        rows.resize(customers, np.full(6, 2.0), s)
        assert (rows.c == customers).all() and (rows.t <= rows.c).all() and (rows.t >= np.minimum(rows.c, 1)).all()
        t.append(rows.t.copy())
        rows.resize(customers // 3, np.full(6, 2.0), s + 1000)
        assert (rows.c == customers // 3).all() and (rows.t <= rows.c).all() and (rows.t >= np.minimum(rows.c, 1)).all()
    t = np.mean(t, axis=0)
    assert t[0] == 0 and t[1] == 1 and abs(t[2] - (1 + 2 / 2.5)) < 0.1 and (np.diff(t) > 0).all() and t[5] < 5_000


RULES = py.Rules((0.4, 0.5, 0.7), 5)


def toy():
    """Every word in every room, seven of them counted."""
    draw = np.random.default_rng(3)
    words = np.sort(draw.integers(0, 2**63, 6, dtype=np.uint64))
    rooms = np.sort(draw.choice(py.ROOMS[2], 4, replace=False))
    rooms[1] = rooms[0] // py.INNER * py.INNER + (rooms[0] + 1) % py.INNER  # shares a parent
    pair_word, room = np.repeat(np.arange(6), 4), np.tile(rooms, 6)
    counts = np.zeros(24, int)
    counts[:20] = draw.choice([0, 1, 2, 9, 300], 20)  # the last word is unknown
    return words, pair_word, room, counts


def totals_of(seating):
    out = py.nothing()
    for k, d in enumerate(seating.levels):
        np.add.at(out.customers[k], d.rooms, d.c)
        np.add.at(out.tables[k], d.rooms, d.t)
    return out


def test_probabilities_sum_to_one_in_every_room():
    words, pair_word, room, counts = toy()
    seating = py.Seating(words, pair_word, room, counts, RULES._replace(vocabulary=int((np.bincount(pair_word, counts) > 0).sum())))
    seating.fewest()
    start = totals_of(seating)
    for _ in seating.states([start, start]):
        p = seating.predictive(totals_of(seating))
        for d, q in zip(seating.levels, p):
            for r in set(d.rooms):
                assert math.isclose(q[d.rooms == r].sum(), 1, rel_tol=1e-9)


def plain_sampler(words, pair_word, room, counts, rules, totals, sweeps):
    """The same sampler with one customer, one dish at a time and no arrays."""
    keys = [{}, {}, {}]
    for w, r, n in zip(pair_word.tolist(), room.tolist(), counts.tolist()):
        keys[2][w, r] = n
        keys[1][w, r // py.INNER] = keys[0][w, 0] = None
    up = lambda k, w, r: (w, r // py.INNER) if k == 2 else (w, 0)
    draw = lambda k, w, r, sweep, step: float(py.uniform(py.mixed(np.array([words[w]]) + np.array([r], np.uint64) * np.uint64(8) + np.uint64(k)), sweep, step)[0])
    known = {w for (w, _), n in keys[2].items() if n}
    base = lambda w: (1 - py.UNKNOWN) / rules.vocabulary if w in known else py.UNKNOWN
    c = [dict(keys[0]), dict(keys[1]), dict(keys[2])]
    t = [{}, {}, {}]
    closing = [py.closing_table(d) for d in rules.discounts]

    def closes(k, n, m):
        return closing[k][int(n), int(m)] if n <= py.EXACT else min(1.0, rules.discounts[k] * (m - 1) / n)

    def p(k, w, r):
        if k < 0:
            return base(w)
        below = p(k - 1, *up(k, w, r)) if k else base(w)
        if not totals.customers[k][r]:
            return below
        d = rules.discounts[k]
        return (max(c[k][w, r] - d * t[k][w, r], 0) + (py.STRENGTH + d * totals.tables[k][r]) * below) / (py.STRENGTH + totals.customers[k][r])

    def weights():
        return [{(w, r): (py.STRENGTH + rules.discounts[k] * totals.tables[k][r]) * (p(k - 1, *up(k, w, r)) if k else base(w)) for w, r in keys[k]} for k in range(3)]

    def sum_up(k):
        out = dict.fromkeys(keys[k - 1], 0)
        for (w, r), m in t[k].items():
            out[up(k, w, r)] += m
        return out

    def resize(k, to, a, sweep):
        d = rules.discounts[k]
        for (w, r), goal in to.items():
            n, m, step = c[k].get((w, r)) or 0, t[k].get((w, r), 0), 0
            while n != goal:
                size = min(max(1, n // 16), abs(goal - n))
                if goal > n:
                    m += math.floor(size * (a[w, r] / (a[w, r] + n - d * m) if n else 1.0) + draw(k, w, r, sweep, step))
                    n += size
                else:
                    m -= math.floor(size * closes(k, n, m) + draw(k, w, r, sweep, step))
                    n -= size
                m = min(max(m, min(n, 1)), n)
                step += 1
            c[k][w, r], t[k][w, r] = n, m

    to = keys[2]
    for k in (2, 1, 0):
        c[k], t[k] = dict(to), {x: min(n, 1) for x, n in to.items()}
        to = sum_up(k) if k else None
    a, to = weights(), keys[2]
    for k in (2, 1, 0):
        c[k], t[k] = dict.fromkeys(keys[k], 0), dict.fromkeys(keys[k], 0)
        resize(k, to, a[k], 0)
        to = sum_up(k) if k else None
    for number in range(1, sweeps + 1):
        a = weights()
        for k in (2, 1, 0):
            for (w, r), n in c[k].items():
                m = t[k][w, r]
                for step in range(min(int(n), py.MOVES) if n > 1 else 0):
                    m -= draw(k, w, r, 2 * number, 2 * step) < closes(k, n, m)
                    m += draw(k, w, r, 2 * number, 2 * step + 1) < a[k][w, r] / (a[k][w, r] + n - 1 - rules.discounts[k] * m)
                t[k][w, r] = m
            if k:
                resize(k - 1, sum_up(k), a[k - 1], 2 * number + 1)
    return t


def test_seating_equals_a_plain_sampler():
    words, pair_word, room, counts = toy()
    seating = py.Seating(words, pair_word, room, counts, RULES)
    seating.fewest()
    totals = totals_of(seating)
    for _ in seating.states([totals]):
        pass
    want = plain_sampler(words, pair_word, room, counts, RULES, totals, py.SWEEPS)
    for k, d in enumerate(seating.levels):
        assert [int(want[k][int(w), int(r)]) for w, r in zip(d.words, d.rooms)] == d.t.astype(int).tolist()
    assert seating.levels[2].t.sum() > (counts > 0).sum()


def test_packed_numbers_come_back():
    for values, kind in ((np.arange(1000) * 7 - 50, "i8"), (np.zeros(0), "i4"), (np.array([2**64 - 1], np.uint64), "u8")):
        assert (py.unpacked(py.packed(values, kind), kind) == values).all()


def test_closing_a_table_of_many_customers():
    for d in (0.3, 0.6, 0.9):
        table, c = py.closing_table(d, 1500), 1400
        t = np.arange(1, c + 1)
        got = dishes([c], d).closes(np.full(c, float(c)), t.astype(float))
        assert np.abs(got - table[c, 1 : c + 1]).max() < 5e-4 and np.median(np.abs(got[1:] / table[c, 2 : c + 1] - 1)) < 1e-5


def came_one_by_one(d, a, customers):
    """The law of the tables of a dish whose customers come one by one."""
    p = np.zeros(customers + 1)
    p[1], t = 1, np.arange(customers + 1)
    for c in range(1, customers):
        opens = np.where(p > 0, a / (a + c - d * t), 0)
        p = p * (1 - opens) + np.append(0, (p * opens)[:-1])
    return p


def test_many_customers_come_and_go_one_by_one():
    d, a, n, c, fewer = 0.6, 30.0, 20_000, 400, 150
    rows = dishes([0] * n, d)
    rows.t[:] = 0
    rows.resize(np.full(n, float(c)), np.full(n, a), 1)
    want = came_one_by_one(d, a, c)
    assert np.abs(np.bincount(rows.t.astype(int), minlength=c + 1) / n - want).max() < 0.01
    rows.resize(np.full(n, float(fewer)), np.full(n, a), 2)
    table = py.closing_table(d, c)
    for k in range(c, fewer, -1):
        want = want * (1 - table[k, : c + 1]) + np.append((want * table[k, : c + 1])[1:], 0)
    assert np.abs(np.bincount(rows.t.astype(int), minlength=c + 1) / n - want).max() < 0.01
    assert (rows.c == fewer).all()


def test_a_sweep_moves_as_many_customers_as_a_dish_has():
    d, a, n, c = 0.6, 30.0, 20_000, 400
    rows = dishes([c] * n, d)
    rows.sweep(np.full(n, a), 3)
    closes, t, want = py.closing_table(d, c)[c], np.arange(c + 1), np.eye(c + 1)[1]
    for _ in range(c):
        opens = np.where(t <= c, a / (a + c - 1 - d * t), 0)
        up, down = want * (1 - closes) * opens, want * closes * (1 - np.append(0, opens[:-1]))
        want = want - up - down + np.append(0, up[:-1]) + np.append(down[1:], 0)
    assert np.abs(np.bincount(rows.t.astype(int), minlength=c + 1) / n - want).max() < 0.01


def test_the_query_seats_one_by_one():
    words, pair_word, room, counts = toy()
    row = {"words": py.packed(words, "u8"), "kinds": py.packed(np.bincount(pair_word), "i4"), "rooms": py.packed(room, "i4"), "counts": py.packed(counts, "i8")}
    assert all(type(d) is py.Dishes for d in py._seating(row, RULES).levels)


def test_dishes_by_themselves_are_sampled_alike(monkeypatch):
    draw, n, out = np.random.default_rng(1), 40, []
    goal, a = np.floor(np.exp(draw.uniform(0, 8, n))), np.exp(draw.uniform(0, 6, n))
    for long in (math.inf, 0):
        monkeypatch.setattr(py, "LONG", long)
        rows = dishes([0] * n, 0.7)
        rows.t[:] = 0
        rows.resize(goal, a, 0)
        rows.sweep(a, 1)
        rows.resize(goal // 2, a, 2)
        out.append(rows.t)
    assert (out[0] == out[1]).all() and (out[0] <= goal // 2).all()
