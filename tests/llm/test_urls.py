import math
import random
import zlib

import pytest

from lodestone.llm import urls
from lodestone.llm.urls import BAD, GOOD, RULES, SIZES, UrlFilter, labelled_urls


def plain(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = rest[: min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([i for i, c in enumerate(path) if c in "?#"] or [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_parts_rules_and_classes(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://A.Example.COM/en/7?x#y", "http://com/en/", "http://xcom/en/", "http://a.com/en/1", "http://a.net/de/1",
        "http://a.example.net/de/8x", "http://a.example.net/de/9", "http://b.org/es/", "http://b.org/ES/", "http://b.org?es", "http://É.org#/es/", "x://a.com//en/", "http://a\nb.com/en/\nq",
    ]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, grams int")
    for r in UrlFilter(labelled_urls(spark)).apply(pages).collect():
        host, path = plain(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert r.rule == (best.host + best.path if best else None)
        if best:
            assert r.verdict == best.verdict
    assert UrlFilter(labelled_urls(spark)).apply(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        UrlFilter(labelled_urls(spark, [], []))


def shares(spark, model, hosts):
    """The share of the hosts that a model blocks."""
    got = model.apply(spark.createDataFrame([(i, f"https://www.{h}.org/fr/{i}") for i, h in enumerate(hosts)], "page_id long, url string")).collect()
    return sum(r.verdict == "block" for r in got) / len(got)


def test_words_that_share_no_stem_with_the_learned_ones(spark):
    """Letters tell nothing of a wholly new word, so few are blocked, of either
    kind; the README gives the figures."""
    held = lambda w: zlib.crc32(w.encode()) % 4 == 0
    stems = lambda words: {w[:4] for w in words}
    new = [w for w in BAD if w[:4] in stems(filter(held, BAD))]
    old = [w for w in BAD if w not in new]
    new_good = [w for w in GOOD if held(w) and w[:4] not in stems(x for x in GOOD if not held(x))]
    model = UrlFilter(labelled_urls(spark, old, [w for w in GOOD if not held(w)]), rules=[])
    assert not stems(new) & stems(old) and len(new) > 40 and len(new_good) > 25
    assert shares(spark, model, new_good) <= 0.04 and shares(spark, model, new) <= 0.5


def test_learned_words_in_hosts_that_were_not(spark):
    draw, model = random.Random(99), UrlFilter(labelled_urls(spark), rules=[])
    pairs = lambda words: [f"{w}-{words[(i + 11) % len(words)]}" for i, w in enumerate(words)]
    with_new = lambda words: [f"{w}-{urls._invented(draw)}" for w in words]
    figures = [shares(spark, model, make(words)) for make in (pairs, with_new) for words in (BAD, GOOD)] + [shares(spark, model, [urls._invented(draw) + urls._invented(draw) for _ in range(300)])]
    print("blocked:", figures)
    assert figures[0] >= 0.9 and figures[2] >= 0.3 and max(figures[1], figures[3], figures[4]) <= 0.03


def test_score_is_that_of_the_logistic_model(spark):
    model = UrlFilter(labelled_urls(spark), rules=[])
    rows = [(1, "http://some-host.org/path/x"), (2, "https://poker.example.com/en/"), (2, "https://poker.example.com/en/"), (3, "http://" + "a" * 20_000 + ".com/" + "b" * 20_000)]
    weights, bias = model._model.coefficients.toArray(), model._model.intercept
    got = model.apply(spark.createDataFrame(rows, "page_id long, url string"))
    for r in got.collect():
        host, path = plain(dict(rows)[r.page_id])
        marked, grams = f"^{host}$", set()
        for n in SIZES:
            grams |= {"h" + marked[k : k + n] for k in range(len(marked) - n + 1)} | {"p" + path[k : k + n] for k in range(len(path) - n + 1)}
        places = model._hash.transform(spark.createDataFrame([(sorted(grams),)], "grams array<string>")).first().features.indices
        assert math.isclose(r.block_score, 1 / (1 + math.exp(-(weights[places].sum() + bias))), rel_tol=1e-9)
    assert got.count() == 4
