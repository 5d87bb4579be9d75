import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.llm import jaccard_join as j
from stayscope.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    pairs = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    of = roots(len(rows), pairs)
    smallest = {}
    for r, (key, _) in zip(of, rows):
        known = smallest.get(r)
        smallest[r] = key if known is None else known if key is None else min(known, key)
    return [(key, len(s), smallest[r]) for (key, _), s, r in zip(rows, sets, of)]


def corpus(seed=2, groups=12, size=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, key = [], 100
    for _ in range(groups):
        base = passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((key, rng.choice([" ", "\n"]).join(words).replace("w1", rng.choice(["w1", "W1"]))))
            key += 1
    return rows


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(
    "k, percent, limits",
    [(3, 90, {}), (5, 80, {}), (3, 80, {"list_entries": 2, "block_sets": 7}), (5, 90, {"list_entries": 3, "block_shingles": 500}), (2, 60, {"list_entries": 1})],
)
def test_against_brute_force(texts, odd, k, percent, limits):
    rows = odd + corpus()
    got = j.link_texts(texts(rows), k=k, percent=percent, **limits).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component"]) for r in got) == ordered(brute(rows, k, percent))


def test_both_ways_of_fetching_texts(texts, odd, monkeypatch):
    monkeypatch.setattr(j, "_BROADCAST_ROWS", 0)
    monkeypatch.setattr(j, "_BROADCAST_TOKENS", 0)
    rows = odd + corpus(groups=4)
    got = j.link_texts(texts(rows), k=3, percent=80).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component"]) for r in got) == ordered(brute(rows, 3, 80))


def test_blocks_span_all_links():
    rng = np.random.default_rng(3)
    base = np.arange(100)
    sets = [np.unique(np.r_[base[rng.random(100) < 0.95], rng.integers(1000, 2000, rng.integers(0, 12))]) for _ in range(60)]
    threshold = j.Threshold(80)
    linked = [
        (a, b) for a in range(60) for b in range(a) if threshold.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
    ]
    assert roots(60, j.join_blocks(sets, None, threshold)) == roots(60, linked)
    across = [(b, a) for a, b in linked if b < 25 <= a]
    found = j.join_blocks(sets[:25], sets[25:], threshold)
    assert set(found) <= set(across) and roots(60, found) == roots(60, across) and len(found) < 60


def test_prefixes_are_long_enough():
    for percent in (60, 80, 90, 100):
        t = j.Threshold(percent)
        for n in range(1, 60):
            for m in range(n, 60):
                need = next(i for i in range(n + 1) if i == n or t.links(i, n, m))
                if t.links(need, n, m) and m > n or need < n:
                    assert t.prefix(n) >= min(n, n - need + min(t.shared, need))


def test_one_of_each_group_stays(texts, odd):
    rows = odd + corpus() + corpus()[:4]
    df = texts(rows)
    kept = j.keep_one(df, k=5, percent=80)
    assert kept.columns == df.columns
    want = {}
    for (key, text), (_, n, component) in zip(rows, brute(rows, 5, 80)):
        if n:
            want[component] = min(want.get(component, (key is None, key or 0)), (key is None, key or 0))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert ordered(k for k, t in got if shingles(t, 5)) == ordered(None if none else k for none, k in want.values())
    assert ordered(t for _, t in got if not shingles(t, 5)) == ordered(t for _, t in rows if not shingles(t, 5))


def test_empty_table(texts):
    assert j.link_texts(texts([])).count() == 0
    assert j.keep_one(texts([])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    pairs += [(200, x) for x in range(201, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(300, pairs)
    assert got == {x: want[x] for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("k, percent, fixed", [(3, 90, 20), (5, 80, 19)])
def test_links_that_also_need_short_lists(texts, k, percent, fixed):
    """Texts of one template, x different in all, y equal in two: only those two are linked."""
    middle = " ".join(f"f{i}" for i in range(fixed))
    rows = [(i, f"x{i} {middle} y{i // 2}") for i in range(20)]
    want = brute(rows, k, percent)
    assert {component for *_, component in want} == set(range(0, 20, 2))
    got = j.link_texts(texts(rows), k=k, percent=percent).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component"]) for r in got) == ordered(want)


def test_unrelated_texts_of_one_key_all_stay(texts):
    apart = ["one two three four five six", "red green blue black white grey", "north south east west up down"]
    rows = [(key, text) for key in (None, 7) for text in (f"{key} {t}" for t in apart)]
    rows += [(9, rows[0][1]), (None, rows[4][1])]
    got = [tuple(r) for r in j.keep_one(texts(rows), k=5, percent=80).select("doc_id", "text").collect()]
    assert ordered(got) == ordered(rows[1:7])
