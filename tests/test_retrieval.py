"""Bounded retrieval and the cache against brute force, and what it joins."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textwarden.operators import history, retrieval, vectors

WORDS = ["w" + str(k) for k in range(400)]


def texts(seed, n, longest):
    """Texts of very different lengths over a few frequent and many rare words; some equal, some empty."""
    r = random.Random(seed)
    draw = lambda: WORDS[min(399, int(r.expovariate(0.02)))]
    rows = [(k, " ".join(draw() for _ in range(r.choice([1, 3, 10, 40, longest])))) for k in range(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "w0 w0 w0"), (n + 5, "none of these")]


def sparse(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["id"]][r["term"]] = r["w"]
    return out


def by_hand(queries, items, sides, k):
    want = {}
    for q, own in queries.items():
        found = defaultdict(list)
        for i, other in items.items():
            shared = own.keys() & other.keys()
            if shared:
                found[sides(i)].append((-math.floor(sum(own[t] * other[t] for t in sorted(shared)) * 1e9), i))
        for side, rows in found.items():
            want |= {(q, side, rank): i for rank, (_, i) in enumerate(sorted(rows)[:k], 1)}
    return want


@pytest.fixture(scope="module")
def fitted(spark):
    vocab, items = vectors.fit(spark.createDataFrame(texts(1, 300, 200), "id long, text string"))
    queries = vectors.tfidf(spark.createDataFrame(texts(2, 40, 60), "id long, text string"), vocab)
    return queries.cache(), items.cache()


@pytest.mark.parametrize(("k", "seed", "skip"), [(1, 48, 0.75), (3, 32, 0.7), (25, 4, 0.99), (400, 48, 0.75)])
def test_top_items(fitted, monkeypatch, k, seed, skip):
    """The same items as of all pairs, whatever the settings; ranks may only differ between scores that are equal but for the order of adding."""
    monkeypatch.setattr(retrieval, "SEED", seed)
    monkeypatch.setattr(retrieval, "SKIP", skip)
    queries, items = fitted
    sided = items.withColumn("side", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    q, x = sparse(queries), sparse(items)
    for df, side in ((items, lambda i: ""), (sided, lambda i: "a" if i % 3 == 0 else "b")):
        got = {(r["query_id"], r["side"], r["rank"]): r for r in retrieval.top_items(queries, df, k).collect()}
        want = by_hand(q, x, side, k)
        assert got.keys() == want.keys()
        exact = lambda a, b: sum(q[a][t] * x[b][t] for t in q[a].keys() & x[b].keys())
        for key, r in got.items():
            assert abs(r["sim"] - exact(key[0], r["item_id"])) < 1e-9
            assert r["item_id"] == want[key] or abs(r["sim"] - exact(key[0], want[key])) < 2e-9


def test_within(fitted):
    queries, items = fitted
    q, x = sparse(queries), sparse(items)
    for least in (0.2, 0.6, 0.95):
        want = {(a, b) for a in q for b in x if round(sum(q[a][t] * x[b][t] for t in q[a].keys() & x[b].keys()), 7) >= least}
        assert {(r["query_id"], r["item_id"]) for r in retrieval.within(queries, items, least).collect()} == want


def test_few_lists_are_joined(spark):
    """Questions that a passage answers: the lists of frequent words are left out."""
    r = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is"]
    rare = lambda: "x" + str(r.randrange(20_000))
    rows = [(k, " ".join(r.choice(common) if r.random() < 0.6 else rare() for _ in range(60))) for k in range(2000)]
    vocab, items = vectors.fit(spark.createDataFrame(rows, "id long, text string"))
    asked = [(k, " ".join(rows[k * 7][1].split()[10:30])) for k in range(100)]
    queries = vectors.tfidf(spark.createDataFrame(asked, "id long, text string"), vocab)
    for k, times in ((1, 20), (3, 5)):  # one passage answers; the third best is hardly better than others
        rows = retrieval.joined_rows(queries, items, k)
        assert 0 < rows["joined"] * times < rows["all"]
    got = retrieval.top_items(queries, items, 1).collect()
    assert all(g["item_id"] == g["query_id"] * 7 for g in got) and len(got) == 100


def test_no_items(spark):
    none = spark.createDataFrame([], "id long, term long, w double")
    some = spark.createDataFrame([(1, 5, 1.0)], "id long, term long, w double")
    assert retrieval.top_items(none, some, 3).count() == retrieval.top_items(some, none, 3).count() == retrieval.within(none, some, 0.9).count() == 0


def test_cache(spark):
    """The best entry before, at slot borders and equal times; versions; ties; nulls."""
    entries = [(1, 10, "How many vacation days?", "a"), (2, 20, "how many vacation days", "b"), (3, 5, "Where is the office?", "a"), (4, 100, "How many vacation days?", "a"), (5, 30, None, "a"), (0, 50, "how many vacation days", "b")]
    asked = [(1, 10, "How many vacation days?", "a"), (2, 11, "How many vacation days?", "a"), (3, 25, "HOW MANY VACATION DAYS", "a"), (4, 60, "How many vacation days?", "a"), (5, 60, "how many vacation days", "b"), (6, 60, "where is the office", "a"), (7, 60, None, "a"), (8, 60, "Nothing like it", "a"), (9, 2, "Where is the office?", "a"), (10, 7, "Where is the office?", "b")]
    e, q = spark.createDataFrame(entries, "entry_id long, at long, question string, version string"), spark.createDataFrame(asked, "id long, at long, question string, version string")
    want = {1: None, 2: 1, 3: 1, 4: None, 5: 0, 6: 3, 7: None, 8: None, 9: None, 10: None}
    for slot in (3, 10, 1000):
        got = history.cached_answers(q, e, slot=slot).collect()
        assert {r["id"]: r["entry_id"] for r in got} == want and all(r["hit"] == (r["entry_id"] is not None) for r in got)
