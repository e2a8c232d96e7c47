"""Vectors of queries and items by the terms that both have, and products of blocks, against what they replace."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from textwarden.operators import retrieval, vectors
from textwarden.plans import risk_queries

TEXT = "id long, side string, text string"
TEXTS = [(1, "a", "The cat sat, the CAT ran"), (2, "b", "a dog ran"), (3, "a", None), (4, "b", ""), (5, "a", "nothing shared ÉTÉ x2 _y"), (6, "b", "The cat sat, the CAT ran"), (7, "a", "cat"), (7, "a", "ran off")]
ASKED = [(1, "", "the cat and the dog ran"), (2, "", "été"), (9, "", "unheard of"), (10, "", None), (11, "", "cat"), (11, "", "cat sat")]


def products(queries, items):
    """(query, item) -> similarity by the vectors, where both have a term."""
    rows = [{r["id"]: dict(zip(r["terms"], r["ws"], strict=True)) for r in vectors.packed(df).collect()} for df in (queries, items)]
    sims = {(q, i): sum(w * other.get(t, 0.0) for t, w in own.items()) for q, own in rows[0].items() for i, other in rows[1].items()}
    return {k: s for k, s in sims.items() if s}


def drawn(seed, n):
    r = random.Random(seed)
    return [(k, "ab"[k % 2], " ".join("w" + str(min(399, int(r.expovariate(0.03)))) for _ in range(r.choice([0, 1, 5, 40, 200])))) for k in range(n)]


@pytest.mark.parametrize(("corpus", "asked"), [(TEXTS, ASKED), (drawn(1, 90), drawn(2, 40))])
def test_between(spark, monkeypatch, corpus, asked):
    """Products, and with them all lengths, are those of the whole vectors, with small pieces and several texts of an id too; sides go along."""
    monkeypatch.setattr(vectors, "WORDS", 30)
    c, q = spark.createDataFrame(corpus, TEXT), spark.createDataFrame(asked, TEXT)
    vocab, whole = vectors.fit(c)
    want = products(vectors.tfidf(q, vocab), whole)
    queries, items = vectors.between(q, c)
    got = products(queries, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(r["id"], r["side"]) for r in items.collect()} <= {(i, s) for i, s, _ in corpus}


def test_terms_with_one_key():
    """Terms whose keys are equal are told apart by their checks."""
    lists = lambda x, kind: pa.array([x], pa.list_(kind))

    def part(asked, ids, checks):
        return pa.RecordBatch.from_pydict({
            "part": pa.array([0], pa.int32()), "asked": pa.array([asked]), "ids": lists(ids, pa.int64()), "sides": lists([""] * len(ids), pa.string()), "ns": lists([1] * len(ids), pa.int32()),
            "keys": lists([5] * len(ids), pa.int64()), "checks": lists(checks, pa.int16()), "tfs": lists([1] * len(ids), pa.int32()),
        })

    told = pa.Table.from_batches(list(vectors._weighed_part(1, 3)([part(False, [1, 2, 3], [7, 8, 9]), part(True, [1, 2], [8, 7])]))).to_pylist()
    terms = {(r["asked"], r["id"]): r["terms"] for r in told}
    assert terms[True, 1] == terms[False, 2] != terms[True, 2] == terms[False, 1] and len(terms[True, 1]) == 1 and terms[False, 3] == []
    assert all(abs(r["square"] - (math.log(2) + 1) ** 2) < 1e-12 for r in told)


def test_a_term_is_no_row(spark, monkeypatch):
    """What is shuffled and written is a row for a text, or for a piece of texts, and never one for a term."""
    c = spark.createDataFrame([(k, "", " ".join(f"w{k}x{j}" for j in range(200))) for k in range(50)], TEXT)
    written, write = [], vectors.kept

    def counted(df):
        table = write(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(vectors, "kept", counted)
    queries, items = vectors.between(c, c)
    assert sum(len(r["terms"]) for r in items.collect()) == 50 * 399 and sum(written) == 100


@pytest.mark.parametrize("settings", [{"OFTEN": 1}, {"OFTEN_FROM": 0}, {"SCORES": 50, "PRODUCTS": 7}, {"OFTEN_FROM": 10**9, "TABLE": 400}])
@pytest.mark.parametrize("k", [1, 3])
def test_products(spark, monkeypatch, settings, k):
    """Rows of frequent terms, and products of the others, give each query's best items, ties of equal texts to the smaller id."""
    for name, value in settings.items():
        monkeypatch.setattr(retrieval, name, value)
    texts = drawn(3, 60) + [(60 + k, "ab"[k % 2], t) for k, _, t in drawn(3, 60)]
    n = Counter(w for _, _, t in texts for w in set(t.split()))
    names = {w: i for i, w in enumerate(sorted(n))}
    weigh = lambda t: {names[w]: (1 + math.log(f)) * math.log(500 / n[w]) for w, f in Counter(t.split()).items()}
    vectors_of = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in ((i, weigh(t)) for i, _, t in texts)}
    table = pa.table({"id": [i for i, *_ in texts], "side": [s for _, s, _ in texts], "terms": pa.array([list(vectors_of[i]) for i, *_ in texts], pa.list_(pa.int64())), "ws": pa.array([list(vectors_of[i].values()) for i, *_ in texts], pa.list_(pa.float64()))})
    found = pa.Table.from_batches(list(retrieval._Asked(table, k).met(table))).to_pylist()
    got = {}
    for r in found:
        got.setdefault((r["query_id"], r["side"]), []).append((-math.floor(r["sim"] * 1e9 + retrieval.EVEN), r["id"]))
    for q, own in vectors_of.items():
        for side in "ab":
            sims = [(-math.floor(sum(w * vectors_of[i].get(t, 0.0) for t, w in own.items()) * 1e9 + retrieval.EVEN), i) for i, s, _ in texts if s == side]
            assert sorted(got.get((q, side), []))[:k] == sorted(x for x in sims if x[0])[:k]


def test_only_what_is_sent_back_gets_evidence(spark, monkeypatch):
    """Evidence is sought for the turns before answers that are sent back, and turns are scanned that an answer follows; others were, to no end."""
    asked, between = [], vectors.between

    def counted(queries, corpus):
        asked.append({r["id"] for r in queries.select("id").collect()})
        return between(queries, corpus)

    monkeypatch.setattr(risk_queries.VE, "between", counted)
    told = risk_queries.retried(spark, "/root/testdata/sf0.01").collect()
    again = {r["run_id"] - 1 for r in told if r["regenerated"]}
    assert asked[0] <= {r["run_id"] - 1 for r in told} and asked[1] <= again and len(again) < len(told)
