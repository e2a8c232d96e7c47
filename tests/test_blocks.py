"""Pairs of rows that meet as blocks: nothing is shuffled for a pair."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from textwarden.operators import encoder, evidence, retrieval, vectors


def test_a_pair_is_no_row(spark, monkeypatch):
    """Every text shares a word with every other: 400 x 300 pairs, none of which is written on the way; small blocks give the same."""
    text = lambda k: f"all {' '.join('w' + str(k * j % 97) for j in range(1, 9))}"
    vocab, items = vectors.fit(spark.createDataFrame([(k, text(k)) for k in range(300)], "id long, text string"))
    queries = vectors.tfidf(spark.createDataFrame([(k, text(k + 5)) for k in range(400)], "id long, text string"), vocab)
    written = []
    write = retrieval.kept

    def counted(df):
        table = write(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(retrieval, "kept", counted)
    want = sorted(tuple(r) for r in retrieval.top_items(queries, items, 2).collect())
    assert len(want) == 800 and max(written) <= 400
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 500)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 40)
    got = sorted(tuple(r) for r in retrieval.top_items(queries, items, 2).collect())
    assert [(r[0], r[3], round(r[2], 8)) for r in got] == [(r[0], r[3], round(r[2], 8)) for r in want]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_texts_are(spark):
    """Texts are dealt by id, and no term is shuffled before it is counted."""
    plan = planned(vectors.term_counts(spark.createDataFrame([(1, "a few words"), (1, "a few more")], "id long, text string")))
    assert re.search(r"hashpartitioning\(id#\d+L?, \d+\)", plan) and not re.search(r"hashpartitioning\(id#\d+L?, term#", plan)


def test_signs_travel_as_bits(spark):
    """What is shuffled for a projection is a term's bits, not a sum for each dimension."""
    items, vocab = spark.createDataFrame([(1, 5, 0.6), (1, 6, 0.8)], "id long, term long, w double"), spark.createDataFrame([("few", 5), ("words", 6)], "term string, key long")
    df = encoder.projected(items, vocab)
    assert not re.search(r"Exchange hashpartitioning\(id#\d+L?, \d+\)[^\n]*\n[^\n]*HashAggregate[^\n]*partial_sum", planned(df))
    bits = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in ("few", "words")]
    want = [sum(w * ((b >> k & 1) * 2 - 1) for w, b in zip((0.6, 0.8), bits)) for k in range(encoder.DIMS)]
    assert all(abs(x - y) < 1e-12 for x, y in zip(df.collect()[0]["parts"], want, strict=True))


def test_blocks_stay_arrow(spark, monkeypatch):
    """A block of vectors isn't turned into Python objects, whose size is many times its own."""
    v = spark.range(40).selectExpr("id", "id % 2 = 0 AS side", "array(cast(cos(id) AS double), cast(sin(id) AS double)) AS v")
    told = encoder.nearest(v.select("id", "v"), v, block=16, others=True)
    assert "MapInArrow" in planned(told) and "MapInPandas" not in planned(told)
    got = {(r["query_id"], r["side"]): r["item_id"] for r in told.collect()}
    near = lambda q, s: min((-math.floor(math.cos(q - i) * 1e6 + 0.5), i) for i in range(40) if i != q and (i % 2 == 0) == s)[1]
    assert got == {(q, s): near(q, s) for q in range(40) for s in (True, False)}


@pytest.mark.parametrize(("above", "inclusive"), [(0.05, True), (0.3, False), (0.6, False), (0.92, False), (0.92, True)])
def test_candidates_of_a_query_meet_in_memory(spark, above, inclusive):
    """Near candidates against all pairs, for copies, near copies, frequent words and queries of one candidate; no pair and no posting is a row."""
    r = random.Random(7)
    draw = lambda n: [f"w{min(299, int(r.expovariate(0.02)))}" for _ in range(n)]
    texts = [draw(r.choice([1, 2, 5, 40, 200])) for _ in range(60)]
    for k in range(30):  # from copies to texts that share half of their words
        texts.append([w if r.random() > k / 60 else draw(1)[0] for w in texts[k]])
    vocab, items = vectors.fit(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string"))
    items = items.cache()
    asked = [(q, i) for q in range(70) for i in r.sample(range(len(texts)), 25 if q else 1)] + [(q, i) for q in range(100, 130) for i in (q - 100, q - 40)]
    told = vectors.near_in_query(spark.createDataFrame(asked, "query_id long, item_id long"), items, above, inclusive)
    assert "MapInArrow" in planned(told) and not re.search(r"Join \[[^\]]*term", planned(told))
    got = {(x["query_id"], x["item_id"]): set(x["near"]) for x in told.collect()}
    v, own = defaultdict(dict), defaultdict(list)
    for x in items.collect():
        v[x["id"]][x["term"]] = x["w"]
    for q, i in asked:
        own[q].append(i)
    sims = {(i, j): sum(v[i][t] * v[j][t] for t in v[i].keys() & v[j].keys()) for ids in own.values() for i in ids for j in ids if i != j}
    assert all(abs(s - above) > 1e-12 for s in sims.values())
    want = {(q, i): {j for j in ids if j != i and sims[i, j] > above} for q, ids in own.items() for i in ids}
    assert got == {k: n for k, n in want.items() if n} and got


def test_rare_terms_have_small_keys(spark):
    """The heads of vectors are their rarest terms: keys are in the order of frequencies, by powers of two."""
    vocab, items = vectors.fit(spark.createDataFrame([(k, f"all {'some' if k < 20 else 'others'} x{k}") for k in range(64)], "id long, text string"))
    rows = sorted((r["key"], r["df"]) for r in vocab.collect())
    assert [int(math.log2(n)) for _, n in rows] == sorted(int(math.log2(n)) for _, n in rows) and len({k for k, _ in rows}) == len(rows)
    head = vectors._heads(0.92)
    pack = {r["id"]: r["head"] for r in retrieval.packed(items).select("id", "terms", "ws").mapInArrow(lambda b: (x.rename_columns(["id", "head"]) for x in head(b)), "id long, head array<long>").collect()}
    rare = {r["key"] for r in vocab.where("df = 1").collect()}
    assert set(pack) == set(range(64)) and all(h and set(h) <= rare for h in pack.values())


def test_texts_stay_behind(spark):
    """What is retrieved has no texts with it: only those that are given out are looked up, at the end."""
    corpus = spark.createDataFrame([(k, f"t{k}", f"The limit is {k % 3} for topic{k % 5} here.", f"s{k}", "news", 2020) for k in range(20)], "id long, title string, text string, source_id string, source_type string, year int")
    questions = spark.createDataFrame([(1, "What is the limit for topic2?"), (2, "zzzzz")], "id long, question string")
    pieces, _, items = evidence.pieces_for(questions, corpus)
    assert "text" not in pieces.columns and "terms" in items.columns
    told = evidence.chosen(questions, corpus)
    built = {r["id"]: r for r in evidence.build(questions, corpus).collect()}
    texts = {r["id"]: r["text"] for r in corpus.collect()}
    assert "text" not in told.columns and {r["id"]: [texts[i] for i in r["item_ids"]] for r in told.collect()} == {k: r["evidence"] for k, r in built.items()}
    assert built[1]["evidence"] and built[2]["no_evidence"] and not built[2]["evidence"]


@pytest.mark.parametrize("at_once", [7, 100_000])
def test_encoder_without_its_table(spark, monkeypatch, at_once):
    """The vectors that fit and encoded give, for texts of the corpus and others; no sum is kept for a term."""
    monkeypatch.setattr(encoder, "AT_ONCE", at_once)
    r = random.Random(3)
    text = lambda: " ".join(["all", *(f"w{min(99, int(r.expovariate(0.05)))}" for _ in range(r.choice([1, 4, 30])))])
    rows = [(k, text()) for k in range(70)] + [(90, ""), (91, None)]
    vocab, items = vectors.fit(spark.createDataFrame(rows, "id long, text string"))
    queries = vectors.tfidf(spark.createDataFrame([(k, text()) for k in range(30)] + [(40, "nothing known"), (41, None)], "id long, text string"), vocab)
    written = []
    write = encoder.kept

    def counted(df):
        table = write(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(encoder, "kept", counted)
    for dims in (6, 40):
        got = {(x["asked"], x["id"]): x["v"] for x in encoder.fitted(items, queries, vocab, dims).collect()}
        parts = spark.sparkContext.defaultParallelism
        assert max(written) <= parts * (70 + 30 + 1) and written.clear() is None
        basis = encoder.fit(items, vocab, dims)
        want = {(asked, x["id"]): x["v"] for asked, df in ((False, items), (True, queries)) for x in encoder.encoded(df, basis).collect()}
        written.clear()
        assert got.keys() == want.keys() and len(got) == 100
        for a, b in zip(sorted(got), sorted(got)[1:], strict=False):  # cosines, as axes may have either sign
            cosine = lambda v: sum(x * y for x, y in zip(v[a], v[b], strict=True))  # noqa: B023, E731
            assert abs(cosine(got) - cosine(want)) < 1e-6
    none = items.where("false")
    assert encoder.fitted(none, none, vocab).count() == encoder.fitted(none, queries, vocab).count() == 0 and encoder.fitted(items, none, vocab).count() == 70
