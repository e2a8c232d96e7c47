"""What lies on disk: shuffle files go with the table they were made for, items and vectors travel in bounded rounds, and results stay those of whole vectors."""

import os
import time

import pytest
from pyspark.sql import functions as F
from test_between import ASKED, TEXT, TEXTS, drawn, products
from test_blocks import planned

from textwarden import tables
from textwarden.operators import encoder, retrieval, vectors
from textwarden.plans import views


def shuffled_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, setting = shuffled_files(spark), spark.conf.get(tables.CLEANUP, "false")
    table = tables.kept(spark.range(100_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("x")).repartition(4, "x"))
    until = time.time() + 20
    while shuffled_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled_files(spark) - before and table.count() == 100_000 and spark.conf.get(tables.CLEANUP, "false") == setting


def test_items_are_not_copied(spark, monkeypatch):
    """Only queries are shuffled before they meet the items, and a task gives k items for a query, however many pieces it meets."""
    text = lambda k: f"all {' '.join('w' + str(k * j % 97) for j in range(1, 9))}"
    queries, items = vectors.between(spark.createDataFrame([(k, text(k + 5)) for k in range(200)], "id long, text string"), spark.createDataFrame([(k, text(k)) for k in range(300)], "id long, text string"))
    for name, value in {"QUERY_BLOCK": 500, "ITEM_BLOCK": 100, "STORED": 50}.items():
        monkeypatch.setattr(retrieval, name, value, raising=False)
    seen, rank = [], retrieval.ranked

    def counted(found, k):
        seen.append((planned(found).count("Exchange"), found.count()))
        return rank(found, k)

    monkeypatch.setattr(retrieval, "ranked", counted)
    assert retrieval.top_items(queries, items, 2).count() == 400
    assert seen[0][0] <= 2 and seen[0][1] <= 200 * 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("corpus", "asked"), [(TEXTS, ASKED), (drawn(1, 90), drawn(2, 40))])
def test_between_whole(spark, monkeypatch, corpus, asked):
    """Products of two items are those of the whole vectors, without the terms that one item has; in rounds and slices too."""
    c, q = spark.createDataFrame(corpus, TEXT), spark.createDataFrame(asked, TEXT)
    vocab, all_terms = vectors.fit(c)
    want, of_queries = products(all_terms, all_terms), products(vectors.tfidf(q, vocab), all_terms)
    for name, value in {"ROUND": 2_000, "SLICE": 40, "TEXTS": 3}.items():
        monkeypatch.setattr(vectors, name, value, raising=False)
    queries, shared, items = vectors.between(q, c, whole=True)
    got = products(items, items)
    pairs = {k for k in want if k[0] != k[1]}
    assert pairs == {k for k in got if k[0] != k[1]} and all(abs(got[k] - want[k]) < 1e-12 for k in pairs)
    got = products(queries, shared)
    assert got.keys() == of_queries.keys() and all(abs(got[k] - of_queries[k]) < 1e-12 for k in of_queries)


def test_candidates_are_dealt_in_rounds(spark, monkeypatch):
    texts = drawn(5, 40) + [(40 + k, s, t + " more") for k, s, t in drawn(5, 40)]
    items = vectors.fit(spark.createDataFrame(texts, TEXT).select("id", "text"))[1].cache()
    asked = spark.createDataFrame([(q, i) for q in range(20) for i in range(q, q + 60, 4)], "query_id long, item_id long")
    told = lambda: sorted((r["query_id"], r["item_id"], sorted(r["near"])) for r in vectors.near_in_query(asked, items, 0.3).collect())
    want, written, write = told(), [], vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda df: (written.append(df), write(df))[1])
    monkeypatch.setattr(vectors, "DEALT", 50, raising=False)
    assert told() == want and want and len(written) >= 6


def test_encoder_of_texts(spark):
    """Terms as digests give the vectors that looked-up terms give."""
    corpus, asked = drawn(6, 70), drawn(7, 30)
    c, q = (spark.createDataFrame(x, TEXT).select("id", "text") for x in (corpus, asked))
    vocab, items = vectors.fit(c)
    for dims in (6, 40):
        want = {(x["asked"], x["id"]): x["v"] for x in encoder.fitted(items, vectors.tfidf(q, vocab), vocab, dims).collect()}
        got = {(x["asked"], x["id"]): x["v"] for x in encoder.encoded_texts(c, q, dims).collect()}
        assert got.keys() == want.keys() and got
        for a, b in zip(sorted(got), sorted(got)[1:], strict=False):
            cosine = lambda v: sum(x * y for x, y in zip(v[a], v[b], strict=True))  # noqa: B023, E731
            assert abs(cosine(got) - cosine(want)) < 1e-6


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Texts aren't shuffled to meet their labels, whatever Spark would broadcast by itself, and beyond the limit they aren't sorted."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = views.examples(spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" in planned(told)
        monkeypatch.setattr(views, "LABELS", 1, raising=False)
        more = views.examples(spark, "/root/testdata/sf0.001")
        assert "ShuffledHashJoin" in planned(more) and sorted(map(tuple, more.collect()), key=repr) == sorted(map(tuple, told.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
