"""Histories against loops, streams against batches, and the stores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textwarden.functions import lexicons as L
from textwarden.operators import history as H
from textwarden.operators import rewrite as R
from textwarden.operators import verify as Y
from textwarden.plans import job_queries
from textwarden.sources import stores

SF = "/root/testdata/sf0.001"


def test_attempts_loop(spark):
    r = random.Random(3)
    rows = [(k % 5, k, r.choice(["again please", "new thing"]), r.choice([None, None, "up", "down"]), r.random() < 0.2) for k in range(300)]
    df = spark.createDataFrame(rows, "thread int, seq int, question string, feedback string, near boolean")
    got = {x["seq"]: x["attempt"] for x in H.attempts(df, ["seq"], F.col("near")).collect()}
    counts, thumbs, want = {}, {}, {}
    for thread, seq, question, feedback, near in rows:
        again = "again" in question or thumbs.get(thread) == "down" or near
        counts[thread] = counts.get(thread, 1) + 1 if again else 1
        want[seq] = counts[thread]
        if feedback:
            thumbs[thread] = feedback
        if feedback == "up":
            counts[thread] = 1
    assert got == want


def test_stream_equals_batch(spark):
    stream = {tuple(r) for r in job_queries.stream_usage(spark, SF).select("run_id", "per_minute", "per_day", "tokens_day").collect()}
    assert stream == {tuple(r) for r in job_queries.usage_rates(spark, SF).collect()}
    assert job_queries.stream_attempts(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_stores(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.append(spark.createDataFrame([("a", "q1"), ("b", "q2")], "run_id string, question string").coalesce(1), path)
    (tmp_path / "log" / "zz.json").write_text('{"run_id": "a", "feedback": "up", "kind": "feedback"}\n{"run_id": "a", "feedback": "down", "kind": "feedback"}\n{"run_id": "half\n' + json.dumps({"run_id": "x", "feedback": "up", "kind": "feedback"}) + "\n")
    assert sorted((r["run_id"], r["feedback"]) for r in stores.load_traces(spark, path).collect()) == [("a", "down"), ("b", None)]


def test_store_is_cleared(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.append(spark.createDataFrame([("a", "q1")], "run_id string, question string"), path)
    stores.clear(spark, path, stores.TRACE_SCHEMA)
    assert stores.load_traces(spark, path).count() == 0


def test_review_queue(spark):
    items = stores.queue(spark.createDataFrame([("a", 10.0, "q"), ("b", 20.0, "r")], "run_id string, queued_at double, question string"))
    rows = [("a", "over_flagged", "x", 1.0), ("a", "correct_block", "y", 2.0), ("z", "over_flagged", "x", 3.0)]
    known = list(L.LESSONS)
    rows = [(i, known[k % len(known)], who, at) for k, (i, _, who, at) in enumerate(rows)]
    verdicts = stores.checked_verdicts(spark.createDataFrame(rows, "run_id string, verdict string, reviewer string, at double"))
    got = {r["run_id"]: (r["status"], r["verdict"], r["reviewer"], r["due_at"]) for r in stores.stitch_verdicts(items, verdicts).collect()}
    assert got == {"a": ("reviewed", known[1], "y", 10.0 + L.SLA_HOURS * 3600), "b": ("waiting", None, None, 20.0 + L.SLA_HOURS * 3600)}
    for wrong in ("fine", None):
        with pytest.raises(Exception, match="unknown verdict"):
            stores.checked_verdicts(spark.createDataFrame([("a", wrong)], "run_id string, verdict string")).collect()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('prompt,n\n"say ""hi"", then\nstop",1\n,2\nplain,3\n')
    assert sorted(r["prompt"] for r in stores.read_attacks(spark, str(tmp_path / "a.csv")).collect()) == ["plain", 'say "hi", then\nstop']
    rows = [{"instruction": f"do {k}", "input": "this" if k % 2 else "", "output": "o"} for k in range(9)]
    (tmp_path / "b.json").write_text(json.dumps(rows))
    every = {r["prompt"] for r in stores.read_benign(spark, str(tmp_path / "b.json")).collect()}
    assert every == {f"do {k} this" if k % 2 else f"do {k}" for k in range(9)}
    some = [[r["prompt"] for r in stores.read_benign(spark, str(tmp_path / "b.json"), 4).collect()] for _ in range(2)]
    assert some[0] == some[1] and len(some[0]) == 4 and set(some[0]) < every


def test_vectors_are_kept(spark, tmp_path):
    calls = []

    def encode(df):
        calls.append(1)
        return df.select("text", F.array(F.length("text").cast("float")).alias("v"))

    rows = [("risky", "a"), ("calm", "bb"), (None, None)]
    for given, encoder, want in ((rows, "e", 1), (rows[::-1], "e", 1), (rows, "f", 2), (rows[:2], "e", 3), ([*rows, rows[0]], "e", 4)):
        df = spark.createDataFrame(given, "category string, text string")
        assert stores.vectors_of(df, encoder, encode, str(tmp_path)).count() == len(given) and len(calls) == want


def test_rewrite(spark):
    rows = [(1, "Is wfh allowed and does it end last month?", "What is the parental leave?"), (2, "plain", None), (3, None, "x"), (4, "", ""), (5, " When does that start? ", "who")]
    df = spark.createDataFrame(rows, "id int, question string, previous string")
    got = {r["id"]: r for r in R.rewrite(df, F.lit("2026-08-26").cast("date")).collect()}
    span = "2026-07-01 to 2026-07-31"
    assert got[1]["rewritten"] == f"Is work from home allowed and does leave end {span}?"
    assert got[1]["changes"] == ["wfh -> work from home", f"last month -> {span}", "pronoun -> leave", "split into 2 questions"]
    assert got[1]["assumptions"] == [f"last month is taken as {span}"] and got[1]["split"] == ["Is work from home allowed", f"does leave end {span}"]
    assert [got[k]["changed"] for k in (1, 2, 3, 4, 5)] == [True, False, False, False, False]
    assert got[3]["rewritten"] is None and got[5]["rewritten"] == "When does that start?" and got[2]["changes"] == []


def test_generate(spark):
    rows = [(1, "notice period days", ["The notice period is sixty days long."], True), (2, "notice period", [], True), (3, "unrelated words here", ["The notice period is sixty days long."], True), (4, "unrelated words here", None, None)]
    df = spark.createDataFrame(rows, "id int, question string, evidence array<string>, strict boolean")
    got = {r["id"]: r for r in R.generate(df).collect()}
    assert got[1]["answer"] == "The notice period is sixty days long [S1]." and (got[1]["calls"], got[1]["citations_ok"], got[1]["temperature"]) == (1, True, 0.1)
    assert (got[2]["calls"], got[2]["citations_ok"], got[2]["answer"]) == (0, True, Y.NOTHING_FOUND) == (got[4]["calls"], got[4]["citations_ok"], got[4]["answer"])
    assert (got[3]["calls"], got[3]["reprompted"], got[3]["citations_ok"]) == (2, True, False)
    model = lambda q, e, t, offending: F.when(offending.isNull(), F.lit("Nobody said where this is from.")).otherwise(F.concat(offending, F.lit(" [S1] [S7]")))
    again = {r["id"]: r for r in R.generate(df, model).collect()}
    assert again[1]["answer"] == "Nobody said where this is from. [S1]" and again[1]["calls"] == 2
    assert {r["temperature"] for r in R.generate(df, second_pass=True).collect()} == {0.6}


def test_simulated(spark):
    a, b = (stores.simulated(spark, 66, ["x", "y"]).collect() for _ in range(2))
    assert a == b and len({r["run_id"] for r in a}) == 66


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fuzzy_ratio_of_nulls(spark):
    df = spark.createDataFrame([("abcd", "abce"), (None, "x"), ("x", None), ("", "")], "a string, b string")
    assert [r["r"] for r in df.select(Y.fuzzy_ratio()("a", "b").alias("r")).collect()] == [0.75, None, None, 1.0]
