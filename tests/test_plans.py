"""Spans of two finders, masks, thresholds in shadow, and attempts by similarity, against brute force."""

import random

from pyspark.sql import functions as F

from textwarden.operators import history, jobs, rewrite, spans, vectors


def test_spans_that_overlap_give_way(spark):
    r = random.Random(3)
    draw = lambda n: [(k, a, a + r.randrange(0, 9)) for k in range(6) for a in sorted(r.randrange(60) for _ in range(n))]
    first, second = draw(5), draw(9) + [(99, 3, 7), (1, 4, None), (None, 2, 5), (1, 10, 12), (1, 10, 12)]
    schema = "doc long, start int, end int"
    got = spans.free_of(spark.createDataFrame(second, schema).withColumn("kind", F.lit("x")), spark.createDataFrame(first + [(None, 4, 6), (2, None, 9)], schema), ["doc"])
    over = lambda s: s[2] is not None and any(f[0] == s[0] and f[1] < s[2] and f[2] > s[1] for f in first + [(None, 4, 6)])
    assert got.columns == ["doc", "start", "end", "kind"]
    assert sorted((tuple(x)[:3] for x in got.collect()), key=repr) == sorted((s for s in second if not over(s)), key=repr)
    none = spark.createDataFrame([], schema)
    assert spans.free_of(none, none, ["doc"]).count() == 0 and spans.merged(spark.createDataFrame(first, schema), none, ["doc"]).count() == len(first)


def test_masks_dont_cut_through_each_other(spark):
    text = "call 4111111111111111 or a.b@c.org now"
    cases = [
        ([(5, 21, "CARD"), (9, 21, "ACCOUNT"), (25, 34, "EMAIL")], "call [CARD] or [EMAIL] now"), ([(9, 21, "B"), (5, 12, "A")], "call [A] or a.b@c.org now"), ([(5, 12, "A"), (12, 21, "B")], "call [A][B] or a.b@c.org now"),
        ([], text), ([(0, 38, "ALL"), (3, 4, "X")], "[ALL]"), ([(5, 9, "B"), (5, 21, "A")], "call [A] or a.b@c.org now"),
    ]
    kind = "array<struct<start:int,end:int,kind:string>>"
    df = spark.createDataFrame([(k, text, [dict(zip(("start", "end", "kind"), s)) for s in found]) for k, (found, _) in enumerate(cases)], f"k int, text string, spans {kind}")
    assert [r[0] for r in df.orderBy("k").select(spans.masked(F.col("text"), F.col("spans"))).collect()] == [want for _, want in cases]


def test_shadow_plan(spark):
    r = random.Random(1)
    rows = [(r.choice([None, round(r.random() * 100, 1), 80.0, 100.0, 0.0]), r.choice([True, False, None])) for _ in range(400)]
    got = {x["threshold"]: x for x in jobs.shadow_plan(spark.createDataFrame(rows, "score double, wrong boolean"), 80.0).collect()}
    assert len(got) == 1001
    for t in (0.0, 0.1, 33.3, 79.9, 80.0, 80.1, 100.0):
        hit = [s is not None and s >= t - 1e-9 for s, _ in rows]
        want = (sum(hit), sum(h and w is False for h, (_, w) in zip(hit, rows)), sum(not h and w is True for h, (_, w) in zip(hit, rows)))
        assert (got[t]["flagged"], got[t]["false_alarms"], got[t]["misses"]) == want
    now = got[80.0]
    assert now["outcome"] == "as is" and got[0.0]["outcome"] == "roll back"
    for x in got.values():
        worse = x["false_alarms"] > now["false_alarms"] or x["misses"] > now["misses"]
        assert (x["outcome"] == "roll back") == worse
    assert {x["flagged"] for x in jobs.shadow_plan(spark.createDataFrame([], "score double, wrong boolean"), 80.0).collect()} == {0}


def test_like_before(spark):
    """Against cosines of every question with its ten predecessors."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 12))) for _ in range(40)] + [None, "", "?"]
    rows = [(k, k % 3, r.choice(texts), k // 2) for k in range(150)]
    rows += [(200 + k, 7, t, k) for k, t in enumerate(["w1 w2 w3", "W1, w2 w3!", *["w9 " * (k + 1) for k in range(3)], "w1 w2 w3"])]
    events = spark.createDataFrame(rows, "run_id long, thread long, question string, at long")
    got = {x["run_id"]: x["similarity"] for x in history.like_before(events, ["at", "run_id"], "run_id").collect()}
    _, items = vectors.fit(spark.createDataFrame([(t, t) for t in {x[2] for x in rows} - {None}], "id string, text string"))
    of = {}
    for x in items.collect():
        of.setdefault(x["id"], {})[x["term"]] = x["w"]
    cos = lambda a, b: 1.0 if a == b and a in of else sum(w * of.get(b, {}).get(t, 0.0) for t, w in of.get(a, {}).items())
    for thread in {x[1] for x in rows}:
        own = sorted((x for x in rows if x[1] == thread), key=lambda x: (x[3], x[0]))
        for k, x in enumerate(own):
            best = max((cos(x[2], y[2]) for y in own[max(0, k - 10) : k]), default=0.0)
            assert (got[x[0]] is None) if best < 0.85 - 1e-9 else abs(got[x[0]] - best) < 1e-9
    assert got[201] > 0.999 and got[205] == 1.0


def test_second_pass_settles_everything(spark):
    """A grounded second answer is allowed; one without support, or without evidence, is not, and is never sent back again; what the first tier stopped stays stopped."""
    evidence = ["Notice period lasts 60 days for everyone."]
    rows = [
        (1, "How long is the notice period?", evidence, 0.0, "allow", False), (2, "How long is the notice period?", evidence, 95.0, "block", True), (3, "Anything else?", [], 0.0, "allow", False),
        (4, None, None, 0.0, "allow", False), (5, "How long is the notice period?", evidence, 50.0, "allow", False),
    ]
    df = spark.createDataFrame(rows, "run_id long, question string, evidence array<string>, t1_score double, t1_action string, t1_sure boolean").withColumn("strict", F.lit(False))
    got = {x["run_id"]: x for x in rewrite.second_pass(df).collect()}
    assert {k: x["action"] for k, x in got.items()} == {1: "allow", 2: "block", 3: "abstain", 4: "abstain", 5: "escalate"}
    assert got[1]["trust_label"] == "verified against your documents" and got[1]["answer"] == "Notice period lasts 60 days for everyone [S1]." and all(x["strict"] for x in got.values())
    made_up = rewrite.second_pass(df.where("run_id = 1"), lambda question, evidence, temperature, offending: F.lit("The notice period lasts 90 days [S1].")).collect()
    assert [x["action"] for x in made_up] == ["abstain"]
