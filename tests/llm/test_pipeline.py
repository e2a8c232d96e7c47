"""Queries with SQL against DuckDB, and the pipeline's stages on odd rows and on the smallest tables."""

import pathlib
import random

import pytest
from oracle import rows_of, sql_rows

import corpus_pipeline
from textwarden.llm import queries
from textwarden.llm.common import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toArrow()) == sql_rows(queries.SQL[name], SF)


def test_stages_take_odd_rows(spark, docs, empty):
    for frame in (docs, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame.select("doc_id", "text", "lang", "source", "n_chars"), SF)
            out.collect()
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_lines_stage_removes_all_repeated_runs(spark):
    """Each line in a run of two lines or more that occurs earlier goes, wherever the run begins; single repeated lines stay."""
    r = random.Random(9)
    rows = []
    for k in range(150):
        own = [f"{k} own line {n} {r.random()}" for n in range(6)]
        if k:
            source = r.choice(rows)[1].split("\n")
            at = r.randrange(len(source))
            own[r.randrange(6) : 0] = source[at : at + r.randrange(1, 6)]
        rows.append((k, "\n".join(own)))
    rows += [(200, rows[0][1]), (201, "one line"), (202, "one line"), (203, ""), (204, "a\na\na"), (205, None), (None, rows[0][1])]
    seen, want = set(), {}
    for k, text in rows[:-2]:
        lines, gone = text.split("\n"), set()
        for n, pair in enumerate(zip(lines, lines[1:])):
            gone |= {n, n + 1} if pair in seen else set()
            seen.add(pair)
        left = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        if not gone or left.strip(" "):
            want[k] = left
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.lines(spark, df, SF).collect()
    assert {x["doc_id"]: x["text"] for x in got if x["doc_id"] is not None and x["text"] is not None} == want and 200 not in want and want[204] == "a"
    assert len(got) == len(want) + 2


def test_mix_keeps_rows_apart(spark):
    """Rows without a doc_id, and repeated rows, give as many words as the mix takes of them."""
    rows = [(None, "a b c d", "x"), (None, "e f", "y"), (1, "g h i", "x"), (1, "g h i", "x"), (1, "j k", "y"), (2, "l m n o p", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix(spark, df, SF).collect()
    targets = {x["source"]: x["target"] for x in got}
    assert set(targets) == {"x", "y", None} and any(x["doc_id"] is None for x in got)
    for source, target in targets.items():
        assert abs(sum(x["words"] for x in got if x["source"] == source) - target) <= 1
    assert all(x["size"] == len(x["text"].split()) for x in got)


def test_run(spark):
    """What the mix takes comes in whole parts, and of all tables that the stages wrote, only the result's is left."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:")) / "textwarden"
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(set(folder.iterdir()) - before) == 1
    assert rows and all(r["words"] <= r["size"] and r["taken"] <= 3 * r["size"] for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault(r["doc_id"], [r["taken"], 0])[1] += r["words"]
    assert all(a == b for a, b in taken.values())
