"""Every registered query against its SQL on the smallest tables; queries without SQL must give rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, rows_of, sql_rows

from textwarden import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = rows_of(registry.QUERIES[name](spark, SF).toArrow())
    if name in registry.SQL:
        assert got == sql_rows(registry.SQL[name], SF)
    else:
        assert got[1]


def test_near_duplicates_go(spark, tmp_path):
    """Passages in several near copies, against SQL: the test tables have none, so that nothing is dropped there."""
    for name in TABLES:
        if name != "benchmark":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 8").collect()
    rows = [(x["item_id"] + 8 * k, x["text"] + end) for x in items for k, end in enumerate(["", "", " again", " and something else"])]
    pq.write_table(pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), tmp_path / "benchmark.parquet")
    names, got = rows_of(registry.QUERIES["near_dup_leaders"](spark, str(tmp_path)).toArrow())
    assert (names, got) == sql_rows(registry.SQL["near_dup_leaders"], str(tmp_path))
    assert sum(r[names.index("dropped")] for r in got) > 0


@pytest.mark.parametrize("name", ["counterfactual_pairs", "rewrite_short_forms", "rewrite_query"])
def test_words_twice_in_a_row(spark, tmp_path, name):
    """Neighbouring words share the character between them; all of them are replaced, by the query and by its SQL."""
    texts = ["he he, he he and hr hr HR pf-pf", "wfh wfh wfh last month last month, this month this month", "od"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    for t in TABLES:
        if t != "conversations":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    (tmp_path / "conversations.parquet").symlink_to(next((tmp_path / "c").glob("*.parquet")))
    got = rows_of(registry.QUERIES[name](spark, str(tmp_path)).toArrow())
    assert got == sql_rows(registry.SQL[name], str(tmp_path))
    told = " ".join(str(x) for r in got[1] for x in r)
    assert "she she, she she" in told if name == "counterfactual_pairs" else "human resources human resources human resources provident fund-provident fund" in told
