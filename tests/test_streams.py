"""Streams over several batches: late and orphan rows, restarts, expiry in event time."""

import json
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from textwarden.sources import stores
from textwarden.streaming import traces as T
from textwarden.streaming import usage as U

HOUR = 3_600_000_000


def put(folder, name, columns, rows):
    """A file of rows; times are given in hours."""
    folder.mkdir(exist_ok=True)
    data = {c: [r[k] for r in rows] for k, c in enumerate(columns)}
    kinds = {"ts": pa.timestamp("us", "UTC"), "at": pa.timestamp("us", "UTC"), "feedback": pa.string(), "kind": pa.string()}
    table = pa.table({c: pa.array([None if x is None else pd.Timestamp(x * HOUR, unit="us", tz="UTC") for x in v] if c in ("ts", "at") else v, kinds.get(c, pa.int64())) for c, v in data.items()})
    pq.write_table(table, folder / name)


def read(spark, folder):
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def rows(spark, out, *names):
    """The rows that a sink has; it has no readable schema as long as it is empty."""
    if not list(Path(out).glob("*.parquet")):
        return []
    return sorted((tuple(r) for r in spark.read.parquet(str(out)).select(*names).collect()), key=repr)


def test_late_and_orphan_feedback(spark, tmp_path):
    """Feedback in later batches; for no trace; after its time; later than the watermark; several for one run. Traces wait for it, and come out once."""
    t, f, out, check = (tmp_path / n for n in ("t", "f", "out", "check"))
    step = lambda: run(T.with_feedback(read(spark, t), read(spark, f), "10 hours", "2 hours"), out, check)
    put(t, "1.parquet", ["run_id", "ts"], [(1, 100), (2, 101), (3, 102)])
    put(f, "1.parquet", ["run_id", "at", "seq", "feedback"], [(1, 101, 1, "up"), (77, 101, 2, "down"), (2, 100, 3, "down")])
    step()
    assert rows(spark, out, "run_id", "feedback") == []
    put(t, "2.parquet", ["run_id", "ts"], [(4, 107)])
    put(f, "2.parquet", ["run_id", "at", "seq", "feedback"], [(1, 108, 5, "down"), (1, 107, 4, "up"), (None, 107, 6, "up")])
    step()
    assert rows(spark, out, "run_id", "feedback") == []
    put(t, "3.parquet", ["run_id", "ts"], [(5, 120), (6, 90)])  # 6 is too late
    put(f, "3.parquet", ["run_id", "at", "seq", "feedback"], [(3, 115, 7, "up"), (4, 119, 8, "up"), (5, 121, 9, "up")])  # 3's and 4's come too long after them
    step()
    put(t, "4.parquet", ["run_id", "ts"], [(7, 200)])
    put(f, "4.parquet", ["run_id", "at", "seq", "feedback"], [(7, 200, 10, "up")])
    step()
    assert rows(spark, out, "run_id", "feedback") == [(1, "down"), (2, None), (3, None), (4, None), (5, "up")]


def test_store_is_exactly_once(spark, tmp_path):
    """A restart goes on where the last one ended; a batch whose commit was lost is run again and not stored twice; files that a failed write left aren't read."""
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    names = ["run_id", "ts", "seq", "feedback", "kind"]
    go = lambda: T.store_kinds(read(spark, source), str(out), str(check)).awaitTermination()
    put(source, "1.parquet", names, [(1, 1, 0, None, "trace"), (2, 2, 1, None, "trace"), (1, 3, 2, "up", "feedback")])
    go()
    put(source, "2.parquet", names, [(3, 4, 3, None, "trace"), (1, 5, 4, "down", "feedback"), (9, 5, 5, "down", "feedback")])
    go()
    commits = sorted((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (check / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    left = next((out / "kind=trace").glob("*.parquet"))
    (out / "kind=trace" / "part-left-over.parquet").write_bytes(left.read_bytes())
    put(source, "3.parquet", names, [(2, 6, 6, "up", "feedback")])
    go()
    go()
    stored = spark.read.parquet(str(out))
    assert sorted(r["run_id"] for r in stored.where("kind = 'trace'").collect()) == [1, 2, 3]
    assert sorted((r["run_id"], r["feedback"]) for r in stored.where("kind = 'feedback'").collect()) == [(1, "down"), (1, "up"), (2, "up"), (9, "down")]
    told = stores.stitch_feedback(stored.where("kind = 'trace'").drop("seq"), stored.where("kind = 'feedback'"))
    assert sorted((r["run_id"], r["feedback"]) for r in told.collect()) == [(1, "down"), (2, "up"), (3, None)]


def usage(spark, folder):
    return U.usage_rates(read(spark, folder).withColumn("us", F.unix_micros("ts")), "2 hours")


def test_rates_across_batches_and_expiry(spark, tmp_path):
    """Rows out of order and in several batches; too late ones; null users and tokens; state that goes by event time, while the clock stands still."""
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    names = ["run_id", "user", "ts", "tokens"]
    step = lambda: run(usage(spark, source), out, check)
    put(source, "1.parquet", names, [(1, 1, 100, 10), (3, 1, 101, 30), (4, 2, 101, None), (9, None, 101, 1)])
    step()
    put(source, "2.parquet", names, [(2, 1, 100.5, 20), (5, 1, 110, 50), (6, 2, 110, 60)])
    step()
    done = {r[0]: r[1:] for r in rows(spark, out, "run_id", "per_minute", "per_day", "tokens_day")}
    assert done == {1: (0, 0, 0), 2: (0, 1, 10), 3: (0, 2, 30), 4: (0, 0, 0)}
    put(source, "3.parquet", names, [(7, 1, 124.5, 70), (8, 1, 100.2, 1)])  # 8 is too late
    step()
    assert U.state_rows(spark, str(check), "memory") == 2
    put(source, "4.parquet", names, [(10, 3, 500, 1)])
    step()
    done = {r[0]: r[1:] for r in rows(spark, out, "run_id", "per_minute", "per_day", "tokens_day")}
    assert done == {1: (0, 0, 0), 2: (0, 1, 10), 3: (0, 2, 30), 4: (0, 0, 0), 5: (0, 3, 60), 6: (0, 1, 0), 7: (0, 3, 100)}
    assert U.state_rows(spark, str(check), "memory") == 0  # users 1 and 2 were last seen over a day before 498; 3 still waits


def test_attempts_keep_thumbs_across_batches(spark, tmp_path):
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    stream = lambda: U.attempts(read(spark, source).select("run_id", F.lit(5).cast("long").alias("thread"), "ts", F.unix_micros("ts").alias("us"), (F.col("seq") == 1).alias("pushed_back"), "feedback"), "2 hours")
    names = ["run_id", "ts", "seq", "feedback"]
    put(source, "1.parquet", names, [(1, 10, 0, None), (2, 11, 1, "down")])
    run(stream(), out, check)
    put(source, "2.parquet", names, [(3, 14, 0, "up"), (4, 15, 0, None), (5, 16, 1, None)])
    run(stream(), out, check)
    put(source, "3.parquet", names, [(6, 90, 0, None)])
    run(stream(), out, check)
    assert rows(spark, out, "run_id", "attempt") == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2)]
    assert json.loads(next((check / "offsets").glob("[0-9]*")).read_text().splitlines()[1])["conf"]["spark.sql.streaming.stateStore.providerClass"] == U.STORE


def test_keys_share_groups(spark, tmp_path):
    """Hundreds of keys wait in far fewer states, and one key's null leaves another's numbers whole."""
    source, out, check = (tmp_path / n for n in ("in", "out", "check"))
    keys = 1500
    put(source, "1.parquet", ["run_id", "user", "ts", "tokens"], [(2 * u + k, u, 10 + k, None if (u, k) == (7, 1) else u) for u in range(keys) for k in (0, 1)] + [(-1, -1, 900, None)])
    run(usage(spark, source), out, check)
    assert U.state_rows(spark, str(check), "waiting") == 1
    told = {r[0]: r[1:] for r in rows(spark, out, "run_id", "per_day", "tokens_day")}
    assert told == {2 * u + k: (k, u * k) for u in range(keys) for k in (0, 1)}
    groups = spark.read.format("statestore").option("stateVarName", "quiet").load(str(check)).count()
    assert groups <= U.GROUPS
