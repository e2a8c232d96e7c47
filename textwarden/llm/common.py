"""What the operators of this subpackage share: tables in the shared folder, checked broadcasts, fixed splits."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of (narrow) rows that a side may have to be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000

#: Most MB that a side may have to be broadcast, where its rows have no fixed size.
BROADCAST_MB = 16

#: The tables that the operators under way have written, innermost last.
_written = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textwarden-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; a lost executor costs no lineage beyond it.

    Inside a scoped operator the files go when it ends; else they stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textwarden/{uuid.uuid4().hex}"
    for tables in getattr(_written, "scopes", [])[-1:]:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its (narrow) result written as a table of the caller's, and the tables written on the way deleted."""

    @functools.wraps(operator)
    def run(*args, **named) -> DataFrame:
        if not hasattr(_written, "scopes"):
            _written.scopes = []
        scopes = _written.scopes
        scopes.append([])
        spark = next(x for x in args if isinstance(x, DataFrame)).sparkSession
        try:
            out = operator(*args, **named)
            inner = scopes.pop()
            try:
                return cut(out)
            finally:
                scopes.append(inner)
        finally:
            _delete(spark, scopes.pop())

    return run


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; else df as it is, for a shuffled join.

    df should be cheap to count: a table from cut(), whose count comes from the files' footers.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def light(df: DataFrame, mb: int = BROADCAST_MB) -> DataFrame:
    """df with a broadcast hint if its rows, written as text, have at most that many MB; else df as it is, for a shuffled join.

    df is computed for that, so it should be a table from cut(), or cheap.
    """
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= mb << 20 else df


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and no other letter changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, separators: str) -> Column:
    """The words of a text between runs of the separator class; none for null. The text is read whole."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")
