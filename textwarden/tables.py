"""Tables that operators write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove shuffle files at the end of a query; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
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


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder. Inside a scoped operator it goes when that ends; else it stays until the folder is cleared."""
    path = f"{shared_folder(spark)}/textwarden/{uuid.uuid4().hex}"
    for paths in getattr(_written, "scopes", [])[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query that runs meanwhile goes from the executors' disks when it ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; a lost executor costs no lineage beyond it. What was shuffled for it goes from the executors' disks when it is written."""
    spark = df.sparkSession
    path = fresh_path(spark)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it has fewer partitions than there are cores: a file may be one task however long its texts take."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores: for narrow rows with costly expressions. Splits of a file don't tell how many tasks have rows, as one row group is one task's."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written as a table of the caller's, and the tables written on the way deleted."""

    @functools.wraps(operator)
    def run(*args, **named) -> DataFrame:
        if not hasattr(_written, "scopes"):
            _written.scopes = []
        scopes = _written.scopes
        spark = next((x if isinstance(x, SparkSession) else x.sparkSession for x in args if isinstance(x, DataFrame | SparkSession)))
        scopes.append([])
        try:
            out = operator(*args, **named)
            inner = scopes.pop()
            try:
                return kept(out)
            finally:
                scopes.append(inner)
        finally:
            _delete(spark, scopes.pop())

    return run
