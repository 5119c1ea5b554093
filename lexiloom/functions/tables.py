"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, as in tests, a folder of this process, but on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="lexiloom-")
        atexit.register(folder.cleanup)
        _own["dir"] = f"file://{folder.name}"
    return _own["dir"]


def write_table(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that survives lost executors.

    Inside :func:`scratch` the table goes when that ends; with ``keep`` it stays for whoever called it.
    """
    path = f"{shared_folder(df.sparkSession)}/lexiloom/{uuid.uuid4().hex}/{name}"
    open_scopes = _scopes[:-1] if keep else _scopes
    if open_scopes:
        open_scopes[-1].append(path)
    # a writer holds a row group in memory: small ones, as several tasks and Python workers share an executor
    df.write.options(**{"parquet.block.size": str(16 << 20), **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], *partitions: str) -> DataFrame:
    """A table derived from ``source`` that is written once an application, with directories for the values of ``partitions``."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _kept:
        path = f"{shared_folder(spark)}/lexiloom/{uuid.uuid4().hex}/{name}"
        rows = make()
        rows.write.partitionBy(*partitions).parquet(path)
        _kept[key] = spark.read.schema(rows.schema).parquet(path)
    return _kept[key]


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows that Python tasks get at a time inside :func:`scratch`, where texts may be long.
BATCH_ROWS = "2000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so what leaves has to be written with ``keep``; Python tasks run inside get small batches."""
    _scopes.append([])
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
        for path in _scopes.pop():
            _delete(spark, path)


def semi_join(rows: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """Rows of a table whose ``column`` is in the one column of ``members``.

    Values in over a thousandth of the rows, such as classes, are fewer than 1000: they are
    met by broadcast, and the shuffle of the others has none that is large.
    """
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).where(F.col("_n") * 1000 > F.col("_all")).select(column)
    hot = write_table(hot, "hot")
    members = members.select(F.col(members.columns[0]).alias(column)).distinct()
    first = rows.join(F.broadcast(hot.join(members, column, "left_semi")), column, "left_semi")
    rest = rows.join(F.broadcast(hot), column, "left_anti").join(members, column, "left_semi")
    return first.unionByName(rest)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`write_table` wrote."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)
