"""Helpers shared by the corpus operators: shared-folder tables, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import gc
import inspect
import math
import time
from collections.abc import Callable, Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.shipping import ship_package
from lexiloom.functions.tables import drop_table, scratch, write_table as materialise

__all__ = ["components", "docs_of", "drop_table", "fetch", "join_hot", "lean", "materialise", "maybe_in", "scratch", "shuffle_partitions", "tidy"]


_trimmed = 0.0


def _trim(now: bool = False) -> None:
    """Give freed memory back to the system, at most a few times a second unless asked for ``now``."""
    global _trimmed
    if now or time.monotonic() - _trimmed > 0.2:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library
        _trimmed = time.monotonic()


def lean(work: Callable) -> Callable:
    """``work`` of a Python task, of batches or of one group, that doesn't keep what it has freed: workers stay between stages, beside the executor."""
    if inspect.isgeneratorfunction(work):

        @wraps(work)
        def of_batches(batches):
            for out in work(batches):
                yield out
                del out
                _trim()
            _trim(now=True)

        return of_batches

    @wraps(work)
    def of_group(frame):
        out = work(frame)
        _trim()
        return out

    return of_group


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of the steps before, whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in ``right``, whose ``count`` is the number of left rows with that key.

    Keys that hold over a thousandth of the ``total`` left rows are fewer than
    1000, so they are broadcast; the other keys are joined by a shuffle in which
    no key is large. ``how`` is inner or left.
    """
    floor = max(total // 1000, 1)
    names = [c for c in right.columns if c != key]
    packed = right.select(key, F.struct(*names).alias("_r"))
    hot = packed.where(F.col(f"_r.{count}") > floor).withColumnRenamed("_r", "_hot")
    cold = packed.where(F.col(f"_r.{count}") <= floor).withColumnRenamed("_r", "_cold")
    first = left.join(F.broadcast(hot), key, "left")
    done = first.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "_r")
    rest = first.where(F.col("_hot").isNull()).drop("_hot").join(cold.withColumnRenamed("_cold", "_r"), key, how)
    return done.unionByName(rest).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in names])


#: Bits of a membership filter; 2**26 bits are 8 MiB, the most that is ever broadcast for one.
FILTER_BITS = 2**26
_PAGE = 32768  # bits of one page, as bitmap_construct_agg makes them


def maybe_in(rows: DataFrame, column: str, members: DataFrame, n_members: int) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``column`` is surely not among the values of the one column of ``members``.

    The members set bits of a bitmap of at most FILTER_BITS bits, so what is
    broadcast is bounded at any size; with very many members the filter lets more
    rows through and saves less, but it never drops a member.
    """
    bits = min(FILTER_BITS, max(_PAGE, 2 ** math.ceil(math.log2(16 * max(1, n_members)))))
    member = members.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    pages = (
        members.select(slot(member).alias("slot"))
        .groupBy(F.floor(F.col("slot") / _PAGE).cast("int").alias("_page"))
        .agg(F.expr(f"bitmap_construct_agg(slot % {_PAGE})").alias("_bitmap"))
    )
    byte = F.conv(F.hex(F.expr(f"substring(_bitmap, cast((_slot % {_PAGE}) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    out = rows.withColumn("_slot", slot(column)).withColumn("_page", F.floor(F.col("_slot") / _PAGE).cast("int"))
    out = out.join(F.broadcast(pages), "_page", "left").withColumn("_byte", byte)
    bit = F.expr("shiftright(_byte, cast(_slot % 8 as int))").bitwiseAND(F.lit(1)) == 1
    return out.withColumn("_maybe", F.coalesce(bit, F.lit(False))).select(*rows.columns, "_maybe")


def fetch(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``wanted`` (one column of that name), one for each key; others aren't shuffled."""
    wanted = materialise(wanted.distinct(), "wanted")
    near = maybe_in(rows, key, wanted, wanted.count()).where("_maybe").drop("_maybe")
    return near.join(wanted, key, "left_semi").dropDuplicates([key])


#: Edges up to which components are found by union-find in one task: 16 bytes an edge.
FEW_EDGES = 1_000_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, max(1, len(nodes)), 100_000):
        own = nodes[at : at + 100_000]
        yield pd.DataFrame({"node": own, "component": [find(x) for x in own]}, dtype="int64")


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 100, few: int | None = None) -> DataFrame:
    """Connected components of an edge list: by union-find where the edges are few, else by alternating large and small stars.

    Returns ``(node, component)`` for each node that isn't the smallest of its
    component. Each round groups by node with a partial minimum first, so a hub
    is never gathered in one task, and is written to the shared folder.
    """
    current = materialise(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v"), "edges")
    if current.count() <= (FEW_EDGES if few is None else few):
        return materialise(current.repartition(1).mapInPandas(lean(_union_find), "node long, component long"), "groups")
    current = materialise(current.distinct(), "edges")
    for _ in range(max_rounds):
        n, nodes = current.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and current.join(current.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u points to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        old, current = current, materialise(small, "edges")
        drop_table(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
