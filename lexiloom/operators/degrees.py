"""Indegrees that are kept in a table and follow the changes of the graph."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.tables import semi_join, write_table
from lexiloom.operators.etl import remove

BUCKETS = 64
_TRIPLE = ["s", "p", "o"]


def _bucketed(degrees: DataFrame) -> DataFrame:
    return degrees.select("node", "indegree", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def save_degrees(degrees: DataFrame, path: str) -> None:
    """Write (node, indegree); a change later rewrites only the buckets it touches."""
    _bucketed(degrees).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    """(node, indegree) as kept; of a table that isn't there no row, so that everything is unranked."""
    schema = "node string, indegree long, bucket int"
    try:
        return spark.read.schema(schema).parquet(path).where("node is not null").select("node", "indegree")
    except AnalysisException:
        return spark.createDataFrame([], schema).select("node", "indegree")


def degree_changes(base: DataFrame, after: DataFrame, adds: DataFrame, gone: DataFrame, type_predicate: str, concept: str) -> DataFrame:
    """(node, change) between two states of a graph, from what was added and what went alone.

    A triple counts where both its ends are concepts. So what can change are the
    triples added or gone, and those at an end that became a concept or stopped to be one.
    """
    is_type = (F.col("p") == type_predicate) & (F.col("o") == concept)
    members = lambda t: t.where(is_type).select(F.col("s").alias("c")).distinct()
    state = lambda t, was, stays: t.select(*_TRIPLE, F.lit(was).alias("was"), F.lit(stays).alias("stays"))
    changed = state(adds, False, True).unionByName(state(gone, True, False))
    touched = write_table(changed.where(is_type).select(F.col("s").alias("c")).distinct(), "touched")  # of types added or gone
    if not touched.isEmpty():  # what is at their ends and not in the base was added
        ends = base.join(touched.withColumnRenamed("c", "s"), "s", "left_semi").select(_TRIPLE).unionByName(semi_join(base, "o", touched).select(_TRIPLE))
        changed = changed.unionByName(state(ends, True, True))
    asked = write_table(changed.groupBy(*_TRIPLE).agg(F.max("was").alias("was"), F.min("stays").alias("stays")), "asked")

    def counted(t: DataFrame, flag: str, sign: int) -> DataFrame:
        c = members(t)
        own = asked.where(flag).join(c.withColumnRenamed("c", "s"), "s", "left_semi")
        by = own.groupBy(F.col("o").alias("node")).agg((F.count(F.lit(1)) * sign).alias("d"))  # a row for each object, before these are joined
        return by.join(c.withColumnRenamed("c", "node"), "node", "left_semi")

    return counted(after, "stays", 1).unionByName(counted(base, "was", -1)).groupBy("node").agg(F.sum("d").alias("change")).where("change <> 0")


def update_with_degrees(path: str, base: DataFrame, adds: DataFrame | None, removals: DataFrame | None, type_predicate: str, concept: str) -> DataFrame:
    """The updated triples; the kept indegrees at ``path`` get the difference, in the buckets that have one."""
    spark = base.sparkSession
    before = write_table(base.select(_TRIPLE).distinct(), "before")
    left = before if removals is None else remove(before, removals)
    if adds is None:
        after, new = write_table(left, "updated"), before.limit(0)
    else:
        wanted = write_table(adds.select(_TRIPLE).distinct().join(left, _TRIPLE, "left_anti"), "wanted")
        after = write_table(left.unionByName(wanted), "updated")
        new = wanted if removals is None else write_table(wanted.join(before, _TRIPLE, "left_anti"), "added")
    gone = before.limit(0) if removals is None else write_table(before.join(after, _TRIPLE, "left_anti"), "gone")
    changes = write_table(_bucketed(degree_changes(before, after, new, gone, type_predicate, concept).withColumnRenamed("change", "indegree")), "changes")
    hit = F.broadcast(changes.select("bucket").distinct())  # at most BUCKETS rows
    old = spark.read.schema("node string, indegree long, bucket int").parquet(path).where("node is not null").join(hit, "bucket", "left_semi").select("node", "indegree", "bucket")
    merged = old.unionByName(changes).groupBy("node", "bucket").agg(F.sum("indegree").alias("indegree"))
    # a node that has fallen to 0 stays out of the rows; its bucket is written even where no row is left
    merged = write_table(merged.where("indegree <> 0").select("node", "indegree", "bucket"), "merged")
    empty = hit.join(merged.select("bucket").distinct(), "bucket", "left_anti").select(F.lit(None).cast("string").alias("node"), F.lit(0).cast("long").alias("indegree"), "bucket")
    merged.unionByName(empty).repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    return after
