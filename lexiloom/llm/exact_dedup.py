"""Exact deduplication with a log-structured merge index of text digests.

Level 0: every memtable (a slice of the rows) is flushed as a digest run, sorted
by digest. Compaction merges ``fan_in`` runs at a time and keeps the smallest
identifier and the row count of each digest, level by level, until one run is
left. Digests met more than once are hits. A bitmap filter of bounded size over
the hits selects the rows whose bytes have to be looked at; every hit is verified
on the bytes, and a digest shared by different texts is resolved on the texts.

Only DataFrame and SQL functions are used. The one place where text is shuffled
is the verification, for rows that pass the filter, after a partial aggregation
on the map side, so a text with billions of copies sends one row per map task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, maybe_in, shuffle_partitions


def _flush(rows: DataFrame, memtable_rows: int) -> DataFrame:
    """Level-0 runs: (run, digest, rid, n, at_rid)."""
    total = rows.count()
    tables = max(1, math.ceil(total / memtable_rows))
    counted = (
        rows.withColumn("run", F.pmod(F.xxhash64("rid"), F.lit(tables)).cast("int"))
        .groupBy("run", "digest", "rid")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("run", "digest")
        .agg(F.min(F.struct("rid", "c")).alias("least"), F.sum("c").alias("n"))
        .select("run", "digest", F.col("least.rid").alias("rid"), "n", F.col("least.c").alias("at_rid"))
    )
    return _sorted_run(counted)


def _sorted_run(runs: DataFrame) -> DataFrame:
    parts = shuffle_partitions(runs.sparkSession)
    return materialise(runs.repartition(parts, "digest").sortWithinPartitions("run", "digest"), "run")


def compact(runs: DataFrame) -> DataFrame:
    """Merge runs that share the value of ``run``: the smallest identifier of each digest stays."""
    return runs.groupBy("run", "digest").agg(F.min(F.struct("rid", "at_rid")).alias("least"), F.sum("n").alias("n")).select(
        "run", "digest", F.col("least.rid").alias("rid"), "n", F.col("least.at_rid").alias("at_rid")
    )


def build_index(rows: DataFrame, memtable_rows: int, fan_in: int) -> DataFrame:
    """(digest, rid, n, at_rid) of all rows, by flushes and tiered compaction."""
    index = _flush(rows, memtable_rows)
    runs = index.agg(F.max("run")).first()[0]
    runs = 0 if runs is None else int(runs)
    while runs > 0:
        index = _sorted_run(compact(index.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))))
        runs //= fan_in
    return index.drop("run")


def _with_hits(rows: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Left join on digest. Groups of over a thousandth of all rows, of which there are fewer than 1000, are broadcast."""
    floor = max(total // 1000, 1)
    hot = hits.where(F.col("n") > floor)
    first = rows.join(
        F.broadcast(hot.select("digest", F.struct("rid", "n", "at_rid").alias("hot"))), "digest", "left"
    )
    rest = hits.where(F.col("n") <= floor).select("digest", F.struct("rid", "n", "at_rid").alias("cold"))
    # rows that are resolved take a key of their own, so that they spread evenly
    spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("-"), F.xxhash64("rid").cast("string")), "utf-8"))
    return (
        first.withColumn("key", spread)
        .join(rest.withColumnRenamed("digest", "key"), "key", "left")
        .withColumn("hit", F.coalesce("hot", "cold"))
        .drop("key", "hot", "cold")
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    digest: Column | None = None,
    memtable_rows: int = 4_000_000,
    fan_in: int = 16,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text counts as the empty
    one. Of each group the row with the smallest (``keep="largest"``: largest)
    identifier stays; a null identifier loses to any other. Of several rows with
    the kept identifier and the same text exactly one is kept. ``digest`` may be
    another function of the column ``text``; collisions are resolved on bytes.
    An empty table gives an empty result; other columns are ignored.
    """
    # the bits turned round reverse the order of whole numbers without an overflow
    turn = {"smallest": lambda c: c, "largest": F.bitwise_not}[keep]
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.unhex(F.sha2("text", 256)) if digest is None else digest
    base = base.withColumn("digest", key).withColumn("rid", F.struct(F.col("doc_id").isNull().alias("none"), turn(F.col("doc_id").cast("long")).alias("key")))
    rows = base.select("digest", "rid")
    index = build_index(rows, memtable_rows, fan_in)
    total, n_hits, ties = index.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 1, 1)), F.count(F.when(F.col("at_rid") > 1, 1))
    ).first()
    hits = index.where(F.col("n") > 1)
    checked = maybe_in(base.select("digest", "text"), "digest", hits.select("digest"), n_hits).where("_maybe")
    differing = materialise(
        checked.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low <> high").select("digest", "n"),
        "collisions",
    )
    sha = F.sha2("text", 256)
    if not differing.isEmpty():
        return _by_text(base, turn)
    out = _with_hits(base.select("doc_id", "rid", "digest", *([sha.alias("text_sha256")] if digest is not None else [])), hits, total)
    if digest is None:
        out = out.withColumn("text_sha256", F.lower(F.hex("digest")))
    out = out.select(
        "doc_id",
        "rid",
        F.coalesce("hit.rid", "rid").alias("best"),
        F.coalesce("hit.n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("hit.at_rid", F.lit(1)).alias("at_rid"),
        "text_sha256",
    )
    return _finish(out, turn, ties > 0)


def _by_text(base: DataFrame, turn: Callable[[Column], Column]) -> DataFrame:
    """Exact way for a digest that different texts share: group on the text itself as well."""
    counted = base.groupBy("digest", "text", "rid").agg(F.count(F.lit(1)).alias("c"))
    groups = counted.groupBy("digest", "text").agg(F.min(F.struct("rid", "c")).alias("least"), F.sum("c").alias("n"))
    out = base.join(groups, ["digest", "text"]).select(
        "doc_id", "rid", F.col("least.rid").alias("best"), F.col("n").alias("group_size"), F.col("least.c").alias("at_rid"), F.sha2("text", 256).alias("text_sha256")
    )
    return _finish(out, turn, True)


def _finish(out: DataFrame, turn: Callable[[Column], Column], ties: bool) -> DataFrame:
    keep_id = turn(F.col("best.key"))
    columns = ["doc_id", keep_id.alias("keep_id"), "group_size", "kept", "text_sha256"]
    if not ties:
        return out.withColumn("kept", F.col("rid") == F.col("best")).select(*columns)
    # of several rows with the kept identifier the one with the smallest number stays; each has its own, so no group meets in one task
    winner = F.col("rid") == F.col("best")
    alone = out.where(~winner | (F.col("at_rid") == 1)).withColumn("kept", winner)
    many = materialise(out.where(winner & (F.col("at_rid") > 1)).withColumn("number", F.monotonically_increasing_id()), "repeated")
    first = many.groupBy("text_sha256", "rid").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("kept"))
    numbered = many.join(first, "number", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return alone.select(*columns).unionByName(numbered.select(*columns))
