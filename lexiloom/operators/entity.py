"""Entities: what is said of a resource, and the reductions of a display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.tables import write_table


def entity_map(triples: DataFrame, *subjects: str) -> DataFrame:
    """(s, p, os): the sorted set of values of each predicate."""
    rows = triples.where(F.col("s").isin(*subjects)) if subjects else triples
    return rows.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("os"))


def raw_vs_inferred(base: DataFrame, inferred: DataFrame) -> DataFrame:
    """The inferred triples that aren't stated."""
    return inferred.select("s", "p", "o").join(base.select("s", "p", "o"), ["s", "p", "o"], "left_anti").distinct()


def nested_blank_nodes(triples: DataFrame) -> DataFrame:
    """(s, p, node, entity): blank-node values with their own statements, one level deep."""
    inner = triples.where(F.col("s").startswith("_:")).groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
    inner = inner.groupBy(F.col("s").alias("node")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "os")))).alias("entity"))
    return triples.where(F.col("o").startswith("_:")).select("s", "p", F.col("o").alias("node")).join(inner, "node", "left").select("s", "p", "node", "entity")


def blank_node_trees(triples: DataFrame, supers: dict[str, set[str]] | None = None, max_rounds: int = 1000) -> DataFrame:
    """(node, entity, depth): every blank node that something is said of, as text with the blank nodes in it folded in.

    An entity is ``[ p o, o ; p o ]``, predicates and values in order. Nodes are folded
    from the innermost out, a level a round. Nodes on a cycle, and those around one,
    can't be: they are folded with the names of nodes that stand open. With ``supers`` predicates
    whose values all stand under a more specific one are left out inside too.
    """
    said = triples.where(F.col("s").startswith("_:")).select("s", "p", "o").distinct()
    if supers:
        said = prune_superproperties(said, supers)
    left = write_table(said, "blank_nodes")
    known = left.sparkSession.createDataFrame([], "node string, entity string, depth int")
    for depth in range(max_rounds):
        open_ = left.select(F.col("s").alias("o")).distinct().withColumn("open", F.lit(True))
        rows = left.join(known.withColumnRenamed("node", "o"), "o", "left").join(open_, "o", "left")
        ready = rows.groupBy("s").agg(F.max(F.coalesce("open", F.lit(False))).alias("open"))
        ready = write_table(ready.where("not open").select("s"), "ready")
        cyclic = ready.isEmpty()
        if cyclic and left.isEmpty():
            return known
        own = rows if cyclic else rows.join(ready, "s", "left_semi")
        values = own.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("entity", "o"))), ", ").alias("os"), F.max(F.coalesce("depth", F.lit(-1))).alias("inner"))
        made = values.groupBy(F.col("s").alias("node")).agg(F.concat(F.lit("[ "), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "os"))), " ; "), F.lit(" ]")).alias("entity"), (F.max("inner") + 1).cast("int").alias("depth"))
        known = known.unionByName(write_table(made, "folded"))
        if cyclic:
            return known
        left = write_table(left.join(ready, "s", "left_anti"), "blank_nodes")
    raise RuntimeError("blank nodes nest too deep")


def with_blank_nodes(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows (s, p, o) with ``entity`` in place of blank-node values that something is said of."""
    inner = trees.select(F.col("node").alias("o"), "entity")
    return rows.join(inner, "o", "left").select(*rows.columns, F.coalesce("entity", "o").alias("value"))


def enriched(result: DataFrame, triples: DataFrame, labels: list[str], most: int = 500) -> DataFrame:
    """(node, label, entity) of the resources that stand in the cells of a result.

    Labels are told of IRIs where there are at most ``most`` of them, by the first of
    the predicates ``labels`` that a resource has one under, then by name; without one a resource stands with none.
    Blank nodes come with what is said of them, whatever their number.
    """
    cells = [F.col(f"`{f.name}`") for f in result.schema.fields if f.dataType.simpleString() == "string"]
    nodes = result.select(F.explode(F.array(*cells)).alias("node")).where("node like '<%' or node like '\\_:%'").distinct()
    nodes = write_table(nodes, "cells")
    iris = nodes.where("node like '<%'")
    few = iris.limit(most + 1).count() <= most
    rank = reduce(lambda rest, i: F.when(F.col("p") == labels[i], i).otherwise(rest), reversed(range(len(labels))), F.lit(len(labels)))
    if few:
        named = triples.where(F.col("p").isin(*labels)).join(F.broadcast(iris.withColumnRenamed("node", "s")), "s", "left_semi")  # at most ``most`` rows
        best = named.groupBy(F.col("s").alias("node")).agg(F.min(F.struct(rank.alias("rank"), "o"))["o"].alias("label"))
        told = iris.join(best, "node", "left").select("node", "label", F.lit(None).cast("string").alias("entity"))
    else:
        told = iris.select("node", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("entity"))
    blanks = nodes.where("node like '\\_:%'").join(blank_node_trees(triples).select("node", "entity"), "node")
    return told.unionByName(blanks.select("node", F.lit(None).cast("string").alias("label"), "entity"))


def prune_superproperties(triples: DataFrame, supers: dict[str, set[str]]) -> DataFrame:
    """Drops (s, p) whose every value also stands under a predicate that entails p."""
    spark = triples.sparkSession
    rows = [(sub, sup) for sub, ups in sorted(supers.items()) for sup in sorted(ups)]
    pairs = F.broadcast(spark.createDataFrame(rows, "sub string, p string"))  # schema rows only
    covered = triples.select("s", F.col("p").alias("sub"), "o").join(pairs, "sub").select("s", "p", "o").distinct()
    uncovered = triples.join(covered, ["s", "p", "o"], "left_anti").select("s", "p").distinct()
    return triples.join(uncovered, ["s", "p"], "left_semi")


def folded_predicates(triples: DataFrame, supers: dict[str, set[str]]) -> DataFrame:
    """(s, p) that :func:`prune_superproperties` folds away."""
    return triples.select("s", "p").distinct().join(prune_superproperties(triples, supers).select("s", "p"), ["s", "p"], "left_anti")


def truncate_relations(weighted: DataFrame, most: int = 150) -> DataFrame:
    """(s, p, kept, deferred) from rows with ``pos``: values shown now and those left for later."""
    return weighted.groupBy("s", "p").agg(
        F.count(F.when(F.col("pos") <= most, 1)).alias("kept"), F.count(F.when(F.col("pos") > most, 1)).alias("deferred")
    )


def best_labels(labels: DataFrame, rank) -> DataFrame:
    """(s, label): the literal of the best rank of each subject, ties by name; ``rank`` is a column of (s, o)."""
    return labels.groupBy("s").agg(F.min(F.struct(rank.alias("rank"), "o")).alias("x")).select("s", F.col("x.o").alias("label"))


def set_merge(a: Column, b: Column) -> Column:
    """The union of two sets of values, in order; a null set is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def unwrapped(values: Column) -> Column:
    """(one, many): a value that stands alone by itself, several as a set, none of both for an empty set."""
    return F.struct(F.when(F.size(values) == 1, values[0]).alias("one"), F.when(F.size(values) > 1, values).alias("many"))


def entity_labels(triples: DataFrame, full: str, short: str, others: list[str], detail: str = "normal") -> DataFrame:
    """(s, os): the labels of each resource, those of the first predicate that it has any under.

    ``normal`` asks for the short label first, ``high`` for the full one, and then leaves out
    values that are short ones too, unless nothing else is left; ``basic`` tells none.
    """
    if detail == "basic":
        return triples.select("s", F.array("o").alias("os")).limit(0)
    order = [short, full, *others] if detail == "normal" else [full, short, *others]
    rows = triples.where(F.col("p").isin(*order)).groupBy("s").pivot("p", order).agg(F.array_sort(F.collect_set("o")))
    have = [F.when(F.size(F.col(f"`{p}`")) > 0, F.col(f"`{p}`")) for p in order]
    found = F.coalesce(*have)
    if detail == "high":
        rest = F.array_except(found, F.coalesce(F.col(f"`{short}`"), F.array().cast("array<string>")))
        found = F.when(F.size(rest) > 0, rest).otherwise(found)
    return rows.select("s", found.alias("os"))


def round_robin_top(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """n values taken in turn from each key: the first of every key, then the second, and so on."""
    w = Window.partitionBy(key).orderBy(value)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", key, value).limit(n).select(key, value, "turn")


def table_query(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with the sorted set of every other column."""
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in rows.columns if c != key])


def resource_labels(triples: DataFrame, resources: DataFrame, *label_predicates: str) -> DataFrame:
    """(node, p, label) of the asked resources."""
    wanted = triples.where(F.col("p").isin(*label_predicates))
    return wanted.join(resources.select(F.col("node").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("node"), "p", F.col("o").alias("label"))


def gathered_values(triples: DataFrame, link: str, predicate: str) -> DataFrame:
    """(s, os): the union of a property over what a resource links to."""
    links = triples.where(F.col("p") == link).select("s", F.col("o").alias("m"))
    values = triples.where(F.col("p") == predicate).select(F.col("s").alias("m"), "o")
    return links.join(values, "m").groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("os"))
