"""Shapes as data: constraint checks to violations, and the baseline gate.

A violation is (focus_node, path, value, shape, constraint, message, severity).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["focus_node", "path", "value", "shape", "constraint", "message", "severity"]


@dataclass(frozen=True)
class Shape:
    """A named shape over the resources of some types (and of a namespace)."""

    name: str
    types: tuple[str, ...]
    prefix: str = "<"

    def targets(self, triples: DataFrame, type_predicate: str) -> DataFrame:
        rows = triples.where((F.col("p") == type_predicate) & F.col("o").isin(*self.types) & F.col("s").startswith(self.prefix))
        return rows.select(F.col("s").alias("focus_node")).distinct()


def _row(df: DataFrame, shape: str, constraint: str, message: str, severity: str, path: str | None = None, value: Column | None = None) -> DataFrame:
    return df.select(
        "focus_node",
        F.lit(path).cast("string").alias("path"),
        (value if value is not None else F.lit(None).cast("string")).alias("value"),
        F.lit(shape).alias("shape"),
        F.lit(constraint).alias("constraint"),
        F.lit(message).alias("message"),
        F.lit(severity).alias("severity"),
    )


class Validator:
    """Checks over one triples frame; each returns a frame of violations."""

    def __init__(self, triples: DataFrame, type_predicate: str):
        self.t, self.type = triples, type_predicate

    def targets(self, shape: Shape) -> DataFrame:
        return shape.targets(self.t, self.type)

    def values(self, path: str) -> DataFrame:
        return self.t.where(F.col("p") == path).select(F.col("s").alias("focus_node"), F.col("o").alias("value")).distinct()

    def min_count(self, shape: Shape, path: str, *more: str, severity: str = "Violation", message: str = "a value is missing") -> DataFrame:
        """At least one value of the path (a sequence where ``more`` is given)."""
        have = self.values(path)
        for p in more:
            step = self.values(p).withColumnRenamed("focus_node", "mid").withColumnRenamed("value", "next")
            have = have.join(step, have["value"] == step["mid"]).select("focus_node", F.col("next").alias("value"))
        missing = self.targets(shape).join(have.select("focus_node").distinct(), "focus_node", "left_anti")
        return _row(missing, shape.name, "MinCount", message, severity, "/".join((path, *more)))

    def max_count(self, shape: Shape, path: str, most: int = 1, severity: str = "Violation", message: str = "too many values") -> DataFrame:
        own = self.values(path).join(self.targets(shape), "focus_node", "left_semi")
        many = own.groupBy("focus_node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        return _row(many, shape.name, "MaxCount", message, severity, path)

    def not_literal(self, shape: Shape, path: str, severity: str = "Violation", message: str = "a resource is needed") -> DataFrame:
        own = self.values(path).join(self.targets(shape), "focus_node", "left_semi").where(F.col("value").startswith('"'))
        return _row(own, shape.name, "NodeKind", message, severity, path, F.col("value"))

    def has_value(self, shape: Shape, path: str, value: str, severity: str = "Warning", message: str = "the value is missing") -> DataFrame:
        have = self.t.where((F.col("p") == path) & (F.col("o") == value)).select(F.col("s").alias("focus_node"))
        return _row(self.targets(shape).join(have, "focus_node", "left_anti"), shape.name, "HasValue", message, severity, path)

    def has_class(self, shape: Shape, path: str, cls: str, severity: str = "Violation", message: str = "the value is of another class") -> DataFrame:
        typed = self.t.where((F.col("p") == self.type) & (F.col("o") == cls)).select(F.col("s").alias("value"))
        own = self.values(path).join(self.targets(shape), "focus_node", "left_semi").join(typed, "value", "left_anti")
        return _row(own, shape.name, "Class", message, severity, path, F.col("value"))

    def irreflexive(self, name: str, *paths: str, message: str = "it stands above itself") -> DataFrame:
        own = self.t.where(F.col("p").isin(*paths) & (F.col("s") == F.col("o"))).select(F.col("s").alias("focus_node"), "p").distinct()
        return _row(own, name, "SPARQL", message, "Violation").withColumn("value", F.col("focus_node"))

    def asymmetric(self, name: str, *paths: str, message: str = "both stand above each other") -> DataFrame:
        one = self.t.where(F.col("p").isin(*paths) & (F.col("s") != F.col("o"))).select("s", "o").distinct()
        back = one.select(F.col("o").alias("s"), F.col("s").alias("o"))
        both = one.join(back, ["s", "o"], "left_semi").select(F.col("s").alias("focus_node"), F.col("o").alias("value"))
        return _row(both, name, "SPARQL", message, "Violation", None, F.col("value"))

    def contradiction(self, name: str, path: str, inverse: str, message: str = "stated in both directions") -> DataFrame:
        """x path y together with x inverse y."""
        one = self.t.where(F.col("p") == path).select("s", "o").distinct()
        other = self.t.where(F.col("p") == inverse).select("s", "o").distinct()
        both = one.join(other, ["s", "o"], "left_semi").select(F.col("s").alias("focus_node"), F.col("o").alias("value"))
        return _row(both, name, "SPARQL", message, "Violation", path, F.col("value"))

    def differing(self, name: str, edge: str, attribute: str, severity: str = "Warning", message: str = "the ends differ") -> DataFrame:
        """Edges whose ends have different values of an attribute."""
        a = self.values(attribute).select(F.col("focus_node").alias("s"), F.col("value").alias("x"))
        b = self.values(attribute).select(F.col("focus_node").alias("o"), F.col("value").alias("y"))
        rows = self.t.where(F.col("p") == edge).select("s", "o").distinct().join(a, "s").join(b, "o").where("x <> y")
        rows = rows.select(F.col("s").alias("focus_node"), F.col("o").alias("value")).distinct()
        return _row(rows, name, "SPARQL", message, severity, edge, F.col("value"))

    def no_target_prefix(self, name: str, paths: list[str], prefix: str, message: str = "a resource of another dataset") -> DataFrame:
        rows = self.t.where(F.col("p").isin(*paths) & F.col("o").startswith(prefix)).select(F.col("s").alias("focus_node"), F.col("o").alias("value"), "p").distinct()
        return _row(rows, name, "SPARQL", message, "Violation", None, F.col("value"))


def union(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).select(*COLUMNS)


def validate_node(violations: DataFrame, node: str) -> DataFrame:
    return violations.where(F.col("focus_node") == node)


def by_shape(violations: DataFrame, severity: str | None = None) -> DataFrame:
    rows = violations if severity is None else violations.where(F.col("severity") == severity)
    return rows.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


def by_severity(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def baseline_exceeded(violations: DataFrame, baseline: dict[str, int]) -> DataFrame:
    """(shape, n, accepted) of shapes with more violations than accepted; warnings don't count."""
    counts = by_shape(violations, "Violation")
    rows = [(k, int(v)) for k, v in baseline.items()]
    known = violations.sparkSession.createDataFrame(rows, "shape string, accepted long")
    out = counts.join(known, "shape", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0).cast("long")))
    return out.where("n > accepted").select("shape", "n", "accepted")


class ValidationFailed(ValueError):
    pass


def validate_export(violations: DataFrame, baseline: dict[str, int]) -> None:
    """Raises where a shape has more violations than its baseline."""
    over = baseline_exceeded(violations, baseline).orderBy("shape").collect()
    if over:
        raise ValidationFailed("; ".join(f"{r['shape']}: {r['n']} > {r['accepted']}" for r in over))


def pos_disagreement(triples: DataFrame, hypernym: str, lexicalized: str, sense: str, pos: str, namespace: str) -> DataFrame:
    """(focus_node, value): concepts and those above them in a namespace that words of different parts of speech stand for.

    A concept has the parts of speech of the words of its senses, found once for both ends.
    """
    edges = triples.where((F.col("p") == hypernym) & F.col("o").startswith(f"<{namespace}")).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    of = lambda p, s, o: triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    kinds = of(lexicalized, "node", "sense").join(of(sense, "word", "sense"), "sense").join(of(pos, "word", "pos"), "word").select("node", "pos").distinct()
    sets = kinds.groupBy("node").agg(F.collect_set("pos").alias("kinds"))  # a handful of parts of speech
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("kinds").alias("ka")), "a").join(sets.select(F.col("node").alias("b"), F.col("kinds").alias("kb")), "b")
    same = (F.size("ka") == 1) & (F.size("kb") == 1) & (F.col("ka")[0] == F.col("kb")[0])
    return both.where(~same).select(F.col("a").alias("focus_node"), F.col("b").alias("value"))
