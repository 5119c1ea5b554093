"""Taxonomy graphs, depths, distances and the similarity measures over them.

Edges are frames (src, dst) from the narrower to the broader node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import labels as L
from lexiloom.functions import terms as T
from lexiloom.functions.tables import write_table
from lexiloom.operators.closure import distances, longest_depths, reach_counts


def edges_of(triples: DataFrame, *predicates: str) -> DataFrame:
    return triples.where(F.col("p").isin(*predicates)).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def hypernym_graph(triples: DataFrame, hypernym: str, orthogonal: str) -> DataFrame:
    """(src, dst, orthogonal): asserted hypernyms; nodes without one fall back to orthogonal hypernyms and are flagged."""
    asserted = edges_of(triples, hypernym).distinct()
    other = edges_of(triples, orthogonal).distinct().join(asserted.select("src"), "src", "left_anti")
    return asserted.withColumn("orthogonal", F.lit(False)).unionByName(other.withColumn("orthogonal", F.lit(True)))


def hyponym_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def meronym_graph(triples: DataFrame, has_part: list[str], part_of: list[str]) -> DataFrame:
    """(whole, part) of part relations stated in either direction, as a set."""
    down = edges_of(triples, *has_part).select(F.col("src").alias("whole"), F.col("dst").alias("part"))
    up = edges_of(triples, *part_of).select(F.col("dst").alias("whole"), F.col("src").alias("part"))
    return down.unionByName(up).distinct()


def node_depths(edges: DataFrame) -> DataFrame:
    """(node, depth) of every node below a root; roots count as 0 where they are looked up."""
    return longest_depths(edges)


def taxonomy_depths(depths: DataFrame, groups: DataFrame) -> DataFrame:
    """Largest depth by group; ``groups`` is (node, grp), nodes without one are in group ``?``."""
    return depths.join(groups, "node", "left").groupBy(F.coalesce("grp", F.lit("?")).alias("grp")).agg(F.max("depth").alias("max_depth"))


def ancestor_distances(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    return distances(edges, seeds)


def common_ancestors(pairs: DataFrame, dist: DataFrame) -> DataFrame:
    """(a, b, ancestor, da, db) for the asked pairs (a, b)."""
    left = dist.select(F.col("node").alias("a"), "ancestor", F.col("dist").alias("da"))
    right = dist.select(F.col("node").alias("b"), "ancestor", F.col("dist").alias("db"))
    return pairs.join(left, "a").join(right, ["b", "ancestor"]).select("a", "b", "ancestor", "da", "db")


def lowest_common_subsumers(common: DataFrame) -> DataFrame:
    """All common ancestors of least combined distance of each pair."""
    w = Window.partitionBy("a", "b").orderBy(F.col("da") + F.col("db"))
    return common.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def similarity(pairs: DataFrame, dist: DataFrame, depths: DataFrame, max_depth: DataFrame | int) -> DataFrame:
    """``a, b, path, lch, wup, lcs`` of each pair.

    path is 1 / (length + 1), 0 for pairs without a common ancestor, whose lch and
    wup are null. lch is -ln((length + 1) / (2 d)) with the depth d of the first
    node's taxonomy. wup is 2k / (i + j + 2k) with k one above the depth of the
    lowest common subsumer; of several the deepest counts, then the first by name.
    """
    low = lowest_common_subsumers(common_ancestors(pairs, dist))
    low = low.join(depths.select(F.col("node").alias("ancestor"), "depth"), "ancestor", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    best = low.groupBy("a", "b").agg(F.min(F.struct((-F.col("depth")).alias("deep"), "ancestor", "da", "db")).alias("x"))
    best = best.select("a", "b", F.col("x.ancestor").alias("lcs"), (F.col("x.da") + F.col("x.db")).alias("n"), (1 - F.col("x.deep")).alias("k"))
    out = pairs.join(best, ["a", "b"], "left")
    if isinstance(max_depth, int):
        out = out.withColumn("d", F.lit(max_depth))
    else:
        out = out.join(max_depth.select(F.col("node").alias("a"), F.col("max_depth").alias("d")), "a", "left")
    k = F.col("k").cast("double")
    return out.select(
        "a",
        "b",
        F.coalesce(1.0 / (F.col("n") + 1), F.lit(0.0)).alias("path"),
        (-F.ln((F.col("n") + 1) / (2.0 * F.col("d")))).alias("lch"),
        (2 * k / (F.col("n") + 2 * k)).alias("wup"),
        "lcs",
    )


def indegree(triples: DataFrame, type_predicate: str, concept: str) -> DataFrame:
    """(node, indegree): triples of any predicate from a concept into a concept."""
    concepts = triples.where((F.col("p") == type_predicate) & (F.col("o") == concept)).select(F.col("s").alias("c")).distinct()
    inner = triples.join(concepts, triples["s"] == concepts["c"], "left_semi")
    counted = inner.groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))
    return counted.join(concepts.withColumnRenamed("c", "node"), "node", "left_semi")  # a row for each object: a class that most statements name is one


def weighted_relations(triples: DataFrame, degrees: DataFrame) -> DataFrame:
    """(s, p, o, pos): values of each relation by indegree, highest first, then by name."""
    ranked = triples.join(degrees.withColumnRenamed("node", "o"), "o", "left").withColumn("indegree", F.coalesce("indegree", F.lit(0)))
    w = Window.partitionBy("s", "p").orderBy(F.desc("indegree"), "o")
    return ranked.withColumn("pos", F.row_number().over(w)).select("s", "p", "o", "indegree", "pos")


#: The namespace of a term: up to the last separator of its IRI.
NAMESPACE = "^<.*[/#]"


def descendant_counts(edges: DataFrame, namespace: str | None = NAMESPACE) -> DataFrame:
    """(node, n): distinct descendants other than the node itself, of its own namespace; cycles count once."""
    return reach_counts(hyponym_graph(edges), namespace)


def borda_children(edges: DataFrame, counts: DataFrame, degrees: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """(parent, child, pos): children by the sum of two ranks, descendant count (then indegree) and indegree.

    Ties of the sum go by name. With ``flags`` (src, orthogonal) children that are
    attached by orthogonal hypernymy alone come after the others.
    """
    rows = edges.select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct()
    rows = rows.join(counts.withColumnRenamed("node", "child"), "child", "left").join(degrees.withColumnRenamed("node", "child"), "child", "left")
    rows = rows.fillna({"n": 0, "indegree": 0})
    if flags is not None:
        rows = rows.join(flags.select(F.col("src").alias("child"), "orthogonal").distinct(), "child", "left").fillna({"orthogonal": False})
    else:
        rows = rows.withColumn("orthogonal", F.lit(False))
    by = lambda *keys: F.row_number().over(Window.partitionBy("parent").orderBy(*keys))
    rows = rows.withColumn("score", by(F.desc("n"), F.desc("indegree"), "child") + by(F.desc("indegree"), "child"))
    return rows.withColumn("pos", by("orthogonal", "score", "child")).select("parent", "child", "n", "indegree", "pos")


def subtree_levels(children: DataFrame, root: str, max_depth: int = 5, max_children: int = 12) -> DataFrame:
    """(node, parent, level) of the tree below a root with at most ``max_children`` ranked children a node; cycles end."""
    spark = children.sparkSession
    top = write_table(children.where(F.col("pos") <= max_children).select("parent", "child"), "children")
    level = spark.createDataFrame([(root, None, 0)], "node string, parent string, level int")
    seen = level
    for depth in range(1, max_depth + 1):
        step = top.join(level.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), "parent", F.lit(depth).alias("level"))
        first = step.groupBy("node").agg(F.min("parent").alias("parent"), F.min("level").alias("level"))
        level = write_table(first.join(seen.select("node"), "node", "left_anti").select("node", "parent", "level"), "level")
        seen = seen.unionByName(level)
    return seen


def bounded_tree(children: DataFrame, root: str, max_depth: int = 5, max_children: int = 12, max_nodes: int = 250) -> DataFrame:
    """(path, node, level) of the tree below a root with a soft budget of nodes, taken depth first; ``children`` is (parent, child, pos).

    ``path`` holds the places of a node and of those above it, so texts in order are
    the tree depth first. Of each node at most ``max_children`` children by ``pos`` are taken, none that stands above it.
    A node that is reached when ``max_nodes`` are there already has no children, but the siblings
    of one that was taken still count: exactly the children of the first ``max_nodes`` - 1 nodes are there.
    """
    spark = children.sparkSession
    kids = write_table(children.select("parent", "child", "pos").where("parent is not null and child is not null"), "children")
    level = spark.createDataFrame([("", root, [root])], "path string, node string, above array<string>")
    tree, first = level.select("path", "node", F.lit(0).alias("level")), level.select("path")
    width = len(str(max_children - 1))
    for depth in range(1, max_depth + 1):
        step = level.join(kids, level["node"] == kids["parent"]).where(~F.array_contains("above", F.col("child")))
        place = F.row_number().over(Window.partitionBy("path").orderBy("pos", "child"))
        step = step.withColumn("k", place).where(F.col("k") <= max_children)
        step = step.select(F.concat("path", F.lit("."), F.lpad((F.col("k") - 1).cast("string"), width, "0")).alias("path"), F.col("child").alias("node"), F.concat("above", F.array("child")).alias("above"))
        # a node counts only if its parent is among the first in order, and what comes after those can't come before them
        level = write_table(step, "level")
        tree = tree.unionByName(level.select("path", "node", F.lit(depth).alias("level")))
        first = write_table(tree.select("path").orderBy("path").limit(max_nodes - 1), "first")
        level = level.join(F.broadcast(first), "path", "left_semi")  # fewer than ``max_nodes`` rows
    above = F.regexp_extract("path", r"^(.*)\.[0-9]+$", 1)
    below = tree.where("path <> ''").withColumn("_up", above).join(F.broadcast(first.withColumnRenamed("path", "_up")), "_up", "left_semi").drop("_up")
    return tree.where("path = ''").unionByName(below)


def labelled_tree(tree: DataFrame, labels: DataFrame, flags: DataFrame) -> DataFrame:
    """(path, node, level, name, orthogonal) of a tree: the first lemma of each node's label, or its local name; ``flags`` is (node, orthogonal)."""
    named = labels.groupBy("node").agg(F.min("label").alias("label"))
    marked = flags.groupBy("node").agg(F.min("orthogonal").alias("orthogonal"))
    out = tree.join(named, "node", "left").join(marked, "node", "left")
    name = F.coalesce(F.when(L.tree_name(T.lex(F.col("label"))) != "", L.tree_name(T.lex(F.col("label")))), T.guessed_local(F.col("node")))
    return out.select("path", "node", "level", name.alias("name"), F.coalesce("orthogonal", F.lit(False)).alias("orthogonal"))


def similarity_functions(namespace: str, dist: DataFrame, depths: DataFrame, max_depth: DataFrame | int) -> dict:
    """Scalar functions ``path``, ``lch`` and ``wup`` of two nodes for queries; a null argument or result is unbound.

    Each is a join: the distinct argument pairs of a solution are scored once.
    """

    def make(measure: str):
        def call(df: DataFrame, columns: list, name: str) -> DataFrame:
            asked = df.withColumn("_a", columns[0]).withColumn("_b", columns[1])
            pairs = asked.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a is not null and b is not null").distinct()
            scored = similarity(pairs, dist, depths, max_depth).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col(measure).alias(name))
            return asked.join(scored, ["_a", "_b"], "left").drop("_a", "_b")

        return call

    return {f"<{namespace}{m}>": make(m) for m in ("path", "lch", "wup")}
