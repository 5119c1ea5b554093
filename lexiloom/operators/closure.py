"""Reachability, shortest distances, depths and descendant counts over edge frames.

Graphs of at most ``FEW_EDGES`` edges are walked inside executor tasks: every task
gets all edges and a share of the seeds (or of the descendants to count). Larger
ones are first cut down to what the seeds lead to. What is on no cycle and leads to none
is then settled level by level: a node's targets and their distances come from the lists
of the nodes it points to, so every list is sent once along each edge that leads to it, and
nothing that is found is read again. The rest goes by semi-naive rounds of joins.
Nothing of a graph passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.shipping import ship_package
from lexiloom.functions.tables import write_table

#: Edges up to which each of ``TASKS`` tasks holds the whole graph: about 100 bytes an edge.
FEW_EDGES, TASKS = 500_000, 8
#: Nodes of a cyclic component in which simple paths are searched (over all subsets); larger ones are an error.
CYCLE = 14
#: Entries of a list that is one row; what a node leads to is split by name where it may be more.
LIST_ROW = 200_000


class Graph:
    """Numbered nodes and the targets of each, without repeated edges."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.out: list[list[int]] = []

    def node(self, name: str) -> int:
        i = self.number.setdefault(name, len(self.names))
        if i == len(self.names):
            self.names.append(name)
            self.out.append([])
        return i

    def add(self, src: str, dst: str) -> None:
        self.out[self.node(src)].append(self.node(dst))

    def components(self) -> list[list[int]]:
        """Strongly connected components, those that others lead to first (Tarjan's order, without recursion)."""
        order, low, found, on = [-1] * len(self.out), [0] * len(self.out), [], [False] * len(self.out)
        stack: list[int] = []
        met = 0
        for root in range(len(self.out)):
            if order[root] >= 0:
                continue
            work = [(root, iter(self.out[root]))]
            order[root] = low[root] = met
            met += 1
            stack.append(root)
            on[root] = True
            while work:
                n, targets = work[-1]
                for m in targets:
                    if order[m] < 0:
                        order[m] = low[m] = met
                        met += 1
                        stack.append(m)
                        on[m] = True
                        work.append((m, iter(self.out[m])))
                        break
                    if on[m]:
                        low[n] = min(low[n], order[m])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[n])
                    if low[n] == order[n]:
                        own = []
                        while True:
                            m = stack.pop()
                            on[m] = False
                            own.append(m)
                            if m == n:
                                break
                        found.append(own)
        return found

    def distances(self, seed: str) -> Iterator[tuple[str, int]]:
        """Every node that the seed reaches with its distance, itself at 0, in breadth-first order."""
        yield seed, 0
        level, dist = [self.number[seed]] if seed in self.number else [], 0
        seen = set(level)
        while level:
            dist += 1
            after = []
            for n in level:
                for m in self.out[n]:
                    if m not in seen:
                        seen.add(m)
                        after.append(m)
                        yield self.names[m], dist
            level = after

    def climbs(self, known: dict[str, int]) -> list[int]:
        """Edges on the longest simple path from each node; ``known`` has those of nodes whose own edges are left out."""
        most = [known.get(n, 0) for n in self.names]
        for own in self.components():
            if len(own) == 1:
                n = own[0]
                most[n] = max([most[n], *(1 + most[m] for m in self.out[n] if m != n)])
                continue
            if len(own) > CYCLE:
                raise ValueError(f"a cyclic component of {len(own)} nodes, e.g. {self.names[own[0]]}")
            place = {n: k for k, n in enumerate(own)}
            leave = [max([most[n], *(1 + most[m] for m in self.out[n] if m not in place)]) for n in own]
            inner = [[place[m] for m in self.out[n] if m in place and m != n] for n in own]
            # best[nodes allowed][start]: a component's longest way out
            best = [[0] * len(own) for _ in range(1 << len(own))]
            for allowed in range(1, 1 << len(own)):
                for k in range(len(own)):
                    if allowed >> k & 1:
                        left = allowed & ~(1 << k)
                        best[allowed][k] = max([leave[k], *(1 + best[left][j] for j in inner[k] if left >> j & 1)])
            for n, k in place.items():
                most[n] = best[-1][k]
        return most

    def reach_counts(self, share: int, shares: int, block: int, group: Callable[[str], str] | None) -> Iterator[tuple[str, int]]:
        """(node, n) a block: how many other nodes of a block it reaches, of its own group where groups are told.

        Nodes by name are dealt into blocks, and blocks to shares; a node's set is a number of as many bits as the block has nodes.
        """
        order = sorted(range(len(self.names)), key=self.names.__getitem__)
        components = self.components()
        kinds = [group(n) for n in self.names] if group else []
        for first in range(share * block, len(order), shares * block):
            bit = {n: 1 << k for k, n in enumerate(order[first : first + block])}
            masks: dict[str, int] = {}
            for n, b in bit.items() if group else ():
                masks[kinds[n]] = masks.get(kinds[n], 0) | b
            sets = [0] * len(self.out)
            for own in components:
                union = 0
                for n in own:
                    union |= bit.get(n, 0)
                    for m in self.out[n]:
                        union |= sets[m]
                for n in own:
                    sets[n] = union
            for n, seen in enumerate(sets):
                seen &= ~bit.get(n, 0)
                if group:
                    seen &= masks.get(kinds[n], 0)
                if seen:
                    yield self.names[n], seen.bit_count()


def in_tasks(edges: DataFrame, work: Callable[[Graph, int, Iterator[tuple[str, int]]], Iterator[tuple]], schema: str, seeds: DataFrame | None = None, tasks: int = TASKS) -> DataFrame:
    """Run ``work`` on the whole graph in each of ``tasks`` tasks; each gets its number and its share of ``seeds`` (node, value)."""
    ship_package(edges.sparkSession)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    rows = edges.select(everywhere.alias("task"), F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("v"))
    asked = edges.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("v"))
    if seeds is not None:
        value = F.col("value").cast("int") if "value" in seeds.columns else F.lit(0)
        own = seeds.select(F.pmod(F.xxhash64("node"), F.lit(tasks)).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), value.alias("v"))
        asked = asked.unionByName(own)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=names)

        def sections() -> Iterator[tuple[int, int, str, str, int]]:
            for batch in batches:
                yield from batch[["task", "kind", "a", "b", "v"]].itertuples(index=False, name=None)

        rest, graph = sections(), Graph()
        pending = next(rest, None)
        while pending is not None:
            task, graph = pending[0], Graph()
            while pending is not None and pending[0] == task and pending[1] == 0:
                graph.add(pending[2], pending[3])
                pending = next(rest, None)

            def own() -> Iterator[tuple[str, int]]:
                nonlocal pending
                while pending is not None and pending[0] == task:
                    if pending[1] == 1:
                        yield pending[2], pending[4]
                    pending = next(rest, None)

            share, out = own(), []
            for row in work(graph, task, share):
                out.append(row)
                if len(out) >= 50_000:
                    yield told(out)
                    out = []
            for _ in share:  # what the work has left
                pass
            if out:
                yield told(out)

    dealt = rows.unionByName(asked).repartition(tasks, "task").sortWithinPartitions("task", "kind")
    return dealt.mapInPandas(run, schema)


def _clean(edges: DataFrame) -> DataFrame:
    return write_table(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")


def _walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(node, ancestor, dist)`` from each seed; dist of the seed itself is 0."""

    def work(graph: Graph, task: int, share: Iterator) -> Iterator[tuple]:
        for seed, _ in share:
            for ancestor, dist in graph.distances(seed):
                yield seed, ancestor, dist

    return in_tasks(edges, work, "node string, ancestor string, dist int", seeds)


def _ahead(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that start at a seed or at a node that one leads to."""
    frontier = write_table(seeds.select(F.col("node").alias("src")).distinct(), "ahead")
    met = frontier
    while not frontier.isEmpty():
        step = edges.join(frontier, "src", "left_semi").select(F.col("dst").alias("src")).distinct()
        frontier = write_table(step.join(met, "src", "left_anti"), "ahead")
        met = met.unionByName(frontier)
    return write_table(edges.join(met, "src", "left_semi"), "edges")


def _levels(edges: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(node, level) of the sources that lead to no cycle, levels counted from the nodes without edges, and the other edges."""
    known = write_table(edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "known")
    parts, left = [], edges
    for level in range(1, max_rounds):
        # an edge goes when its target is settled; a source without edges left is settled next
        rest = write_table(left.join(known, left["dst"] == known["node"], "left_anti"), "edges")
        ready = left.select(F.col("src").alias("node")).distinct().join(rest.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        known = write_table(ready, "known")
        left = rest
        if known.isEmpty():
            break
        parts.append(known.withColumn("level", F.lit(level)))
    levels = edges.select(F.col("src").alias("node"), F.lit(0).alias("level")).limit(0)
    for part in parts:
        levels = levels.unionByName(part)
    return levels, edges.join(left.select("src").distinct(), "src", "left_semi")


def _lists(edges: DataFrame, max_rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """(node, met) of the sources that lead to no cycle, ``met`` the other nodes each leads to as sorted (ancestor, dist), and the sources (src) that are left.

    A node that leads to very many others has several rows, which share no ancestor.
    """
    levels, rest = _levels(edges, max_rounds)
    levels = write_table(levels, "levels")
    last = levels.agg(F.max("level")).first()[0] or 0
    # the edges of each level, and what its nodes are handed by the levels below
    own = edges.join(levels.withColumnRenamed("node", "src"), "src")
    above = levels.select(F.col("node").alias("dst"), F.lit(True).alias("inner"))
    own = write_table(own.join(above, "dst", "left"), "edges")
    handed: list[DataFrame] = []
    lists: list[DataFrame] = []
    one = F.array(F.struct(F.col("dst").alias("ancestor"), F.lit(1).alias("dist")))
    for level in range(1, last + 1):
        direct = own.where(F.col("level") == level).select(F.col("src").alias("node"), one.alias("met"), F.lit(1).alias("n"))
        got = direct
        for part in handed:
            got = got.unionByName(part.where(F.col("level") == level).select("node", "met", "n"))
        most = got.groupBy("node").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        split = -(-most // LIST_ROW)
        got = got.select("node", F.lit(0).alias("share"), "met")
        if split > 1:
            got = got.select("node", F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("share"), "met")
            got = got.select("node", "share", F.filter("met", lambda x: F.pmod(F.xxhash64(x["ancestor"]), F.lit(split)) == F.col("share")).alias("met")).where("size(met) > 0")
        merged = got.groupBy("node", "share").agg(F.flatten(F.collect_list("met")).alias("met"))
        # sorted by node and distance, the first of each node is its nearest
        ordered = merged.select("node", F.array_sort("met").alias("met"))
        first = F.filter("met", lambda x, i: (i == 0) | (x["ancestor"] != F.get("met", i - 1)["ancestor"]))
        done = write_table(ordered.select("node", first.alias("met")), "lists")
        lists.append(done)
        ways = own.where("inner").select("dst", F.col("src").alias("up"), F.col("level"))
        further = F.transform("met", lambda x: F.struct(x["ancestor"].alias("ancestor"), (x["dist"] + 1).alias("dist")))
        if level < last:
            handed.append(write_table(done.join(ways, done["node"] == ways["dst"]).select(F.col("up").alias("node"), further.alias("met"), F.size("met").alias("n"), "level"), "handed", compression="zstd"))
    out = None
    for part in lists:
        out = part if out is None else out.unionByName(part)
    return out, rest.select("src").distinct()


def distances(edges: DataFrame, seeds: DataFrame | None = None, max_rounds: int = 10_000, few: int = FEW_EDGES) -> DataFrame:
    """``(node, ancestor, dist)``: shortest number of edges (src, dst) from each seed, itself included at 0.

    Up to ``few`` edges, of those that the seeds lead to, are walked in tasks. With more, lists of what
    leads to no cycle are made level by level; the others go by rounds in which only newly found pairs are
    joined and known ones leave by an anti join, so cycles end; each round is written, which cuts the lineage. Without ``seeds`` every source is one.
    """
    edges = _clean(edges)
    start = edges.select(F.col("src").alias("node")).distinct() if seeds is None else seeds.select("node").where("node is not null").distinct()
    if edges.count() <= few:
        return write_table(_walk(edges, start), "distances")
    if seeds is not None:
        start = write_table(start, "seeds")
        edges = _ahead(edges, start)
        if edges.count() <= few:
            return write_table(_walk(edges, start), "distances")
    lists, left = _lists(edges, max_rounds)
    left = write_table(left, "left")
    pairs = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist"))
    if lists is not None:
        own = lists if seeds is None else lists.join(start, "node", "left_semi")
        pairs = pairs.unionByName(own.select("node", F.inline("met")))
    if left.isEmpty():
        return pairs
    first = start.join(left.select(F.col("src").alias("node")), "node", "left_semi")
    frontier = write_table(first.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")), "frontier")
    seen = frontier
    for dist in range(1, max_rounds):
        step = frontier.join(edges, frontier["ancestor"] == edges["src"]).select("node", F.col("dst").alias("ancestor"), F.lit(dist).alias("dist")).distinct()
        frontier = write_table(step.join(seen, ["node", "ancestor"], "left_anti").select("node", "ancestor", "dist"), "frontier")
        if frontier.isEmpty():
            return pairs.unionByName(seen.where("dist > 0"))
        seen = seen.unionByName(frontier)
    raise RuntimeError("closure did not end")


def reachable(edges: DataFrame, seeds: DataFrame | None = None, few: int = FEW_EDGES) -> DataFrame:
    """Distinct ``(src, dst)`` pairs joined by one or more edges; a node on a cycle reaches itself."""
    edges = _clean(edges)
    n = edges.count()
    if n > few and seeds is not None:
        edges = _ahead(edges, seeds.select("node").where("node is not null"))
        n = edges.count()
    first = edges if seeds is None else edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    if n <= few:

        def work(graph: Graph, task: int, share: Iterator) -> Iterator[tuple]:
            for seed, _ in share:
                back = False
                for other, dist in graph.distances(seed):
                    back = back or graph.number[seed] in graph.out[graph.number[other]]
                    if dist:
                        yield seed, other
                if back:
                    yield seed, seed

        return write_table(in_tasks(edges, work, "src string, dst string", first.select(F.col("src").alias("node")).distinct()), "reachable")
    lists, left = _lists(edges, 10_000)
    left = write_table(left, "left")
    pairs = None
    if lists is not None:
        own = lists if seeds is None else lists.join(seeds.select("node").distinct(), "node", "left_semi")
        pairs = own.select(F.col("node").alias("src"), F.inline("met")).select("src", F.col("ancestor").alias("dst"))
        if left.isEmpty():
            return pairs
    frontier = write_table(first.join(left, "src", "left_semi"), "frontier")
    seen = frontier if pairs is None else pairs.unionByName(frontier)
    known = frontier
    hop = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        step = frontier.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = write_table(step.join(known, ["src", "dst"], "left_anti").select("src", "dst"), "frontier")
        if frontier.isEmpty():
            return seen
        known = known.unionByName(frontier)
        seen = seen.unionByName(frontier)


def _climbs_in_a_task(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, climb) of the sources of ``edges``, in one task; ``known`` (node, value) are climbs that are settled."""

    def work(graph: Graph, task: int, share: Iterator) -> Iterator[tuple]:
        settled = dict(share)
        most = graph.climbs(settled)
        for n, name in enumerate(graph.names):
            if graph.out[n]:
                yield name, most[n]

    return in_tasks(edges, work, "node string, climb int", known, tasks=1)


def longest_depths(edges: DataFrame, max_rounds: int = 10_000, few: int = FEW_EDGES) -> DataFrame:
    """``(node, depth)``: edges on the longest climb from each source; the first step may come back to the source, the rest is a simple path.

    Up to ``few`` edges are ordered in one task. With more, nodes are settled level by
    level from those without edges. What is on a cycle, or between two, is cut out by taking
    away nodes that nothing leads to, and is settled in one task, under ``FEW_EDGES``;
    then the levels go on. A cyclic component of over ``CYCLE`` nodes is an error.
    """
    edges = _clean(edges)
    if edges.count() <= few:

        def work(graph: Graph, task: int, share: Iterator) -> Iterator[tuple]:
            most = graph.climbs({})
            for n, name in enumerate(graph.names):
                if graph.out[n]:
                    yield name, 1 + max(most[m] for m in graph.out[n])

        return write_table(in_tasks(edges, work, "node string, depth int", tasks=1), "depths")
    levels, left = _levels(edges, max_rounds)
    left = write_table(left, "edges")
    if left.isEmpty():
        return levels.select("node", F.col("level").alias("depth"))
    known = edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    known = write_table(known.withColumn("climb", F.lit(0)).unionByName(levels.withColumnRenamed("level", "climb")), "climbs")
    for _ in range(max_rounds):
        step = left.join(known, left["dst"] == known["node"], "left")
        ready = step.groupBy("src").agg(F.max("climb").alias("deepest"), F.count(F.when(F.col("node").isNull(), 1)).alias("unknown"))
        ready = write_table(ready.where("unknown = 0").select(F.col("src").alias("node"), (F.col("deepest") + 1).alias("climb")), "climbs")
        if ready.isEmpty():
            if left.isEmpty():
                break
            ready = _settled_cycles(left, known, max_rounds)
        known = known.unionByName(ready)
        left = write_table(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
    deepest = edges.join(known, edges["dst"] == known["node"]).groupBy("src").agg((F.max("climb") + 1).alias("depth"))
    return deepest.select(F.col("src").alias("node"), "depth")


def _settled_cycles(left: DataFrame, known: DataFrame, max_rounds: int) -> DataFrame:
    """Climbs of the nodes of ``left`` that are on a cycle, or lead from one to another."""
    core = left
    for _ in range(max_rounds):
        inner = write_table(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "core")
        if inner.count() == core.count():
            break
        core = inner
    n = core.count()
    if n > FEW_EDGES:
        raise RuntimeError(f"{n} edges are on cycles or between them")
    settled = known.join(core.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("node", F.col("climb").alias("value"))
    return write_table(_climbs_in_a_task(core, settled), "climbs")


def reach_counts(edges: DataFrame, group: str | None = None, few: int = FEW_EDGES, block: int = 4096) -> DataFrame:
    """``(node, n)``: how many other nodes each node reaches, where any; with ``group``, a pattern, only those for whose name it matches the same text.

    Up to ``few`` edges no pair is written: strongly connected nodes are one, each
    task counts a share of the nodes as bits, ``block`` at a time, in the order of
    the components, and the counts of the blocks are added up. With more, the pairs are counted by
    their first node, made from the other end: in a taxonomy a node stands below few, but above very many.
    """
    edges = _clean(edges)
    if edges.count() > few:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = reachable(back, few=few).where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if group is not None:
            pairs = pairs.where(F.regexp_extract("src", group, 0) == F.regexp_extract("dst", group, 0))
        return pairs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    pattern = None if group is None else re.compile(group)

    def work(graph: Graph, task: int, share: Iterator) -> Iterator[tuple]:
        kind = None if pattern is None else lambda name: m[0] if (m := pattern.search(name)) else ""
        yield from graph.reach_counts(task, TASKS, block, kind)

    return in_tasks(edges, work, "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
