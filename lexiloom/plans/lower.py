"""Lowers the algebra to DataFrames.

A solution is a DataFrame with one column per variable, unbound as null. For each
variable it is known whether it is always bound: joins on always-bound variables
are plain equi-joins, and only others get the compatibility rule, split into a
bound and an unbound branch so that Spark never falls back to a nested loop.
Variables hold term strings; computed numbers, strings and booleans stay native
until they meet terms.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import terms as T
from lexiloom.functions.tables import write_table
from lexiloom.operators.closure import reachable
from lexiloom.plans import algebra as A


@dataclass
class Solution:
    df: DataFrame
    bound: set[str]  # variables that are never null
    kinds: dict[str, str]  # variable -> term, num, int, str, bool

    @property
    def vars(self) -> list[str]:
        return list(self.kinds)


class Lowering:
    """One query over one triples frame (s, p, o); ``quads`` (g, s, p, o) serves GRAPH; ``functions`` adds scalar functions.

    A custom function is called with (solution frame, argument columns, output
    name) and returns the frame with the output column added.
    """

    def __init__(self, triples: DataFrame, quads: DataFrame | None = None, functions: dict | None = None):
        self.t, self.quads, self.functions = triples, quads, functions or {}
        self.graph: A.Var | None = None  # of a GRAPH with a variable
        self.spark = triples.sparkSession
        self.n = 0

    def fresh(self) -> str:
        self.n += 1
        return f"_x{self.n}"

    # results
    def run(self, q: A.Query) -> DataFrame:
        if q.dataset:
            return self.of_dataset(q.dataset).run(replace(q, dataset=()))
        if q.kind == "select":
            sol = self.eval(q.body)
            return sol.df.select(*[v for v in sol.vars if not v.startswith("_")])
        if q.kind == "ask":
            found = self.eval(q.body).df.limit(1).agg(F.count(F.lit(1)).alias("n"))
            return found.select((F.col("n") > 0).alias("answer"))
        if q.kind == "construct":
            sol = self.eval(q.body)
            parts = [sol.df.select(*[self.as_term(sol, x).alias(n) for n, x in (("s", t.s), ("p", t.p), ("o", t.o))]) for t in q.template]
            out = reduce(DataFrame.unionByName, parts)
            return out.where("s is not null and p is not null and o is not null").where(~F.col("s").startswith('"')).distinct()
        return self.describe(q)

    def of_dataset(self, dataset) -> Lowering:
        """The same source restricted to the graphs that FROM merges and FROM NAMED names."""
        if self.quads is None:
            raise ValueError("this source has no named graphs")
        merged, named = ([g for is_named, g in dataset if is_named == kind] for kind in (False, True))
        triples = self.quads.where(F.col("g").isin(*merged)).select("s", "p", "o").distinct()
        return Lowering(triples, self.quads.where(F.col("g").isin(*named)), self.functions)

    def describe(self, q: A.Query) -> DataFrame:
        """Statements about the resources and, through blank nodes, about what these stand for."""
        named = [t for t in q.targets if isinstance(t, str)]
        parts = [self.spark.createDataFrame([(t,) for t in named], "node string")] if named else []
        if q.body is not None:
            sol = self.eval(q.body)
            parts += [sol.df.select(F.col(t.name).alias("node")) for t in q.targets if isinstance(t, A.Var)]
        seeds = reduce(DataFrame.union, parts).where("node is not null").distinct()
        hops = self.t.where(F.col("o").startswith("_:")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        inner = reachable(hops, seeds).where(F.col("dst").startswith("_:")).select(F.col("dst").alias("node"))
        return self.t.join(seeds.union(inner).distinct().withColumnRenamed("node", "s"), "s", "left_semi").select("s", "p", "o").distinct()

    # patterns
    def eval(self, node) -> Solution:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(), set(), {})

    def on_bgp(self, node: A.BGP) -> Solution:
        if not node.triples:
            return self.unit()
        left, sol = list(node.triples), None
        while left:
            seen = set(sol.kinds) if sol else set()

            def rank(t: A.Triple, seen: set[str] = seen):
                parts = [x for x in (t.s, t.p, t.o) if isinstance(x, A.Var)]
                touches = any(v.name in seen for v in parts)
                fixed = (isinstance(t.s, str)) * 4 + (isinstance(t.o, str)) * 2 + (isinstance(t.p, str))
                return (bool(seen) and not touches, -fixed)  # connected patterns first, then the most bound

            best = min(left, key=rank)
            left.remove(best)
            own = self.pattern(best, sol)
            sol = own if sol is None else self.join(sol, own)
        return sol

    def pattern(self, t: A.Triple, sol: Solution | None) -> Solution:
        if isinstance(t.p, A.Path):
            if self.graph is not None:
                return self.bind(self.graph_path(t.p), {"g": self.graph, "s": t.s, "o": t.o})
            if t.p.op in ("plus", "star") and sol is not None:
                own = self.seeded(t, sol)
                if own is not None:
                    return own
            pairs = self.path(t.p, t.s if isinstance(t.s, str) else None, t.o if isinstance(t.o, str) else None)
            return self.bind(pairs, {"s": t.s, "o": t.o})
        if self.graph is not None:
            return self.bind(self.quads, {"g": self.graph, "s": t.s, "p": t.p, "o": t.o})
        return self.bind(self.t, {"s": t.s, "p": t.p, "o": t.o})

    def graph_path(self, p: A.Path) -> DataFrame:
        """(g, s, o) of a path inside each graph: the path over nodes that carry their graph's name in front, so that no step leaves it."""
        inside = lambda c: F.concat(F.col("g"), F.lit(" "), F.col(c)).alias(c)
        pairs = Lowering(self.quads.select(inside("s"), "p", inside("o")), functions=self.functions).path(p)
        bare = lambda c: F.substring(c, F.position(F.lit(" "), F.col(c)) + 1, F.length(c))
        return pairs.select(F.substring_index("s", " ", 1).alias("g"), bare("s").alias("s"), bare("o").alias("o"))

    def seeded(self, t: A.Triple, sol: Solution) -> Solution | None:
        """A closure from the values that an end has so far, where that end is a bound variable and the other one isn't fixed."""
        forward = isinstance(t.s, A.Var) and t.s.name in sol.bound and not isinstance(t.o, str)
        backward = isinstance(t.o, A.Var) and t.o.name in sol.bound and not isinstance(t.s, str)
        if not forward and not backward:
            return None
        end = t.s if forward else t.o
        values = self.terms_of(sol, [end.name])
        seeds = write_table(values.df.select(F.col(end.name).alias("node")).distinct(), "seeds")
        edges = self.path(t.p.args[0]).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        if not forward:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        pairs = reachable(edges, seeds)
        if t.p.op == "star":
            pairs = pairs.union(seeds.select("node", "node")).distinct()
        names = ("s", "o") if forward else ("o", "s")
        return self.bind(pairs.select(F.col("src").alias(names[0]), F.col("dst").alias(names[1])), {"s": t.s, "o": t.o})

    def bind(self, df: DataFrame, parts: dict) -> Solution:
        """Filter on constants and repeated variables, name the columns by the variables."""
        out: dict[str, str] = {}
        for column, x in parts.items():
            if isinstance(x, A.Var):
                if x.name in out:
                    df = df.where(F.col(out[x.name]) == F.col(column))
                else:
                    out[x.name] = column
            else:
                df = df.where(F.col(column) == F.lit(x))
        df = df.select(*[F.col(c).alias(v) for v, c in out.items()])
        return Solution(df, set(out), dict.fromkeys(out, "term"))

    def path(self, p, s: str | None = None, o: str | None = None) -> DataFrame:
        """(s, o) pairs of a path; closures start from a constant end where there is one."""
        if isinstance(p, str):
            return self.t.where(F.col("p") == p).select("s", "o")
        op, args = p.op, p.args
        if op == "iri":
            return self.path(args[0])
        if op == "inv":
            return self.path(args[0], o, s).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "not":
            forward, back = [a for a in args if isinstance(a, str)], [a.args[0] for a in args if not isinstance(a, str)]
            parts = [self.t.where(~F.col("p").isin(*forward)).select("s", "o")] if forward or not back else []
            if back:
                parts.append(self.t.where(~F.col("p").isin(*back)).select(F.col("o").alias("s"), F.col("s").alias("o")))
            return reduce(DataFrame.unionAll, parts)
        if op == "alt":
            if all(isinstance(a, str) or a.op == "iri" for a in args):
                return self.t.where(F.col("p").isin(*[a if isinstance(a, str) else a.args[0] for a in args])).select("s", "o")
            return reduce(DataFrame.unionAll, [self.path(a, s, o) for a in args])
        if op == "seq":
            out = self.path(args[0], s)
            for i, a in enumerate(args[1:]):
                last = i == len(args) - 2
                more = self.path(a, None, o if last else None).select(F.col("s").alias("_m"), F.col("o").alias("_o"))
                out = out.join(more, out["o"] == more["_m"]).select("s", F.col("_o").alias("o"))
            return out
        edges = self.path(args[0]).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        nodes = self.t.select(F.col("s").alias("n")).union(self.t.select("o")).distinct()
        if s is not None or o is not None:
            nodes = self.spark.createDataFrame([(s if s is not None else o,)], "n string")
        same = nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))
        if op == "opt":
            return same.union(edges.select("src", "dst")).distinct()
        if s is None and o is not None:  # from the object backwards
            back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.spark.createDataFrame([(o,)], "node string"))
            pairs = back.select(F.col("dst").alias("s"), F.col("src").alias("o"))
        else:
            seeds = self.spark.createDataFrame([(s,)], "node string") if s is not None else None
            pairs = reachable(edges, seeds).select(F.col("src").alias("s"), F.col("dst").alias("o"))
        return pairs if op == "plus" else pairs.union(same).distinct()

    def terms_of(self, sol: Solution, names) -> Solution:
        """The named variables as terms, so that they can be joined."""
        df, kinds = sol.df, dict(sol.kinds)
        for v in names:
            if kinds[v] != "term":
                df = df.withColumn(v, T.to_literal(F.col(v), kinds[v]))
                kinds[v] = "term"
        return Solution(df, sol.bound, kinds)

    def join(self, a: Solution, b: Solution, how: str = "inner", condition=None) -> Solution:
        shared = [v for v in a.vars if v in b.kinds]
        a, b = self.terms_of(a, shared), self.terms_of(b, shared)
        sure = [v for v in shared if v in a.bound and v in b.bound]
        maybe = [v for v in shared if v not in sure]
        if how == "inner" and maybe and not sure:
            v = maybe[0]
            if v not in a.bound and v not in b.bound:
                have, none = F.col(v).isNotNull(), F.col(v).isNull()
                parts = [
                    self.join(Solution(a.df.where(have), a.bound | {v}, a.kinds), Solution(b.df.where(have), b.bound | {v}, b.kinds)),
                    self.join(self.drop(Solution(a.df.where(none), a.bound, a.kinds), v), b),
                    self.join(Solution(a.df.where(have), a.bound | {v}, a.kinds), self.drop(Solution(b.df.where(none), b.bound, b.kinds), v)),
                ]
            else:
                open_, full = (a, b) if v in b.bound else (b, a)
                parts = [
                    self.join(Solution(open_.df.where(F.col(v).isNotNull()), open_.bound | {v}, open_.kinds), full),
                    self.join(self.drop(Solution(open_.df.where(F.col(v).isNull()), open_.bound, open_.kinds), v), full),
                ]
            return reduce(self.union, parts)
        if how == "left" and maybe:
            return self.left_join_unbound(a, b, condition)
        other = b.df.select(*[F.col(v).alias(f"_r_{v}" if v in shared else v) for v in b.vars])
        tests = [F.col(v) == F.col(f"_r_{v}") for v in sure]
        tests += [(F.col(v) == F.col(f"_r_{v}")) | F.col(v).isNull() | F.col(f"_r_{v}").isNull() for v in maybe]
        kinds = a.kinds | {v: k for v, k in b.kinds.items() if v not in a.kinds}
        if condition is not None:
            scope = Solution(a.df, set(), kinds)
            tests.append(self.truth(scope, condition))
        on = reduce(lambda x, y: x & y, tests) if tests else None
        if how == "left":
            joined = a.df.join(other, on if on is not None else F.lit(True), "left")
        else:
            joined = a.df.join(other, on, "inner") if on is not None else a.df.crossJoin(other)
        columns = [F.coalesce(v, f"_r_{v}").alias(v) if v in maybe else F.col(v) for v in a.vars]
        columns += [F.col(v) for v in b.vars if v not in shared]
        bound = a.bound | b.bound if how == "inner" else set(a.bound)
        return Solution(joined.select(*columns), bound, kinds)

    def tagged(self, sol: Solution, names) -> Solution:
        """Copies of variables beside them, which a join doesn't fill in."""
        names = list(names)
        return Solution(sol.df.select("*", *[F.col(v).alias(f"_k_{v}") for v in names]), sol.bound, sol.kinds | {f"_k_{v}": sol.kinds[v] for v in names})

    def without(self, sol: Solution, matched: DataFrame, names, how: str = "left_anti") -> DataFrame:
        """Rows of ``sol`` whose variables are not (left_semi: are) among the copies in ``matched``; null equals null."""
        other = matched.select(*[F.col(f"_k_{v}").alias(f"_m_{v}") for v in names]).distinct()
        on = reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"_m_{v}")) for v in names], F.lit(True))
        return sol.df.join(other, on, how)

    def left_join_unbound(self, a: Solution, b: Solution, condition) -> Solution:
        """The inner join, whose cases are equi-joins, and the rows of ``a`` that are not in it."""
        inner = self.join(self.tagged(a, a.vars), b)
        if condition is not None:
            inner = self.prepared(inner, condition)
            inner = Solution(inner.df.where(self.truth(inner, condition)), inner.bound, inner.kinds)
        inner = Solution(write_table(inner.df, "matched"), inner.bound, inner.kinds)
        rest = self.without(a, inner.df, a.vars)
        out = inner.df.select(*[v for v in inner.vars if v in a.kinds or v in b.kinds]).unionByName(rest, allowMissingColumns=True)
        return Solution(out, set(a.bound), a.kinds | {v: inner.kinds[v] for v in b.vars if v not in a.kinds})

    def drop(self, sol: Solution, v: str) -> Solution:
        return Solution(sol.df.drop(v), sol.bound - {v}, {k: x for k, x in sol.kinds.items() if k != v})

    def on_join(self, node: A.Join) -> Solution:
        return self.join(self.eval(node.left), self.eval(node.right))

    def on_leftjoin(self, node: A.LeftJoin) -> Solution:
        left, right = self.eval(node.left), self.eval(node.right)
        if not left.kinds:
            return right if node.condition is None else self.on_filter(A.Filter(node.right, node.condition))
        return self.join(left, right, "left", node.condition)

    def union(self, a: Solution, b: Solution) -> Solution:
        mixed = [v for v in a.vars if v in b.kinds and a.kinds[v] != b.kinds[v]]
        a, b = self.terms_of(a, mixed), self.terms_of(b, mixed)
        return Solution(a.df.unionByName(b.df, allowMissingColumns=True), a.bound & b.bound, a.kinds | b.kinds)

    def on_union(self, node: A.Union) -> Solution:
        return self.union(self.eval(node.left), self.eval(node.right))

    def on_minus(self, node: A.Minus) -> Solution:
        left, right = self.eval(node.left), self.eval(node.right)
        shared = [v for v in left.vars if v in right.kinds]
        if not shared:
            return left
        left, right = self.terms_of(left, shared), self.terms_of(right, shared)
        other = right.df.select(*[F.col(v).alias(f"_r_{v}") for v in shared]).distinct()
        if all(v in left.bound and v in right.bound for v in shared):
            on = reduce(lambda x, y: x & y, [F.col(v) == F.col(f"_r_{v}") for v in shared])
        else:
            one = self.tagged(Solution(left.df.select(*shared).distinct(), left.bound & set(shared), {v: left.kinds[v] for v in shared}), shared)
            two = Solution(right.df.select(*shared, *[F.col(v).alias(f"_o_{v}") for v in shared]).distinct(), right.bound & set(shared), {v: right.kinds[v] for v in shared} | {f"_o_{v}": "term" for v in shared})
            both = self.join(one, two).df.where(reduce(lambda x, y: x | y, [F.col(f"_k_{v}").isNotNull() & F.col(f"_o_{v}").isNotNull() for v in shared]))
            return Solution(self.without(left, both, shared), left.bound, left.kinds)
        return Solution(left.df.join(other, on, "left_anti"), left.bound, left.kinds)

    def on_filter(self, node: A.Filter) -> Solution:
        if isinstance(node.condition, A.Exists):
            return self.exists(self.eval(node.child), node.condition)
        if isinstance(node.condition, A.Call) and node.condition.name == "and":
            inner = A.Filter(node.child, node.condition.args[0])
            return self.on_filter(A.Filter(inner, node.condition.args[1]))
        sol = self.prepared(self.eval(node.child), node.condition)
        return Solution(sol.df.where(self.truth(sol, node.condition)), sol.bound, sol.kinds)

    def exists(self, sol: Solution, e: A.Exists) -> Solution:
        """Semi or anti join on the shared variables; a filter inside may use outer variables."""
        inner, conditions = e.child, []
        while isinstance(inner, A.Filter) and not isinstance(inner.condition, A.Exists):
            conditions.append(inner.condition)
            inner = inner.child
        right = self.eval(inner)
        shared = [v for v in sol.vars if v in right.kinds]
        sol, right = self.terms_of(sol, shared), self.terms_of(right, shared)
        if any(v not in sol.bound or v not in right.bound for v in shared):
            met = self.join(self.tagged(sol, sol.vars), right)
            for c in conditions:
                met = self.prepared(met, c)
                met = Solution(met.df.where(self.truth(met, c)), met.bound, met.kinds)
            return Solution(self.without(sol, met.df, sol.vars, "left_anti" if e.negated else "left_semi"), sol.bound, sol.kinds)
        other = right.df.select(*[F.col(v).alias(f"_r_{v}" if v in shared else v) for v in right.vars])
        tests = [F.col(v) == F.col(f"_r_{v}") for v in shared]
        scope = Solution(sol.df, set(), right.kinds | sol.kinds)
        tests += [self.truth(scope, c) for c in conditions]
        on = reduce(lambda x, y: x & y, tests) if tests else F.lit(True)
        return Solution(sol.df.join(other, on, "left_anti" if e.negated else "left_semi"), sol.bound, sol.kinds)

    def on_extend(self, node: A.Extend) -> Solution:
        sol = self.prepared(self.eval(node.child), node.expr)
        column, kind = self.expr(sol, node.expr)
        return Solution(sol.df.withColumn(node.var.name, column), sol.bound, sol.kinds | {node.var.name: kind})

    def prepared(self, sol: Solution, e) -> Solution:
        """Custom functions and EXISTS inside an expression become columns first."""
        if isinstance(e, A.Exists):
            name = f"_e{abs(hash(e)) % 10**12}"
            if name not in sol.kinds:
                asked = Solution(sol.df.select(*sol.vars).distinct(), sol.bound, sol.kinds)
                found = self.exists(self.tagged(asked, sol.vars), A.Exists(e.child)).df
                other = found.select(*[F.col(f"_k_{v}").alias(f"_m_{v}") for v in sol.vars], F.lit(True).alias(name)).distinct()
                on = reduce(lambda x, y: x & y, [F.col(v).eqNullSafe(F.col(f"_m_{v}")) for v in sol.vars], F.lit(True))
                df = sol.df.join(other, on, "left").select(*sol.vars, (F.coalesce(name, F.lit(False)) != F.lit(e.negated)).alias(name))
                sol = Solution(df, sol.bound, sol.kinds | {name: "bool"})
        if isinstance(e, A.Call):
            for a in e.args:
                sol = self.prepared(sol, a)
            if e.name.startswith("<") and e.name in self.functions:
                name = f"_f{abs(hash(e)) % 10**12}"
                if name not in sol.kinds:
                    columns = [self.as_term(sol, a) for a in e.args]
                    sol = Solution(self.functions[e.name](sol.df, columns, name), sol.bound, sol.kinds | {name: "num"})
        return sol

    def on_values(self, node: A.Values) -> Solution:
        names = [v.name for v in node.vars]
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], ", ".join(f"`{n}` string" for n in names))
        bound = {n for i, n in enumerate(names) if all(r[i] is not None for r in node.rows)}
        return Solution(F.broadcast(df), bound, dict.fromkeys(names, "term"))  # rows written in the query text

    def on_graph(self, node: A.Graph) -> Solution:
        if self.quads is None:
            raise ValueError("this source has no named graphs")
        if isinstance(node.name, str):
            inner = Lowering(self.quads.where(F.col("g") == node.name).select("s", "p", "o"), self.quads, self.functions)
            return inner.eval(node.child)
        inner = Lowering(self.t, self.quads, self.functions)
        inner.graph = node.name
        return inner.eval(node.child)

    def on_group(self, node: A.Group) -> Solution:
        sol = self.eval(node.child)
        for v, e in node.keys:
            if e is not None:
                column, kind = self.expr(sol, e)
                sol = Solution(sol.df.withColumn(v.name, column), sol.bound, sol.kinds | {v.name: kind})
        keys = [v.name for v, _ in node.keys]
        kinds, columns = {k: sol.kinds.get(k, "term") for k in keys}, []
        for v, call in node.aggregates:
            column, kind = self.aggregate(sol, call)
            columns.append(column.alias(v.name))
            kinds[v.name] = kind
        df = sol.df.groupBy(*keys).agg(*columns) if columns else sol.df.select(*keys).distinct()
        return Solution(df, (sol.bound & set(keys)) | {v.name for v, c in node.aggregates if c.name == "COUNT"}, kinds)

    def aggregate(self, sol: Solution, call: A.Call) -> tuple[Column, str]:
        name = call.name
        if name == "COUNT":
            if not call.args:
                columns = [F.col(v) for v in sol.vars]
                return (F.count_distinct(F.struct(*columns)), "int") if call.distinct else (F.count(F.lit(1)), "int")
            column = self.expr(sol, call.args[0])[0]
            return (F.count_distinct(column) if call.distinct else F.count(column)), "int"
        if name in ("SUM", "AVG"):
            value = self.num(sol, call.args[0])
            if name == "AVG" and call.distinct:
                made = F.try_divide(F.sum_distinct(value), F.count_distinct(value))
            else:
                made = {"SUM": F.sum_distinct if call.distinct else F.sum, "AVG": F.avg}[name](value)
            return F.coalesce(made, F.lit(0.0)), "num"
        column, kind = self.expr(sol, call.args[0])
        if name in ("MIN", "MAX"):
            if kind != "term":
                return (F.min if name == "MIN" else F.max)(column), kind
            order = F.struct(*T.sort_keys(column))
            bound = F.when(column.isNotNull(), order)
            return (F.min_by if name == "MIN" else F.max_by)(column, bound), "term"
        if name == "SAMPLE":
            return F.min(column), kind
        separator = T.parse_term(call.args[1])[1] if len(call.args) > 1 else " "
        text = self.str(sol, call.args[0])
        gathered = F.collect_set(text) if call.distinct else F.collect_list(text)
        return F.array_join(F.array_sort(gathered), separator), "str"

    def on_project(self, node: A.Project) -> Solution:
        sol = self.eval(node.child)
        if node.vars is None:
            names = [v for v in sol.vars if not v.startswith("_")]
        else:
            names = [v.name for v in node.vars]
        columns = [F.col(n) if n in sol.kinds else F.lit(None).cast("string").alias(n) for n in names]
        return Solution(sol.df.select(*columns), sol.bound & set(names), {n: sol.kinds.get(n, "term") for n in names})

    def on_distinct(self, node: A.Distinct) -> Solution:
        sol = self.eval(node.child)
        return Solution(sol.df.distinct(), sol.bound, sol.kinds)

    def on_orderby(self, node: A.OrderBy) -> Solution:
        sol = self.eval(node.child)
        keys = []
        for e, down in node.keys:
            column, kind = self.expr(sol, e)
            for k in T.sort_keys(column) if kind == "term" else [column]:
                keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        return Solution(sol.df.orderBy(*keys), sol.bound, sol.kinds)

    def on_slice(self, node: A.Slice) -> Solution:
        sol = self.eval(node.child)
        df = sol.df.offset(node.offset) if node.offset else sol.df
        return Solution(df if node.limit is None else df.limit(node.limit), sol.bound, sol.kinds)

    # expressions
    def as_term(self, sol: Solution, e) -> Column:
        column, kind = self.expr(sol, e)
        return column if kind == "term" else T.to_literal(column, kind)

    def num(self, sol: Solution, e) -> Column:
        column, kind = self.expr(sol, e)
        return T.number(column) if kind == "term" else column.try_cast("double")

    def str(self, sol: Solution, e) -> Column:
        column, kind = self.expr(sol, e)
        return T.lex(column) if kind == "term" else column.cast("string")

    def truth(self, sol: Solution, e) -> Column:
        """Effective boolean value; an error is null, which a filter drops."""
        column, kind = self.expr(sol, e)
        if kind == "bool":
            return column
        if kind in ("num", "int"):
            return column != 0
        if kind == "str":
            return column != ""
        boolean = F.when(T.datatype(column) == f"{T.XSD}boolean", T.lex(column).isin("true", "1"))
        return F.coalesce(boolean, T.number(column) != 0, F.when(T.kind(column) == "lit", T.lex(column) != ""))

    def expr(self, sol: Solution, e) -> tuple[Column, str]:
        if isinstance(e, A.Var):
            return (F.col(e.name), sol.kinds[e.name]) if e.name in sol.kinds else (F.lit(None).cast("string"), "term")
        if isinstance(e, str):
            return F.lit(e), "term"
        if isinstance(e, A.Exists):
            return F.col(f"_e{abs(hash(e)) % 10**12}"), "bool"
        name, args = e.name, e.args
        if name.startswith("<"):
            key = f"_f{abs(hash(e)) % 10**12}"
            if key in sol.kinds:
                return F.col(key), "num"
            raise ValueError(f"unknown function {name}")
        if name in ("and", "or"):
            x, y = self.truth(sol, args[0]), self.truth(sol, args[1])
            return (x & y if name == "and" else x | y), "bool"
        if name == "not":
            return ~self.truth(sol, args[0]), "bool"
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return self.compare(sol, name, *args), "bool"
        if name == "in":
            tests = [self.compare(sol, "=", args[0], a) for a in args[1:]]
            return reduce(lambda x, y: x | y, tests, F.lit(False)), "bool"
        if name in ("+", "-", "*", "/"):
            x, y = self.num(sol, args[0]), self.num(sol, args[1])
            return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[name](), "num"
        if name == "neg":
            return -self.num(sol, args[0]), "num"
        return self.builtin(sol, name, args)

    def compare(self, sol: Solution, op: str, a, b) -> Column:
        (x, kx), (y, ky) = self.expr(sol, a), self.expr(sol, b)
        test = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        numeric = {"num", "int"}
        if kx in numeric or ky in numeric:
            return test(self.num(sol, a), self.num(sol, b))
        if "str" in (kx, ky):
            return test(self.str(sol, a), self.str(sol, b))
        if kx == ky == "bool":
            return test(x, y)
        if any(isinstance(v, str) and v.startswith("<") for v in (a, b)):
            return test(x, y)  # against an IRI equality of terms says all
        p, q = T.number(x), T.number(y)
        both = p.isNotNull() & q.isNotNull()
        if op in ("=", "!="):
            return F.when(both, test(p, q)).otherwise(test(x, y))
        return F.when(both, test(p, q)).otherwise(F.when(T.kind(x) == T.kind(y), test(T.lex(x), T.lex(y))))

    def builtin(self, sol: Solution, name: str, args) -> tuple[Column, str]:
        s = lambda i: self.str(sol, args[i])
        n = lambda i: self.num(sol, args[i])
        term = lambda i: self.as_term(sol, args[i])
        text = {
            "STR": lambda: s(0), "UCASE": lambda: F.upper(s(0)), "LCASE": lambda: F.lower(s(0)),
            "CONCAT": lambda: F.concat(*[s(i) for i in range(len(args))]),
            "SUBSTR": lambda: F.substring(s(0), n(1).cast("int"), n(2).cast("int")) if len(args) > 2 else F.substring(s(0), n(1).cast("int"), F.length(s(0))),
            "STRAFTER": lambda: F.when(F.instr(s(0), self.constant(args[1])) > 0, F.substring(s(0), F.instr(s(0), self.constant(args[1])) + len(self.constant(args[1])), F.length(s(0)))).otherwise(""),
            "STRBEFORE": lambda: F.when(F.instr(s(0), self.constant(args[1])) > 0, F.substring(s(0), F.lit(1), F.instr(s(0), self.constant(args[1])) - 1)).otherwise(""),
            "REPLACE": lambda: F.regexp_replace(s(0), s(1), s(2)),
            "LANG": lambda: T.lang(term(0)), "MD5": lambda: F.md5(s(0)), "SHA1": lambda: F.sha1(s(0)), "SHA256": lambda: F.sha2(s(0), 256), "SHA512": lambda: F.sha2(s(0), 512), "SHA384": lambda: F.sha2(s(0), 384), "STRUUID": lambda: F.uuid(),
            "TZ": lambda: F.regexp_extract(s(0), self.ZONE, 1),
            "ENCODE_FOR_URI": lambda: F.url_encode(s(0)),
        }
        if name in text:
            return text[name](), "str"
        numeric = {
            "STRLEN": lambda: F.length(s(0)).cast("double"), "ABS": lambda: F.abs(n(0)), "CEIL": lambda: F.ceil(n(0)).cast("double"), "FLOOR": lambda: F.floor(n(0)).cast("double"),
            "ROUND": lambda: F.floor(n(0) + 0.5).cast("double"),
            "YEAR": lambda: F.year(s(0).try_cast("timestamp")), "MONTH": lambda: F.month(s(0).try_cast("timestamp")), "DAY": lambda: F.dayofmonth(s(0).try_cast("timestamp")),
            "HOURS": lambda: F.hour(s(0).try_cast("timestamp")), "MINUTES": lambda: F.minute(s(0).try_cast("timestamp")), "SECONDS": lambda: F.second(s(0).try_cast("timestamp")), "RAND": lambda: F.rand(),
        }
        if name in numeric:
            return numeric[name](), "num"
        boolean = {
            "STRSTARTS": lambda: s(0).startswith(s(1)), "STRENDS": lambda: s(0).endswith(s(1)), "CONTAINS": lambda: s(0).contains(s(1)),
            "REGEX": lambda: F.rlike(s(0), F.concat(F.lit(f"(?{self.constant(args[2])})"), s(1)) if len(args) > 2 else s(1)),
            "BOUND": lambda: term(0).isNotNull(), "ISIRI": lambda: T.kind(term(0)) == "iri", "ISURI": lambda: T.kind(term(0)) == "iri",
            "ISBLANK": lambda: T.kind(term(0)) == "bnode", "ISLITERAL": lambda: T.kind(term(0)) == "lit", "ISNUMERIC": lambda: n(0).isNotNull(),
            "SAMETERM": lambda: term(0) == term(1),
            "LANGMATCHES": lambda: F.when(s(1) == "*", s(0) != "").otherwise((F.lower(s(0)) == F.lower(s(1))) | F.lower(s(0)).startswith(F.concat(F.lower(s(1)), F.lit("-")))),
        }
        if name in boolean:
            return boolean[name](), "bool"
        if name == "NOW":
            return F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(f'"^^<{T.XSD}dateTime>')), "term"
        if name == "UUID":
            return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "term"
        if name == "BNODE":
            return (F.concat(F.lit("_:b"), F.md5(s(0))) if args else F.concat(F.lit("_:u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))), "term"
        if name == "TIMEZONE":
            zone = F.regexp_extract(s(0), self.ZONE, 1)
            hours, minutes = (F.regexp_replace(F.substring(zone, i, 2), "^0", "") for i in (2, 5))
            part = F.concat(F.lit("PT"), F.when(hours != "0", F.concat(hours, F.lit("H"))).otherwise(""), F.when(minutes != "0", F.concat(minutes, F.lit("M"))).otherwise(""))
            span = F.when(zone == "Z", "PT0S").when(zone != "", F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.when(part == "PT", "PT0S").otherwise(part)))
            return F.concat(F.lit('"'), span, F.lit(f'"^^<{T.XSD}dayTimeDuration>')), "term"
        if name == "COALESCE":
            return F.coalesce(*[term(i) for i in range(len(args))]), "term"
        if name == "IF":
            return F.when(self.truth(sol, args[0]), term(1)).otherwise(term(2)), "term"
        if name in ("IRI", "URI"):
            return F.concat(F.lit("<"), s(0), F.lit(">")), "term"
        if name == "DATATYPE":
            return F.concat(F.lit("<"), T.datatype(term(0)), F.lit(">")), "term"
        if name == "STRLANG":
            return F.concat(T.to_literal(s(0), "str"), F.lit("@"), s(1)), "term"
        if name == "STRDT":
            return F.concat(T.to_literal(s(0), "str"), F.lit("^^"), term(1)), "term"
        raise ValueError(f"unknown function {name}")

    #: The zone at the end of a dateTime.
    ZONE = r"T[\d:.]+(Z|[+-]\d\d:\d\d)$"

    def constant(self, e) -> str:
        if not isinstance(e, str):
            raise ValueError("this argument has to be a constant")
        return T.parse_term(e)[1]
