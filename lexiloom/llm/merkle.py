"""A Merkle manifest of a data set: leaves, one tree a source, one tree over the sources, and a proof for each row.

1. A leaf is the SHA-256 of the row's fields, each with its length in front. Rows
   are sorted by source and identifier over range partitions and written; a row's
   place in its source follows from its place in its file and from the counts
   that stand before it, so no source is ever gathered in one task.
2. Bottom up, every ``FAN`` neighbours become one digest. Each level is a written
   table of runs that holds the run's digest beside its children.
3. Top down, each child puts its siblings in front of the proof that its parent
   inherited, from the root through the source's root to the leaves.

A proof is a list of (digests to the left, digests to the right), one pair a
level, and folds to the root by hashing. A tree of one node is that node itself.

Rows with null identifiers stand first, rows with one identifier in the order of
their leaves; repeated rows are leaves of their own. A null source is a source.
Null fields are marked, so that null and empty texts have different leaves. An
empty table gives no rows. Columns beside ``fields`` take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, scratch, shuffle_partitions

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row: of each field its UTF-8 byte count, a colon and the value, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _sorted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` written in the order of ``keys``, with the number of the file and of the row in it. Equal rows are spread by a salt."""
    parts = shuffle_partitions(rows.sparkSession)
    ranged = rows.withColumn("_salt", F.rand(17)).repartitionByRange(parts, *keys, "_salt").sortWithinPartitions(*keys)
    table = materialise(ranged.drop("_salt"), name)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return table.select("*", file.alias("file"), F.col("_metadata.row_index").alias("row"))


def _before(spans: DataFrame, group: str | None) -> DataFrame:
    """Of (file, n): ``start``, the rows in earlier files of the group. A group has at most one span a file."""
    within = f"PARTITION BY {group}" if group else ""
    return spans.withColumn("start", F.expr(f"coalesce(sum(n) OVER ({within} ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))


def _placed_sources(spans: DataFrame) -> DataFrame:
    """(source, tree, n): the sources numbered in their order, with their row counts."""
    table = _sorted(spans.groupBy("source").agg(F.sum("n").alias("n_rows")), ["source"], "sources")
    files = _before(table.groupBy("file").agg(F.count(F.lit(1)).alias("n")), None)
    return table.join(files.drop("n"), "file").select("source", (F.col("start") + F.col("row")).alias("tree"), F.col("n_rows").alias("n"))


def placed_leaves(rows: DataFrame) -> DataFrame:
    """(tree, n, at, ...) of rows (source, doc_id, leaf, ...): the source's number and row count, the row's place in it."""
    table = _sorted(rows, ["source", "doc_id", "leaf"], "leaves")
    spans = materialise(table.groupBy("file", "source").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")), "spans")
    sources = materialise(_placed_sources(spans), "sources")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    told = _before(spans, "source").alias("s").join(sources.alias("t"), same("s", "t")).select("s.file", "s.source", "s.first", "s.start", "t.tree", "t.n")
    joined = table.alias("r").join(told.alias("o"), (F.col("r.file") == F.col("o.file")) & same("r", "o"))
    return joined.select("o.tree", "o.n", F.expr("o.start + r.row - o.first").alias("at"), *[f"r.{c}" for c in rows.columns])


def depth_of(n: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // FAN), depth + 1
    return depth


def build_levels(nodes: DataFrame, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs above (tree, n, at, digest), and the root (tree, depth, digest) of each tree.

    A run is (tree, n, at, kids, digest): its children's digests in order, and the count of children on their level.
    """
    levels, roots = [], nodes.where("n = 1").select("tree", F.lit(0).alias("depth"), "digest")
    for k in range(depth):
        runs = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("at") / FAN).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("kids"))
        runs = runs.withColumn("kids", F.col("kids.digest")).withColumn("digest", F.sha2(F.array_join("kids", ""), 256))
        levels.append(materialise(runs, f"{name}_{k}"))
        nodes = levels[-1].select("tree", F.ceil(F.col("n") / FAN).alias("n"), "at", "digest")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.lit(k + 1).alias("depth"), "digest"))
    return levels, materialise(roots, f"{name}_roots")


def _own_step(kids: Column, place: Column) -> Column:
    """What stands left and right of a child in its run."""
    side = lambda start, length: F.array_join(F.slice(kids, start, length), "")
    return F.array(F.struct(side(F.lit(1), place).alias("left"), side(place + 2, F.lit(FAN)).alias("right")))


def push_proofs(levels: list[DataFrame], roots: DataFrame, lowest: int, name: str) -> DataFrame:
    """(tree, at, proof) of the nodes of level ``lowest``, from ``roots`` (tree, depth, proof)."""
    here = roots.where(F.col("depth") >= len(levels)).select("tree", F.lit(0).cast("long").alias("at"), "proof")
    for k in range(len(levels) - 1, lowest - 1, -1):
        runs = levels[k].select("tree", "at", "kids").join(here, ["tree", "at"])
        kids = runs.select("tree", F.col("at").alias("run"), "kids", "proof", F.posexplode("kids").alias("place", "_"))
        kids = kids.select("tree", (F.col("run") * FAN + F.col("place")).alias("at"), F.concat(_own_step(F.col("kids"), F.col("place")), F.col("proof")).alias("proof"))
        here = materialise(kids.unionByName(roots.where(F.col("depth") == k).select("tree", F.lit(0).cast("long").alias("at"), "proof")), f"{name}_{k}")
    return here


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a document: doc_id, source, leaf, subroot, root, proof, and folded_root, what the leaf and the proof lead to.

    Where ``tampered`` holds, the folded leaf is that of the row with the capital
    ASCII letters of its text in lower case; a row without any folds to the root.
    """
    spark = docs.sparkSession
    of = lambda text: leaf_of(*[text if f == "text" else F.col(f) for f in fields])
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, of(F.translate("text", UPPER, LOWER)))
    rows = docs.select("source", "doc_id", of(F.col("text")).alias("leaf"), changed.alias("changed"))
    with scratch(spark):
        leaves = materialise(placed_leaves(rows), "placed")
        most, trees = leaves.agg(F.max("n"), F.max("tree")).first()
        levels, roots = build_levels(leaves.select("tree", "n", "at", F.col("leaf").alias("digest")), depth_of(most or 0), "runs")
        n_trees = 0 if trees is None else trees + 1
        tops = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("at"), "digest")
        top_levels, top_root = build_levels(tops, depth_of(n_trees), "top")
        start = top_root.select("tree", "depth", F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
        proofs = push_proofs(top_levels, start, 0, "top_proofs").select(F.col("at").alias("tree"), "proof")
        root = top_root.first()  # one row, or none of an empty table
        subroots = materialise(roots.join(proofs, "tree").withColumn("root", F.lit(root and root["digest"]).cast("string")).withColumnRenamed("digest", "subroot"), "subroots")
        inherited = push_proofs(levels, subroots.select("tree", "depth", "proof"), 1, "proofs")
        if levels:
            runs = levels[0].select("tree", F.col("at").alias("run"), "kids").join(inherited.select("tree", F.col("at").alias("run"), "proof"), ["tree", "run"])
            many = leaves.where("n > 1").withColumn("run", F.floor(F.col("at") / FAN)).join(runs, ["tree", "run"])
            many = many.withColumn("proof", F.concat(_own_step(F.col("kids"), (F.col("at") % FAN).cast("int")), F.col("proof"))).drop("run", "kids")
            told = many.unionByName(leaves.where("n = 1").join(subroots.select("tree", "proof"), "tree"))
        else:
            told = leaves.join(subroots.select("tree", "proof"), "tree")
        told = told.join(subroots.select("tree", "subroot", "root"), "tree")
        folded = fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root")
        out = told.select("doc_id", "source", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"), folded)
        return materialise(out, "manifest", keep=True)


#: One byte of a CRC-32 in SQL: eight steps with the reversed polynomial.
_CRC_STEP = "list_reduce(list_prepend(xor(c % 256, x), range(0, 8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)"


def oracle(levels: int = 7) -> str:
    """The manifest in DuckDB SQL, for sources of at most 16 ** ``levels`` rows and as many sources."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"h AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, x: xor(c // 256, {_CRC_STEP})) AS c FROM documents)",
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN xor(c, CAST(4294967295 AS BIGINT)) % 5 = 0 AND text IS NOT NULL THEN {leaf(lower)} ELSE {leaf('text')} END AS folded FROM h)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "s_0 AS (SELECT source AS tree, pos, n, leaf AS d FROM placed)",
    ]

    def tree(x: str) -> None:
        for k in range(levels):
            ctes.append(f"{x}r_{k} AS MATERIALIZED (SELECT tree, pos // 16 AS run, n, list(d ORDER BY pos) AS ds FROM {x}_{k} GROUP BY tree, pos // 16, n)")
            ctes.append(f"{x}_{k + 1} AS MATERIALIZED (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {x}r_{k})")

    def climb(x: str, first: str) -> None:
        ctes.append(f"{x}p_0 AS ({first})")
        for k in range(levels):
            left, right = "array_to_string(ds[1:p.pos % 16], '')", "array_to_string(ds[p.pos % 16 + 2:], '')"
            ctes.append(
                f"{x}p_{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (pos, folded, proof), p.pos // 16 AS pos, CASE WHEN r.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded, "
                f"CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {x}p_{k} p JOIN {x}r_{k} r ON r.tree IS NOT DISTINCT FROM p.tree AND r.run = p.pos // 16)"
            )

    tree("s")
    ctes.append(f"tops AS MATERIALIZED (SELECT tree AS source, d AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s_{levels})")
    ctes.append("t_0 AS (SELECT 0 AS tree, pos, n, subroot AS d FROM tops)")
    tree("t")
    climb("s", "SELECT doc_id, leaf, source AS tree, pos, folded, '' AS proof FROM placed")
    climb("t", f"SELECT p.doc_id, p.leaf, o.subroot, 0 AS tree, o.pos, p.folded, p.proof FROM sp_{levels} p JOIN tops o ON o.source IS NOT DISTINCT FROM p.tree")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM tp_{levels}, t_{levels}"
