"""Tabular and line sources, the quad store on Parquet, and result sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import terms as T

QUADS = "g string, s string, p string, o string"


def read_tsv(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="\t", schema=schema, header=header, quote="")


def rows_to_triples(rows: DataFrame, *triples: tuple[Column, Column, Column]) -> DataFrame:
    """(s, p, o) as a set: each triple of expressions over each row; those with a null part are left out."""
    made = F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in triples])
    return rows.select(F.inline(made)).where("s is not null and p is not null and o is not null").distinct()


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """(kind, new, old) of lines ``MRG|MOV|REP new < old``; other lines are left out."""
    pattern = r"^\s*(MRG|MOV|REP)\s+(\S+)\s*<\s*(\S+)"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i).alias(c) for i, c in enumerate(("kind", "new", "old"), 1)])


def missing_inputs(paths: list[str]) -> list[str]:
    return [p for p in paths if not Path(p).exists()]


def write_quads(quads: DataFrame, path: str, replace: bool = False) -> None:
    """The store: term projections beside the terms, partitioned by graph and predicate for pruning. With ``replace`` the partitions written take the place of what is in them."""
    rows = quads.dropDuplicates(["g", "s", "p", "o"])
    o = F.col("o")
    rows = rows.select(
        "g", "s", "p", "o", T.kind(o).alias("o_kind"), T.lex(o).alias("o_lex"), T.lang(o).alias("o_lang"), T.datatype(o).alias("o_dt"),
        F.regexp_replace("g", "[^A-Za-z0-9]+", "_").alias("g_id"), F.regexp_replace("p", "[^A-Za-z0-9]+", "_").alias("p_id"),
    )
    if replace:  # predicates that a graph has no more are written empty, in the same commit
        try:
            old = quads.sparkSession.read.parquet(path).select("g_id", "p_id").distinct()
        except AnalysisException:
            old = None
        if old is not None:
            stale = old.join(rows.select("g_id").distinct(), "g_id", "left_semi").join(rows.select("g_id", "p_id").distinct(), ["g_id", "p_id"], "left_anti")
            rows = rows.unionByName(stale, allowMissingColumns=True)
    writer = rows.repartition("g_id", "p_id", F.pmod(F.xxhash64("s"), F.lit(16))).write.partitionBy("g_id", "p_id")
    if replace:
        writer = writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.parquet(path)


def read_quads(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where("s is not null")
    if predicate is not None:  # the partition column prunes, the term decides
        rows = rows.where(F.col("p_id") == F.regexp_replace(F.lit(predicate), "[^A-Za-z0-9]+", "_")).where(F.col("p") == predicate)
    return rows


def named_graph(quads: DataFrame, graph: str) -> DataFrame:
    return quads.where(F.col("g") == graph).select("s", "p", "o")


def union_graph(quads: DataFrame) -> DataFrame:
    """The set union of all named graphs."""
    return quads.select("s", "p", "o").distinct()


def sparql_json(df: DataFrame) -> DataFrame:
    """(binding): each solution as a SPARQL 1.1 results JSON object; unbound variables are left out."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "string":
            kind = F.when(c.startswith("<"), "uri").when(c.startswith("_:"), "bnode").otherwise("literal")
            value = F.when(c.startswith("_:"), F.substring(c, 3, 10**6)).when(c.startswith("<") | c.startswith('"'), T.lex(c)).otherwise(c)
            lang = F.when(T.lang(c) != "", T.lang(c))
            dt = F.when(c.contains('"^^<'), T.datatype(c))
        else:
            kind, value, lang = F.lit("literal"), c.cast("string"), F.lit(None).cast("string")
            dt = F.lit(T.XSD + {"boolean": "boolean", "double": "double"}.get(f.dataType.simpleString(), "integer"))
        cell = F.struct(kind.alias("type"), value.alias("value"), lang.alias("xml:lang"), dt.alias("datatype"))
        cells.append(F.when(c.isNotNull(), cell).alias(f.name))
    return df.select(F.to_json(F.struct(*cells)).alias("binding"))


def csv_cell(values: Column) -> Column:
    """A set as one cell: names in order, joined by a semicolon."""
    return F.array_join(F.array_sort(values), "; ")


#: Languages of labels that stay where a property has several values.
LABEL_LANGUAGES = ("da", "en")


def json_ld(triples: DataFrame) -> DataFrame:
    """(s, doc): each resource as a JSON-LD object with full IRIs; several values are an array, in order.

    Of several values literals in other languages than :data:`LABEL_LANGUAGES` are left out. A blank node
    stands as what is said of it, a bag as the set of its members.
    """
    o, bag, kind = F.col("o"), f"<{T.PREFIXES['rdf']}Bag>", f"<{T.PREFIXES['rdf']}type>"
    lang = F.when(T.lang(o) != "", T.lang(o))
    typed = F.when(o.contains('"^^<'), T.datatype(o))
    plain = F.to_json(F.struct(F.when(~o.startswith('"'), F.when(o.startswith("_:"), o).otherwise(T.lex(o))).alias("@id"), F.when(o.startswith('"'), T.lex(o)).alias("@value"), lang.alias("@language"), typed.alias("@type")))
    told = F.coalesce(lang.isNull() | lang.isin(*LABEL_LANGUAGES), F.lit(True))

    def objects(rows: DataFrame) -> DataFrame:
        """(s, body): the properties of (s, p, value, told)."""
        by = rows.groupBy("s", "p").agg(F.array_sort(F.collect_set("value")).alias("all"), F.array_sort(F.collect_set(F.when(F.col("told"), F.col("value")))).alias("some"))
        many = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.concat(F.lit("["), F.array_join("some", ","), F.lit("]")))
        key = F.to_json(F.struct(T.lex(F.col("p")).alias("k")))
        pair = F.concat(F.regexp_replace(key, r'^\{"k":(.*)\}$', "$1"), F.lit(":"), many)
        return by.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("body"))

    inner = triples.where(F.col("s").startswith("_:"))
    bags = inner.where((F.col("p") == kind) & (o == bag)).select("s").distinct()
    members = inner.join(bags, "s", "left_semi").where(F.col("p").startswith(f"<{T.PREFIXES['rdf']}_")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract("p", r"_(\d+)>$", 1).cast("long").alias("n"), plain.alias("v")))).alias("m"))
    sets = members.select(F.col("s").alias("o"), F.concat(F.lit('{"@set":['), F.array_join(F.transform("m", lambda m: m["v"]), ","), F.lit("]}")).alias("node"))
    nodes = objects(inner.join(bags, "s", "left_anti").select("s", "p", plain.alias("value"), told.alias("told"))).select(F.col("s").alias("o"), F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("node"))
    outer = triples.where(~F.col("s").startswith("_:")).join(sets.unionByName(nodes), "o", "left").select("s", "p", F.coalesce("node", plain).alias("value"), told.alias("told"))
    return objects(outer).select("s", F.concat(F.lit('{"@id":"'), T.lex(F.col("s")), F.lit('",'), F.col("body"), F.lit("}")).alias("doc"))
