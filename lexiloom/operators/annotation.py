"""Rows for annotators: which senses of a lemma may be the root and which the figurative use, from a reference to a dictionary entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of senses that aren't there yet.
ROOT, METAPHOR, SENSE = "unknown_root", "unknown_metaphor", "unknown_sense"


def normalize_entry(entry: Column) -> Column:
    """A reference such as ``1.a`` in lower case without a last full stop; null for what is no reference."""
    text = F.regexp_replace(F.lower(F.trim(entry.cast("string"))), r"\.$", "")
    return F.when(text.rlike(r"^\d+[a-z.]*$"), text)


def entry_suffix(entry: Column) -> Column:
    """The mark of a sense label that a reference stands for: ``1.a`` is ``§1a``."""
    return F.concat(F.lit("§"), F.replace(entry, F.lit("."), F.lit("")))


def parent_suffix(suffix: Column) -> Column:
    """The mark of the sense above: that of ``§1a`` is ``§1``; null for one on top."""
    return F.when(suffix.rlike("[a-z]$"), F.regexp_replace(suffix, "[a-z]$", ""))


def label_suffix(label: Column) -> Column:
    """The mark in a sense label: ``§1a`` of ``kulde_§1a``; null where there is none."""
    return F.when(label.contains("§"), F.regexp_extract(label, "(§.+)", 1))


def requests(rows: DataFrame, order: str) -> DataFrame:
    """(lemma, entry, sentence): one row for each lemma, the first by ``order``, but the first with a sentence where there is one."""
    first = F.row_number().over(Window.partitionBy("lemma").orderBy(F.col("sentence").isNull(), order))
    return rows.withColumn("_n", first).where("_n = 1").select("lemma", normalize_entry(F.col("entry")).alias("entry"), "sentence")


_ROW = "array<struct<sense_id:string,description:string,example:string,derived_from:string,task:string>>"


def _row(sense, description, example, derived, task) -> Column:
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(text(sense).alias("sense_id"), text(description).alias("description"), text(example).alias("example"), text(derived).alias("derived_from"), text(task).alias("task"))


def annotation_rows(asked: DataFrame, senses: DataFrame) -> DataFrame:
    """(lemma, place, sense_id, derived_from, task, description, example, qualia_role, relation, status, rank) of each request.

    ``asked`` is (lemma, entry, sentence), a row for each lemma; ``senses`` is (lemma, sense, label, definition), of which one stands for each
    label, the first by name. Root rows have ``-`` where only the other row is to be filled in. A lemma is complete where all its
    senses are there and told apart, partial where one is there, else missing; ``rank`` puts them in this order.
    """
    one = senses.groupBy("lemma", "label").agg(F.min(F.struct("sense", "definition")).alias("x"))
    one = one.select("lemma", F.struct(F.col("x.sense").alias("sense"), F.col("x.definition").alias("definition"), label_suffix(F.col("label")).alias("suffix")).alias("s"))
    by = one.groupBy("lemma").agg(F.array_sort(F.collect_list("s")).alias("senses"))  # the senses of one lemma
    rows = asked.join(by, "lemma", "left").withColumn("senses", F.coalesce("senses", F.array().cast("array<struct<sense:string,definition:string,suffix:string>>")))
    rows = rows.withColumn("suffix", entry_suffix(F.col("entry"))).withColumn("above", parent_suffix(F.col("suffix")))
    marked = lambda mark: F.filter("senses", lambda s: s["suffix"] == mark)
    first = lambda found: F.get(found, F.lit(0))
    rows = rows.withColumns({"found": first(marked(F.col("suffix"))), "base": first(marked(F.col("above"))), "bases": F.size(marked(F.col("above"))), "one": first(marked(F.lit("§1"))), "one_a": first(marked(F.lit("§1a")))})
    sentence, found, base = F.col("sentence"), F.col("found"), F.col("base")
    family = F.filter("senses", lambda s: F.coalesce(s["suffix"].startswith(F.col("suffix")), F.lit(False)))
    rows = rows.withColumn("known", F.when(found.isNotNull() & F.col("above").isNull() & (F.size(family) > 1), family).otherwise(F.col("senses")))

    def both(root, metaphor, task) -> Column:
        sense = lambda s, name: (s["sense"], s["definition"]) if s is not None else (name, None)
        (a, da), (b, db) = sense(root, ROOT), sense(metaphor, METAPHOR)
        return F.array(_row(a, da, None, "-", task[0]), _row(b, db, sentence, a, task[1]))

    open_ = F.transform("known", lambda s, i: _row(s["sense"], s["definition"], F.when((i == 0) & (F.size("known") > 1), sentence), None, "assign roles"))
    single = F.concat(open_, F.array(_row(SENSE, None, sentence, None, "assign roles")))
    made = (
        F.when(F.size("senses") == 0, both(None, None, ("not in the dictionary", "not in the dictionary")))
        .when(found.isNotNull() & base.isNotNull(), both(base, found, (None, None)))
        .when(found.isNotNull() & F.col("above").isNotNull(), both(None, found, ("root not in the dictionary", None)))
        .when(F.col("entry").isNull() & F.col("one").isNotNull() & F.col("one_a").isNotNull(), both(F.col("one"), F.col("one_a"), ("verify inferred IDs", "verify inferred IDs")))
        .when(F.col("above").isNotNull() & found.isNull() & (F.col("bases") == 1), both(base, None, (None, "metaphor not in the dictionary")))
        .when(F.size("known") == 1, single)
        .otherwise(open_)
    ).cast(_ROW)
    rows = rows.select("lemma", made.alias("rows"))
    real = lambda r: ~r["sense_id"].startswith("unknown_")
    rank = F.when(F.forall("rows", lambda r: real(r) & r["derived_from"].isNotNull()), 0).when(F.exists("rows", real), 1).otherwise(2)
    rows = rows.withColumn("rank", rank).withColumn("status", F.element_at(F.array(F.lit("complete"), F.lit("partial"), F.lit("missing")), F.col("rank") + 1))
    out = rows.select("lemma", "status", "rank", F.posexplode("rows").alias("place", "r")).select("lemma", "place", "r.*", "status", "rank")
    root = F.when(F.col("derived_from") == "-", "-")
    return out.select("*", root.alias("qualia_role"), root.alias("relation"))
