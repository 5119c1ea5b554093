"""Triple rewriting: updates, removals, renames, merges, splits and change logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def update_triples(base: DataFrame, adds: DataFrame | None = None, removals: DataFrame | None = None) -> DataFrame:
    """Removals (s, p, o; null is a wildcard) go before the additions; the result is a set."""
    out = base.select("s", "p", "o")
    if removals is not None:
        out = remove(out, removals)
    if adds is not None:
        out = out.unionByName(adds.select("s", "p", "o"))
    return out.distinct()


def safe_add(base: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base with the rows that are triples, and the others with what is wrong with them: one bad row doesn't hold up the rest."""
    term = lambda c: F.col(c).rlike(r"^(<[^<>\"{}|^`\\\s]*>|_:\S+)$")
    literal = F.col("o").rlike(r'(?s)^"(?:[^"\\]|\\.)*"(@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?$')
    wrong = F.when(F.col("s").isNull() | F.col("p").isNull() | F.col("o").isNull(), "a part is missing").when(~term("s"), "the subject is no resource")
    wrong = wrong.when(~term("p") | F.col("p").startswith("_:"), "the predicate is no IRI").when(~term("o") & ~literal, "the value is no term")
    told = rows.select("s", "p", "o", wrong.alias("problem"))
    good = told.where("problem is null").select("s", "p", "o")
    return base.select("s", "p", "o").unionByName(good).distinct(), told.where("problem is not null")


def remove(base: DataFrame, patterns: DataFrame) -> DataFrame:
    """Without the triples that match a pattern; one anti join for each shape of pattern, on its fixed parts."""
    shapes = patterns.select(*[F.col(c).isNotNull().alias(c) for c in "spo"]).distinct().collect()  # at most eight
    for shape in shapes:
        fixed = [c for c in "spo" if shape[c]]
        if not fixed:
            return base.limit(0)
        same = patterns
        for c in "spo":
            same = same.where(F.col(c).isNotNull() if shape[c] else F.col(c).isNull())
        base = base.join(same.select(*fixed).distinct(), fixed, "left_anti").select("s", "p", "o")
    return base


def rename_resources(triples: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (old, new) put in subject and object place; triples that become equal merge."""
    as_s = names.select(F.col("old").alias("s"), F.col("new").alias("_s"))
    as_o = names.select(F.col("old").alias("o"), F.col("new").alias("_o"))
    out = triples.join(as_s, "s", "left").join(as_o, "o", "left")
    return out.select(F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o")).distinct()


def compose_remaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old, new) of two change logs in a row; identities are dropped."""
    one = first.select("old", F.col("new").alias("mid"))
    two = second.select(F.col("old").alias("mid"), F.col("new").alias("last"))
    both = one.join(two, "mid", "left").select("old", F.coalesce("last", "mid").alias("new"))
    rest = second.join(first.select("old"), "old", "left_anti").select("old", "new")
    return both.unionByName(rest).where("old <> new").distinct()


def split_shared(links: DataFrame) -> DataFrame:
    """(concept, sense, new_sense, part): senses of several concepts become one for each, numbered by concept."""
    n = F.count(F.lit(1)).over(Window.partitionBy("sense"))
    part = F.row_number().over(Window.partitionBy("sense").orderBy("concept"))
    rows = links.distinct().withColumn("n", n).withColumn("part", part).where("n > 1")
    new = F.concat(F.expr("substring(sense, 1, length(sense) - 1)"), F.lit("-i"), F.col("part"), F.lit(">"))
    return rows.select("concept", "sense", new.alias("new_sense"), "part")


def merge_duplicates(triples: DataFrame, predicates: list[str], definition: str | None = None) -> DataFrame:
    """(loser, winner): resources with the same non-empty set of values under ``predicates``; one with a definition wins, then the first by name."""
    values = triples.where(F.col("p").isin(*predicates)).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("p", "o"))).alias("x"))
    digest = values.select("s", F.sha2(F.to_json("x"), 256).alias("x"))
    if definition is None:
        digest = digest.withColumn("bare", F.lit(False))
    else:
        told = triples.where(F.col("p") == definition).select("s", F.lit(False).alias("bare")).distinct()
        digest = digest.join(told, "s", "left").withColumn("bare", F.coalesce("bare", F.lit(True)))
    winner = digest.groupBy("x").agg(F.min(F.struct("bare", "s")).alias("best")).select("x", F.col("best.s").alias("winner"))
    return digest.join(winner, "x").where("s <> winner").select(F.col("s").alias("loser"), "winner")


def merge_resources(triples: DataFrame, names: DataFrame, carried: list[str]) -> DataFrame:
    """Losers (old) give way to winners (new): references are redirected, what losers say goes, but for ``carried`` predicates that the winner lacks."""
    lost = names.select(F.col("old").alias("s"), F.col("new"))
    kept = triples.join(lost.select("s"), "s", "left_anti")
    said = triples.where(F.col("p").isin(*carried)).join(lost, "s").select(F.col("new").alias("s"), "p", "o").distinct()
    said = said.join(kept.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return rename_resources(kept.select("s", "p", "o").unionByName(said), names)


def remove_all(triples: DataFrame, predicate: str, expected: int | None = None) -> DataFrame:
    """Without the triples of a predicate, of which there have to be as many as ``expected``."""
    if expected is not None and (n := triples.where(F.col("p") == predicate).count()) != expected:
        raise ValueError(f"{n} triples of {predicate}, not {expected}")
    return triples.where(F.col("p") != predicate)


def lemma_labels(members: DataFrame) -> DataFrame:
    """(synset, label) from (synset, lemma): the different lemmas in order, in braces."""
    return members.groupBy("synset").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set("lemma")), "; "), F.lit("}")).alias("label"))


def in_scheme(triples: DataFrame, namespace: str, predicate: str, scheme: str) -> DataFrame:
    """(s, p, o): every subject of a namespace is in its scheme."""
    return triples.where(F.col("s").startswith(f"<{namespace}")).select("s").distinct().select("s", F.lit(predicate).alias("p"), F.lit(scheme).alias("o"))


def rewrite_prefix(triples: DataFrame, predicate: str, old: str, new: str) -> DataFrame:
    """Values of a predicate that begin with one address begin with another; doing it again changes nothing."""
    moved = F.concat(F.lit(f"<{new}"), F.expr(f"substring(o, {len(old) + 2})"))
    return triples.withColumn("o", F.when((F.col("p") == predicate) & F.col("o").startswith(f"<{old}"), moved).otherwise(F.col("o"))).distinct()


def minted(wanted: DataFrame, triples: DataFrame, predicate: str, value) -> DataFrame:
    """(s, p, o) for the resources (s) that lack a predicate, with a value made from their columns."""
    has = triples.where(F.col("p") == predicate).select("s").distinct()
    return wanted.join(has, "s", "left_anti").select("s", F.lit(predicate).alias("p"), value.alias("o")).distinct()


def cascade_delete(triples: DataFrame, roots: DataFrame, *predicates: str) -> DataFrame:
    """Without the roots (node), what they own through ``predicates`` in turn, and whatever points to these."""
    doomed = roots.select("node").distinct()
    level = doomed
    for p in predicates:
        level = triples.where(F.col("p") == p).join(level.select(F.col("node").alias("s")), "s", "left_semi").select(F.col("o").alias("node")).distinct()
        doomed = doomed.union(level)
    doomed = doomed.distinct()
    return triples.join(doomed.withColumnRenamed("node", "s"), "s", "left_anti").join(doomed.withColumnRenamed("node", "o"), "o", "left_anti").select("s", "p", "o")


def rebuild_links(links: DataFrame, remap: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, fate) of links into a graph that was loaded anew: kept, moved along ``remap`` (old, new), or dropped where the target is gone."""
    out = links.join(remap.select(F.col("old").alias("b"), "new"), "b", "left")
    out = out.withColumn("target", F.coalesce("new", "b")).join(known.select(F.col("node").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    fate = F.when(F.col("there").isNull(), "dropped").when(F.col("new").isNotNull(), "moved").otherwise("kept")
    return out.select("a", F.when(F.col("there"), F.col("target")).alias("b"), fate.alias("fate")).distinct()


def reloaded(kept: DataFrame, links: DataFrame, fresh: DataFrame, remap: DataFrame) -> DataFrame:
    """A graph loaded anew: what was kept beside it, the fresh triples, and the links (s, p, o) into it, moved along ``remap`` (old, new) or dropped."""
    nodes = fresh.select(F.col("s").alias("node")).distinct()
    ends = rebuild_links(links.select(F.struct("s", "p").alias("a"), F.col("o").alias("b")), remap, nodes).where("fate <> 'dropped'")
    return kept.select("s", "p", "o").unionByName(fresh.select("s", "p", "o")).unionByName(ends.select("a.s", "a.p", F.col("b").alias("o"))).distinct()


def replace_subjects(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """All that was said of the subjects of ``metadata`` gives way to it."""
    rest = triples.join(metadata.select("s").distinct(), "s", "left_anti").select("s", "p", "o")
    return rest.unionByName(metadata.select("s", "p", "o")).distinct()


def check_release(triples: DataFrame, dataset: str, predicate: str, expected: str) -> None:
    """Fails unless the dataset's only version is the expected one."""
    found = [r["o"] for r in triples.where((F.col("s") == dataset) & (F.col("p") == predicate)).select("o").distinct().limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"version {found}, not {expected}")


def release(triples: DataFrame, current: str, following: str, *changes) -> DataFrame:
    """The changes of a release in turn; none where it is already the following one."""
    for change in changes if current != following else ():
        triples = change(triples)
    return triples


def build_hash(inputs: DataFrame, code: list[str]) -> str:
    """A digest of the inputs (path, length, modificationTime) and the texts of the code: a new one asks for a new build."""
    own = inputs.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "length", F.col("modificationTime").cast("string"))))), 256)).first()[0]
    return hashlib.sha256("\n".join([own, *code]).encode()).hexdigest()


def retarget_unique(links: DataFrame) -> DataFrame:
    """(source, target, kept): links through targets that exactly one source has; others are to be deleted."""
    n = F.count(F.lit(1)).over(Window.partitionBy("target"))
    return links.distinct().withColumn("kept", n == 1)


def first_of_run(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows at the start of each run of equal consecutive values."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def homograph_numbers(words: DataFrame) -> DataFrame:
    """(id, form, pos, n): numbers from 1 by id in groups of equal form and part of speech; single words get none."""
    w = Window.partitionBy("form", "pos")
    rows = words.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("n", F.row_number().over(w.orderBy("id")))
    return rows.where("size > 1").select("id", "form", "pos", "n")


def unambiguous_links(links: DataFrame) -> DataFrame:
    """Links (a, b) that are one to one on both sides."""
    rows = links.distinct()
    rows = rows.withColumn("na", F.count(F.lit(1)).over(Window.partitionBy("a"))).withColumn("nb", F.count(F.lit(1)).over(Window.partitionBy("b")))
    return rows.where("na = 1 and nb = 1").select("a", "b")


def symmetric_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs of different nodes, as a set."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def merge_forms(forms: DataFrame, strength: list[str]) -> DataFrame:
    """One row for each (word, tag, text) with its strongest status; ``strength`` lists them, strongest first."""
    rank = F.lit(len(strength))
    for i, s in reversed(list(enumerate(strength))):
        rank = F.when(F.col("status") == s, i).otherwise(rank)
    best = forms.groupBy("word", "tag", "text").agg(F.min(F.struct(rank.alias("rank"), "status")).alias("x"))
    return best.select("word", "tag", "text", F.col("x.status").alias("status"))


def dataset_statistics(triples: DataFrame, type_predicate: str, entry: str, sense_of_entry: str, sense_of_concept: str, concept: str) -> DataFrame:
    """Counts by kind, senses by entry and by concept with two decimals (null without any), and the triple count."""
    is_type = F.col("p") == type_predicate
    counts = triples.agg(
        F.count(F.when(is_type & (F.col("o") == entry), 1)).alias("entries"),
        F.count(F.when(is_type & (F.col("o") == concept), 1)).alias("concepts"),
        F.count(F.when(F.col("p") == sense_of_entry, 1)).alias("senses"),
        F.count(F.when(F.col("p") == sense_of_concept, 1)).alias("lexicalized"),
        F.count(F.lit(1)).alias("triples"),
    )
    return counts.select(
        "entries", "concepts", "senses", "triples",
        F.round(F.try_divide("senses", "entries"), 2).alias("avg_ambiguity"), F.round(F.try_divide("lexicalized", "concepts"), 2).alias("avg_synonymy"),
    )
