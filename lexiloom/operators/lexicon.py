"""Dictionary operators: expanded entities, canonical labels, lemma search through forms, and the relational steps of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import labels as L
from lexiloom.functions import terms as T
from lexiloom.functions.tables import write_table
from lexiloom.operators.closure import distances, reachable
from lexiloom.operators.entity import blank_node_trees, gathered_values, prune_superproperties, raw_vs_inferred, resource_labels


def _links(triples: DataFrame, p: str, a: str, b: str) -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))


# --- entities


def raw_entity(schema: DataFrame, base: DataFrame, subjects: DataFrame) -> DataFrame:
    """(s, p, o) of the asked subjects as stated in the schema or the base, without inference."""
    both = schema.select("s", "p", "o").unionByName(base.select("s", "p", "o"))
    return both.join(subjects.select(F.col("node").alias("s")).distinct(), "s", "left_semi").distinct()


def supplement_synset(triples: DataFrame, sense: str, example: str, source: str, ili: str, definition: str) -> DataFrame:
    """(s, p, os, supplemented): examples and sources of the senses in place of the synset's own, and its definitions with those of its ILI."""
    synsets = triples.where(F.col("p") == sense).select("s").distinct()
    own = triples.join(synsets, "s", "left_semi").groupBy("s", "p").agg(F.collect_set("o").alias("os"))
    gathered = gathered_values(triples, sense, example).withColumn("p", F.lit(example)).unionByName(gathered_values(triples, sense, source).withColumn("p", F.lit(source)))
    through = gathered_values(triples.where(F.col("p").isin(ili, definition)), ili, definition).join(synsets, "s", "left_semi").withColumn("p", F.lit(definition))
    more = gathered.withColumn("replaces", F.lit(True)).unionByName(through.withColumn("replaces", F.lit(False))).withColumnRenamed("os", "more")
    out = own.join(more, ["s", "p"], "full")
    values = F.when(F.col("replaces"), F.col("more")).otherwise(F.array_union(F.coalesce("os", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("s", "p", F.array_sort(values).alias("os"), F.col("more").isNotNull().alias("supplemented"))


def supplement_word(triples: DataFrame, same_as: str, other_form: str, namespace: str) -> DataFrame:
    """(s, forms): other forms of a word with those of the entries of ``namespace`` that it is the same as."""
    entries = _links(triples, same_as, "s", "entry").where(F.col("entry").startswith(f"<{namespace}"))
    theirs = entries.join(_links(triples, other_form, "entry", "form"), "entry").select("s", "form")
    own = _links(triples, other_form, "s", "form").join(entries.select("s").distinct(), "s", "left_semi")
    return own.unionByName(theirs).groupBy("s").agg(F.array_sort(F.collect_set("form")).alias("forms"))


def expanded_entity(triples: DataFrame, base: DataFrame, subjects: DataFrame, degrees: DataFrame, label: str, supers: dict[str, set[str]] | None = None, gather: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """(s, p, o, pos, label, inferred, entity, supplemented) of the asked subjects, what a page of a resource shows.

    Values of each predicate by indegree, with their labels, whether they are inferred only, and blank nodes folded to what is said of them.
    With ``supers`` predicates go whose values all stand under a more specific one. ``gather`` names, for a predicate, what
    is told under it of other resources: pairs (link, predicate), whose values take the place of the subject's own.
    Everything starts from the statements of the subjects in ``triples``, which may be inferred from those around them
    alone; labels, gathered values and blank nodes come from ``base``.
    """
    asked = subjects.select(F.col("node").alias("s")).distinct()
    rows = triples.join(F.broadcast(asked), "s", "left_semi").select("s", "p", "o").distinct()  # the subjects that a user asked for
    if supers:
        rows = prune_superproperties(rows, supers)
    rows = write_table(rows.withColumn("supplemented", F.lit(False)), "asked")
    for predicate, links in (gather or {}).items():
        for link, told in links:
            linked = rows.where(F.col("p") == link).select("s", F.col("o").alias("m"))
            values = base.where(F.col("p") == told).select(F.col("s").alias("m"), "o").join(linked, "m").select("s", F.lit(predicate).alias("p"), "o").distinct()
            values = write_table(values.withColumn("supplemented", F.lit(True)), "gathered")
            rows = rows.join(values.select("s", "p").distinct(), ["s", "p"], "left_anti").select("s", "p", "o", "supplemented").unionByName(values)
    ranked = rows.join(degrees.withColumnRenamed("node", "o"), "o", "left").withColumn("indegree", F.coalesce("indegree", F.lit(0)))
    ranked = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("s", "p").orderBy(F.desc("indegree"), "o")))
    ranked = write_table(ranked.select("s", "p", "o", "pos", "supplemented"), "ranked")
    named = resource_labels(base, ranked.select(F.col("o").alias("node")), label).groupBy("node").agg(F.min("label").alias("label"))
    made = raw_vs_inferred(base, ranked).withColumn("inferred", F.lit(True))
    out = ranked.join(named.withColumnRenamed("node", "o"), "o", "left").join(made, ["s", "p", "o"], "left")
    blanks = ranked.where(F.col("o").startswith("_:")).select(F.col("o").alias("src")).distinct()
    if blanks.isEmpty():
        out = out.withColumn("entity", F.lit(None).cast("string"))
    else:
        # what the subjects' blank nodes lead to, through blank nodes alone
        inner = base.where(F.col("s").startswith("_:"))
        hops = inner.where(F.col("o").startswith("_:")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        reached = blanks.union(reachable(hops, blanks.withColumnRenamed("src", "node")).select("dst")).distinct()
        trees = blank_node_trees(inner.join(reached.withColumnRenamed("src", "s"), "s", "left_semi"), supers)
        out = out.join(trees.select(F.col("node").alias("o"), "entity"), "o", "left")
    return out.select("s", "p", "o", "pos", "label", F.coalesce("inferred", F.lit(False)).alias("inferred"), "entity", "supplemented")


def displayed_resources(rows: DataFrame) -> DataFrame:
    """(s, node): the IRIs that stand in a display of (s, p, o), as predicate or value."""
    both = rows.select("s", F.col("p").alias("node")).union(rows.select("s", "o"))
    return both.where(F.col("node").startswith("<")).distinct()


def truncated_values(weighted: DataFrame, most: int = 150) -> DataFrame:
    """(s, p, kept, deferred): the first values by ``pos`` and those left for a second request."""
    group = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "o")))), lambda x: x["o"])
    return weighted.groupBy("s", "p").agg(group(F.col("pos") <= most).alias("kept"), group(F.col("pos") > most).alias("deferred"))


def merge_deferred(shown: DataFrame, later: DataFrame) -> DataFrame:
    """(s, p, os): values shown with those that came later after them."""
    out = shown.join(later.withColumnRenamed("os", "more"), ["s", "p"], "full")
    none = F.array().cast("array<string>")
    return out.select("s", "p", F.concat(F.coalesce("os", none), F.coalesce("more", none)).alias("os"))


def is_semantic(predicate: Column, namespace: str, but: list[str], also: list[str]) -> Column:
    """Whether a predicate relates meanings: all of a namespace but some, and some others."""
    return (predicate.startswith(f"<{namespace}") & ~predicate.isin(*but)) | predicate.isin(*also)


# --- labels


def canonical_labels(rows: DataFrame, group: str = "synset", label: str = "label", senses: str | None = None, most: int = 2) -> DataFrame:
    """(group, label, pos) of the most significant labels: by entry key, then by the senses of its word, most first, then by name; one for each word."""
    tie = [F.desc(senses)] if senses else []
    word = F.regexp_extract(label, r"^(.*?)_\S*$", 1)
    rows = rows.where(F.col(label) != "…").withColumn("_word", F.when(word == "", F.col(label)).otherwise(word)).withColumn("_key", L.entry_sort_key(F.col(label)))
    order = [F.col("_key"), *tie, F.col(label)]
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_word").orderBy(*order))).where("_n = 1")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return rows.where(F.col("pos") <= most).select(group, label, "pos")


def short_labels(rows: DataFrame, group: str = "synset", label: str = "label", senses: str | None = None) -> DataFrame:
    """(group, short): the canonical labels and an ellipsis, for groups in which something is left out."""
    kept = canonical_labels(rows, group, label, senses).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", label))), lambda x: x[label]).alias("kept"))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = kept.join(sizes, group).where(F.size("kept") < F.col("n"))
    return out.select(group, F.concat(F.lit("{"), F.array_join("kept", "; "), F.lit("; …}")).alias("short"))


def cloud_weights(items: DataFrame, item: str, weight: str, most: int = 10_000) -> DataFrame:
    """(item, size, highlight): sizes from 0 to 1 for a word cloud of at most ``most`` items, by rank alone.

    From the lowest up, each step is the logarithm of the size so far, 1 at least.
    Of more than 30 items those near the top get half the range more.
    """
    import math

    n = items.count()
    if n > most:
        raise ValueError(f"a cloud of {n} items")
    values = [1.0]
    while len(values) < n:
        values.append(values[-1] + max(1.0, math.log(values[-1])))
    span = values[-1] - values[0]
    bar, bonus = (values[-1] - math.sqrt(span), span / 2) if n > 30 else (values[-1], 0.0)
    steps = [(i + 1, (v - 1 + (bonus if v > bar else 0.0)) / (span + bonus) if span else 0.0, v > bar) for i, v in enumerate(values)]
    ranked = items.withColumn("_n", F.row_number().over(Window.orderBy(F.col(weight), F.desc(item))))  # bounded by ``most``
    return ranked.join(items.sparkSession.createDataFrame(steps, "_n int, size double, highlight boolean"), "_n").select(item, "size", "highlight")


def lemma_spans(rows: DataFrame, lemma: str = "lemma", text: str = "text") -> DataFrame:
    """The rows plus ``spans`` (start, end): where the lemma stands as the beginning of a word, in any case, endings included."""
    lower, out = F.lower(text), F.lower(lemma)
    at = F.transform(F.sequence(F.lit(0), F.length(lower)), lambda i: F.when((F.length(out) > 0) & (F.substring(lower, i + 1, F.length(out)) == out), i))
    starts = F.filter(at, lambda i: i.isNotNull() & ((i == 0) | ~F.substring(lower, i, F.lit(1)).rlike(r"\p{L}")))
    end = lambda i: i + F.length(out) + F.length(F.regexp_extract(F.substring(lower, i + F.length(out) + 1, F.length(lower)), r"^\p{L}*", 0))
    return rows.withColumn("spans", F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), end(i).cast("int").alias("end"))))


# --- search


def search_forms(triples: DataFrame, lemma: str, written: list[str], forms: list[str], same_as: str, evokes: str) -> DataFrame:
    """(synset): what words evoke that have the written form ``lemma`` (a term), by a form of their own or of an entry that they are the same as."""
    form = write_table(triples.where(F.col("p").isin(*written) & (F.col("o") == lemma)).select(F.col("s").alias("form")), "forms")
    holders = triples.where(F.col("p").isin(*forms)).select(F.col("s").alias("word"), F.col("o").alias("form")).join(form, "form", "left_semi").select("word")
    own = write_table(form.select(F.col("form").alias("word")).union(holders), "words")
    through = _links(triples, same_as, "word", "entry").join(own.select(F.col("word").alias("entry")), "entry", "left_semi").select("word")
    return _links(triples, evokes, "word", "synset").join(own.union(through).distinct(), "word", "left_semi").select("synset").distinct()


def completion_index(triples: DataFrame, word_written: str, forms: str, form_written: str, same_as: str) -> DataFrame:
    """(key, form, lemmas): search keys of written words, which keep their own spelling, and of inflections with the words they belong to."""
    words = triples.where(F.col("p") == word_written).select(F.col("s").alias("word"), T.lex(F.col("o")).alias("lemma"))
    inflected = _links(triples, same_as, "word", "entry").join(_links(triples, forms, "entry", "form"), "entry").join(_links(triples, form_written, "form", "rep"), "form")
    inflected = inflected.join(words, "word").select(T.lex(F.col("rep")).alias("form"), "lemma").where("form <> lemma and form not like '%-'")
    key = lambda c: F.lower(F.trim(F.col(c)))
    plain = words.groupBy(key("lemma").alias("key")).agg(F.max("lemma").alias("word"))
    bent = inflected.groupBy(key("form").alias("key")).agg(F.min("form").alias("first"), F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    out = plain.join(bent, "key", "full").where("key <> ''")
    return out.select("key", F.coalesce("word", "first").alias("form"), F.coalesce("lemmas", F.array().cast("array<string>")).alias("lemmas"))


def search_kind(asked: str) -> str:
    """What a search box was given: an IRI in brackets, a link, a qualified name, nothing, or a lemma."""
    text = asked.strip()
    if not text:
        return "nothing"
    if text.startswith("<") and text.endswith(">"):
        return "iri"
    if text.startswith(("http://", "https://")):
        return "link"
    prefix, colon, name = text.partition(":")
    return "qname" if colon and prefix in T.PREFIXES and name and " " not in text else "lemma"


# --- taxonomy beside the measures


def node_pos(triples: DataFrame, lexfile: str, member: str, pos: str) -> DataFrame:
    """(node, pos) of synsets: the part of speech of a word that evokes it where there is one (the first by name), else the head of its lexicographer file."""
    filed = triples.where(F.col("p") == lexfile).select(F.col("s").alias("node"), L.lexfile_pos(T.lex(F.col("o"))).alias("filed")).groupBy("node").agg(F.min("filed").alias("filed"))
    said = _links(triples, member, "word", "node").join(_links(triples, pos, "word", "said"), "word").groupBy("node").agg(F.min("said").alias("said"))
    said = said.withColumn("said", F.regexp_extract("said", r"([^/#]+)>$", 1))
    return filed.join(said, "node", "full").select("node", F.coalesce("said", "filed").alias("pos"))


def ancestry(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, parent, child, level): the edges of the graph above each seed, by the shortest distance of the child; cycles end."""
    above = distances(edges, seeds)
    return above.join(edges.select(F.col("src").alias("ancestor"), F.col("dst").alias("parent")).distinct(), "ancestor").select("node", "parent", F.col("ancestor").alias("child"), F.col("dist").alias("level"))


def relations_in_use(triples: DataFrame, type_predicate: str, kind: str, labels: DataFrame) -> DataFrame:
    """(p, n, label): predicates between resources of one kind with their counts, and a label where the schema has one."""
    members = triples.where((F.col("p") == type_predicate) & (F.col("o") == kind)).select(F.col("s").alias("m")).distinct()
    rows = triples.join(members.withColumnRenamed("m", "s"), "s", "left_semi").where(F.col("o").startswith("<")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(labels.select("p", "label")), "p", "left")  # schema rows only


def known_relations(triples: DataFrame, typed: DataFrame, cross: list[str], labels: DataFrame) -> DataFrame:
    """(p, cross, label): relations that a schema types as such (p), and of the relations to other data sets those in use, each probed by itself."""
    used = triples.where(F.col("p").isin(*cross)).select("p").distinct()
    rows = typed.select("p").distinct().withColumn("cross", F.lit(False)).unionByName(used.join(typed.select("p"), "p", "left_anti").withColumn("cross", F.lit(True)))
    return rows.join(F.broadcast(labels.select("p", "label")), "p", "left")  # schema rows only


def grouped_relations(relations: DataFrame, groups: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """(p, grp, place): relations by the first group whose pattern matches them, groups in their order, then by name."""
    grp, rank = F.lit(other), F.lit(len(groups))
    for i, (name, pattern) in reversed(list(enumerate(groups))):
        grp = F.when(F.col("p").rlike(pattern), name).otherwise(grp)
        rank = F.when(F.col("p").rlike(pattern), i).otherwise(rank)
    return relations.select("p", grp.alias("grp"), rank.alias("_rank")).withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("p"))).select("p", "grp", F.col("_rank").alias("rank"), "place")


def largest_parents(edges: DataFrame, n: int) -> DataFrame:
    """(node, children): the n nodes with most children, for warming a cache."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("children")).orderBy(F.desc("children"), "node").limit(n)


#: Rows that one row of the dealt pairs is written out as, at most.
PAIR_ROWS = 100_000
#: Shares that the names of a group are dealt into, so that a large group is paired by many tasks.
PAIR_SHARES = 32


def clones(rows: DataFrame, group: list[str], name: str, member: str) -> DataFrame:
    """(name, b): the names of each two rows of a group whose names and members both differ, once for every such two rows, in either order.

    Pairs are made of the different names of a group with their numbers of rows, less the two rows of one
    member, and only then written out as often as they stand, in even pieces. So what is joined and held
    grows with the names, not with the pairs of rows.
    """
    one = write_table(rows.dropna(subset=[*group, name, member]).groupBy(*group, member, name).agg(F.count(F.lit(1)).alias("n")), "members")
    n = write_table(one.groupBy(*group, name).agg(F.sum("n").alias("n")), "names")
    share = F.pmod(F.xxhash64(name), F.lit(PAIR_SHARES)).cast("int")
    left = n.withColumn("_share", share)
    right = n.select(*group, F.col(name).alias("b"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(PAIR_SHARES - 1))).alias("_share"))
    pairs = left.join(right, [*group, "_share"]).where(F.col(name) != F.col("b"))
    other = one.select(*group, member, F.col(name).alias("b"), F.col("n").alias("m"))
    same = one.join(other, [*group, member]).where(F.col(name) != F.col("b")).groupBy(name, "b").agg(F.sum(F.col("n") * F.col("m")).alias("less"))
    times = pairs.groupBy(name, "b").agg(F.sum(F.col("n") * F.col("m")).alias("times")).join(same, [name, "b"], "left")
    left_over = times.select(name, "b", (F.col("times") - F.coalesce("less", F.lit(0))).alias("times")).where("times > 0")
    pieces = left_over.select(name, "b", "times", F.explode(F.expr(f"sequence(0L, (times - 1) div {PAIR_ROWS})")).alias("_piece"))
    pieces = pieces.select(name, "b", F.least(F.lit(PAIR_ROWS), F.col("times") - F.col("_piece") * PAIR_ROWS).cast("int").alias("_rows"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return pieces.repartition(tasks).select(name, "b", F.explode(F.sequence(F.lit(1), F.col("_rows")))).select(name, "b")


# --- exports


def without_ids(rows: DataFrame, column: str, excluded: DataFrame) -> DataFrame:
    """Rows but for those whose ``column`` is among the excluded (id)."""
    return rows.join(excluded.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def without_pairs(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges (src, dst) that are excluded in neither direction."""
    both = excluded.select("src", "dst").union(excluded.select("dst", "src"))
    return edges.join(both.distinct(), ["src", "dst"], "left_anti")


def cross_kind(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges whose ends have different kinds (node, pos); an end without one differs from nothing."""
    a, b = kinds.select(F.col("node").alias("src"), F.col("pos").alias("a")), kinds.select(F.col("node").alias("dst"), F.col("pos").alias("b"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").select("src", "dst").distinct()


def single_claims(links: DataFrame, target: str) -> DataFrame:
    """Links whose target stands in one row only."""
    return links.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(target))).where("_n = 1").drop("_n")


def one_of_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the last value by name."""
    return rows.groupBy(key).agg(F.max(value).alias(value))


def all_of_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values in order, repeats kept)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(value))


def matching_entries(rows: DataFrame) -> DataFrame:
    """(word, entry) from (word, headword, entry, lemma): entries of the headword's own lemma where several lemmas are linked and one is it, else all."""
    by = Window.partitionBy("word")
    kept = rows.withColumn("lemmas", F.size(F.collect_set("lemma").over(by))).withColumn("same", F.col("lemma") == F.col("headword"))
    kept = kept.withColumn("some", F.max("same").over(by))
    return kept.where("lemmas = 1 or not some or same").select("word", "entry").distinct()


def sentiment_labels(rows: DataFrame) -> DataFrame:
    """(subject, labels) from (subject, polarity, value): none for several polarities; the value only where there is one whose sign agrees."""
    out = rows.groupBy("subject").agg(F.count_distinct("polarity").alias("n"), F.min("polarity").alias("polarity"), F.count_distinct("value").alias("values"), F.min("value").alias("value"))
    agrees = ((F.col("polarity") == "positive") & (F.col("value") > 0)) | ((F.col("polarity") == "neutral") & (F.col("value") == 0)) | ((F.col("polarity") == "negative") & (F.col("value") < 0))
    both = F.array("polarity", F.col("value").cast("string"))
    return out.where("n = 1").select("subject", F.when((F.col("values") == 1) & agrees, both).otherwise(F.array("polarity")).alias("labels"))


def relation_roles(relations: DataFrame) -> DataFrame:
    """(rel, obverse, subject_role, object_role): two names for inverse relations, one for a symmetric one, and a made-up one where there is no obverse."""
    name = lambda c: F.regexp_extract(c, r"([^/#]+)>$", 1)
    subject = F.when(F.col("obverse").isNull(), F.concat(F.lit("involved_"), name("rel"))).otherwise(name("obverse"))
    return relations.select("rel", "obverse", subject.alias("subject_role"), name("rel").alias("object_role"))


def member_order(senses: DataFrame, degrees: DataFrame) -> DataFrame:
    """(synset, sense, listing_order) from (synset, sense, label): the rank of the synset by indegree, then the place of the sense in it."""
    top = degrees.agg(F.coalesce(F.max("indegree"), F.lit(0)).alias("top"))
    rows = senses.withColumn("_key", L.entry_sort_key(F.col("label"))).groupBy("synset", "sense").agg(F.min(F.struct("_key", "label")).alias("_best"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("synset").orderBy("_best", "sense")) - 1)
    size = rows.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("size"))
    rows = rows.join(degrees.withColumnRenamed("node", "synset"), "synset", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(size))  # one row each
    return rows.select("synset", "sense", ((F.col("top") - F.coalesce("indegree", F.lit(0))) * F.col("size") + F.col("place")).alias("listing_order"))


def relation_members(pairs: DataFrame, members: DataFrame, rel: str, subject_role: str, object_role: str) -> DataFrame:
    """(rel, a, b, ref, role, listing_order): the senses at both ends of each pair (a, b); pairs with an end without senses are left out."""
    able = members.select("synset").distinct()
    pairs = pairs.join(able.withColumnRenamed("synset", "a"), "a", "left_semi").join(able.withColumnRenamed("synset", "b"), "b", "left_semi")
    end = lambda c, role: pairs.join(members.withColumnRenamed("synset", c), c).select(F.lit(rel).alias("rel"), "a", "b", F.col("sense").alias("ref"), F.lit(role).alias("role"), "listing_order")
    return end("a", subject_role).unionByName(end("b", object_role))


def synonym_relations(members: DataFrame) -> DataFrame:
    """(synset, members) of synsets with two senses or more, in listing order."""
    rows = members.groupBy("synset").agg(F.array_sort(F.collect_list(F.struct("listing_order", F.col("sense").alias("ref")))).alias("members"))
    return rows.where(F.size("members") > 1)
