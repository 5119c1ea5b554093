"""Named queries over the dictionary, rewriting and export operators, each with an oracle."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import labels as L
from lexiloom.functions import terms as T
from lexiloom.functions.tables import write_table
from lexiloom.operators import etl, lexicon, taxonomy
from lexiloom.operators.infer import infer, superproperties
from lexiloom.plans.lexical import sql
from lexiloom.plans.registry import _CONCEPTS, _H, _INDEG, _INFERRED, HYPER, ORACLES, QUERIES, _graph, _indegree, ex, p, query
from lexiloom.sources.relational import EX, LABEL, SCHEMA, TYPE
from lexiloom.sources.relational import view_triples as _view_triples

__all__ = ["ORACLES", "QUERIES"]

view_triples = partial(_view_triples, dictionary=True)
_LEX = lambda c: f"regexp_extract({c}, '^\"(.*)\"', 1)"


def _nodes(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(ex(n),) for n in names], "node string")


def _of(triples: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    return triples.where(F.col("p") == ex(predicate)).select(F.col("s").alias(a), F.col("o").alias(b))


# --- entities


@query(sql(f"SELECT DISTINCT s, p, o FROM t WHERE s IN ('{ex('part-12')}', '{ex('word-red_bolt')}')"))
def raw_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.createDataFrame(SCHEMA, "s string, p string, o string")
    return lexicon.raw_entity(schema, view_triples(spark, sf_dir), _nodes(spark, "part-12", "word-red_bolt"))


_SENSES = f"m AS (SELECT a.s, b.p, b.o FROM t a JOIN t b ON b.s = a.o AND b.p IN ('{ex('example')}', '{ex('source')}') WHERE a.{p('lexicalizedSense')})"


@query(
    sql(
        "SELECT s, p, string_agg(DISTINCT o, ' | ' ORDER BY o) AS os, bool_or(more) AS supplemented FROM (SELECT s, p, o, true AS more FROM m UNION ALL "
        f"SELECT s, p, o, false FROM t WHERE s IN (SELECT s FROM t WHERE {p('lexicalizedSense')})) GROUP BY s, p",
        _SENSES,
    )
)
def supplemented_synsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.supplement_synset(view_triples(spark, sf_dir), ex("lexicalizedSense"), ex("example"), ex("source"), ex("ili"), ex("definition"))
    return out.select("s", "p", F.array_join("os", " | ").alias("os"), "supplemented")


@query(sql(f"SELECT a.s, string_agg(DISTINCT f.o, ' | ' ORDER BY f.o) AS forms FROM t a JOIN t f ON f.s = a.o AND f.{p('otherForm')} WHERE a.{p('sameAs')} GROUP BY a.s"))
def supplemented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.supplement_word(view_triples(spark, sf_dir, only=[ex("sameAs"), ex("otherForm")]), ex("sameAs"), ex("otherForm"), f"{EX}entry-")
    return out.select("s", F.array_join("forms", " | ").alias("forms"))


_ASKED = ("part-1", "part-12", "nation-3")
_SUBJECTS = "(" + ", ".join(f"'{ex(n)}'" for n in _ASKED) + ")"
_PAGES = (*_ASKED, "synset-Brand10_MEDIUM")
_PAGE = "(" + ", ".join(f"'{ex(n)}'" for n in _PAGES) + ")"


@query(
    sql(
        "SELECT r.s, r.p, r.o, CAST(row_number() OVER (PARTITION BY r.s, r.p ORDER BY coalesce(indegree, 0) DESC, r.o) AS INTEGER) AS pos, l.label, NOT EXISTS (SELECT 1 FROM t WHERE t.s = r.s AND t.p = r.p AND t.o = r.o) AS inferred, "
        "CASE WHEN r.o LIKE '\\_:%' ESCAPE '\\' THEN '[ ' || (SELECT string_agg(t.p || ' ' || t.o, ' ; ' ORDER BY t.p) FROM t WHERE t.s = r.o) || ' ]' END AS entity, supplemented "
        f"FROM (SELECT DISTINCT s, p, o, false AS supplemented FROM i WHERE s IN {_PAGE} AND p NOT IN ('{ex('broader')}', '{ex('narrower')}', '{ex('related')}') UNION ALL "
        f"SELECT DISTINCT a.s, b.p, b.o, true FROM t a JOIN t b ON b.s = a.o AND b.{p('example')} WHERE a.{p('lexicalizedSense')} AND a.s IN {_PAGE}) r "
        f"LEFT JOIN deg ON deg.node = r.o LEFT JOIN (SELECT s, min(o) AS label FROM t WHERE p = '{LABEL}' GROUP BY s) l ON l.s = r.o",
        _INFERRED, _CONCEPTS, _INDEG,
    )
)
def expanded_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four resources: ranked, labelled and pruned values, nested nodes, and the examples of a synset's senses. Only what touches them is inferred from."""
    base, subjects = view_triples(spark, sf_dir), [ex(n) for n in _PAGES]
    near = base.where(F.col("s").isin(*subjects) | F.col("o").isin(*subjects))
    gather = {ex("example"): [(ex("lexicalizedSense"), ex("example"))]}
    return lexicon.expanded_entity(infer(near, SCHEMA), base, _nodes(spark, *_PAGES), _indegree(spark, sf_dir), LABEL, superproperties(SCHEMA), gather)


@query(sql(f"SELECT DISTINCT s, x AS node FROM (SELECT s, p AS x FROM t UNION ALL SELECT s, o FROM t) WHERE s IN {_SUBJECTS} AND x LIKE '<%'"))
def displayed_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir)
    return lexicon.displayed_resources(t.where(F.col("s").isin(ex("part-1"), ex("part-12"), ex("nation-3"))))


@query(
    sql(
        "SELECT s, p, coalesce(string_agg(o, ' ' ORDER BY pos) FILTER (pos <= 20), '') AS kept, coalesce(string_agg(o, ' ' ORDER BY pos) FILTER (pos > 20), '') AS deferred "
        f"FROM (SELECT s, p, o, row_number() OVER (PARTITION BY s, p ORDER BY coalesce(indegree, 0) DESC, o) AS pos FROM t LEFT JOIN deg ON deg.node = t.o WHERE {p('supplies')}) GROUP BY s, p",
        _CONCEPTS, _INDEG,
    )
)
def truncated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taxonomy.weighted_relations(view_triples(spark, sf_dir, only=[ex("supplies")]), _indegree(spark, sf_dir))
    return lexicon.truncated_values(rows, 20).select("s", "p", F.array_join("kept", " ").alias("kept"), F.array_join("deferred", " ").alias("deferred"))


@query(sql(f"SELECT s, p, string_agg(o, ' ' ORDER BY o) AS os FROM t WHERE {p('supplies')} GROUP BY s, p"))
def merged_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view_triples(spark, sf_dir, only=[ex("supplies")]).select("s", "p", "o", F.lit(0).alias("indegree"))
    rows = taxonomy.weighted_relations(rows.select("s", "p", "o"), spark.createDataFrame([], "node string, indegree long"))
    cut = lexicon.truncated_values(rows, 20)
    return lexicon.merge_deferred(cut.select("s", "p", F.col("kept").alias("os")), cut.select("s", "p", F.col("deferred").alias("os"))).select("s", "p", F.array_join("os", " ").alias("os"))


@query(sql(f"SELECT p, count(*) AS n FROM t WHERE (p LIKE '<{EX}%' AND p NOT IN ('{ex('brand')}', '{ex('size')}')) OR p = '{LABEL}' GROUP BY p"))
def semantic_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir)
    return t.where(lexicon.is_semantic(F.col("p"), EX, [ex("brand"), ex("size")], [LABEL])).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# --- labels

_W = "w AS (SELECT concat(p_brand, '_', p_type) AS synset, p_name AS label, count(*) AS senses FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY synset ORDER BY senses DESC, label) AS pos, count(*) OVER (PARTITION BY synset) AS n FROM w)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.groupBy(F.concat("p_brand", F.lit("_"), "p_type").alias("synset"), F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("senses"))


@query(f"WITH {_W} SELECT synset, label, CAST(pos AS INTEGER) AS pos FROM r WHERE pos <= 2")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.canonical_labels(_members(spark, sf_dir), senses="senses")


@query(f"WITH {_W} SELECT synset, '{{' || string_agg(label, '; ' ORDER BY pos) || '; …}}' AS short FROM r WHERE pos <= 2 AND n > 2 GROUP BY synset")
def regenerated_short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.short_labels(_members(spark, sf_dir), senses="senses")


@query("SELECT p_partkey, p_name || ', ' || lower(p_brand) AS indicator, p_name || ' §' || p_size || ', ' || lower(p_brand) AS marked, '{' || p_name || '; ' || lower(p_brand) || '}' AS stripped FROM part")
def indicator_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.concat(F.lit("{"), "p_name", F.lit("_§"), F.col("p_size").cast("string"), F.lit("; "), F.lower("p_brand"), F.lit("}"))
    return part.select("p_partkey", L.synset_indicator(label).alias("indicator"), L.marked_indicator(label).alias("marked"), L.strip_sense_markers(label).alias("stripped"))


@query(
    "WITH x AS (SELECT p_partkey, lower('A ' || p_name || 's, ' || upper(p_name) || '-like ' || p_brand) AS text, lower(split_part(p_name, ' ', 1)) AS lemma FROM part) "
    "SELECT p_partkey, '2-' || (2 + length(lemma)) || ' ' || (length(text) - position(reverse(lemma) IN reverse(text)) - length(lemma) + 1) || '-' || (length(text) - position(reverse(lemma) IN reverse(text)) + 1) AS spans FROM x"
)
def headword_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("A "), "p_name", F.lit("s, "), F.upper("p_name"), F.lit("-like "), "p_brand")
    rows = lexicon.lemma_spans(part.select("p_partkey", text.alias("text"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("lemma")))
    return rows.select("p_partkey", F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ").alias("spans"))


@query(
    "WITH RECURSIVE c AS (SELECT p_brand AS item, count(*) AS n FROM part GROUP BY 1), r AS (SELECT item, CAST(row_number() OVER (ORDER BY n, item DESC) AS INTEGER) AS k FROM c), "
    "w AS (SELECT 1 AS k, 1.0::DOUBLE AS v UNION ALL SELECT k + 1, v + greatest(1.0, ln(v)) FROM w WHERE k < (SELECT count(*) FROM c)), top AS (SELECT max(v) AS high FROM w) "
    "SELECT item, round((v - 1) / (high - 1), 6) AS size, false AS highlight FROM r JOIN w USING (k), top"
)
def cloud_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return lexicon.cloud_weights(items, "item", "n").select("item", F.round("size", 6).alias("size"), "highlight")


# --- search


@query(
    sql(
        f"SELECT DISTINCT e.o AS synset FROM t e WHERE e.{p('evokes')} AND (e.s IN (SELECT s FROM t WHERE {p('canonicalForm')} AND o IN (SELECT s FROM f)) "
        f"OR e.s IN (SELECT a.s FROM t a JOIN t b ON b.s = a.o AND b.{p('otherForm')} WHERE a.{p('sameAs')} AND b.o IN (SELECT s FROM f)))",
        f"f AS (SELECT s FROM t WHERE {p('rep')} AND o = '\"red widgets\"@en')",
    )
)
def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.search_forms(view_triples(spark, sf_dir, only=[ex(n) for n in ("rep", "canonicalForm", "otherForm", "sameAs", "evokes")]), '"red widgets"@en', [ex("rep")], [ex("canonicalForm"), ex("otherForm")], ex("sameAs"), ex("evokes"))


@query(
    sql(
        "SELECT coalesce(w.key, i.key) AS key, coalesce(w.form, i.form) AS form, coalesce(i.lemmas, '') AS lemmas FROM w FULL JOIN i ON i.key = w.key",
        f"w AS (SELECT lower(trim({_LEX('o')})) AS key, max({_LEX('o')}) AS form FROM t WHERE {p('writtenRep')} GROUP BY 1)",
        f"i AS (SELECT lower(trim({_LEX('r.o')})) AS key, min({_LEX('r.o')}) AS form, string_agg(DISTINCT {_LEX('l.o')}, '|' ORDER BY {_LEX('l.o')}) AS lemmas FROM t a JOIN t b ON b.s = a.o AND b.{p('otherForm')} "
        f"JOIN t r ON r.s = b.o AND r.{p('rep')} JOIN t l ON l.s = a.s AND l.{p('writtenRep')} WHERE a.{p('sameAs')} GROUP BY 1)",
    )
)
def completion_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lexicon.completion_index(view_triples(spark, sf_dir, only=[ex(n) for n in ("writtenRep", "otherForm", "rep", "sameAs")]), ex("writtenRep"), ex("otherForm"), ex("rep"), ex("sameAs"))
    return out.select("key", "form", F.array_join("lemmas", "|").alias("lemmas"))


# --- taxonomy

_POS_OF = (
    f"said AS (SELECT e.o AS node, min(regexp_extract(q.o, '([^/#]+)>$', 1)) AS pos FROM t e JOIN t q ON q.s = e.s AND q.{p('partOfSpeech')} WHERE e.{p('evokes')} GROUP BY 1), "
    f"pos AS (SELECT coalesce(f.s, said.node) AS node, coalesce(said.pos, split_part({_LEX('f.o')}, '.', 1)) AS pos FROM (SELECT * FROM t WHERE {p('lexfile')}) f FULL JOIN said ON said.node = f.s)"
)


@query(sql("SELECT node, pos FROM pos", _POS_OF))
def node_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.node_pos(view_triples(spark, sf_dir, only=[ex("lexfile"), ex("evokes"), ex("partOfSpeech")]), ex("lexfile"), ex("evokes"), ex("partOfSpeech"))


_SEED = ex("part-1999")
_UP = f"up AS (SELECT '{_SEED}' AS node, 0 AS level UNION SELECT h.dst, up.level + 1 FROM up JOIN h ON h.src = up.node WHERE up.level < 64)"


@query(sql(f"SELECT '{_SEED}' AS node, h.dst AS parent, h.src AS child, l.level FROM (SELECT node, min(level) AS level FROM up GROUP BY node) l JOIN h ON h.src = l.node", _H, _UP, recursive=True))
def hypernym_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.ancestry(_graph(spark, sf_dir), _nodes(spark, "part-1999"))


@query(sql(f"SELECT t.p, count(*) AS n, CASE t.p WHEN '{HYPER}' THEN 'hypernym' END AS label FROM t WHERE o LIKE '<%' AND s IN (SELECT s FROM t WHERE p = '{TYPE}' AND o = '{ex('Concept')}') GROUP BY t.p"))
def relations_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([(HYPER, "hypernym")], "p string, label string")
    return lexicon.relations_in_use(view_triples(spark, sf_dir), TYPE, ex("Concept"), named)


@query(
    sql(
        "SELECT p, grp, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY grp ORDER BY p) AS INTEGER) AS place FROM (SELECT DISTINCT p, "
        "CASE WHEN regexp_matches(p, '[hH]ypernym') THEN 'taxonomy' WHEN regexp_matches(p, 'label|Label|Rep') THEN 'labels' ELSE 'other' END AS grp, CASE WHEN regexp_matches(p, '[hH]ypernym') THEN 0 WHEN regexp_matches(p, 'label|Label|Rep') THEN 1 ELSE 2 END AS rank FROM t)"
    )
)
def grouped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = view_triples(spark, sf_dir).select("p").distinct()
    return lexicon.grouped_relations(relations, [("taxonomy", "[hH]ypernym"), ("labels", "label|Label|Rep")])


@query(sql("SELECT dst AS node, count(DISTINCT src) AS children FROM h GROUP BY dst ORDER BY children DESC, node LIMIT 25", _H))
def largest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.largest_parents(_graph(spark, sf_dir), 25)


# --- exports

_KINDS = f"k2 AS (SELECT a.o AS node, {_LEX('f.o')} AS pos FROM t a JOIN t f ON f.s = a.s AND f.{p('lexfile')} WHERE a.{p('lexicalizedSense')}), x AS (SELECT DISTINCT h.src, h.dst FROM h JOIN k2 a ON a.node = h.src JOIN k2 b ON b.node = h.dst WHERE a.pos <> b.pos)"


def _file_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("lexicalizedSense"), ex("lexfile")])
    return _of(t, "lexicalizedSense", "synset", "node").join(_of(t, "lexfile", "synset", "file"), "synset").select("node", T.lex(F.col("file")).alias("pos"))


@query(sql("SELECT src, dst FROM x", _H, _KINDS))
def cross_kind_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.cross_kind(_graph(spark, sf_dir), _file_of(spark, sf_dir))


@query(sql("SELECT h.src, h.dst FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE (x.src = h.src AND x.dst = h.dst) OR (x.src = h.dst AND x.dst = h.src))", _H, _KINDS))
def supported_hypernyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir).select("src", "dst")
    return lexicon.without_pairs(graph, lexicon.cross_kind(graph, _file_of(spark, sf_dir)))


@query(sql(f"SELECT s AS synset, o AS ili FROM (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM t WHERE {p('eqHypernym')} OR {p('ili')}) WHERE n = 1"))
def single_ili_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("eqHypernym"), ex("ili")])
    return lexicon.single_claims(t.select(F.col("s").alias("synset"), F.col("o").alias("ili")), "ili")


@query("SELECT p_brand AS key, max(p_name) AS value FROM part GROUP BY 1")
def index_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return lexicon.one_of_each(rows, "key", "value")


@query("SELECT p_brand AS key, string_agg(p_name, '|' ORDER BY p_name) AS value FROM part GROUP BY 1")
def index_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return lexicon.all_of_each(rows, "key", "value").select("key", F.array_join("value", "|").alias("value"))


@query(
    "WITH x AS (SELECT o_custkey AS word, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'none' END AS headword, o_orderpriority AS entry, o_orderstatus AS lemma FROM orders), "
    "y AS (SELECT *, lemma = headword AS same, max(CAST(lemma = headword AS INTEGER)) OVER (PARTITION BY word) AS any_same FROM x), z AS (SELECT word, count(DISTINCT lemma) AS n FROM x GROUP BY word) "
    "SELECT DISTINCT y.word, y.entry FROM y JOIN z ON z.word = y.word WHERE z.n = 1 OR any_same = 0 OR same"
)
def matching_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("none")
    return lexicon.matching_entries(o.select(F.col("o_custkey").alias("word"), head.alias("headword"), F.col("o_orderpriority").alias("entry"), F.col("o_orderstatus").alias("lemma")))


_FEEL = "x AS (SELECT p_brand || '/' || p_type AS subject, CASE WHEN p_size % 50 = 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN p_size % 3 = 0 THEN p_size % 2 + 1 END AS value FROM part)"


@query(
    f"WITH {_FEEL}, y AS (SELECT subject, min(polarity) AS polarity, count(DISTINCT value) AS n, min(value) AS value FROM x GROUP BY subject HAVING count(DISTINCT polarity) = 1) "
    "SELECT subject, polarity || CASE WHEN n = 1 AND ((polarity = 'positive' AND value > 0) OR (polarity = 'negative' AND value < 0)) THEN ' ' || value ELSE '' END AS labels FROM y"
)
def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.concat_ws("/", "p_brand", "p_type").alias("subject"), F.when(F.col("p_size") % 50 == 0, "negative").otherwise("positive").alias("polarity"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 2 + 1).alias("value"))
    return lexicon.sentiment_labels(rows).select("subject", F.array_join("labels", " ").alias("labels"))


_INVERSE = [(a, o) for a, pr, o in SCHEMA if pr.endswith("inverseOf>")]


@query(
    sql(
        "SELECT rel, obverse, CASE WHEN obverse IS NULL THEN 'involved_' || regexp_extract(rel, '([^/#]+)>$', 1) ELSE regexp_extract(obverse, '([^/#]+)>$', 1) END AS subject_role, regexp_extract(rel, '([^/#]+)>$', 1) AS object_role, n "
        f"FROM (SELECT t.p AS rel, v.obverse, count(*) AS n FROM t LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _INVERSE)}) v(rel, obverse) ON v.rel = t.p WHERE t.o LIKE '<%' AND t.p <> '{TYPE}' GROUP BY t.p, v.obverse)"
    )
)
def relation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role names of the relations that the view uses, with their inverses from the schema where it has one."""
    used = view_triples(spark, sf_dir).where(F.col("o").startswith("<") & (F.col("p") != TYPE)).groupBy(F.col("p").alias("rel")).agg(F.count(F.lit(1)).alias("n"))
    inverse = spark.createDataFrame(_INVERSE, "rel string, obverse string")
    relations = used.join(F.broadcast(inverse), "rel", "left")  # schema rows only
    return lexicon.relation_roles(relations).join(used, "rel")


_ORDER = (
    f"s0 AS (SELECT a.s AS synset, a.o AS sense, {_LEX('l.o')} AS label FROM t a JOIN t l ON l.s = a.o AND l.p = '{LABEL}' WHERE a.{p('lexicalizedSense')}), "
    "s1 AS (SELECT *, row_number() OVER (PARTITION BY synset ORDER BY label, sense) - 1 AS place FROM s0), "
    "s2 AS (SELECT s1.synset, s1.sense, CAST(((SELECT max(n) FROM e) - coalesce(e.n, 0)) * (SELECT max(place) + 1 FROM s1) + place AS BIGINT) AS listing_order FROM s1 LEFT JOIN e ON e.node = s1.synset)"
)
_EVOKED = f"e AS (SELECT o AS node, count(*) AS n FROM t WHERE {p('evokes')} GROUP BY o)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("lexicalizedSense"), LABEL, ex("evokes")])
    senses = _of(t, "lexicalizedSense", "synset", "sense").join(t.where(F.col("p") == LABEL).select(F.col("s").alias("sense"), T.lex(F.col("o")).alias("label")), "sense")
    degrees = _of(t, "evokes", "word", "node").groupBy("node").agg(F.count(F.lit(1)).alias("indegree"))
    return write_table(lexicon.member_order(senses, degrees), "members")


@query(sql("SELECT synset, sense, listing_order FROM s2", _EVOKED, _ORDER))
def member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("synset", "sense", F.col("listing_order").cast("long").alias("listing_order"))



@query(
    sql(
        "SELECT 'sibling' AS rel, a, b, ref, role, listing_order FROM (SELECT a, b, sense AS ref, 'first' AS role, listing_order FROM pr JOIN s2 ON s2.synset = a UNION ALL SELECT a, b, sense, 'second', listing_order FROM pr JOIN s2 ON s2.synset = b)",
        _EVOKED, _ORDER, f"pr AS (SELECT s AS a, '{ex('synset-Brand5_SMALL')}' AS b FROM t WHERE {p('variant')} AND s <> '{ex('synset-Brand5_SMALL')}' AND '{ex('synset-Brand5_SMALL')}' IN (SELECT synset FROM s2))",
    )
)
def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = ex("synset-Brand5_SMALL")
    pairs = _of(view_triples(spark, sf_dir, only=[ex("variant")]), "variant", "a", "x").where(F.col("a") != center).select("a", F.lit(center).alias("b"))
    return lexicon.relation_members(pairs, _ordered(spark, sf_dir), "sibling", "first", "second").withColumn("listing_order", F.col("listing_order").cast("long"))


@query(sql("SELECT synset, string_agg(sense, ' ' ORDER BY listing_order, sense) AS members FROM s2 GROUP BY synset HAVING count(*) > 1", _EVOKED, _ORDER))
def synonym_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.synonym_relations(_ordered(spark, sf_dir)).select("synset", F.array_join(F.transform("members", lambda m: m["ref"]), " ").alias("members"))


# --- rewriting


@query(sql(f"SELECT e.o AS synset, '{{' || string_agg(DISTINCT {_LEX('w.o')}, '; ' ORDER BY {_LEX('w.o')}) || '}}' AS label FROM t e JOIN t w ON w.s = e.s AND w.{p('writtenRep')} WHERE e.{p('evokes')} GROUP BY e.o"))
def lemma_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("evokes"), ex("writtenRep")])
    return etl.lemma_labels(_of(t, "evokes", "word", "synset").join(_of(t, "writtenRep", "word", "w"), "word").select("synset", T.lex(F.col("w")).alias("lemma")))


@query(sql(f"SELECT DISTINCT s, '{ex('inScheme')}' AS p, '{ex('scheme')}' AS o FROM t WHERE s LIKE '<{EX}synset-%'"))
def in_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.in_scheme(view_triples(spark, sf_dir), f"{EX}synset-", ex("inScheme"), ex("scheme"))


@query(sql(f"SELECT DISTINCT s, p, replace(o, '<https://old.example.org/', '<https://words.example.org/') AS o FROM t WHERE {p('source')}"))
def rewritten_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("source")])
    once = etl.rewrite_prefix(t, ex("source"), "https://old.example.org/", "https://words.example.org/")
    return etl.rewrite_prefix(once, ex("source"), "https://old.example.org/", "https://words.example.org/")


@query(sql(f"SELECT DISTINCT a.o AS s, '{ex('source')}' AS p, replace(a.o, '<{EX}part-', '<https://new.example.org/') AS o FROM t a WHERE a.{p('sense')} AND a.o NOT IN (SELECT s FROM t WHERE {p('source')})"))
def minted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("sense"), ex("source")])
    senses = t.where(F.col("p") == ex("sense")).select(F.col("o").alias("s")).distinct()
    return etl.minted(senses, t, ex("source"), F.replace("s", F.lit(f"<{EX}part-"), F.lit("<https://new.example.org/")))


@query(sql(f"SELECT DISTINCT a.o AS s, '{ex('rep')}' AS p, l.o FROM t a JOIN t l ON l.s = a.s AND l.p = '{LABEL}' WHERE a.{p('canonicalForm')} AND a.o NOT IN (SELECT s FROM t WHERE {p('rep')})"))
def recovered_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("canonicalForm"), LABEL, ex("rep")])
    forms = _of(t, "canonicalForm", "word", "s").join(t.where(F.col("p") == LABEL).select(F.col("s").alias("word"), F.col("o").alias("label")), "word")
    return etl.minted(forms, t, ex("rep"), F.col("label"))


@query(sql(f"SELECT p, count(*) AS n FROM t WHERE NOT {p('assertedPartOfSpeech')} GROUP BY p"))
def removed_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir)
    n = t.where(F.col("p") == ex("assertedPartOfSpeech")).count()  # what the caller is told to remove
    return etl.remove_all(t, ex("assertedPartOfSpeech"), n).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_DOOMED = f"doom AS (SELECT '{ex('word-red_bolt')}' AS x UNION SELECT o FROM t WHERE {p('sense')} AND s = '{ex('word-red_bolt')}')"


@query(sql("SELECT p, count(*) AS n FROM t WHERE s NOT IN (SELECT x FROM doom) AND o NOT IN (SELECT x FROM doom) GROUP BY p", _DOOMED))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = etl.cascade_delete(view_triples(spark, sf_dir), _nodes(spark, "word-red_bolt"), ex("sense"))
    return out.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_SAME = f"g AS (SELECT s, string_agg(p || ' ' || o, '|' ORDER BY p, o) AS x FROM t WHERE p IN ('{ex('ptype')}', '{ex('size')}') GROUP BY s), h2 AS (SELECT g.*, g.s NOT IN (SELECT s FROM t WHERE {p('source')}) AS bare FROM g), h3 AS (SELECT s, first_value(s) OVER (PARTITION BY x ORDER BY bare, s) AS winner FROM h2)"


@query(sql("SELECT s AS loser, winner FROM h3 WHERE s <> winner", _SAME))
def merge_defined_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.merge_duplicates(view_triples(spark, sf_dir, only=[ex("ptype"), ex("size"), ex("source")]), [ex("ptype"), ex("size")], ex("source"))


@query(
    sql(
        f"SELECT DISTINCT a.s, a.p, coalesce(b.winner, a.o) AS o FROM t a LEFT JOIN h3 b ON b.s = a.o AND b.s <> b.winner WHERE a.p IN ('{HYPER}', '{ex('example')}') AND a.s NOT IN (SELECT s FROM h3 WHERE s <> winner) "
        f"UNION SELECT h3.winner, a.p, a.o FROM t a JOIN h3 ON h3.s = a.s AND h3.s <> h3.winner WHERE a.{p('example')} AND h3.winner NOT IN (SELECT s FROM t WHERE {p('example')})",
        _SAME,
    )
)
def merged_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view_triples(spark, sf_dir, only=[ex("ptype"), ex("size"), ex("source"), HYPER, ex("example")])
    names = etl.merge_duplicates(t, [ex("ptype"), ex("size")], ex("source")).select(F.col("loser").alias("old"), F.col("winner").alias("new"))
    return etl.merge_resources(t.where(F.col("p").isin(HYPER, ex("example"))), names, [ex("example")])


@query(
    "WITH x AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), y AS (SELECT a, b, CASE WHEN b % 10 = 3 THEN b + 1 END AS new FROM x), k AS (SELECT p_partkey AS k FROM part WHERE p_size > 5) "
    "SELECT DISTINCT a, CASE WHEN k IS NOT NULL THEN coalesce(new, b) END AS b, CASE WHEN k IS NULL THEN 'dropped' WHEN new IS NOT NULL THEN 'moved' ELSE 'kept' END AS fate FROM y LEFT JOIN k ON k.k = coalesce(new, b)"
)
def rebuilt_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    remap = links.select(F.col("b").alias("old"), F.when(F.col("b") % 10 == 3, F.col("b") + 1).alias("new")).distinct().where("new is not null")
    return etl.rebuild_links(links, remap, part.where("p_size > 5").select(F.col("p_partkey").alias("node")))


@query(sql(f"SELECT DISTINCT s, p, o FROM t WHERE {p('partOf')} AND s <> '{ex('nation-3')}' UNION ALL SELECT '{ex('nation-3')}', '{ex('partOf')}', '{ex('region-9')}'"))
def replaced_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(ex("nation-3"), ex("partOf"), ex("region-9"))], "s string, p string, o string")
    return etl.replace_subjects(view_triples(spark, sf_dir, only=[ex("partOf")]), new)


