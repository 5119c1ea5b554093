"""Named queries over what goes in and out: files read back, documents checked, changes of kept tables, and displays of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import labels as L
from lexiloom.functions import terms as T
from lexiloom.functions.tables import kept, shared_folder, write_table
from lexiloom.operators import annotation, degrees, entity, etl, export, lexicon, mentions, search, taxonomy, validate
from lexiloom.plans.lexical import sparql, sql
from lexiloom.plans.lower import Lowering
from lexiloom.plans.parser import parse
from lexiloom.plans.registry import _BORDA, _CONCEPTS, _COUNTS, _D, _H, _INDEG, HYPER, LEXICON, ORACLES, QUERIES, _borda, _graph, ex, p, query
from lexiloom.plans.registry import sql as concept_sql
from lexiloom.sources import documents, tables, turtle
from lexiloom.sources.relational import EX, LABEL, TYPE, view_quads, view_triples

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lexiloom/{uuid.uuid4().hex}/{name}"


def _bare(c: str):
    """A blank node without the scope of the file that it was read from."""
    return F.regexp_replace(c, "^_:f[0-9a-f]{8}", "_:").alias(c)


# --- files


@query(sql("SELECT s, p, o FROM t"))
def turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view written as a Turtle document in parts and read again."""
    path = _folder(spark, "view.ttl")
    turtle.write_turtle(view_triples(spark, sf_dir, dictionary=True), path)
    return turtle.read_turtle(spark, path).select(_bare("s"), "p", _bare("o"))


@query(sql(f"SELECT s, p, o FROM t WHERE p <> '{ex('supplies')}'"))
def rdf_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view written as an RDF/XML document in parts and read again; the result leaves out its largest predicate, as the SQL does."""
    path = _folder(spark, "view.rdf")
    turtle.write_rdf_xml(view_triples(spark, sf_dir, dictionary=True), path)
    return turtle.read_rdf_xml(spark, path).where(F.col("p") != ex("supplies")).select(_bare("s"), "p", _bare("o"))


@query(sql(f"SELECT '{ex('graph/b')}' AS g, s, p, o FROM t WHERE s LIKE '{ex('nation-')[:-1]}%' AND p <> '{LABEL}' UNION ALL SELECT '{ex('graph/a')}', s, p, o FROM t WHERE s LIKE '{ex('region-')[:-1]}%'"))
def imported_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs imported from files; one is imported again with its labels taken out by a hook, in the place of what was there."""
    t, store = view_triples(spark, sf_dir), _folder(spark, "quads")
    for name, kind in (("a", "region"), ("b", "nation")):
        path = _folder(spark, f"{kind}.ttl")
        turtle.write_turtle(t.where(F.col("s").startswith(f"<{EX}{kind}-")), path)
        turtle.import_files(spark, ex(f"graph/{name}"), path, store)
    turtle.import_files(spark, ex("graph/b"), path, store, lambda rows: rows.where(F.col("p") != LABEL))
    return tables.read_quads(spark, store).select("g", "s", "p", "o")


def _dictionary_document(spark: SparkSession, sf_dir: str) -> str:
    """An XML document of the parts: entries with a sense and a marker of their brand, then relations between senses."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x = documents.xml_text
    entry = F.concat(
        F.lit('<entry id="e'), F.col("p_partkey").cast("string"), F.lit('"><headword>'), F.when(F.col("p_size") % 7 != 0, x(F.col("p_name"))).otherwise(""), F.lit('</headword><sense id="s'),
        F.col("p_partkey").cast("string"), F.lit('"><collocateMarker id="'), x(F.col("p_brand")), F.lit('"/><definition>'), x(F.concat(F.lit("a < b & "), "p_type")), F.lit("</definition></sense></entry>"),
    )
    relation = F.concat(F.lit('<relation type="hypernym"><member ref="s'), F.col("p_partkey").cast("string"), F.lit('"/><member ref="s'), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit('"/></relation>'))
    rows = part.select(F.lit(0).alias("place"), "p_partkey", entry.alias("text")).unionByName(part.select(F.lit(1).alias("place"), "p_partkey", relation.alias("text")))
    path = _folder(spark, "dictionary.xml")
    documents.write_document(rows, ["place", "p_partkey"], "text", path, '<?xml version="1.0"?>\n<!-- made > of parts -->\n<lexicographicResource langCode="en">', "</lexicographicResource>")
    return path


@query(
    "SELECT 'repeated id' AS problem, p_brand AS id, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1 UNION ALL "
    "SELECT 'reference to nothing', 's' || floor(p_partkey / 2)::BIGINT, count(*) FROM part WHERE floor(p_partkey / 2)::BIGINT NOT IN (SELECT p_partkey FROM part) GROUP BY 2"
)
def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = documents.xml_tags(spark, _dictionary_document(spark, sf_dir))
    return documents.identity_problems(tags, ["entry", "sense", "collocateMarker"], "member").select("problem", "id", "n")


def _entry_problems(text: str) -> list[str]:
    """What is wrong with an entry by itself."""
    from xml.etree import ElementTree

    e = ElementTree.fromstring(text)
    return [f"{e.attrib['id']}: no headword"] if not "".join(e.find("headword").itertext()) else []


@query("SELECT 'e' || p_partkey || ': no headword' AS problem FROM part WHERE p_size % 7 = 0")
def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.xml_items(spark, _dictionary_document(spark, sf_dir), "entry", _entry_problems).select("problem")


@query(
    "SELECT kind, name, n FROM (VALUES ('open', 'entry', 1), ('close', 'entry', 1), ('open', 'sense', 1), ('close', 'sense', 1), ('empty', 'collocateMarker', 1), ('empty', 'member', 2), ('open', 'relation', 1), ('close', 'relation', 1), "
    "('open', 'definition', 1), ('close', 'definition', 1), ('open', 'headword', 1), ('close', 'headword', 1)) v(kind, name, k), LATERAL (SELECT k * count(*) AS n FROM part) UNION ALL "
    "SELECT kind, 'lexicographicResource', 1 FROM (VALUES ('open'), ('close')) r(kind) UNION ALL SELECT 'other', '', 2"
)
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the document by kind; it is well formed, so that no file is told."""
    tags = documents.xml_tags(spark, _dictionary_document(spark, sf_dir))
    fine = tags.join(documents.malformed(tags).select("file"), "file", "left_anti")
    return fine.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


# --- kept indegrees

_OLD = f"(SELECT s, p, o FROM t WHERE p IN ('{TYPE}', '{HYPER}', '{ex('orthogonalHypernym')}'))"
_CHANGED = (
    f"b1 AS (SELECT * FROM {_OLD} WHERE NOT (p = '{HYPER}' AND s LIKE '%1>')), "
    f"b2 AS (SELECT * FROM b1 UNION SELECT '<{EX}part-' || p_partkey || '>', '{ex('related')}', '<{EX}part-' || (p_partkey + 1) || '>' FROM part WHERE p_size > 25), "
    f"b3 AS (SELECT * FROM b2 WHERE NOT (p = '{TYPE}' AND s LIKE '%7>')), "
    f"c AS (SELECT s FROM b3 WHERE p = '{TYPE}' AND o = '{ex('Concept')}')"
)


@query(sql("SELECT o AS node, count(*) AS indegree FROM b3 WHERE s IN (SELECT s FROM c) AND o IN (SELECT s FROM c) GROUP BY o", _CHANGED))
def kept_indegrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indegrees kept in a table through three changes: links go, others come, and nodes stop to be concepts."""
    t = view_triples(spark, sf_dir, only=[TYPE, HYPER, ex("orthogonalHypernym")])
    path = _folder(spark, "indegrees")
    degrees.save_degrees(taxonomy.indegree(t, TYPE, ex("Concept")), path)
    gone = lambda rows, predicate, ending: rows.where((F.col("p") == predicate) & F.col("s").endswith(ending))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 25")
    name = lambda c: F.concat(F.lit(f"<{EX}part-"), c.cast("string"), F.lit(">"))
    adds = part.select(name(F.col("p_partkey")).alias("s"), F.lit(ex("related")).alias("p"), name(F.col("p_partkey") + 1).alias("o"))
    for new, old in ((None, lambda rows: gone(rows, HYPER, "1>")), (adds, None), (None, lambda rows: gone(rows, TYPE, "7>"))):
        t = degrees.update_with_degrees(path, t, new, None if old is None else old(t), TYPE, ex("Concept"))
    return degrees.read_degrees(spark, path)


# --- paths, nested nodes and results

sparql(
    "graph_path_plus",
    "SELECT ?g ?x ?y WHERE { GRAPH ?g { ?x (ex:partOf|ex:in|ex:orthogonalHypernym)+ ?y } }",
    sql(
        "SELECT g, x, y FROM r",
        f"e AS (SELECT CASE WHEN {p('partOf')} THEN '{ex('graph/places')}' WHEN {p('in')} THEN '{ex('graph/trade')}' ELSE '{ex('graph/concepts')}' END AS g, s, o FROM t WHERE p IN ('{ex('partOf')}', '{ex('in')}', '{ex('orthogonalHypernym')}'))",
        "r AS (SELECT g, s AS x, o AS y FROM e UNION SELECT r.g, r.x, e.o FROM r JOIN e ON e.s = r.y AND e.g = r.g)",
        recursive=True,
    ),
    graphs=True,
)


@query(
    "SELECT '<http://ex.org/customer-' || c_custkey || '>' AS s, '[ <http://ex.org/name> \"' || n_name || '\" ; <http://ex.org/within> [ <http://ex.org/name> \"' || r_name || '\" ; <http://ex.org/world> [ <http://ex.org/name> \"world\" ] ] ]' AS home "
    "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"
)
def nested_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes three levels deep, folded from the innermost out; a broader predicate inside is pruned."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    blank = lambda kind, c: F.concat(F.lit(f"_:{kind}"), F.col(c).cast("string"))
    say = lambda s, name, o: (s, F.lit(ex(name)), o)
    nation, region, world = blank("n", "n_nationkey"), blank("r", "r_regionkey"), F.lit("_:w")
    rows = tables.rows_to_triples(read("customer"), say(F.concat(F.lit(f"<{EX}customer-"), F.col("c_custkey").cast("string"), F.lit(">")), "home", blank("n", "c_nationkey")))
    rows = rows.unionByName(tables.rows_to_triples(read("nation"), say(nation, "name", text("n_name")), say(nation, "within", blank("r", "n_regionkey")), say(nation, "near", blank("r", "n_regionkey"))))
    rows = rows.unionByName(tables.rows_to_triples(read("region"), say(region, "name", text("r_name")), say(region, "world", world), say(world, "name", F.lit('"world"'))))
    trees = entity.blank_node_trees(rows, {ex("within"): {ex("near")}})
    return entity.with_blank_nodes(rows.where(F.col("p") == ex("home")), trees).select("s", F.col("value").alias("home"))


_SHOWN = f"res AS (SELECT s AS x, o AS k FROM t WHERE {p('ontologicalType')} ORDER BY s LIMIT 12)"


@query(
    sql(
        f"SELECT x AS node, l.label, CAST(NULL AS VARCHAR) AS entity FROM res LEFT JOIN (SELECT s, coalesce(min(o) FILTER ({p('shortLabel')}), min(o)) AS label FROM t WHERE p IN ('{ex('shortLabel')}', '{LABEL}') GROUP BY s) l ON l.s = x "
        "UNION ALL SELECT k, NULL, '[ ' || (SELECT string_agg(p || ' ' || o, ' ; ' ORDER BY p) FROM t WHERE t.s = k) || ' ]' FROM (SELECT DISTINCT k FROM res)",
        _SHOWN,
    )
)
def enriched_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the IRIs in a result, short ones first, and what is said of its blank nodes."""
    t = view_triples(spark, sf_dir, dictionary=True)
    result = Lowering(t).run(parse("SELECT ?x ?k WHERE { ?x ex:ontologicalType ?k } ORDER BY ?x LIMIT 12"))
    return entity.enriched(result, t, [ex("shortLabel"), LABEL])


# --- texts and search


@query(
    "SELECT p_partkey, '0-' || (length(p_name) + 1) || ' ' || p_name || '|' || (length(p_name) + 6) || '-' || (2 * length(p_name) + 6) || ' ' || p_name AS mentions FROM part"
)
def lemma_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and their words looked for in texts made of them: the longest lemma, with its ending, in any case."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lemmas = part.select(F.explode(F.array_append(F.split("p_name", " "), F.col("p_name"))).alias("lemma"))
    texts = part.select("p_partkey", F.concat("p_name", F.lit("s and "), F.upper("p_name")).alias("text"))
    found = mentions.lemma_mentions(texts, lemmas)
    told = F.transform("mentions", lambda m: F.concat_ws("", m["start"].cast("string"), F.lit("-"), m["end"].cast("string"), F.lit(" "), m["lemma"]))
    return found.select("p_partkey", F.array_join(told, "|").alias("mentions"))


@query("SELECT DISTINCT lower(trim(p_name)) AS key, min(p_name) AS form FROM part WHERE lower(p_name) LIKE 's%' GROUP BY 1 ORDER BY 1 LIMIT 200")
def autocomplete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions from a stored index, of which only the files of the prefix's first character are read."""

    def make() -> DataFrame:
        rows = search.completions(view_triples(spark, sf_dir, only=[LEXICON.written]), LEXICON.written)
        return rows.withColumn("first", F.substring("key", 1, 1)).sortWithinPartitions("first", "key")

    return search.autocomplete(kept(spark, "completions", sf_dir, make, "first"), " S")


@query(
    concept_sql(
        "SELECT path, node, level FROM pre WHERE path = '' OR regexp_replace(path, '\\.[0-9]+$', '') IN (SELECT path FROM pre ORDER BY path LIMIT 59)",
        _CONCEPTS, _INDEG, _H, _D, _COUNTS, _BORDA,
        f"pre AS (SELECT '' AS path, '{ex('part-1')}' AS node, 0 AS level, ['{ex('part-1')}'] AS above UNION ALL SELECT pre.path || '.' || lpad(CAST(b.pos - 1 AS VARCHAR), 2, '0'), b.child, pre.level + 1, list_append(pre.above, b.child) "
        "FROM pre JOIN borda b ON b.parent = pre.node AND b.pos <= 12 WHERE pre.level < 5)",
        recursive=True,
    )
)
def budgeted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.bounded_tree(_borda(spark, sf_dir), ex("part-1"), max_nodes=60)


# --- graphs of one view as quads


@query(sql("SELECT g, count(*) AS n FROM (SELECT CASE WHEN s LIKE '<http://ex.org/nation-%' OR s LIKE '<http://ex.org/region-%' THEN 'places' END AS g FROM t) WHERE g IS NOT NULL GROUP BY g"))
def union_of_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union graph of a store of quads, counted by the graph that its places are in."""
    places = tables.named_graph(view_quads(spark, sf_dir), ex("graph/places"))
    union = tables.union_graph(view_quads(spark, sf_dir, dictionary=True))
    return union.join(places, ["s", "p", "o"], "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("places").alias("g"), "n")


# --- rows for annotators

_REQUESTS = (
    "q AS (SELECT p_name || '/' || p_brand AS lemma, CASE p_partkey % 6 WHEN 0 THEN '1.A.' WHEN 1 THEN ' 1' WHEN 2 THEN '2.b' WHEN 3 THEN 'ordet mangler' WHEN 4 THEN '1a' END AS entry, CASE WHEN p_size % 2 = 0 THEN 'a sentence of ' || p_size END AS sentence, p_partkey AS place FROM part "
    "UNION ALL SELECT c_mktsegment, '1.a', NULL, c_custkey FROM customer), "
    "q2 AS (SELECT lemma, CASE WHEN regexp_full_match(regexp_replace(lower(trim(entry)), '\\.$', ''), '[0-9]+[a-z.]*') THEN regexp_replace(lower(trim(entry)), '\\.$', '') END AS entry, sentence FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY sentence IS NULL, place) AS n FROM q) WHERE n = 1), "
    "x AS (SELECT p_name || '/' || p_brand AS lemma, 's' || p_partkey AS sense, p_name || CASE p_size % 5 WHEN 0 THEN '_§1' WHEN 1 THEN '_§1a' WHEN 2 THEN '_§2' WHEN 3 THEN '_§1b' ELSE '' END AS label, lower(p_type) AS definition FROM part), "
    "x1 AS (SELECT lemma, min(sense) AS sense, arg_min(definition, sense) AS definition, CASE WHEN contains(label, '§') THEN regexp_extract(label, '(§.+)', 1) END AS suffix FROM x GROUP BY lemma, label), "
    "r AS (SELECT *, '§' || replace(entry, '.', '') AS suffix FROM q2), r1 AS (SELECT *, CASE WHEN regexp_matches(suffix, '[a-z]$') THEN regexp_replace(suffix, '[a-z]$', '') END AS above FROM r), "
    "n AS (SELECT r1.*, (SELECT count(*) FROM x1 WHERE x1.lemma = r1.lemma) AS size, (SELECT min(sense) FROM x1 WHERE x1.lemma = r1.lemma AND x1.suffix = r1.suffix) AS found, (SELECT min(sense) FROM x1 WHERE x1.lemma = r1.lemma AND x1.suffix = r1.above) AS base, "
    "(SELECT count(*) FROM x1 WHERE x1.lemma = r1.lemma AND x1.suffix = r1.above) AS bases, (SELECT min(sense) FROM x1 WHERE x1.lemma = r1.lemma AND x1.suffix = '§1') AS one, (SELECT min(sense) FROM x1 WHERE x1.lemma = r1.lemma AND x1.suffix = '§1a') AS one_a, "
    "(SELECT count(*) FROM x1 WHERE x1.lemma = r1.lemma AND starts_with(x1.suffix, r1.suffix)) AS family FROM r1), "
    "k AS (SELECT *, CASE WHEN size = 0 THEN 1 WHEN found IS NOT NULL AND base IS NOT NULL THEN 2 WHEN found IS NOT NULL AND above IS NOT NULL THEN 3 WHEN entry IS NULL AND one IS NOT NULL AND one_a IS NOT NULL THEN 4 "
    "WHEN above IS NOT NULL AND found IS NULL AND bases = 1 THEN 5 WHEN found IS NOT NULL AND above IS NULL AND family > 1 THEN 6 ELSE 7 END AS kind FROM n), "
    "pair AS (SELECT lemma, sentence, CASE kind WHEN 2 THEN base WHEN 4 THEN one WHEN 5 THEN base ELSE 'unknown_root' END AS a, CASE kind WHEN 2 THEN found WHEN 3 THEN found WHEN 4 THEN one_a ELSE 'unknown_metaphor' END AS b, "
    "CASE kind WHEN 1 THEN 'not in the dictionary' WHEN 3 THEN 'root not in the dictionary' WHEN 4 THEN 'verify inferred IDs' END AS ta, CASE kind WHEN 1 THEN 'not in the dictionary' WHEN 4 THEN 'verify inferred IDs' WHEN 5 THEN 'metaphor not in the dictionary' END AS tb FROM k WHERE kind <= 5), "
    "many AS (SELECT k.lemma, k.sentence, x1.sense, row_number() OVER (PARTITION BY k.lemma ORDER BY x1.sense) - 1 AS place, count(*) OVER (PARTITION BY k.lemma) AS c FROM k JOIN x1 ON x1.lemma = k.lemma AND (k.kind = 7 OR starts_with(x1.suffix, k.suffix)) WHERE k.kind >= 6), "
    "rows AS (SELECT lemma, 0 AS place, a AS sense_id, '-' AS derived_from, ta AS task, NULL AS example FROM pair UNION ALL SELECT lemma, 1, b, a, tb, sentence FROM pair UNION ALL "
    "SELECT lemma, place, sense, NULL, 'assign roles', CASE WHEN place = 0 AND c > 1 THEN sentence END FROM many UNION ALL SELECT lemma, 1, 'unknown_sense', NULL, 'assign roles', sentence FROM many WHERE c = 1), "
    "st AS (SELECT lemma, CASE WHEN bool_and(sense_id NOT LIKE 'unknown%' AND derived_from IS NOT NULL) THEN 'complete' WHEN bool_or(sense_id NOT LIKE 'unknown%') THEN 'partial' ELSE 'missing' END AS status FROM rows GROUP BY lemma)"
)


@query(f"WITH {_REQUESTS} SELECT rows.lemma, CAST(place AS INTEGER) AS place, sense_id, derived_from, task, d.definition AS description, example, status FROM rows JOIN st ON st.lemma = rows.lemma LEFT JOIN (SELECT DISTINCT sense, definition FROM x1) d ON d.sense = rows.sense_id")
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    part, lemma = read("part"), F.concat("p_name", F.lit("/"), "p_brand").alias("lemma")
    entry = F.expr("CASE p_partkey % 6 WHEN 0 THEN '1.A.' WHEN 1 THEN ' 1' WHEN 2 THEN '2.b' WHEN 3 THEN 'ordet mangler' WHEN 4 THEN '1a' END")
    asked = part.select(lemma, entry.alias("entry"), F.expr("CASE WHEN p_size % 2 = 0 THEN concat('a sentence of ', p_size) END").alias("sentence"), F.col("p_partkey").alias("place"))
    asked = asked.unionByName(read("customer").select(F.col("c_mktsegment").alias("lemma"), F.lit("1.a").alias("entry"), F.lit(None).cast("string").alias("sentence"), F.col("c_custkey").alias("place")))
    label = F.expr("concat(p_name, CASE p_size % 5 WHEN 0 THEN '_§1' WHEN 1 THEN '_§1a' WHEN 2 THEN '_§2' WHEN 3 THEN '_§1b' ELSE '' END)")
    senses = part.select(lemma, F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sense"), label.alias("label"), F.lower("p_type").alias("definition"))
    rows = annotation.annotation_rows(annotation.requests(asked, "place"), senses)
    return rows.select("lemma", "place", "sense_id", "derived_from", "task", "description", "example", "status")


# --- a lexicon document


@query(
    sql(
        "SELECT entry, lemma, senses FROM (SELECT substr(w.s, 16, length(w.s) - 16) AS entry, min(substr(w.o, 2, length(w.o) - 5)) AS lemma, count(DISTINCT a.o) AS senses FROM t w JOIN t a ON a.s = w.s AND "
        f"a.{p('sense')} JOIN t b ON b.o = a.o AND b.{p('lexicalizedSense')} WHERE w.{p('writtenRep')} GROUP BY w.s)"
    )
)
def lexicon_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon document of entries and concepts written in parts; its entries are read again, one by one."""
    t, path = view_triples(spark, sf_dir, dictionary=True), _folder(spark, "lexicon.xml")
    entries = export.lexicon_entries(t, ex("writtenRep"), ex("sense"), ex("lexicalizedSense"))
    concepts = export.concept_entries(t, ex("lexicalizedSense"), [ex("domain"), ex("eqHypernym")])
    export.write_lexicon(entries, concepts, path, {"id": "view", "language": "en"})
    found = documents.xml_items(spark, path, "LexicalEntry", _entry_line)
    cells = F.split("problem", "\t")
    return found.select(cells[0].alias("entry"), cells[1].alias("lemma"), cells[2].cast("long").alias("senses"))


def _entry_line(text: str) -> list[str]:
    from xml.etree import ElementTree

    e = ElementTree.fromstring(text)
    return [f"{e.attrib['id']}\t{e.find('Lemma').attrib['writtenForm']}\t{len(e.findall('Sense'))}"]


# --- search with everything that a result shows, and the catalog of sources

sparql(
    "search_synsets",
    "SELECT ?form ?word ?synset ?label ?short ?definition ?kind ?file WHERE { ?form ex:rep \"red widgets\"@en . ?word ex:canonicalForm|ex:otherForm|(ex:sameAs/(ex:canonicalForm|ex:otherForm)) ?form ; ex:evokes ?synset "
    "OPTIONAL { ?synset rdfs:label ?label } OPTIONAL { ?synset ex:shortLabel ?short } OPTIONAL { ?synset ex:definition ?definition } OPTIONAL { ?synset ex:ontologicalType ?kind } OPTIONAL { ?synset ex:lexfile ?file } }",
    sql(
        "SELECT f.s AS form, w.word, e.o AS synset, l.o AS label, h.o AS short, d.o AS definition, k.o AS kind, x.o AS file FROM t f "
        f"JOIN (SELECT s AS word, o FROM t WHERE p IN ('{ex('canonicalForm')}', '{ex('otherForm')}') UNION ALL SELECT a.s, b.o FROM t a JOIN t b ON b.s = a.o AND b.p IN ('{ex('canonicalForm')}', '{ex('otherForm')}') WHERE a.{p('sameAs')}) w ON w.o = f.s "
        f"JOIN t e ON e.s = w.word AND e.{p('evokes')} LEFT JOIN t l ON l.s = e.o AND l.p = '{LABEL}' LEFT JOIN t h ON h.s = e.o AND h.{p('shortLabel')} LEFT JOIN t d ON d.s = e.o AND d.{p('definition')} "
        f"LEFT JOIN t k ON k.s = e.o AND k.{p('ontologicalType')} LEFT JOIN t x ON x.s = e.o AND x.{p('lexfile')} WHERE f.{p('rep')} AND f.o = '\"red widgets\"@en'"
    ),
)

_NAMED = {"rdfs": T.PREFIXES["rdfs"], "owl": T.PREFIXES["owl"], "skos": T.PREFIXES["skos"], "dc": T.PREFIXES["dc"], "vann": "http://purl.org/vocab/vann/", "dcat": "http://www.w3.org/ns/dcat#", "lime": "http://www.w3.org/ns/lemon/lime#"}


@query(
    "WITH d AS (SELECT DISTINCT source, 'http://src.org/' || source AS u FROM documents WHERE source IS NOT NULL), f AS ("
    "SELECT u FROM d UNION SELECT 'http://src.org/nation/' || n_nationkey FROM nation UNION SELECT 'http://src.org/region' || r_regionkey || '#' FROM region UNION SELECT 'http://src.org/region' || r_regionkey FROM region WHERE r_regionkey < 2) "
    "SELECT '<' || u || '>' AS uri, CASE WHEN u LIKE '%src1' THEN '\"title of ' || substr(u, 16) || '\"' WHEN u LIKE '%/nation/%' THEN '\"' || (SELECT n_name FROM nation WHERE n_nationkey = TRY_CAST(split_part(u, '/', 5) AS BIGINT)) || '\"' END AS label, "
    "CASE WHEN u LIKE '%/nation/%' THEN '\"n' || split_part(u, '/', 5) || '\"' END AS prefix FROM f WHERE NOT (u LIKE '%#' AND rtrim(u, '#') IN (SELECT u FROM f))"
)
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that a graph names in any of nine ways, without specifications and spare forms, with labels and prefixes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    term = lambda *parts: F.concat(F.lit("<http://src.org/"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts], F.lit(">"))
    name = lambda prefix, local: F.lit(f"<{_NAMED[prefix]}{local}>")
    text = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    docs = read("documents").where("source is not null")
    rows = tables.rows_to_triples(docs, (term("doc/", F.col("doc_id")), name("rdfs", "isDefinedBy"), term(F.col("source"))), (term("doc/", F.col("doc_id")), name("rdfs", "isDefinedBy"), F.lit("<http://www.w3.org/TR/x>")))
    rows = rows.unionByName(tables.rows_to_triples(docs.where("source like '%src1'"), (term(F.col("source")), name("dc", "title"), text(F.lit("title of "), F.col("source")))))
    n = F.col("n_nationkey")
    rows = rows.unionByName(tables.rows_to_triples(read("nation"), (term("nation/", n), name("vann", "preferredNamespacePrefix"), text(F.lit("n"), n.cast("string"))), (term("nation/", n), F.lit(LABEL), text(F.col("n_name"))), (term("x", n), name("skos", "inScheme"), F.lit("_:scheme"))))
    r = F.col("r_regionkey")
    rows = rows.unionByName(tables.rows_to_triples(read("region"), (F.concat(F.lit("<http://src.org/region"), r.cast("string"), F.lit("#>")), F.lit(TYPE), name("dcat", "Dataset"))))
    rows = rows.unionByName(tables.rows_to_triples(read("region").where("r_regionkey < 2"), (term("region", r), F.lit(TYPE), F.when(r == 0, name("lime", "Lexicon")).otherwise(name("owl", "Ontology")))))
    rows = write_table(rows, "catalog")
    prefixes = " ".join(f"PREFIX {k}: <{u}>" for k, u in _NAMED.items())
    found = Lowering(rows).run(
        parse(
            f"{prefixes} SELECT DISTINCT ?source WHERE {{ {{ ?s rdfs:isDefinedBy ?source }} UNION {{ ?source vann:preferredNamespaceUri ?u }} UNION {{ ?source vann:preferredNamespacePrefix ?x }} UNION {{ ?s skos:inScheme ?source }} UNION "
            "{ ?source owl:imports ?o } UNION { ?source a owl:Ontology } UNION { ?source a skos:ConceptScheme } UNION { ?source a dcat:Dataset } UNION { ?source a lime:Lexicon } FILTER(!isBlank(?source)) }"
        )
    )
    labels = [f"<{_NAMED['dc']}title>", LABEL]
    return export.catalog_entries(found.withColumnRenamed("source", "uri"), rows, labels, f"<{_NAMED['vann']}preferredNamespacePrefix>")


# --- labels, types and sinks


@query(
    "SELECT p_partkey, replace(p_name, ' ', '-') AS word, CASE WHEN p_size % 3 = 0 THEN '_§' || p_size || 'a' WHEN p_size % 3 = 1 THEN '_(' || p_size || ') som ' || lower(p_brand) END AS rest, "
    "CASE WHEN p_size % 3 = 0 THEN '§' || p_size || 'a' WHEN p_size % 3 = 1 THEN '(' || p_size || ')' END AS mark, CASE WHEN p_size % 3 = 1 THEN ' som ' || lower(p_brand) END AS more FROM part"
)
def sense_label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.expr("concat(replace(p_name, ' ', '-'), CASE p_size % 3 WHEN 0 THEN concat('_§', p_size, 'a') WHEN 1 THEN concat('_(', p_size, ') som ', lower(p_brand)) ELSE '' END)")
    return part.select("p_partkey", L.sense_label_parts(label).alias("x")).select("p_partkey", "x.*")


_BOTH = f"b AS (SELECT s, p, o FROM t WHERE p IN ('{ex('shortLabel')}', '{LABEL}') AND s LIKE '{ex('synset-')[:-1]}%' UNION SELECT s, '{LABEL}', o FROM t WHERE {p('shortLabel')})"


@query(
    sql(
        "SELECT 'normal' AS detail, s, string_agg(o, ' | ' ORDER BY o) AS label FROM (SELECT DISTINCT s, o FROM b WHERE p LIKE '%shortLabel>' OR s NOT IN (SELECT s FROM b WHERE p LIKE '%shortLabel>')) GROUP BY s UNION ALL "
        "SELECT 'high', s, string_agg(o, ' | ' ORDER BY o) FROM (SELECT DISTINCT s, o FROM b x WHERE p LIKE '%label>' AND NOT EXISTS (SELECT 1 FROM b y WHERE y.s = x.s AND y.o = x.o AND y.p LIKE '%shortLabel>')) GROUP BY s",
        _BOTH,
    )
)
def label_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of synsets in both degrees of detail, where short labels are full ones too."""
    t = view_triples(spark, sf_dir, dictionary=True).where(F.col("p").isin(ex("shortLabel"), LABEL) & F.col("s").startswith(f"<{EX}synset-"))
    t = t.unionByName(t.where(F.col("p") == ex("shortLabel")).select("s", F.lit(LABEL).alias("p"), "o"))
    parts = [entity.entity_labels(t, LABEL, ex("shortLabel"), [], d).select(F.lit(d).alias("detail"), "s", F.array_join("os", " | ").alias("label")) for d in ("normal", "high")]
    return parts[0].unionByName(parts[1])


_ABOVE = f"h AS (SELECT DISTINCT x.s AS a, y.s AS b FROM t e JOIN t x ON x.o = e.s AND x.{p('lexicalizedSense')} JOIN t y ON y.o = e.o AND y.{p('lexicalizedSense')} WHERE e.{p('hypernym')})"


@query(
    sql(
        "SELECT DISTINCT h.a AS focus_node, h.b AS value FROM h JOIN kinds x ON x.node = h.a JOIN kinds y ON y.node = h.b WHERE x.pos <> y.pos",
        _ABOVE,
        f"kinds AS (SELECT DISTINCT l.s AS node, q.o AS pos FROM t l JOIN t w ON w.o = l.o AND w.{p('sense')} JOIN t q ON q.s = w.s AND q.{p('partOfSpeech')} WHERE l.{p('lexicalizedSense')})",
    )
)
def pos_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synsets above which one stands that words of another part of speech stand for, over the links of their senses."""
    t = view_triples(spark, sf_dir, dictionary=True)
    of = lambda name, a, b: t.where(F.col("p") == ex(name)).select(F.col("s").alias(a), F.col("o").alias(b))
    links = of("hypernym", "x", "y").join(of("lexicalizedSense", "s", "x"), "x").join(of("lexicalizedSense", "o", "y"), "y").select("s", F.lit(ex("above")).alias("p"), "o").distinct()
    return validate.pos_disagreement(t.unionByName(links), ex("above"), ex("lexicalizedSense"), ex("sense"), ex("partOfSpeech"), f"{EX}synset-")


@query(
    "SELECT problem, n FROM (VALUES ('the subject is no resource', 0), ('the value is no term', 1), ('a part is missing', 2)) v(problem, k), LATERAL (SELECT count(*) AS n FROM nation WHERE n_nationkey % 4 = k) UNION ALL "
    "SELECT 'added', (SELECT count(*) FROM nation WHERE n_nationkey % 4 = 3) + (SELECT 2 * count(*) FROM region)"
)
def safe_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some are no triples: the others are added, and what is wrong is told."""
    base = view_triples(spark, sf_dir).where(F.col("s").startswith(f"<{EX}region-"))
    row = F.expr(f"named_struct('s', if(n_nationkey % 4 = 0, n_name, concat('<{EX}n', n_nationkey, '>')), 'p', '{ex('told')}', 'o', CASE n_nationkey % 4 WHEN 1 THEN concat('\"', n_name) WHEN 2 THEN null ELSE concat('\"', n_name, '\"@en') END)")
    good, bad = etl.safe_add(base, spark.read.parquet(f"{sf_dir}/nation.parquet").select(row.alias("r")).select("r.*"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("problem"), "n"))


@query(
    sql(
        f"SELECT s, p, o FROM t WHERE s LIKE '{ex('region-')[:-1]}%' UNION SELECT s, p, o FROM t WHERE s LIKE '{ex('nation-')[:-1]}%' AND s NOT LIKE '%1>' UNION "
        f"SELECT s, p, CASE WHEN o LIKE '%1>' THEN '{ex('nation-0')}' ELSE o END FROM t WHERE {p('in')} AND s LIKE '{ex('supplier-')[:-1]}%' AND (o NOT LIKE '%21>')"
    )
)
def reloaded_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations loaded anew without some: links to these are moved, or dropped where nothing takes their place."""
    t = view_triples(spark, sf_dir)
    regions, nations = t.where(F.col("s").startswith(f"<{EX}region-")), t.where(F.col("s").startswith(f"<{EX}nation-"))
    gone = nations.where(F.col("s").endswith("1>") & ~F.col("s").endswith("21>")).select(F.col("s").alias("old"), F.lit(ex("nation-0")).alias("new")).distinct()
    links = t.where((F.col("p") == ex("in")) & F.col("s").startswith(f"<{EX}supplier-"))
    return etl.reloaded(regions, links, nations.where(~F.col("s").endswith("1>")), gone)


@query(
    concept_sql(
        f"SELECT pre.path, pre.node, pre.level, split_part(split_part(l.o, '\"', 2), ' ', 1) || ' ' || split_part(split_part(l.o, '\"', 2), ' ', 2) AS name, coalesce(f.orthogonal, false) AS orthogonal FROM pre JOIN t l ON l.s = pre.node AND l.p = '{LABEL}' "
        "LEFT JOIN (SELECT src, bool_and(orthogonal) AS orthogonal FROM h GROUP BY src) f ON f.src = pre.node WHERE pre.path = '' OR regexp_replace(pre.path, '\\.[0-9]+$', '') IN (SELECT path FROM pre ORDER BY path LIMIT 19)",
        _CONCEPTS, _INDEG, _H, _D, _COUNTS, _BORDA,
        f"pre AS (SELECT '' AS path, '{ex('part-1')}' AS node, 0 AS level UNION ALL SELECT pre.path || '.' || lpad(CAST(b.pos - 1 AS VARCHAR), 2, '0'), b.child, pre.level + 1 FROM pre JOIN borda b ON b.parent = pre.node AND b.pos <= 12 WHERE pre.level < 5)",
        recursive=True,
    )
)
def labelled_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small tree with the names that a display shows and whether a node hangs on by an orthogonal link."""
    tree = taxonomy.bounded_tree(_borda(spark, sf_dir), ex("part-1"), max_nodes=20)
    labels = view_triples(spark, sf_dir, only=[LABEL]).select(F.col("s").alias("node"), F.col("o").alias("label"))
    return taxonomy.labelled_tree(tree, labels, _graph(spark, sf_dir).select(F.col("src").alias("node"), "orthogonal"))


@query(
    sql(
        f"SELECT v.p, false AS cross, v.label FROM (VALUES ('{ex('hypernym')}', 'hypernym'), ('{ex('orthogonalHypernym')}', NULL)) v(p, label) UNION ALL SELECT DISTINCT t.p, true, CASE WHEN t.{p('eqHypernym')} THEN 'equal hypernym' END FROM t WHERE t.p IN ('{ex('eqHypernym')}', '{ex('ili')}', '{ex('eqNothing')}')"
    )
)
def known_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that a schema types, and those to other data sets that are in use."""
    typed = spark.createDataFrame([(ex("hypernym"),), (ex("orthogonalHypernym"),)], "p string")
    labels = spark.createDataFrame([(ex("hypernym"), "hypernym"), (ex("eqHypernym"), "equal hypernym"), (ex("eqNothing"), "nothing")], "p string, label string")
    return lexicon.known_relations(view_triples(spark, sf_dir, dictionary=True), typed, [ex("eqHypernym"), ex("ili"), ex("eqNothing")], labels)


_SHOWN_SYNSETS = f"sh AS (SELECT DISTINCT s FROM t WHERE {p('ontologicalType')} UNION SELECT s FROM t WHERE p = '{TYPE}' AND o = '{ex('Nation')}')"


@query(
    sql(
        "SELECT s, p, o FROM t WHERE s IN (SELECT s FROM sh) AND o NOT LIKE '\\_:%' ESCAPE '\\' UNION "
        f"SELECT s, p, o FROM t WHERE p = '{LABEL}' AND s IN (SELECT o FROM t WHERE s IN (SELECT s FROM sh)) UNION SELECT '{ex('partOf')}', '{LABEL}', '\"part of\"@en'",
        _SHOWN_SYNSETS,
    )
)
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Turtle document for each synset and nation, with blank nodes inside and labels after it; what the documents say when they are read."""
    t, path = view_triples(spark, sf_dir, dictionary=True), _folder(spark, "entities")
    shown = t.where((F.col("p") == ex("ontologicalType")) | ((F.col("p") == TYPE) & (F.col("o") == ex("Nation")))).select("s").distinct()
    rows = t.join(shown, "s", "left_semi")
    labels = t.where(F.col("p") == LABEL).select(F.col("s").alias("node"), "p", F.col("o").alias("label"))
    labels = labels.join(rows.select(F.col("o").alias("node")).distinct(), "node", "left_semi").unionByName(spark.createDataFrame([(ex("partOf"), LABEL, '"part of"@en')], "node string, p string, label string"))
    docs = turtle.entity_turtle(rows, entity.blank_node_trees(t), labels)
    head = "\n".join(f"@prefix {k}: <{u}> ." for k, u in sorted(T.PREFIXES.items()))
    documents.write_document(docs, "s", "text", path, head)
    return turtle.read_turtle(spark, path).where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))


_LD = lambda iri: "'{\"@id\":\"' || " + f"substr({iri}, 2, length({iri}) - 2)" + " || '\"}'"


@query(
    sql(
        f"SELECT n.s, '{{\"@id\":\"' || substr(n.s, 2, length(n.s) - 2) || '\",\"{EX}partOf\":' || {_LD('q.o')} || ',\"{T.PREFIXES['rdf']}type\":' || {_LD('n.o')} || ',\"{T.PREFIXES['rdfs']}label\":{{\"@value\":\"' || split_part(l.o, '\"', 2) || '\"}}}}' AS doc "
        f"FROM t n JOIN t q ON q.s = n.s AND q.{p('partOf')} JOIN t l ON l.s = n.s AND l.p = '{LABEL}' WHERE n.p = '{TYPE}' AND n.o = '{ex('Nation')}' UNION ALL "
        f"SELECT a.s, '{{\"@id\":\"' || substr(a.s, 2, length(a.s) - 2) || '\",\"{EX}ontologicalType\":{{\"@set\":[' || (SELECT string_agg({_LD('m.o')}, ',' ORDER BY m.p) FROM t m WHERE m.s = a.o) || ']}}}}' FROM t a WHERE a.{p('ontologicalType')}"
    )
)
def json_ld_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, and the bags of kinds of synsets, as JSON-LD."""
    t = view_triples(spark, sf_dir, dictionary=True)
    kinds = t.where(F.col("p") == ex("ontologicalType"))
    bags = t.where(F.col("s").startswith("_:"))
    typed = bags.select("s", F.lit(TYPE).alias("p"), F.lit(f"<{T.PREFIXES['rdf']}Bag>").alias("o")).distinct()
    return tables.json_ld(kinds.unionByName(bags).unionByName(typed).unionByName(t.where(F.col("s").startswith(f"<{EX}nation-"))))
