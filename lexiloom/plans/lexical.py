"""Named queries of a dictionary: scans, joins and reports over words, senses, synsets and forms of the view, each with an oracle."""

from __future__ import annotations

from functools import partial

from lexiloom.plans import registry
from lexiloom.plans.registry import ORACLES, QUERIES, ex, p
from lexiloom.sources.relational import LABEL, RDF, TYPE, view_sql

__all__ = ["ORACLES", "QUERIES", "sql"]

sparql = partial(registry.sparql, dictionary=True)
_VIEW = view_sql(dictionary=True)


def sql(body: str, *more: str, recursive: bool = False) -> str:
    """An oracle over the view ``t`` with what dictionaries say."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((_VIEW, *more))} {body}"


_KIND = lambda name: f"p = '{TYPE}' AND o = '{ex(name)}'"
_IS = lambda alias, name: f"{alias}.p = '{ex(name)}'"
_LABELLED = lambda alias: f"{alias}.p = '{LABEL}'"


def scan(name: str, predicate: str, subject: str, value: str) -> None:
    """All statements of one predicate."""
    sparql(name, f"SELECT ?{subject} ?{value} WHERE {{ ?{subject} ex:{predicate} ?{value} }}", sql(f'SELECT s AS "{subject}", o AS "{value}" FROM t WHERE {p(predicate)}'))


# --- scans
sparql("synsets", "SELECT ?synset WHERE { ?synset a ex:Synset }", sql(f"SELECT s AS synset FROM t WHERE {_KIND('Synset')}"))
scan("written_representations", "rep", "form", "written")
scan("definitions", "definition", "synset", "definition")
scan("examples", "example", "sense", "example")
scan("sources", "source", "sense", "source")
scan("domains", "domain", "synset", "domain")
scan("lexfiles", "lexfile", "synset", "lexfile")
scan("usage_notes", "usageNote", "sense", "note")
scan("genders", "gender", "sense", "gender")
scan("ilis", "ili", "synset", "ili")
scan("short_labels", "shortLabel", "synset", "label")
scan("asserted_parts_of_speech", "assertedPartOfSpeech", "word", "pos")

# --- joins
sparql(
    "words",
    "SELECT ?word ?pos ?rep WHERE { ?word a ex:Word ; ex:partOfSpeech ?pos ; ex:canonicalForm/ex:rep ?rep }",
    sql(f"SELECT w.s AS word, q.o AS pos, r.o AS rep FROM t w JOIN t q ON q.s = w.s AND {_IS('q', 'partOfSpeech')} JOIN t f ON f.s = w.s AND {_IS('f', 'canonicalForm')} JOIN t r ON r.s = f.o AND {_IS('r', 'rep')} WHERE w.p = '{TYPE}' AND w.o = '{ex('Word')}'"),
)
sparql(
    "senses",
    "SELECT ?sense ?word ?synset WHERE { ?word ex:sense ?sense . ?synset ex:lexicalizedSense ?sense }",
    sql(f"SELECT a.o AS sense, a.s AS word, b.s AS synset FROM t a JOIN t b ON b.o = a.o AND {_IS('b', 'lexicalizedSense')} WHERE {_IS('a', 'sense')}"),
)
sparql(
    "synset_labels",
    "SELECT ?synset ?label WHERE { ?synset a ex:Synset ; rdfs:label ?label FILTER(STRSTARTS(STR(?synset), CONCAT(STR(ex:), \"synset-Brand\"))) }",
    sql(f"SELECT a.s AS synset, l.o AS label FROM t a JOIN t l ON l.s = a.s AND {_LABELLED('l')} WHERE a.p = '{TYPE}' AND a.o = '{ex('Synset')}' AND a.s LIKE '{ex('synset-Brand')[:-1]}%'"),
)
sparql(
    "synset_long_short_labels",
    "SELECT ?synset ?label ?short WHERE { ?synset a ex:Synset ; rdfs:label ?label OPTIONAL { ?synset ex:shortLabel ?short } }",
    sql(f"SELECT a.s AS synset, l.o AS label, h.o AS short FROM t a JOIN t l ON l.s = a.s AND {_LABELLED('l')} LEFT JOIN t h ON h.s = a.s AND {_IS('h', 'shortLabel')} WHERE a.p = '{TYPE}' AND a.o = '{ex('Synset')}'"),
)
sparql(
    "synset_sense_labels",
    "SELECT ?synset ?sense ?label WHERE { ?synset ex:lexicalizedSense ?sense . ?sense rdfs:label ?label }",
    sql(f"SELECT a.s AS synset, a.o AS sense, l.o AS label FROM t a JOIN t l ON l.s = a.o AND {_LABELLED('l')} WHERE {_IS('a', 'lexicalizedSense')}"),
)
sparql(
    "sense_label_polysemy",
    "SELECT ?label (COUNT(DISTINCT ?synset) AS ?n) WHERE { ?synset ex:lexicalizedSense ?sense . ?sense rdfs:label ?label } GROUP BY ?label",
    sql(f"SELECT l.o AS label, count(DISTINCT a.s) AS n FROM t a JOIN t l ON l.s = a.o AND {_LABELLED('l')} WHERE {_IS('a', 'lexicalizedSense')} GROUP BY l.o"),
)
sparql(
    "sense_labels_of",
    "SELECT ?sense ?label WHERE { VALUES ?sense { ex:part-3 ex:part-4 ex:part-5 ex:part-999999 } ?sense rdfs:label ?label }",
    sql(f"SELECT s AS sense, o AS label FROM t WHERE {_LABELLED('t')} AND s IN ('{ex('part-3')}', '{ex('part-4')}', '{ex('part-5')}', '{ex('part-999999')}')"),
)
sparql(
    "variants",
    "SELECT ?synset ?variant ?label WHERE { ?synset ex:variant ?variant ; rdfs:label ?label }",
    sql(f"SELECT v.s AS synset, v.o AS variant, l.o AS label FROM t v JOIN t l ON l.s = v.s AND {_LABELLED('l')} WHERE {_IS('v', 'variant')}"),
)
sparql(
    "ontological_types",
    "SELECT ?synset ?kind WHERE { ?synset ex:ontologicalType ?bag . ?bag ?member ?kind FILTER(STRSTARTS(STR(?member), CONCAT(STR(rdf:), \"_\"))) }",
    sql(f"SELECT a.s AS synset, m.o AS kind FROM t a JOIN t m ON m.s = a.o AND m.p LIKE '<{RDF}\\_%' ESCAPE '\\' WHERE {_IS('a', 'ontologicalType')}"),
)
sparql(
    "csv_synsets",
    "SELECT ?synset ?definition ?kind WHERE { ?synset ex:ontologicalType/rdf:_1 ?kind ; ex:definition ?definition }",
    sql(f"SELECT a.s AS synset, d.o AS definition, m.o AS kind FROM t a JOIN t m ON m.s = a.o AND m.p = '<{RDF}_1>' JOIN t d ON d.s = a.s AND {_IS('d', 'definition')} WHERE {_IS('a', 'ontologicalType')}"),
)
sparql(
    "csv_senses",
    "SELECT ?sense ?synset ?word ?note WHERE { ?word ex:sense ?sense . ?synset ex:lexicalizedSense ?sense OPTIONAL { ?sense ex:usageNote ?note } }",
    sql(f"SELECT a.o AS sense, b.s AS synset, a.s AS word, n.o AS note FROM t a JOIN t b ON b.o = a.o AND {_IS('b', 'lexicalizedSense')} LEFT JOIN t n ON n.s = a.o AND {_IS('n', 'usageNote')} WHERE {_IS('a', 'sense')}"),
)
sparql(
    "csv_inheritance",
    "SELECT ?synset ?member ?kind WHERE { ?synset ex:ontologicalType ?bag . ?bag ?member ?kind FILTER(isBlank(?bag)) }",
    sql(f"SELECT a.s AS synset, m.p AS member, m.o AS kind FROM t a JOIN t m ON m.s = a.o WHERE {_IS('a', 'ontologicalType')} AND a.o LIKE '\\_:%' ESCAPE '\\'"),
)
sparql(
    "csv_examples",
    "SELECT ?synset ?example WHERE { ?synset ex:lexicalizedSense/ex:example ?example }",
    sql(f"SELECT a.s AS synset, e.o AS example FROM t a JOIN t e ON e.s = a.o AND {_IS('e', 'example')} WHERE {_IS('a', 'lexicalizedSense')}"),
)
sparql(
    "entry_links",
    "SELECT ?word ?entry WHERE { ?word a ex:Word ; ex:sameAs ?entry FILTER(STRSTARTS(STR(?entry), CONCAT(STR(ex:), \"entry-\"))) }",
    sql(f"SELECT a.s AS word, b.o AS entry FROM t a JOIN t b ON b.s = a.s AND {_IS('b', 'sameAs')} WHERE a.p = '{TYPE}' AND a.o = '{ex('Word')}' AND b.o LIKE '{ex('entry-')[:-1]}%'"),
)
sparql(
    "entry_forms",
    "SELECT ?entry ?form ?rep WHERE { ?word ex:sameAs ?entry OPTIONAL { ?entry ex:otherForm ?form . ?form ex:rep ?rep } }",
    sql(f"SELECT a.o AS entry, f.s AS form, f.o AS rep FROM t a LEFT JOIN (SELECT x.s AS e, y.s, y.o FROM t x JOIN t y ON y.s = x.o AND {_IS('y', 'rep')} WHERE {_IS('x', 'otherForm')}) f ON f.e = a.o WHERE {_IS('a', 'sameAs')}"),
)
sparql(
    "sentiments",
    "SELECT ?sense ?polarity ?value WHERE { ?sense ex:polarity ?polarity OPTIONAL { ?sense ex:sentiment ?value } }",
    sql(f"SELECT a.s AS sense, a.o AS polarity, v.o AS value FROM t a LEFT JOIN t v ON v.s = a.s AND {_IS('v', 'sentiment')} WHERE {_IS('a', 'polarity')}"),
)
sparql(
    "ili_definitions",
    "SELECT ?ili ?definition WHERE { ?synset ex:ili ?ili ; ex:definition ?definition FILTER(LANG(?definition) = \"en\") }",
    sql(f"SELECT a.o AS ili, d.o AS definition FROM t a JOIN t d ON d.s = a.s AND {_IS('d', 'definition')} WHERE {_IS('a', 'ili')} AND d.o LIKE '%\"@en'"),
)
sparql(
    "lemmas_of_synsets",
    "SELECT ?synset ?lemma WHERE { ?word ex:evokes ?synset ; ex:canonicalForm ?form . ?form ex:rep ?lemma . ?synset a ex:Synset ; ex:ili ?ili }",
    sql(f"SELECT e.o AS synset, r.o AS lemma FROM t e JOIN t f ON f.s = e.s AND {_IS('f', 'canonicalForm')} JOIN t r ON r.s = f.o AND {_IS('r', 'rep')} JOIN t k ON k.s = e.o AND k.p = '{TYPE}' AND k.o = '{ex('Synset')}' JOIN t i ON i.s = e.o AND {_IS('i', 'ili')} WHERE {_IS('e', 'evokes')}"),
)
sparql(
    "label_targets",
    "SELECT ?synset ?rep WHERE { ?synset ex:lexicalizedSense ?sense . ?word ex:sense ?sense ; ex:canonicalForm ?form . ?form ex:rep ?rep }",
    sql(f"SELECT a.s AS synset, r.o AS rep FROM t a JOIN t w ON w.o = a.o AND {_IS('w', 'sense')} JOIN t f ON f.s = w.s AND {_IS('f', 'canonicalForm')} JOIN t r ON r.s = f.o AND {_IS('r', 'rep')} WHERE {_IS('a', 'lexicalizedSense')}"),
)
sparql(
    "synset_intersection",
    "SELECT ?synset ?word ?rep ?definition WHERE { ?synset a ex:Synset ; ex:lexicalizedSense ?sense ; rdfs:label ?label ; ex:lexfile ?file ; ex:domain ?domain ; ex:ontologicalType ?bag . ?word a ex:Word ; ex:sense ?sense ; ex:evokes ?synset ; ex:writtenRep ?rep "
    "OPTIONAL { ?synset ex:definition ?definition } FILTER(?file = \"noun.artifact\") }",
    sql(
        f"SELECT b.s AS synset, w.s AS word, r.o AS rep, d.o AS definition FROM t b JOIN t w ON w.o = b.o AND {_IS('w', 'sense')} JOIN t e ON e.s = w.s AND e.o = b.s AND {_IS('e', 'evokes')} JOIN t r ON r.s = w.s AND {_IS('r', 'writtenRep')} "
        f"JOIN t x ON x.s = b.s AND {_IS('x', 'lexfile')} AND x.o = '\"noun.artifact\"' JOIN t m ON m.s = b.s AND {_IS('m', 'domain')} JOIN t l ON l.s = b.s AND {_LABELLED('l')} JOIN t g ON g.s = b.s AND {_IS('g', 'ontologicalType')} LEFT JOIN t d ON d.s = b.s AND {_IS('d', 'definition')} WHERE {_IS('b', 'lexicalizedSense')}"
    ),
)

# --- reports on what is missing or odd
sparql(
    "missing_sources",
    "SELECT ?sense ?label WHERE { ?word ex:sense ?sense . ?sense rdfs:label ?label FILTER NOT EXISTS { ?sense ex:source ?source } }",
    sql(f"SELECT a.o AS sense, l.o AS label FROM t a JOIN t l ON l.s = a.o AND {_LABELLED('l')} WHERE {_IS('a', 'sense')} AND NOT EXISTS (SELECT 1 FROM t z WHERE z.s = a.o AND {_IS('z', 'source')})"),
)
sparql(
    "old_sources",
    "SELECT ?sense ?source WHERE { ?sense ex:source ?source FILTER(STRSTARTS(STR(?source), \"https://old.example.org/\")) }",
    sql(f"SELECT s AS sense, o AS source FROM t WHERE {p('source')} AND o LIKE '<https://old.example.org/%'"),
)
sparql(
    "missing_written_forms",
    "SELECT ?word ?form ?label WHERE { ?word ex:canonicalForm ?form ; rdfs:label ?label FILTER NOT EXISTS { ?form ex:rep ?rep } }",
    sql(f"SELECT a.s AS word, a.o AS form, l.o AS label FROM t a JOIN t l ON l.s = a.s AND {_LABELLED('l')} WHERE {_IS('a', 'canonicalForm')} AND NOT EXISTS (SELECT 1 FROM t z WHERE z.s = a.o AND {_IS('z', 'rep')})"),
)
sparql(
    "scaffolding_words",
    "SELECT ?word ?sense ?synset WHERE { VALUES ?word { ex:word-red_bolt ex:word-blue_bolt } ?word ex:sense ?sense . ?synset ex:lexicalizedSense ?sense }",
    sql(f"SELECT a.s AS word, a.o AS sense, b.s AS synset FROM t a JOIN t b ON b.o = a.o AND {_IS('b', 'lexicalizedSense')} WHERE {_IS('a', 'sense')} AND a.s IN ('{ex('word-red_bolt')}', '{ex('word-blue_bolt')}')"),
)
sparql(
    "temporary_words",
    "SELECT ?word ?label WHERE { ?word a ex:Word ; rdfs:label ?label FILTER(STR(?word) = CONCAT(STR(ex:), \"word-\", REPLACE(STR(?label), \" \", \"_\"))) }",
    sql(f"SELECT a.s AS word, l.o AS label FROM t a JOIN t l ON l.s = a.s AND {_LABELLED('l')} WHERE a.p = '{TYPE}' AND a.o = '{ex('Word')}' AND a.s = concat('{ex('word-')[:-1]}', replace(substr(l.o, 2, length(l.o) - 5), ' ', '_'), '>')"),
)
sparql(
    "cross_kind_hypernyms",
    "SELECT ?a ?b WHERE { ?a ex:hypernym ?b . ?x ex:lexicalizedSense ?a ; ex:lexfile ?f . ?y ex:lexicalizedSense ?b ; ex:lexfile ?g FILTER(?f != ?g) }",
    sql(
        f"SELECT h.s AS a, h.o AS b FROM t h JOIN t x ON x.o = h.s AND {_IS('x', 'lexicalizedSense')} JOIN t f ON f.s = x.s AND {_IS('f', 'lexfile')} JOIN t y ON y.o = h.o AND {_IS('y', 'lexicalizedSense')} "
        f"JOIN t g ON g.s = y.s AND {_IS('g', 'lexfile')} WHERE {_IS('h', 'hypernym')} AND f.o <> g.o"
    ),
)
sparql("relation_in_use", "SELECT ?a ?b WHERE { ?a ex:eqHypernym ?b } ORDER BY ?a ?b LIMIT 1", sql(f"SELECT s AS a, o AS b FROM t WHERE {p('eqHypernym')} ORDER BY s, o LIMIT 1"))
sparql("synset_relation_types", "SELECT DISTINCT ?p WHERE { ?x a ex:Synset ; ?p ?y . FILTER(isIRI(?y)) }", sql(f"SELECT DISTINCT b.p FROM t a JOIN t b ON b.s = a.s AND b.o LIKE '<%' WHERE a.p = '{TYPE}' AND a.o = '{ex('Synset')}'"))
sparql("relation_pairs_of", "SELECT ?a ?b WHERE { ?a ex:orthogonalHypernym ?b FILTER(?a != ?b) }", sql(f"SELECT s AS a, o AS b FROM t WHERE {p('orthogonalHypernym')} AND s <> o"))
sparql(
    "kind_labels",
    "SELECT ?x ?label WHERE { { ?x a ex:Region ; rdfs:label ?label } UNION { ?x a ex:Nation ; rdfs:label ?label } }",
    sql(f"SELECT a.s AS x, l.o AS label FROM t a JOIN t l ON l.s = a.s AND {_LABELLED('l')} WHERE a.p = '{TYPE}' AND a.o IN ('{ex('Region')}', '{ex('Nation')}')"),
)
sparql(
    "search_labels",
    "SELECT ?a ?b ?c WHERE { ex:region-0 rdfs:label ?a . ex:region-1 rdfs:label ?b . ex:nation-2 rdfs:label ?c }",
    sql(f"SELECT a.o AS a, b.o AS b, c.o AS c FROM t a, t b, t c WHERE {_LABELLED('a')} AND {_LABELLED('b')} AND {_LABELLED('c')} AND a.s = '{ex('region-0')}' AND b.s = '{ex('region-1')}' AND c.s = '{ex('nation-2')}'"),
)
sparql(
    "annotation_senses",
    "SELECT ?sense ?label ?definition ?example WHERE { ?word ex:canonicalForm/ex:rep ?rep ; ex:sense ?sense . ?sense rdfs:label ?label . ?synset ex:lexicalizedSense ?sense "
    "OPTIONAL { ?synset ex:definition ?definition FILTER(LANG(?definition) = \"en\") } OPTIONAL { ?sense ex:example ?example } }",
    sql(
        f"SELECT a.o AS sense, l.o AS label, d.o AS definition, e.o AS example FROM t a JOIN t f ON f.s = a.s AND {_IS('f', 'canonicalForm')} JOIN t r ON r.s = f.o AND {_IS('r', 'rep')} JOIN t l ON l.s = a.o AND {_LABELLED('l')} "
        f"JOIN t b ON b.o = a.o AND {_IS('b', 'lexicalizedSense')} LEFT JOIN t d ON d.s = b.s AND {_IS('d', 'definition')} LEFT JOIN t e ON e.s = a.o AND {_IS('e', 'example')} WHERE {_IS('a', 'sense')}"
    ),
)
sparql(
    "tag_descriptions",
    "SELECT ?tag ?label ?pos WHERE { VALUES ?tag { ex:word-red_bolt ex:word-small_ring ex:nothing } OPTIONAL { ?tag rdfs:label ?label FILTER(LANG(?label) = \"en\") } OPTIONAL { ?tag ex:partOfSpeech ?pos } }",
    sql(
        f"SELECT v.tag, l.o AS label, q.o AS pos FROM (VALUES ('{ex('word-red_bolt')}'), ('{ex('word-small_ring')}'), ('{ex('nothing')}')) v(tag) LEFT JOIN t l ON l.s = v.tag AND {_LABELLED('l')} LEFT JOIN t q ON q.s = v.tag AND {_IS('q', 'partOfSpeech')}"
    ),
)
sparql(
    "lexicon_examples",
    "SELECT ?entry ?synset ?example WHERE { ?entry a ex:Word ; ex:sense ?sense . ?synset ex:lexicalizedSense ?sense . ?sense ex:example ?example }",
    sql(f"SELECT a.s AS entry, b.s AS synset, x.o AS example FROM t a JOIN t b ON b.o = a.o AND {_IS('b', 'lexicalizedSense')} JOIN t x ON x.s = a.o AND {_IS('x', 'example')} WHERE {_IS('a', 'sense')}"),
)
sparql("lexicon_supersenses", "SELECT ?synset ?file WHERE { ?synset a ex:Synset ; ex:lexfile ?file }", sql(f"SELECT a.s AS synset, f.o AS file FROM t a JOIN t f ON f.s = a.s AND {_IS('f', 'lexfile')} WHERE a.p = '{TYPE}' AND a.o = '{ex('Synset')}'"))
sparql(
    "lexicon_relations",
    "SELECT ?a ?p ?b WHERE { ?a a ex:Synset ; ?p ?b FILTER(?p IN (ex:eqHypernym, ex:ili, ex:domain)) }",
    sql(f"SELECT t.s AS a, t.p, t.o AS b FROM t JOIN t k ON k.s = t.s AND k.p = '{TYPE}' AND k.o = '{ex('Synset')}' WHERE t.p IN ('{ex('eqHypernym')}', '{ex('ili')}', '{ex('domain')}')"),
)

# --- cases of the language
sparql("average_distinct", "SELECT ?b (AVG(DISTINCT ?z) AS ?mean) WHERE { ?x ex:ptype ?b ; ex:size ?z } GROUP BY ?b", sql(f"SELECT b.o AS b, avg(DISTINCT CAST(regexp_extract(z.o, '^\"(\\d+)\"', 1) AS INTEGER)) AS mean FROM t b JOIN t z ON z.s = b.s AND {_IS('z', 'size')} WHERE {_IS('b', 'ptype')} GROUP BY b.o"))
sparql("from_graphs", f"SELECT ?p (COUNT(*) AS ?n) FROM {ex('graph/places')} WHERE {{ ?s ?p ?o }} GROUP BY ?p", sql(f"SELECT p, count(*) AS n FROM t WHERE s LIKE '{ex('region-')[:-1]}%' OR s LIKE '{ex('nation-')[:-1]}%' GROUP BY p"), graphs=True)
sparql(
    "negated_inverse_path",
    "SELECT ?p ?x WHERE { ex:nation-3 !(^ex:in|rdf:type|rdfs:label) ?x . ?x a ?p }",
    sql(
        f"SELECT k.o AS p, k.s AS x FROM t a JOIN t k ON k.s = a.o AND k.p = '{TYPE}' WHERE a.s = '{ex('nation-3')}' AND a.p NOT IN ('{TYPE}', '{LABEL}') "
        f"UNION ALL SELECT k.o, k.s FROM t a JOIN t k ON k.s = a.s AND k.p = '{TYPE}' WHERE a.o = '{ex('nation-3')}' AND a.p <> '{ex('in')}'"
    ),
)
sparql(
    "exists_or",
    "SELECT ?x WHERE { ?x a ex:Synset ; ex:lexfile ?f FILTER(?f = \"adj.all\" || NOT EXISTS { ?x ex:definition ?d }) }",
    sql(f"SELECT f.s AS x FROM t f JOIN t k ON k.s = f.s AND k.p = '{TYPE}' AND k.o = '{ex('Synset')}' WHERE {_IS('f', 'lexfile')} AND (f.o = '\"adj.all\"' OR NOT EXISTS (SELECT 1 FROM t d WHERE d.s = f.s AND {_IS('d', 'definition')}))"),
)
sparql(
    "graph_optional",
    "SELECT ?g ?n ?r WHERE { GRAPH ?g { ?n rdfs:label ?l OPTIONAL { ?n ex:partOf ?r } FILTER(STRSTARTS(?l, \"A\")) } }",
    sql(f"SELECT '{ex('graph/places')}' AS g, l.s AS n, r.o AS r FROM t l LEFT JOIN t r ON r.s = l.s AND {_IS('r', 'partOf')} WHERE {_LABELLED('l')} AND l.o LIKE '\"A%' AND (l.s LIKE '{ex('region-')[:-1]}%' OR l.s LIKE '{ex('nation-')[:-1]}%')"),
    graphs=True,
)
sparql(
    "optional_unbound",
    "SELECT ?doc ?q ?kind WHERE { ?doc a ex:Document OPTIONAL { ?doc ex:quality ?q } OPTIONAL { VALUES (?q ?kind) { (1 \"good\") (0 \"bad\") } } }",
    sql(
        f"SELECT d.s AS doc, coalesce(q.o, v.q) AS q, v.kind FROM t d LEFT JOIN t q ON q.s = d.s AND {_IS('q', 'quality')} LEFT JOIN (VALUES ('\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"good\"'), ('\"0\"^^<http://www.w3.org/2001/XMLSchema#integer>', '\"bad\"')) v(q, kind) "
        f"ON q.o = v.q OR q.o IS NULL WHERE d.p = '{TYPE}' AND d.o = '{ex('Document')}'"
    ),
)
sparql(
    "minus_unbound",
    "SELECT ?doc ?q WHERE { ?doc a ex:Document OPTIONAL { ?doc ex:quality ?q } MINUS { VALUES ?q { 0 } } }",
    sql(f"SELECT d.s AS doc, q.o AS q FROM t d LEFT JOIN t q ON q.s = d.s AND {_IS('q', 'quality')} WHERE d.p = '{TYPE}' AND d.o = '{ex('Document')}' AND (q.o IS NULL OR q.o NOT LIKE '\"0\"%')"),
)
sparql(
    "path_plus_seeded",
    "SELECT ?x ?y WHERE { ?x ex:brand \"Brand#7\" . ?x ex:hypernym+ ?y }",
    sql(
        f"SELECT x, y FROM r",
        f"seed AS (SELECT a.s FROM t a WHERE {_IS('a', 'brand')} AND a.o = '\"Brand#7\"')",
        f"r AS (SELECT s AS x, o AS y FROM t WHERE {p('hypernym')} AND s IN (SELECT s FROM seed) UNION SELECT r.x, t.o FROM r JOIN t ON t.s = r.y AND {p('hypernym')})",
        recursive=True,
    ),
)
