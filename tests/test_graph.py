"""Taxonomy golden numbers, cycles, inference and validation on hand-made graphs."""

import math

import pytest

from lexiloom.functions.terms import PREFIXES
from lexiloom.operators import entity, etl, taxonomy, validate
from lexiloom.operators.closure import distances, longest_depths, reachable
from lexiloom.operators.infer import infer, predicate_closure, superproperties
from lexiloom.sources.turtle import parse_turtle

CHAIN = [("54219", "5619"), ("5619", "2355"), ("2355", "20633"), ("56495", "5619")]


def frame(spark, rows, columns="src string, dst string"):
    return spark.createDataFrame(rows, columns)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_distances_and_similarity(spark):
    edges = frame(spark, CHAIN)
    seeds = spark.createDataFrame([("54219",), ("56495",)], "node string")
    dist = distances(edges, seeds)
    assert {(a, d) for n, a, d in as_set(dist) if n == "54219"} == {("54219", 0), ("5619", 1), ("2355", 2), ("20633", 3)}
    pairs = spark.createDataFrame([("54219", "56495"), ("54219", "54219")], "a string, b string")
    got = {r["b"]: r for r in taxonomy.similarity(pairs, dist, longest_depths(edges), 13).collect()}
    assert got["56495"]["lcs"] == "5619"
    assert got["56495"]["path"] == pytest.approx(1 / 3)
    assert got["56495"]["wup"] == pytest.approx(0.75)
    assert got["56495"]["lch"] == pytest.approx(-math.log(3 / 26))
    assert got["54219"]["wup"] == pytest.approx(1.0)


def test_disconnected_pair(spark):
    edges = frame(spark, [("a", "b"), ("x", "y")])
    pairs = spark.createDataFrame([("a", "x")], "a string, b string")
    row = taxonomy.similarity(pairs, distances(edges), longest_depths(edges), 3).first()
    assert (row["path"], row["lch"], row["wup"]) == (0.0, None, None)


def test_cycles_end(spark):
    loop = frame(spark, [("a", "a")])
    assert as_set(distances(loop)) == {("a", "a", 0)}
    assert as_set(longest_depths(loop)) == {("a", 1)}
    two = frame(spark, [("a", "b"), ("b", "a")])
    assert as_set(distances(two)) == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1)}
    assert as_set(reachable(two)) == {("a", "b"), ("a", "a"), ("b", "a"), ("b", "b")}


def test_diamond(spark):
    edges = frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("e", "d")])
    assert dict(as_set(longest_depths(edges)))["a"] == 3
    assert ("a", "d", 2) in as_set(distances(edges))


def test_orthogonal_fallback(spark):
    t = spark.createDataFrame([("x", "o", "p"), ("y", "o", "q"), ("y", "h", "r")], "s string, p string, o string")
    assert as_set(taxonomy.hypernym_graph(t, "h", "o")) == {("x", "p", True), ("y", "r", False)}


def test_inference(spark):
    inv, sub = f"<{PREFIXES['owl']}inverseOf>", f"<{PREFIXES['rdfs']}subPropertyOf>"
    schema = [("h", inv, "y"), ("h", sub, "b"), ("y", sub, "n")]
    assert predicate_closure(schema)["h"] == {("y", True), ("b", False), ("n", True)}
    t = spark.createDataFrame([("<a>", "h", "<c>"), ("<a>", "h", '"x"')], "s string, p string, o string")
    assert as_set(infer(t, schema)) == {("<a>", "h", "<c>"), ("<a>", "h", '"x"'), ("<c>", "y", "<a>"), ("<a>", "b", "<c>"), ("<a>", "b", '"x"'), ("<c>", "n", "<a>")}
    assert superproperties([("h", sub, "b"), ("b", sub, "h"), ("h", sub, "t")])["h"] == {"t"}


def test_superproperties_fold(spark):
    supers = {"h": {"b"}}
    t = spark.createDataFrame([("s", "h", "1"), ("s", "h", "2"), ("s", "b", "1"), ("s", "b", "2"), ("u", "h", "1"), ("u", "b", "1"), ("u", "b", "3")], "s string, p string, o string")
    assert as_set(entity.folded_predicates(t, supers)) == {("s", "b")}


UNIT = """
@prefix dn: <http://ex.org/dn/> .
dn:entry-1 a ontolex:LexicalEntry ; rdfs:label "hund" ; wn:partOfSpeech wn:noun ; ontolex:sense dn:sense-1 ; ontolex:canonicalForm dn:form-1 .
dn:form-1 ontolex:writtenRep "hund"@da .
"""


def entry_report(spark, text):
    ontolex, rdfs, wn = PREFIXES["ontolex"], PREFIXES["rdfs"], PREFIXES["wn"]
    v = validate.Validator(spark.createDataFrame(parse_turtle(text), "s string, p string, o string"), f"<{PREFIXES['rdf']}type>")
    entry = validate.Shape("EntryShape", (f"<{ontolex}LexicalEntry>",), "<http://ex.org/dn/")
    form = f"<{ontolex}canonicalForm>"
    return validate.union(
        v.min_count(entry, f"<{rdfs}label>"), v.min_count(entry, f"<{wn}partOfSpeech>"), v.min_count(entry, f"<{ontolex}sense>"), v.min_count(entry, form),
        v.max_count(entry, form), v.not_literal(entry, form), v.min_count(entry, form, f"<{ontolex}writtenRep>"), v.irreflexive("Self", f"<{wn}hypernym>"),
        v.asymmetric("Mutual", f"<{wn}hypernym>"), v.contradiction("Part", f"<{wn}mero_part>", f"<{wn}holo_part>"),
    )


def test_conforming_unit(spark):
    assert entry_report(spark, UNIT).count() == 0


@pytest.mark.parametrize(
    ("text", "constraint"),
    [
        (UNIT.replace('rdfs:label "hund" ; ', ""), "MinCount"),
        (UNIT.replace("wn:partOfSpeech wn:noun ; ", ""), "MinCount"),
        (UNIT.replace("ontolex:sense dn:sense-1 ; ", ""), "MinCount"),
        (UNIT + "dn:entry-1 ontolex:canonicalForm dn:form-2 .", "MaxCount"),
        (UNIT.replace("ontolex:canonicalForm dn:form-1", 'ontolex:canonicalForm "hund"'), "NodeKind"),
        (UNIT.replace('ontolex:writtenRep "hund"@da', "rdfs:label 1"), "MinCount"),
        (UNIT + "dn:a wn:hypernym dn:a .", "SPARQL"),
        (UNIT + "dn:a wn:hypernym dn:b . dn:b wn:hypernym dn:a .", "SPARQL"),
        (UNIT + "dn:a wn:mero_part dn:b ; wn:holo_part dn:b .", "SPARQL"),
    ],
)
def test_mutations(spark, text, constraint):
    assert constraint in {r["constraint"] for r in entry_report(spark, text).collect()}


def test_export_gate(spark):
    bad = entry_report(spark, UNIT.replace('rdfs:label "hund" ; ', ""))
    validate.validate_export(bad, {"EntryShape": 1})
    with pytest.raises(validate.ValidationFailed):
        validate.validate_export(bad, {})


def test_rewriting(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("c", "p", "b"), ("b", "q", "z")], "s string, p string, o string")
    assert as_set(etl.rename_resources(t, spark.createDataFrame([("c", "a")], "old string, new string"))) == {("a", "p", "b"), ("b", "q", "z")}
    gone = spark.createDataFrame([(None, "q", None)], "s string, p string, o string")
    assert as_set(etl.update_triples(t, removals=gone)) == {("a", "p", "b"), ("c", "p", "b")}
    assert etl.update_triples(t, removals=spark.createDataFrame([(None, None, None)], "s string, p string, o string")).count() == 0
