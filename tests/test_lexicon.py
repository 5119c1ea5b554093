"""Dictionary operators, labels, rewriting and closures on small hand-made rows."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import labels as L
from lexiloom.functions.tables import scratch, write_table
from lexiloom.operators import etl, lexicon
from lexiloom.operators.closure import distances, longest_depths, reachable
from lexiloom.plans import registry
from lexiloom.plans.lower import Lowering
from lexiloom.plans.parser import parse
from lexiloom.sources.relational import view_triples


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("few", [0, 1000])
def test_closures_by_walk_and_by_rounds(spark, few):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("l", "l")], "src string, dst string")
    assert {(n, a): d for n, a, d in rows(distances(edges, few=few))} == {
        ("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("a", "e"): 2, ("b", "b"): 0, ("b", "d"): 1, ("c", "c"): 0, ("c", "d"): 1, ("c", "e"): 1, ("e", "e"): 0, ("e", "d"): 1,
        ("x", "x"): 0, ("x", "y"): 1, ("y", "y"): 0, ("y", "x"): 1, ("z", "z"): 0, ("z", "x"): 1, ("z", "y"): 2, ("l", "l"): 0,
    }
    found = set(rows(reachable(edges, few=few)))
    assert {("x", "x"), ("l", "l"), ("z", "y"), ("a", "d")} <= found and ("a", "a") not in found and len(found) == 15
    depth = dict(rows(longest_depths(edges, few=few)))
    assert (depth["a"], depth["b"], depth["c"], depth["e"], depth["l"], depth["x"], depth["z"]) == (3, 1, 2, 1, 1, 2, 2)


def test_canonical_and_short_labels(spark):
    df = spark.createDataFrame([("s", "hund_§1a", 3), ("s", "hund_§2", 9), ("s", "køter_§1", 1), ("s", "vovse_§1", 5), ("s", "…", 0), ("t", "kat_§1", 1)], "synset string, label string, senses int")
    assert rows(lexicon.canonical_labels(df, senses="senses")) == [("s", "hund_§1a", 1), ("s", "vovse_§1", 2), ("t", "kat_§1", 1)]
    assert rows(lexicon.short_labels(df, senses="senses")) == [("s", "{hund_§1a; vovse_§1; …}")]
    label = spark.createDataFrame([("{hund_§1a; køter_§2}",)], "l string").select(L.strip_sense_markers(F.col("l")), L.synset_indicator(F.col("l")), L.marked_indicator(F.col("l")))
    assert rows(label) == [("{hund; køter}", "hund, køter", "hund §1a, køter §2")]


def test_lemma_spans(spark):
    df = spark.createDataFrame([("Hund", "En hund og HUNDEN, ikke overhund"), ("", "x"), ("a", "")], "lemma string, text string")
    got = [[(s["start"], s["end"]) for s in r["spans"]] for r in lexicon.lemma_spans(df).collect()]
    assert got == [[(3, 7), (11, 17)], [], []]


def test_cloud_of_many_items(spark):
    items = spark.createDataFrame([(f"i{k:02d}", k) for k in range(40)], "item string, n int")
    got = {r["item"]: r for r in lexicon.cloud_weights(items, "item", "n").collect()}
    assert got["i39"]["size"] == 1 and got["i00"]["size"] == 0 and got["i39"]["highlight"] and not got["i05"]["highlight"]
    with pytest.raises(ValueError):
        lexicon.cloud_weights(items, "item", "n", most=10)


def test_rewriting(spark):
    t = spark.createDataFrame([("<a>", "<p>", '"1"'), ("<b>", "<p>", '"1"'), ("<b>", "<d>", '"x"'), ("<c>", "<r>", "<a>"), ("<c>", "<r>", "<b>")], "s string, p string, o string")
    names = etl.merge_duplicates(t, ["<p>"], "<d>")
    assert rows(names) == [("<a>", "<b>")]
    merged = etl.merge_resources(t, names.select(F.col("loser").alias("old"), F.col("winner").alias("new")), ["<d>"])
    assert rows(merged) == [("<b>", "<d>", '"x"'), ("<b>", "<p>", '"1"'), ("<c>", "<r>", "<b>")]
    assert etl.remove_all(t, "<p>", 2).count() == 3
    with pytest.raises(ValueError):
        etl.remove_all(t, "<p>", 3)
    etl.check_release(t, "<b>", "<d>", '"x"')
    with pytest.raises(ValueError):
        etl.check_release(t, "<b>", "<d>", '"y"')
    assert etl.release(t, "1", "2", lambda x: x.limit(0)).count() == 0 and etl.release(t, "2", "2", lambda x: x.limit(0)).count() == 5


def test_search_kind():
    assert [lexicon.search_kind(x) for x in ("<http://a>", "https://a", "ex:part-1", "no:body knows", "hund", "  ")] == ["iri", "link", "qname", "lemma", "lemma", "nothing"]


def test_builtins_and_dataset_clause(spark):
    quads = spark.createDataFrame([("<g>", "<a>", "<p>", '"2020-01-02T03:04:05-05:30"'), ("<h>", "<b>", "<p>", '"x"')], "g string, s string, p string, o string")
    low = Lowering(quads.select("s", "p", "o"), quads)
    got = low.run(parse("SELECT ?s FROM <h> WHERE { ?s ?p ?o }")).collect()
    assert [r["s"] for r in got] == ["<b>"]
    assert Lowering(quads.select("s", "p", "o"), quads).run(parse("SELECT ?s FROM <http://none> WHERE { ?s ?p ?o }")).count() == 0
    with pytest.raises(ValueError):
        Lowering(quads.select("s", "p", "o")).run(parse("SELECT ?s FROM <g> WHERE { ?s ?p ?o }"))
    r = Lowering(quads.select("s", "p", "o")).run(parse("SELECT ?z ?y ?r ?u ?h ?n ?b WHERE { <a> <p> ?o BIND(TZ(?o) AS ?z) BIND(TIMEZONE(?o) AS ?y) BIND(RAND() AS ?r) BIND(UUID() AS ?u) BIND(SHA384(?o) AS ?h) BIND(NOW() AS ?n) BIND(BNODE() AS ?b) }")).first()
    assert r["z"] == "-05:30" and r["y"].startswith('"-PT5H30M"') and 0 <= r["r"] < 1 and r["u"].startswith("<urn:uuid:") and len(r["h"]) == 96 and "dateTime" in r["n"] and r["b"].startswith("_:")


def test_scratch_deletes(spark):
    with scratch(spark):
        gone = write_table(spark.range(3), "gone")
        stays = write_table(gone, "stays", keep=True)
    assert stays.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_clones_as_often_as_their_rows(spark):
    """Against all pairs of rows, with names that share members, repeated rows, nulls and pieces."""
    rng = random.Random(3)
    data = [(rng.choice("st"), f"n{rng.randrange(5)}", f"m{rng.randrange(9)}") for _ in range(70)] + [("u", "n1", "m1")] * 3 + [("u", "n2", "m2")] * 400 + [("u", "n3", "m3")] * 300 + [("u", None, "m4"), ("u", "n4", None)]
    rows = spark.createDataFrame(data, "s string, a string, x string")
    want = Counter((a, b) for s, a, x in data for t, b, y in data if s == t and None not in (a, b, x, y) and a != b and x != y)
    assert want["n2", "n3"] > lexicon.PAIR_ROWS
    found = lexicon.clones(rows, ["s"], "a", "x")
    assert {(r.a, r.b): r["count"] for r in found.groupBy("a", "b").count().collect()} == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clones_as_the_pattern_says(spark):
    t = view_triples(spark, "/root/testdata/sf0.001")
    text = "SELECT ?a ?b WHERE { ?a ex:sense ?x . ?b ex:sense ?y . ?s ex:lexicalizedSense ?x, ?y . ex:part-7 ex:brand ?brand . ?x ex:brand ?brand . ?y ex:brand ?brand FILTER(?a != ?b && ?x != ?y) }"
    want = Lowering(t).run(parse(text))
    found = registry.filter_neq_clones(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
