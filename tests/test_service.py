import pytest

from lexiloom.functions import labels as L
from lexiloom.operators.infer import infer
from lexiloom.plans.parser import QueryError
from lexiloom.plans.service import QueryService, status_of
from lexiloom.sources import tables
from lexiloom.sources.relational import SCHEMA, EX
from lexiloom.sources.turtle import parse_turtle, read_ntriples, turtle_by_subject, write_ntriples
from lexiloom.streaming.rate_limit import decide
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def service(spark):
    ex = lambda n: f"<{EX}{n}>"
    t = spark.createDataFrame([(ex(f"n{i}"), ex("partOf"), ex("r")) for i in range(5)], "s string, p string, o string")
    return QueryService(spark, t, infer(t, SCHEMA))


def test_lookahead_and_limits(service):
    r = service.run("SELECT ?n WHERE { ?n ex:partOf ?r }", limit=3)
    assert len(r.rows) == 3 and r.has_more and not r.inferred
    assert not service.run("SELECT ?n WHERE { ?n ex:partOf ?r } LIMIT 3").has_more
    assert len(service.run("SELECT ?r WHERE { ?n ex:partOf ?r }", distinct=True).rows) == 1


def test_model_choice_and_cache(service):
    r = service.run("SELECT ?n WHERE { ?r ex:hasPart ?n }")
    assert r.inferred and len(r.rows) == 5
    assert service.run("SELECT ?n WHERE { ?r ex:hasPart ?n }") is r
    assert service.run("SELECT ?n WHERE { ?r ex:hasPart ?n }", inference=False).rows == ()
    assert service.run("ASK { ?r ex:hasPart ?n }", inference=True).rows == ((True,),)


def test_statuses(service):
    with pytest.raises(QueryError) as e:
        service.run("DELETE WHERE { ?s ?p ?o }")
    assert status_of(e.value) == 403


def test_turtle_round_trip(spark, tmp_path):
    triples = parse_turtle('@prefix x: <http://x/> . x:a x:p "q\\"\\n"@en , 3 ; x:q [ x:r x:b ] . x:c x:l ( 1 2 ) .')
    df = spark.createDataFrame(triples, "s string, p string, o string")
    write_ntriples(df, str(tmp_path / "nt"))
    assert {tuple(r) for r in read_ntriples(spark, str(tmp_path / "nt")).collect()} == set(triples)
    text = "\n".join(r["turtle"] for r in turtle_by_subject(df).collect())
    assert set(parse_turtle(text)) == set(triples)


def test_quad_store(spark, tmp_path):
    rows = [("<g>", "<a>", "<p>", '"x"@da'), ("<g>", "<a>", "<p>", '"x"@da'), ("<h>", "<a>", "<q>", "<b>")]
    tables.write_quads(spark.createDataFrame(rows, tables.QUADS), str(tmp_path / "q"))
    back = tables.read_quads(spark, str(tmp_path / "q"), "<p>")
    assert [tuple(r) for r in back.select("o_kind", "o_lex", "o_lang").collect()] == [("lit", "x", "da")]
    assert tables.union_graph(tables.read_quads(spark, str(tmp_path / "q"))).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "log").write_text("MRG a < b\nnoise\nREP c < d\n")
    assert {tuple(r) for r in tables.read_change_log(spark, str(tmp_path / "log")).collect()} == {("MRG", "a", "b"), ("REP", "c", "d")}
    (tmp_path / "t.tsv").write_text("1\thund\n2\tkat\n2\tkat\n")
    rows = tables.read_tsv(spark, str(tmp_path / "t.tsv"), ["id", "lemma"])
    triples = tables.rows_to_triples(rows, (F.concat(F.lit("<"), "id", F.lit(">")), F.lit("<l>"), F.col("lemma")))
    assert triples.count() == 2
    out = tables.sparql_json(spark.createDataFrame([("<a>", '"x"@da', None)], "a string, b string, c string")).first()[0]
    assert out == '{"a":{"type":"uri","value":"a"},"b":{"type":"literal","value":"x","xml:lang":"da"}}'


def test_labels(spark):
    names = ["1§1", "§1", "2§1", "§1a", "§1b", "§2", "§12", "word"]
    df = spark.createDataFrame([(n,) for n in names], "l string")
    order = [r[0] for r in df.orderBy(L.entry_sort_key(F.col("l"))).collect()]
    assert order.index("1§1") < order.index("§1") < order.index("2§1")
    assert order.index("§1a") < order.index("§1") < order.index("§1b")
    assert order.index("§2") < order.index("§12") < order.index("word")
    row = spark.range(1).select(L.sense_labels(F.lit("{a_1; b}")), L.slug(F.lit("Æble Grød!")), L.lexfile_pos(F.lit("noun.person"))).first()
    assert tuple(row) == (["a_1", "b"], "aeble-groed", "noun")
    assert L.language_preferences("fr") == ["fr", "en", None, "da"]


def test_counters():
    assert decide([0, 10, 20, 70, 90], 2, 60)[0] == [True, True, False, False, True]
    assert decide([0, 60, 121], 1, 60)[0] == [True, False, True]
