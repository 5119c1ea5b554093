import pytest

from lexiloom.plans import algebra as A
from lexiloom.plans.parser import QueryError, parse


def test_kinds_of_queries():
    assert parse("SELECT ?s WHERE { ?s a ex:C }").kind == "select"
    assert parse("ASK { ?s a ex:C }").kind == "ask"
    assert parse("CONSTRUCT { ?s ex:p ?o } WHERE { ?o ex:q ?s }").kind == "construct"
    assert parse("DESCRIBE ex:a").targets == ("<http://ex.org/a>",)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("SELECT ?s WHERE { ?s ?p ?o } " + " " * 5000, "too-long"),
        ("DELETE WHERE { ?s ?p ?o }", "update"),
        ("INSERT DATA { ex:a ex:b ex:c }", "update"),
        ("SELECT ?s WHERE { SERVICE <http://x/> { ?s ?p ?o } }", "unsafe"),
        ("SELECT ?s WHERE { ?s ?p }", "parse"),
        ("SELECT ?s WHERE { ?s nope:p ?o }", "parse"),
        ("nothing at all", "parse"),
    ],
)
def test_refusals(text, kind):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.kind == kind


def test_paths_and_literals():
    q = parse("SELECT * WHERE { ?a ex:p/^ex:q|ex:r+ ?b ; ex:s 'x'@da, 1, 2.5, true }")
    bgp = q.body.child
    assert bgp.triples[0].p == A.Path("alt", (A.Path("seq", (A.Path("iri", ("<http://ex.org/p>",)), A.Path("inv", (A.Path("iri", ("<http://ex.org/q>",)),)))), A.Path("plus", (A.Path("iri", ("<http://ex.org/r>",)),))))
    assert [t.o for t in bgp.triples[1:]] == [
        '"x"@da', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>',
    ]


def test_rewrites_of_the_root():
    q = parse("SELECT ?s WHERE { ?s ?p ?o } LIMIT 500")
    assert A.has_user_pagination(q) and A.user_limit(q) == 500
    assert A.limit_results(q, 100).body.limit == 100
    assert A.limit_results(parse("SELECT ?s WHERE { ?s ?p ?o } LIMIT 5"), 100).body.limit == 5
    assert A.offset_results(parse("SELECT ?s WHERE { ?s ?p ?o } OFFSET 7"), 3).body.offset == 7
    assert isinstance(A.ensure_distinct(q).body.child, A.Distinct)
    assert A.ensure_distinct(A.ensure_distinct(q)) == A.ensure_distinct(q)
