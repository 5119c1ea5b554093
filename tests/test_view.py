"""Queries that name their predicates read the tables of these and no others."""

import os
import shutil

import duckdb
import pytest

from lexiloom.plans import exchange, lexical, reports
from lexiloom.plans.algebra import predicates
from lexiloom.plans.parser import parse
from lexiloom.sources import relational
from lexiloom.sources.relational import DICTIONARY, VIEW, view_quads

ORACLES, QUERIES = exchange.ORACLES, exchange.QUERIES
assert lexical.QUERIES is QUERIES and reports.QUERIES is QUERIES  # one register

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

NEEDED = {
    "union_sources": "supplier nation region customer orders part documents",  # all that have a type or a place
    "csv_table": "part documents region nation",  # all that have labels
    "entry_forms": "part",
    "relation_in_use": "part",
    "largest_parents": "part",
    "merged_resources": "part",
    "infer_inverse": "part",
}


def _put(folder, *tables):
    for t in tables:
        (shutil.copytree if os.path.isdir(f"{SF}/{t}.parquet") else shutil.copy)(f"{SF}/{t}.parquet", folder / f"{t}.parquet")


@pytest.mark.parametrize("name", sorted(NEEDED))
def test_no_table_of_other_predicates(spark, tmp_path, name):
    _put(tmp_path, *NEEDED[name].split())
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in sorted({v[1] for v in VIEW}):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'/*' if os.path.isdir(f'{SF}/{t}.parquet') else ''}')")
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
    text = lambda rows: sorted([str(v) for v in r] for r in rows)
    assert text(df.collect()) == text(found) and found


def test_each_predicate_as_in_the_store(spark):
    whole = view_quads(spark, SF, True)
    every = {v[4] for v in VIEW + DICTIONARY}
    own = view_quads(spark, SF, True, every)
    assert own.exceptAll(whole).isEmpty() and whole.exceptAll(own).isEmpty()
    assert view_quads(spark, SF, True, ["<none>"]).isEmpty()
    assert view_quads(spark, SF, False, every).count() == view_quads(spark, SF).count()


def test_predicates_of_a_query():
    of = lambda text: predicates(parse(text))
    ex = lambda *names: {f"<{relational.EX}{n}>" for n in names}
    assert of("SELECT ?a { ?a ex:b/^ex:c+ ?d OPTIONAL { ?d ex:e ?f } MINUS { ?a ex:g ?h } FILTER(?a != ?d && NOT EXISTS { ?d ex:i ?a }) }") == ex("b", "c", "e", "g", "i")
    assert of("SELECT ?a { GRAPH ?g { ?a (ex:b|ex:c) ?d } { SELECT ?a { ?a ex:e ?f } } }") == ex("b", "c", "e")
    for text in ("?a ?b ?c", "?a ex:b* ?c", "?a ex:b? ?c", "?a !ex:b ?c", "?a ex:b ?c FILTER EXISTS { ?a ?p ?c }"):
        assert of(f"SELECT ?a {{ {text} }}") is None
    assert of("DESCRIBE ex:b") is None
