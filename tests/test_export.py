import json

import pytest

from lexiloom.operators import export


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ('{"langCode": "da", "entries": [{"headword": "hund"}]}', None),
        ('{"langCode": "da", "entries": []}', "no entry"),
        ('{"entries": [{"headword": "hund"}]}', "langCode is missing"),
        ('{"langCode": "da", "entries": [{"headword": "h"}], "x": 1}', "unknown property"),
        ('{"langCode": "da", "translationLanguages": ["en", "en"], "entries": [{"headword": "h"}]}', "repeated"),
        ('[1]', "not an object"),
        ("", "not JSON"),
        ('{"langCode": "da", "entries": [{"headword"', "not JSON"),
        ('{"langCode": "da", "langCode": "en", "entries": [{"headword": "h"}]}', "repeated key"),
        ('{"langCode": "da", "entries": [{}]}', "no headword"),
    ],
)
def test_document_checks(text, problem):
    found = export.validate_document(text)
    assert found == [] if problem is None else any(problem in f for f in found)


def test_references_and_catalog(spark):
    refs, ids = spark.createDataFrame([("a",), ("b",)], "ref string"), spark.createDataFrame([("a",), ("c",), ("c",)], "id string")
    assert [r[0] for r in export.dangling_references(refs, ids).collect()] == ["b"]
    assert [tuple(r) for r in export.duplicate_ids(ids).collect()] == [("c", 2)]
    t = spark.createDataFrame([("s", "p", u) for u in ("<http://x>", "<http://x/>", "<http://y/>", '"z"')], "s string, p string, o string")
    assert {r[0] for r in export.catalog(t, ["p"]).collect()} == {"<http://x>", "<http://y/>"}


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("<w>", "f", '"hund"@da'), ("<w>", "s", "<k>"), ("<c>", "l", "<k>"), ("<c>", "h", "<d>"), ("<d>", "l", "<m>")], "s string, p string, o string")
    entries, concepts = export.lexicon_entries(t, "f", "s", "l"), export.concept_entries(t, "l", ["h"])
    export.write_json(concepts.coalesce(1), str(tmp_path / "json"))
    docs = [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert {d["id"]: d.get("relations") for d in docs} == {"<c>": [{"relType": "h", "target": "<d>"}], "<d>": None}
    export.write_xml(entries, str(tmp_path / "xml"), "Lexicon", "LexicalEntry")
    assert spark.read.format("xml").option("rowTag", "LexicalEntry").load(str(tmp_path / "xml")).first()["lemma"] == "hund"
    assert json.loads(export.csvw_metadata("words", {"id": "http://x/id"}, "id"))["tableSchema"]["primaryKey"] == "id"
