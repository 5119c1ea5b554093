"""Export frames: CSV tables with metadata, lexicon documents as nested rows, and their checks."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import terms as T
from lexiloom.sources.documents import write_document, xml_text


def csv_table(triples: DataFrame, *predicates: str) -> DataFrame:
    """(s, one column per predicate): values as one cell, in order and joined by a semicolon."""
    rows = triples.where(F.col("p").isin(*predicates))
    cells = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == p, T.lex(F.col("o"))))), "; ").alias(f"c{i}") for i, p in enumerate(predicates)]
    return rows.groupBy("s").agg(*cells)


def relation_table(triples: DataFrame, namespace: str) -> DataFrame:
    """(s, p, o) between resources of one namespace."""
    return triples.where(F.col("o").startswith(f"<{namespace}") & F.col("s").startswith(f"<{namespace}")).select("s", "p", "o").distinct()


def csvw_metadata(table: str, columns: dict[str, str], key: str) -> str:
    """CSVW metadata of a headerless table: column names with their property IRIs."""
    body = {
        "@context": "http://www.w3.org/ns/csvw",
        "url": f"{table}.csv",
        "dialect": {"header": False},
        "tableSchema": {"columns": [{"name": n, "titles": n, "propertyUrl": iri} for n, iri in columns.items()], "primaryKey": key},
    }
    return json.dumps(body, ensure_ascii=False, indent=2)


def lexicon_entries(triples: DataFrame, written: str, sense: str, lexicalized: str) -> DataFrame:
    """(id, lemma, senses array<struct<id, synset>>) of each word, senses in order."""
    forms = triples.where(F.col("p") == written).groupBy(F.col("s").alias("id")).agg(F.min(T.lex(F.col("o"))).alias("lemma"))
    senses = triples.where(F.col("p") == sense).select(F.col("s").alias("id"), F.col("o").alias("sense"))
    concepts = triples.where(F.col("p") == lexicalized).select(F.col("s").alias("synset"), F.col("o").alias("sense"))
    rows = senses.join(concepts, "sense").groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("sense").alias("id"), "synset"))).alias("senses"))
    return forms.join(rows, "id", "left")


def concept_entries(triples: DataFrame, lexicalized: str, relations: list[str]) -> DataFrame:
    """(id, members, relations array<struct<relType, target>>) of concepts that have members; concepts without relations stay."""
    members = triples.where(F.col("p") == lexicalized).groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("o")).alias("members"))
    known = members.select("id")
    edges = triples.where(F.col("p").isin(*relations)).join(known.withColumnRenamed("id", "s"), "s", "left_semi").join(known.withColumnRenamed("id", "o"), "o", "left_semi")
    rows = edges.groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col("p").alias("relType"), F.col("o").alias("target")))).alias("relations"))
    return members.join(rows, "id", "left")


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_json(df: DataFrame, path: str) -> None:
    """One document a line; empty arrays are left out as absent values are."""
    cells = [F.when(F.size(c) > 0, F.col(c)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(F.to_json(F.struct(*cells)).alias("value")).write.text(path)


def relation_pairs(triples: DataFrame, predicate: str, inverse: str | None) -> DataFrame:
    """(a, b): a relation with its obverse flipped, self pairs dropped; without an inverse it is symmetric and unordered."""
    rows = triples.where(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))
    if inverse is not None:
        rows = rows.unionByName(triples.where(F.col("p") == inverse).select(F.col("o").alias("a"), F.col("s").alias("b")))
    rows = rows.where("a <> b")
    return (rows if inverse is not None else rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def indicators(rows: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """The first text where it is unique in its group, else the second where that is, else none."""
    one = F.count(F.lit(1)).over(Window.partitionBy(group, first))
    two = F.count(F.lit(1)).over(Window.partitionBy(group, second))
    return rows.withColumn("indicator", F.when(one == 1, F.col(first)).when(two == 1, F.col(second)))


def listing_order(rows: DataFrame, group: str, weight: Column, name: str) -> DataFrame:
    """``pos``: place from 1 in the group by weight, highest first, then by name."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(weight.desc(), name)))


def single_label_codes(rows: DataFrame, code: str, label: str) -> DataFrame:
    """(code, label) of codes with exactly one label."""
    return rows.groupBy(code).agg(F.count_distinct(label).alias("n"), F.min(label).alias(label)).where("n = 1").select(code, label)


def duplicate_ids(entries: DataFrame, column: str = "id") -> DataFrame:
    return entries.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_references(references: DataFrame, declared: DataFrame) -> DataFrame:
    """References (ref) to identifiers (id) that nothing declares."""
    return references.select("ref").distinct().join(declared.select(F.col("id").alias("ref")), "ref", "left_anti")


def catalog(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(uri): distinct sources named by any of the predicates; a form with a trailing ``/`` or ``#`` goes where the plain one exists."""
    return plain_sources(triples.where(F.col("p").isin(*predicates) & F.col("o").startswith("<")).select(F.col("o").alias("uri")))


def plain_sources(found: DataFrame) -> DataFrame:
    """(uri) without forms with a trailing ``/`` or ``#`` of which the plain one is there too."""
    found = found.select("uri").distinct()
    plain = found.where(~F.col("uri").rlike("[/#]>$")).select(F.col("uri").alias("base"))
    variant = found.where(F.col("uri").rlike("[/#]>$")).withColumn("base", F.regexp_replace("uri", "[/#]>$", ">"))
    return found.join(variant.join(plain, "base", "left_semi").select("uri"), "uri", "left_anti")


def catalog_entries(found: DataFrame, triples: DataFrame, labels: list[str], prefix: str) -> DataFrame:
    """(uri, label, prefix) of sources (uri): texts of specifications and spare forms left out, the label by the first of the predicates that there is one under."""
    uris = plain_sources(found.where(F.col("uri").startswith("<") & ~F.col("uri").contains("www.w3.org/TR/")))
    rank = F.lit(len(labels))
    for i, p in reversed(list(enumerate(labels))):
        rank = F.when(F.col("p") == p, i).otherwise(rank)
    named = triples.where(F.col("p").isin(*labels)).groupBy(F.col("s").alias("uri")).agg(F.min(F.struct(rank.alias("rank"), "o"))["o"].alias("label"))
    short = triples.where(F.col("p") == prefix).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("prefix"))
    return uris.join(named, "uri", "left").join(short, "uri", "left")


def write_lexicon(entries: DataFrame, concepts: DataFrame, path: str, attributes: dict[str, str]) -> None:
    """A lexicon document in parts: entries with their lemma and senses, then concepts with members and relations, in the order of their names.

    ``entries`` and ``concepts`` are those of :func:`lexicon_entries` and :func:`concept_entries`; entries without a sense are left out.
    """
    name = lambda c: xml_text(F.regexp_extract(c, "([^/#]+)>$", 1))
    tag = lambda kind, *pairs: F.concat(F.lit(f"<{kind}"), *[x for key, value in pairs for x in (F.lit(f' {key}="'), value, F.lit('"'))])
    senses = F.array_join(F.transform("senses", lambda s: F.concat(tag("Sense", ("id", name(s["id"])), ("synset", name(s["synset"]))), F.lit("/>"))), "")
    entry = F.concat(tag("LexicalEntry", ("id", name(F.col("id")))), F.lit(">"), tag("Lemma", ("writtenForm", xml_text(F.col("lemma")))), F.lit("/>"), senses, F.lit("</LexicalEntry>"))
    relations = F.coalesce(F.array_join(F.transform("relations", lambda r: F.concat(tag("SynsetRelation", ("relType", name(r["relType"])), ("target", name(r["target"]))), F.lit("/>"))), ""), F.lit(""))
    members = F.array_join(F.transform("members", name), " ")
    concept = F.concat(tag("Synset", ("id", name(F.col("id"))), ("members", members)), F.lit(">"), relations, F.lit("</Synset>"))
    rows = entries.where(F.size("senses") > 0).select(F.lit(0).alias("place"), "id", entry.alias("text")).unionByName(concepts.select(F.lit(1).alias("place"), "id", concept.alias("text")))
    said = "".join(f' {k}="{html.escape(v)}"' for k, v in attributes.items())
    write_document(rows, ["place", "id"], "text", path, f'<?xml version="1.0" encoding="UTF-8"?>\n<LexicalResource><Lexicon{said}>', "</Lexicon></LexicalResource>")


def validate_document(text: str) -> list[str]:
    """Problems of a lexicographic resource in JSON: root kind, required and unknown keys, languages, entries."""

    def pairs(items: list) -> dict:
        keys = [k for k, _ in items]
        twice = sorted({k for k in keys if keys.count(k) > 1})
        if twice:
            raise ValueError(f"repeated key {twice[0]}")
        return dict(items)

    try:
        root = json.loads(text, object_pairs_hook=pairs)
    except ValueError as e:
        return [f"not JSON: {e}"]
    if not isinstance(root, dict):
        return ["the root is not an object"]
    out = []
    known = {"langCode": str, "translationLanguages": list, "entries": list, "title": str}
    out += [f"unknown property {k}" for k in root if k not in known]
    out += [f"{k} has the wrong kind" for k, kind in known.items() if k in root and not isinstance(root[k], kind)]
    if "langCode" not in root:
        out.append("langCode is missing")
    if not root.get("entries"):
        out.append("there is no entry")
    languages = root.get("translationLanguages") or []
    if isinstance(languages, list) and len(set(map(str, languages))) != len(languages):
        out.append("a translation language is repeated")
    for i, e in enumerate(root["entries"] if isinstance(root.get("entries"), list) else []):
        if not isinstance(e, dict) or not e.get("headword"):
            out.append(f"entry {i} has no headword")
    return out
