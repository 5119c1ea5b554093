"""RDF terms as canonical strings: ``<iri>``, ``_:b``, ``"x"``, ``"x"@da``, ``"1"^^<dt>``.

Term equality is equality of one string column, so pattern joins stay plain
equi-joins; kind, lexical form, language and datatype are projections of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces of the vocabularies that queries may name by prefix.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/terms/",
    "ontolex": "http://www.w3.org/ns/lemon/ontolex#",
    "lexinfo": "http://www.lexinfo.net/ontology/3.0/lexinfo#",
    "wn": "https://globalwordnet.github.io/schemas/wn#",
    "sh": "http://www.w3.org/ns/shacl#",
    "ex": "http://ex.org/",
}
XSD = PREFIXES["xsd"]
NUMERIC = [f"{XSD}{t}" for t in ("integer", "decimal", "double", "float", "long", "int")]


def iri(name: str, prefixes: dict[str, str] | None = None) -> str:
    """The term of a qualified name or of a full IRI."""
    if name.startswith("<") or name.startswith("_:"):
        return name
    prefix, colon, local = name.partition(":")
    known = PREFIXES if prefixes is None else prefixes
    return f"<{known[prefix]}{local}>" if colon and prefix in known else f"<{name}>"


def literal(lex: str, lang: str | None = None, datatype: str | None = None) -> str:
    text = lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{text}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != f"{XSD}string" else "")


_LITERAL = re.compile(r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$', re.S)
_ESCAPES = {"\\n": "\n", "\\r": "\r", "\\t": "\t"}


def parse_term(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form, language, datatype) of a term."""
    if term.startswith("<"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "bnode", term[2:], None, None
    m = _LITERAL.match(term)
    if not m:
        raise ValueError(f"not a term: {term!r}")
    lex = re.sub(r"\\.", lambda e: _ESCAPES.get(e[0], e[0][1]), m[1])
    return "lit", lex, m[2], m[3]


def qname(term: str, prefixes: dict[str, str] | None = None) -> str:
    """``prefix:local`` where a namespace fits (the longest one), else the term."""
    best = max(((p, u) for p, u in (prefixes or PREFIXES).items() if term.startswith(f"<{u}")), key=lambda x: len(x[1]), default=None)
    return f"{best[0]}:{term[1 + len(best[1]):-1]}" if best else term


def kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").when(term.isNotNull(), "lit")


def lex(term: Column) -> Column:
    """STR(): an IRI without brackets, a literal's lexical form."""
    body = F.regexp_extract(term, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\\n", "\n"), r"\\t", "\t"), r"\\r", "\r"), r"\\(.)", "$1")
    simple = F.when(body.contains("\\"), plain).otherwise(body)
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).when(term.startswith('"'), simple)


def lang(term: Column) -> Column:
    """LANG(): empty for literals without one, null for other terms."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


def datatype(term: Column) -> Column:
    found = F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1)
    return F.when(term.startswith('"'), F.when(found != "", found).when(lang(term) != "", PREFIXES["rdf"] + "langString").otherwise(f"{XSD}string"))


def number(term: Column) -> Column:
    """The value of a numeric literal, null for other terms."""
    return F.when(datatype(term).isin(*NUMERIC), lex(term).try_cast("double"))


def to_literal(value: Column, kind_: str) -> Column:
    """A native column as a literal term."""
    text = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    tail = {"num": f'"^^<{XSD}double>', "int": f'"^^<{XSD}integer>', "bool": f'"^^<{XSD}boolean>'}.get(kind_, '"')
    return F.concat(F.lit('"'), text, F.lit(tail))


def sort_keys(term: Column) -> list[Column]:
    """Total order of terms: unbound, blank nodes, IRIs, literals; numbers by value."""
    rank = F.when(term.isNull(), 0).when(term.startswith("_:"), 1).when(term.startswith("<"), 2).otherwise(3)
    return [rank, number(term), lex(term), term]


def normalized(term: Column) -> Column:
    """A resource without a separator at its end."""
    return F.when(term.startswith("<"), F.regexp_replace(term, r"[/#]>$", ">")).otherwise(term)


def guessed_namespace(term: Column) -> Column:
    """The namespace of an IRI that no prefix is known for: up to its last ``#``, or else its last ``/``; null for other terms."""
    return F.when(term.startswith("<"), F.when(term.contains("#"), F.regexp_extract(term, "^<(.*#)", 1)).otherwise(F.regexp_extract(term, "^<(.*/)", 1)))


def guessed_local(term: Column) -> Column:
    """The local name of such an IRI: what follows the namespace."""
    return F.when(term.startswith("<"), F.when(term.contains("#"), F.regexp_extract(term, "#([^#]*)>$", 1)).otherwise(F.regexp_extract(term, "/([^/]*)>$", 1)))


def is_qname(text: Column) -> Column:
    return text.rlike("^[^:/]+:[^:/]+$")


def resource_of(name: Column, prefixes: dict[str, str] | None = None) -> Column:
    """The IRI of a qualified name, null where its prefix isn't known."""
    known = F.create_map(*[F.lit(x) for pair in (prefixes or PREFIXES).items() for x in pair])
    return F.concat(F.lit("<"), known[F.substring_index(name, ":", 1)], F.substring_index(name, ":", -1), F.lit(">"))
