"""Materialised inference: inverses, superproperties and part-of-speech values.

Every rule has one data atom, so the closure is computed on the small schema
alone: for each predicate the set of (predicate, swapped) it entails. One join of
the data with that set, broadcast as it only has schema rows, and one distinct
give the inferred triples; the data needs no recursion.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.terms import PREFIXES

INVERSE = f"<{PREFIXES['owl']}inverseOf>"
SUB = f"<{PREFIXES['rdfs']}subPropertyOf>"
POS = f"<{PREFIXES['wn']}partOfSpeech>"
LEX_POS = f"<{PREFIXES['lexinfo']}partOfSpeech>"
MEMBER = f"<{PREFIXES['rdfs']}member>"

#: The parts of speech that are translated between the two vocabularies.
POS_VALUES = ["noun", "verb", "adjective", "adverb", "conjunction", "adposition"]


def predicate_closure(schema: list[tuple[str, str, str]]) -> dict[str, set[tuple[str, bool]]]:
    """predicate -> {(entailed predicate, subject and object swapped)}, itself unswapped left out."""
    inverse, sub = defaultdict(set), defaultdict(set)
    for s, p, o in schema:
        if p == INVERSE:
            inverse[s].add(o)
            inverse[o].add(s)
        elif p == SUB and s != o and s != POS:
            sub[s].add(o)
    out = {}
    for start in {*inverse, *sub}:
        found, todo = set(), [(start, False)]
        while todo:
            q, swapped = todo.pop()
            for step in [(r, not swapped) for r in inverse[q]] + [(r, swapped) for r in sub[q]]:
                if step not in found:
                    found.add(step)
                    todo.append(step)
        out[start] = found - {(start, False)}
    return out


def sources(schema: list[tuple[str, str, str]], wanted: set[str]) -> set[str] | None:
    """The predicates whose statements may entail one of ``wanted``, these among them; None where members of bags are asked for, whose predicates have no end."""
    if MEMBER in wanted:
        return None
    spoken = {POS} if wanted & {LEX_POS, *(q for q, _ in predicate_closure(schema).get(LEX_POS, ()))} else set()
    return wanted | spoken | {p for p, found in predicate_closure(schema).items() if any(q in wanted for q, _ in found)}


def superproperties(schema: list[tuple[str, str, str]]) -> dict[str, set[str]]:
    """Strict superproperties; of properties that are each other's superproperty neither is."""
    direct = defaultdict(set)
    for s, p, o in schema:
        if p == SUB and s != o:
            direct[s].add(o)

    def above(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for r in direct[todo.pop()]:
                if r not in seen:
                    seen.add(r)
                    todo.append(r)
        return seen

    reach = {p: above(p) for p in list(direct)}
    return {p: {q for q in up if q != p and p not in reach.get(q, ())} for p, up in reach.items()}


def infer(triples: DataFrame, schema: list[tuple[str, str, str]]) -> DataFrame:
    """The triples and all they entail, as a set."""
    spark = triples.sparkSession
    closure = predicate_closure(schema)
    rows = [(p, q, swapped) for p, found in closure.items() for q, swapped in sorted(found)]
    parts = [triples.select("s", "p", "o")]
    # members of a bag are members
    parts.append(triples.where(F.col("p").rlike(rf"^<{PREFIXES['rdf']}_[0-9]+>$")).select("s", F.lit(MEMBER).alias("p"), "o"))
    values = spark.createDataFrame([(f"<{PREFIXES['wn']}{v}>", f"<{PREFIXES['lexinfo']}{v}>") for v in POS_VALUES], "o string, lex string")
    spoken = triples.where(F.col("p") == POS).join(F.broadcast(values), "o").select("s", F.lit(LEX_POS).alias("p"), F.col("lex").alias("o"))
    parts.append(spoken)
    if rows:
        rules = F.broadcast(spark.createDataFrame(rows, "p string, q string, swapped boolean"))  # schema rows only
        base = triples.select("s", "p", "o").unionByName(spoken)
        hit = base.join(rules, "p").where(~F.col("swapped") | ~F.col("o").startswith('"'))
        parts.append(
            hit.select(F.when(F.col("swapped"), F.col("o")).otherwise(F.col("s")).alias("s"), F.col("q").alias("p"), F.when(F.col("swapped"), F.col("s")).otherwise(F.col("o")).alias("o"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
