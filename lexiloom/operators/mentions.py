"""Where the lemmas of a list stand in texts: the longest first, as the beginning of a word, in any case."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.shipping import ship_package

#: Lemmas of one automaton, which every task holds: some hundred bytes each. A longer list takes several passes over the texts.
LEMMAS = 500_000


def folded(text: str) -> str:
    """Lower case, a character for a character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def candidates(text: str, automaton) -> dict[int, int]:
    """start -> end of the longest lemma that stands there, where no letter stands before it."""
    out: dict[int, int] = {}
    for end, size in automaton.iter(folded(text)):
        start = end - size + 1
        if (start == 0 or not text[start - 1].isalpha()) and out.get(start, 0) <= end:
            out[start] = end + 1
    return out


def chosen(text: str, found: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, end, end of the lemma) from left to right without overlaps; ``end`` takes in the letters that follow."""
    out, free = [], 0
    for start in sorted(found):
        if start >= free:
            end = lemma = found[start]
            while end < len(text) and text[end].isalpha():
                end += 1
            out.append((start, end, lemma))
            free = end
    return out


def lemma_mentions(rows: DataFrame, lemmas: DataFrame, text: str = "text", lemma: str = "lemma", most: int = LEMMAS) -> DataFrame:
    """``rows`` with ``mentions``, an array of (start, end, lemma in lower case) in order.

    A text is passed by once, whatever the number of lemmas in the list. Null texts
    and lemmas count as empty ones, and empty lemmas stand nowhere.
    """
    spark = rows.sparkSession
    ship_package(spark)
    names = rows.columns
    wanted = lemmas.select(F.col(lemma).alias("lemma")).where("lemma <> ''").distinct()
    parts = max(1, math.ceil(wanted.count() / most))
    kept = [f"c{i}" for i in range(len(names))]
    ddl = ", ".join(f"{k} {f.dataType.simpleString()}" for k, f in zip(kept, rows.schema.fields, strict=True))
    out = rows.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(names, kept, strict=True)], F.lit(None).cast("array<struct<start:int,end:int>>").alias("found"))
    which = kept[names.index(text)]
    for part in range(parts):
        automaton = ahocorasick.Automaton()
        for word in wanted.where(F.pmod(F.xxhash64("lemma"), F.lit(parts)) == part).toPandas()["lemma"]:
            automaton.add_word(folded(word), len(word))
        automaton.make_automaton()

        def run(batches: Iterator[pd.DataFrame], automaton=automaton) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for own, before in zip(batch[which], batch["found"], strict=True):
                    have = {} if before is None else {x["start"]: x["end"] for x in before}
                    for a, b in candidates(own or "", automaton).items() if len(automaton) else ():
                        have[a] = max(b, have.get(a, 0))
                    found.append([{"start": a, "end": b} for a, b in have.items()])
                yield batch.assign(found=found)

        out = out.mapInPandas(run, f"{ddl}, found array<struct<start:int,end:int>>")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for own, found in zip(batch[which], batch["found"], strict=True):
                body = own or ""
                told.append([{"start": a, "end": b, "lemma": folded(body[a:c])} for a, b, c in chosen(body, {x["start"]: x["end"] for x in found})])
            yield batch.drop(columns="found").assign(mentions=told)

    out = out.mapInPandas(settle, f"{ddl}, mentions array<struct<start:int,end:int,lemma:string>>")
    return out.select(*[F.col(k).alias(n) for n, k in zip(names, kept, strict=True)], "mentions")
