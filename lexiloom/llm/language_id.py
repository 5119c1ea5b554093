"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams, n from 1 to ``max_n``, hashed to
``dims`` slots. The kernel of two texts is the size of the intersection of their
sets over the geometric mean of their sizes. Landmarks give the Nyström map, and
one-versus-rest kernel ridge regression is solved on it. As the kernel is linear
in the presence vector, landmarks and coefficients fold into one matrix, and a
batch of texts is scored by one matrix product.

The score says which language fits best, not whether one does: a text unlike all
that was learned scores near one half. For that, ``known`` tells how many of a
text's n-grams of at least KNOWN_N characters, with repeats, are usual in the
language it was told as, which doesn't hang on the text's length, against what learned
texts have that are held out of the count.

Training takes at most ``per_language`` texts of every language, about ``samples``
in all but up to 8 of each, by a hash of the identifier; every text is read whole
and scored. More than ``languages`` languages, whose model would not fit a worker,
are an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, MAX_N = 2**15, 4
#: ``known`` looks at n-grams from KNOWN_N characters, usual in USUAL of a language's texts; the lowest LOW of learned texts set the mark.
KNOWN_N, USUAL, LOW = 3, 0.02, 0.005
_LETTER = re.compile(r"[^\W\d_]")


def ngram_slots(text: str, dims: int = DIMS, max_n: int = MAX_N) -> np.ndarray:
    """Slots of all n-grams of the lower-cased text with white space runs as one space; with repeats."""
    code = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(code), np.uint32)
    for n in range(1, max_n + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        out.append((h + np.uint32(n * 40503)) % np.uint32(dims))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def long_slots(text: str) -> np.ndarray:
    """Slots of the n-grams of KNOWN_N characters and more."""
    slots = ngram_slots(text)
    short = sum(max(0, len(" ".join(text.lower().split())) - n) for n in range(KNOWN_N - 1))
    return slots[short:]


def usual_slots(presence: np.ndarray, langs: list[str], heads: list[str]) -> tuple[np.ndarray, float]:
    """Which slots are usual in each language, by name, and the share of usual n-grams that nearly all learned texts reach.

    The mark is taken from the learned texts' ``heads``, each without its own part
    in the counts, and is 0 where fewer than 20 of them have 100 n-grams.
    """
    own = np.array(langs)
    counts = {a: presence[own == a].sum(0, dtype=np.int64) for a in sorted(set(langs))}
    least = {a: max(1.0, USUAL * langs.count(a)) for a in counts}
    shares = []
    for i, head in enumerate(heads):
        slots = long_slots(head)
        if len(slots) >= 100:
            counted = counts[langs[i]][slots] - presence[i, slots]
            shares.append(float((counted >= least[langs[i]]).mean()))
    mark = float(np.quantile(shares, LOW)) if len(shares) >= 20 else 0.0
    return np.stack([counts[a] >= least[a] for a in counts]), mark


def fit(presence: np.ndarray, langs: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix (dims x languages); ``presence`` is 0/1 by text and slot."""
    names = sorted(set(langs))
    norm = np.sqrt(np.maximum(presence.sum(1, dtype=np.int64), 1)).astype(np.float32)
    order = sorted(range(len(langs)), key=lambda i: (sum(1 for j in range(i) if langs[j] == langs[i]), langs[i]))
    marks = order[:landmarks]  # round robin over the languages
    z = presence[marks] / norm[marks, None]
    # a few rows at a time, as the driver holds little
    k_xz = np.concatenate([presence[at : at + 64].astype(np.float32) @ z.T for at in range(0, len(norm), 64)]) / norm[:, None]
    k_zz = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_zz + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = k_xz.astype(np.float64) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([langs.count(a) for a in langs])  # languages count alike
    weight = (weight / weight.mean())[:, None]
    coefficients = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(len(marks)), phi.T @ (weight * target))
    folded = root @ coefficients
    return names, np.concatenate([(z[:, at : at + 4096].T.astype(np.float64) @ folded).astype(np.float32) for at in range(0, z.shape[1], 4096)])


def identify(
    df: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = (),
    per_language: int = 400,
    languages: int = 1024,
    samples: int = 1000,
    landmarks: int = 512,
    ridge: float = 1e-2,
    batch: int = 64,
    tell_known: bool = False,
) -> DataFrame:
    """The columns ``keep`` of each row plus ``lang_pred`` and ``score`` (0 to 1), and with ``tell_known`` ``known``.

    ``known`` is false for a text whose share of usual n-grams is below 0.9 times
    what nearly all learned texts reach, by more than twice the standard error of
    a share over so many characters; a very short text is told only if the share
    is that much lower, and a text without a letter is never known.

    ``learn`` says which rows the model may learn from; of these, rows with null
    language, null identifier or without a letter are left out. A null text or
    one without a letter is ``und`` with score 0, as is every text when there is
    nothing to learn from. Rows that repeat are scored each. Columns in ``keep``
    that have the new names are replaced.
    """
    ids = F.col(id_col).cast("string")
    taught = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ids.isNotNull())
    counts = taught.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(languages + 1).collect()
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages to learn")
    slots, names, matrix = 2**62, [], np.zeros((DIMS, 0), np.float32)
    usual, mark = np.zeros((0, DIMS), bool), 0.0
    if counts:
        per_language = max(8, min(per_language, samples // len(counts)))
        rate = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(int(slots * min(1.0, per_language / r[1]))))])
        place = F.shiftrightunsigned(F.xxhash64(ids), 2)
        sample = taught.where(place < F.try_element_at(rate, F.col(lang_col))).select(
            F.xxhash64(ids).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
        )

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                rows = rows[[has_letter(t) for t in rows["text"]]]
                bits = []
                for t in rows["text"]:
                    x = np.zeros(DIMS, bool)
                    x[ngram_slots(t)] = True
                    bits.append(np.packbits(x).tobytes())
                yield pd.DataFrame({"h": rows["h"], "lang": rows["lang"], "bits": bits, "head": [t[:2000] if tell_known else "" for t in rows["text"]]})

        # at most about languages x per_language rows of dims / 8 bytes
        got = sample.mapInPandas(features, "h long, lang string, bits binary, head string").toPandas().sort_values(["h", "lang"], kind="stable")
        got = got.groupby("lang", sort=False).head(per_language)
        if len(got):
            x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1)
            names, matrix = fit(x, got["lang"].tolist(), max(landmarks, len(counts)), ridge)
            if tell_known:
                usual, mark = usual_slots(x, got["lang"].tolist(), got["head"].tolist())

    def is_known(text: str, language: int) -> bool:
        own = long_slots(text)
        return not len(own) or float(usual[language, own].mean()) >= 0.9 * mark - 1 / math.sqrt(len(own) / (MAX_N - KNOWN_N + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            texts = rows.column("_text").to_pylist()
            pred, value, known = ["und"] * len(texts), np.zeros(len(texts)), [False] * len(texts)
            able = [i for i, t in enumerate(texts) if names and has_letter(t)]
            for at in range(0, len(able), batch):
                own = able[at : at + batch]
                x = np.zeros((len(own), DIMS), np.float32)
                for k, i in enumerate(own):
                    x[k, ngram_slots(texts[i])] = 1
                f = (x @ matrix) / np.sqrt(x.sum(1))[:, None]
                best = f.argmax(1)
                for k, i in enumerate(own):
                    pred[i] = names[best[k]]
                    known[i] = tell_known and is_known(texts[i], best[k])
                    value[i] = min(1.0, max(0.0, (float(f[k, best[k]]) + 1) / 2))
            columns = [rows.column(i) for i in range(rows.num_columns - 1)]  # as they came
            columns += [pa.array(pred, pa.string()), pa.array(value), *([pa.array(known, pa.bool_())] if tell_known else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*order, *told])

    told = ["lang_pred", "score", *(["known"] if tell_known else [])]
    order = [f.name for f in df.schema.fields if f.name in keep and f.name not in told]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in order)
    named = df.select(*[F.col(f"`{c}`") for c in order], F.col(text_col).alias("_text"))
    return named.mapInArrow(score, ", ".join([*([fields] if order else []), "lang_pred string, score double", *(["known boolean"] if tell_known else [])]))
