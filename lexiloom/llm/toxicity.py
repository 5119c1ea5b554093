"""Toxic passages as maximum-scoring segments of token log-odds.

1. Token log-odds (words and their stems) of toxic against clean texts, each text counting a token once,
   with an informative Dirichlet prior that follows the token's share in both
   classes together; tokens whose log-odds aren't significant score as the rest of the tokens do.
2. A linear-time scan (Ruzzo and Tompa) finds all maximal scoring segments.
3. Extreme-value calibration: a segment of score S in a text of n tokens has
   E = K n exp(-lambda S) chance segments; ``lambda`` is fitted on the scores of
   clean tokens, K on the best segments of random texts of such tokens, and segments with E below ``e_value`` are the passages.
4. A text's score is a logistic curve over the total calibrated score of its
   passages, fitted on the training rows.

Training takes about ``per_class`` labelled texts of each class by a hash of the
identifier, so the model is bounded by the words of these texts; every text is
scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise

_WORD = re.compile(r"\w+")


def _forms(word: str) -> list[str]:
    """A word and its proper stems of 4 to 8 letters: inflections of a stem count together, apart from the bare stem."""
    return [word, *(f"{word[:n]}~" for n in range(4, min(9, len(word))))]


class _Scores(dict):
    """Score of a white-space separated token: the highest among its words and their stems; filled as tokens come."""

    def __init__(self, words: dict[str, float], rest: float, most: int = 500_000):
        super().__init__()
        self.words, self.rest, self.most = words, rest, most

    def __missing__(self, token: str) -> float:
        own = _WORD.findall(token.lower())
        value = max((self.words.get(f, self.rest) for w in own for f in _forms(w)), default=0.0)
        if len(token) <= 60:
            if len(self) >= self.most:
                self.clear()
            self[token] = value
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in linear time."""
    cumulative = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []  # the next segment to the left with a smaller left sum, -1: none
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(cumulative[i]), float(cumulative[i + 1])
        j = len(starts) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            start, low = starts[j], left[j]
            del starts[j:], ends[j:], left[j:], right[j:], back[j:]
            j -= 1
        starts.append(start)
        ends.append(i + 1)
        left.append(low)
        right.append(high)
        back.append(j)
    return [(s, e, h - w) for s, e, w, h in zip(starts, ends, left, right, strict=True)]


class ToxicModel:
    """Token scores and calibration; small and sent to the executors with the code."""

    def __init__(self, words: dict[str, float], rest: float, scale: float, k: float, slope: float = 1.0, offset: float = 0.0, e_value: float = 0.05):
        self.words, self.rest, self.scale, self.k = words, rest, scale, k
        self.slope, self.offset, self.e_value = slope, offset, e_value
        self._tokens: _Scores | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tokens": None}

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """(first token, token after the last, score, E) of each significant passage, and the number of tokens."""
        tokens = (text or "").split()
        if self._tokens is None:
            self._tokens = _Scores(self.words, self.rest)
        if not tokens or not self.words:
            return [], len(tokens)
        scores = np.fromiter(map(self._tokens.__getitem__, tokens), np.float64, len(tokens))
        n, out = len(tokens), []
        for start, end, s in maximal_segments(scores):
            e = self.k * n * math.exp(-min(self.scale * s, 700.0))
            if e <= self.e_value:
                out.append((start, end, s, e))
        return out, n

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        """Sum over passages of -ln P, where P is the chance of a segment as good anywhere in the text."""
        return sum(-math.log(max(-math.expm1(-e), 1e-300)) for *_, e in found)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.slope * math.log1p(evidence) + self.offset))))


def _fit_scale(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1 for scores of negative mean."""
    if not (scores > 0).any() or (scores * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    total = lambda x: float((weights * np.exp(np.minimum(x * scores, 700))).sum())
    while total(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if total(mid) > 1 else (mid, high)
    return high


def _fit_k(scores: np.ndarray, weights: np.ndarray, scale: float, texts: int = 1000) -> float:
    """K of the extreme-value law, from the best scores of random texts of n tokens: a tenth of them reach the score at which E is -ln 0.9.

    The tail is what E-values are asked of. About 30 tokens of positive score are in a text.
    """
    good = float(weights[scores > 0].sum())
    if good <= 0:
        return 1.0
    rng, n = np.random.default_rng(1), int(min(50_000, max(2000, 30 / good)))
    upto = np.cumsum(weights)
    best = []
    for _ in range(texts):
        walk = np.cumsum(scores[np.minimum(np.searchsorted(upto, rng.random(n) * upto[-1], side="right"), len(scores) - 1)])
        best.append((walk - np.minimum.accumulate(np.append(0.0, walk[:-1]))).max())
    return float(-math.log(0.9) * np.exp(scale * np.quantile(best, 0.9)) / n)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a slight ridge; classes count alike."""
    a, b = 0.0, 0.0
    pos = max(1.0, y.sum())
    neg = max(1.0, len(y) - y.sum())
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.1 * a, (weight * (p - y)).sum()])
        w = weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, *, per_class: int = 6000, prior: float = 4.0, z: float = 3.0, e_value: float = 0.05) -> ToxicModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1); rows with nulls are left out.

    The labels are sampled first, by 62 bits of a hash of the identifier, so the
    broadcast side of the join has about 2 x ``per_class`` rows at any size of the
    input and no text is shuffled. A document counts once: of several labels the
    larger one, of several texts the first by name.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    slots = 2**62
    most = [int(slots * min(1.0, per_class / max(1, sizes.get(c, 0)))) for c in (0, 1)]
    place = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 2)
    chosen = labels.where(place < F.when(F.col("toxic") == 1, most[1]).otherwise(most[0])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialise(sample.select("text", "toxic"), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tally = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                tally[int(toxic)].update({f for w in set(_WORD.findall(text.lower())) for f in _forms(w)})  # a text counts once
            words = list(tally[0].keys() | tally[1].keys())
            yield pd.DataFrame({"word": words, "bad": [tally[1][w] for w in words], "good": [tally[0][w] for w in words]})

    counts = sample.mapInPandas(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialise(counts, "counts")
    n_bad, n_good = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n_bad or not n_good:
        return ToxicModel({}, -1.0, 1.0, 1.0, offset=-1.0, e_value=e_value)
    n_toxic = sample.where("toxic = 1").count()
    # of the prior's mass a token gets one count where a quarter of the toxic texts hold it
    prior = prior * (n_bad + n_good) / n_toxic
    share = (F.col("bad") + F.col("good")) / float(n_bad + n_good)
    bad, good = F.col("bad") + prior * share, F.col("good") + prior * share
    odds = F.log(bad / (n_bad + prior - bad)) - F.log(good / (n_good + prior - good))
    scored = counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / bad + 1 / good))
    top = scored.where((F.col("z") >= z) & (F.col("odds") > 1)).select("word", "odds", "bad", "good").collect()
    words = {r[0]: float(r[1]) for r in top}
    # the other tokens together: their log-odds, at least a step below 0
    rest_bad, rest_good = n_bad - sum(r[2] for r in top), n_good - sum(r[3] for r in top)
    rest = min(-0.5, math.log(max(rest_bad, 1) / n_bad) - math.log(max(rest_good, 1) / n_good))
    scores = np.array([*words.values(), rest])
    weights = np.array([*(float(r[3]) + prior * (r[2] + r[3]) / (n_bad + n_good) for r in top), float(rest_good)])
    weights /= weights.sum()
    scale = _fit_scale(scores, weights)
    model = ToxicModel(words, rest, scale, _fit_k(scores, weights, scale), e_value=e_value)

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"e": [model.evidence(model.passages(t)[0]) for t in batch["text"]], "y": batch["toxic"].astype("int32")})

    got = sample.mapInPandas(evidence, "e double, y int").toPandas()  # two numbers for each of at most 2 x per_class rows
    model.slope, model.offset = _logistic(np.log1p(got["e"].to_numpy()), got["y"].to_numpy().astype(float))
    return model


def score(df: DataFrame, model: ToxicModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The columns ``keep`` of each row plus ``score, predicted, n_passages`` and, with ``spans``, ``passages``.

    Null and empty texts have no passage and get the score of such texts. Rows
    that repeat are scored each; other columns are ignored, as are columns in
    ``keep`` that have the new names.
    """
    made_here = ("score", "predicted", "n_passages", "passages")
    order = [f for f in df.schema.fields if f.name in keep and f.name not in made_here]
    names = [f.name for f in order]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in order)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.passages(t)[0] for t in batch.column("_text").to_pylist()]
            scores = np.array([model.probability(model.evidence(f)) for f in found], np.float64)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]  # as they came
            made = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([len(f) for f in found], pa.int32())]
            if spans:
                made.append(pa.array([[{"first": s, "after": e, "score": v, "e_value": x} for s, e, v, x in f] for f in found], passage))
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "score", "predicted", "n_passages", *(["passages"] if spans else [])])

    schema = f"{fields}score double, predicted int, n_passages int" + (", passages array<struct<first:int,after:int,score:double,e_value:double>>" if spans else "")
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(text_col).alias("_text")).mapInArrow(run, schema)
