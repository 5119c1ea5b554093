"""Log probabilities of texts under a hashed maximum-entropy model with a class-factored softmax.

1. Words of the training texts are counted by a shuffle. The ``DICTIONARY`` most
   frequent ones are known in every task; counts of all others stay in a table and
   are joined to the words of the texts, so the vocabulary has no bound.
2. The ``HEAD`` most frequent words and ``TAIL`` buckets of the others are the leaves
   of a tree of three levels with ``BRANCH`` branches, in the order of their endings. A word is
   a class, a class in it and a leaf in that one: three softmaxes of ``BRANCH`` terms.
   Inside a bucket a word has its share of the counts, and one part is for unseen words.
3. Features are the word before, the word before that one, the one before both
   (skips), and the pair of the last two; each is hashed with its node to a row of
   weights. What the words' frequencies say is a fixed term; weights start at zero.
4. Every text is written once as the numbers of its leaves, two bytes a token, with what
   doesn't depend on the model, for training and for scoring.
5. Training goes once over all training texts, in ``ROUNDS`` jobs over disjoint parts of them. A task
   makes gradient steps on its own copy of the weights over small batches; the gradients of all
   tokens of a batch count, those of a shared row summed over the root of their number. Spark averages the
   changes of each row by the number of batches that made one, and the next job goes on from there.
6. Every text is scored whole.

Null texts are empty ones: their one token is the end. A row with a null doc_id is
scored as any other; whether it trains is up to ``held_out``. Repeated rows count
each time. Without training texts all scores are those of an unseen word a token.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, scratch

END = b"\n"  # no word holds white space
BRANCH, LEVELS = 32, 3
BRANCH_BITS = BRANCH.bit_length() - 1
LEAVES = BRANCH**LEVELS
TAIL = 1024
HEAD = LEAVES - TAIL
DICTIONARY = 262_144
#: Rows of hashed weights on each level, batch of a gradient step, rate, jobs of the training.
ROWS = (2**13, 2**13, 2**14)
BATCH, RATE, ROUNDS = 1024, 0.03, 2
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_LOG10 = math.log10(math.e)
_ONES = np.ones(BRANCH, np.float32)
_ROW = np.dtype((np.void, 4 * BRANCH))
#: Summands of a row that are added one by one.
FEW_SUMMANDS = 4


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, without the end."""
    return (text or "").encode().lower().split()


class _Lookup(dict):
    """Number of a word in the dictionary; of other words, the dictionary's size and their bucket."""

    def __init__(self, words: list[bytes], cuts: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.cuts, self.n = cuts, len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n + bisect.bisect_right(self.cuts, word[::-1])


class Vocabulary:
    """Words known in every task with their counts, the leaves, and the buckets of all other words."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, head: int = HEAD, tail: int = TAIL):
        """``words`` come with the most frequent first; the end is among them wherever there are training texts."""
        self.words, self.counts = words, np.array(counts, np.int64)
        self.total, self.distinct = total, distinct
        at = words.index(END) if END in words else 0
        first = [i for i in range(len(words)) if i < head or i == at][: head + 1]
        if len(first) > head:  # the end takes the place of the last head word
            first.remove(head - 1)
        rest = sorted((words[i][::-1], i) for i in set(range(len(words))).difference(first))
        bounds = np.cumsum(self.counts[[i for _, i in rest]]) if rest else np.empty(0)
        marks = [int(np.searchsorted(bounds, bounds[-1] * k / tail)) for k in range(1, tail)] if rest else []
        self.cuts = sorted({rest[k][0] for k in marks})
        buckets = len(self.cuts) + 1
        # leaves in the order of endings; a bucket stands where its words begin
        names = [(words[i][::-1], 0, i) for i in first] + [(([b""] + self.cuts)[b], 1, b) for b in range(buckets)]
        names.sort()
        self.leaf = np.zeros(len(words) + buckets, np.int64)
        for leaf, (_, kind, i) in enumerate(names):
            self.leaf[len(words) + i if kind else i] = leaf
        self.bucket_leaves = self.leaf[len(words) :]
        self.is_tail = np.ones(len(words), bool)
        self.is_tail[first] = False
        self.bucket = np.zeros(len(words), np.int64)
        for reversed_word, i in rest:
            self.bucket[i] = bisect.bisect_right(self.cuts, reversed_word)
            self.leaf[i] = self.bucket_leaves[self.bucket[i]]
        self.end = int(self.leaf[at]) if words else 0
        self.buckets = buckets
        self.mass = np.zeros(LEAVES)
        self.mass[self.leaf[first]] = self.counts[first]
        self._lookup: _Lookup | None = None

    def fill(self, tokens: np.ndarray, distinct: np.ndarray) -> None:
        """Tokens and different words of each bucket, of the whole training corpus."""
        self.bucket_size = tokens + distinct + 1.0
        self.mass[self.bucket_leaves] = tokens + 1.0
        # log10 of the known part of a token's share, dictionary words first, then buckets
        unit = -math.log10(self.total + self.distinct + 1)
        self.base = np.append(np.log10(self.counts + 1.0) + unit, np.full(self.buckets, unit))
        inside = np.where(self.is_tail, np.log10(self.counts + 1.0) - np.log10(self.bucket_size[self.bucket]), 0.0)
        self.inside = np.append(inside, -np.log10(self.bucket_size))

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}

    @property
    def lookup(self) -> _Lookup:
        if self._lookup is None:
            self._lookup = _Lookup(self.words, self.cuts)
        return self._lookup

    def bias(self) -> list[np.ndarray]:
        """Log share of each branch at each node, from the counts; nodes without words are never visited."""
        out, mass = [], self.mass
        for _ in range(LEVELS):
            mass = mass.reshape(-1, BRANCH)
            whole = mass.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where(whole > 0, np.log(mass / whole), 0.0).astype(np.float32))
            mass = whole.ravel()
        return out[::-1]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """(numbers of all tokens, first token of each text, words of each text)."""
        get, parts, words = self.lookup.__getitem__, [], []
        for t in texts:
            own = words_of(t)
            own.append(END)
            words.append(own)
            parts.append(np.fromiter(map(get, own), np.int64, len(own)))
        lengths = np.array([len(w) for w in words], np.int64)
        return np.concatenate(parts), np.cumsum(lengths) - lengths, words


def features(leaf: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """(4, n) hashes of what stands before each token of its text; before the first stands the end."""
    place = np.arange(len(leaf)) - np.repeat(first, np.diff(np.append(first, len(leaf))))
    back = []
    for k in (1, 2, 3):
        h = np.full(len(leaf), end, np.uint64)
        far = np.flatnonzero(place >= k)
        h[far] = leaf[far - k]
        back.append(h)
    seen = [back[0], back[1], back[2], back[0] * np.uint64(LEAVES) + back[1]]
    return np.stack([(x + np.uint64(1)) * np.uint64(m) for x, m in zip(seen, _MIX, strict=True)])


class Model:
    """Weights of hashed rows, the fixed terms, and the steps made on each row."""

    def __init__(self, bias: list[np.ndarray], rows: tuple[int, ...] = ROWS):
        self.bias = bias
        self.weights = [np.zeros((n, BRANCH), np.float32) for n in rows]
        self.steps = [np.zeros(n, np.float32) for n in rows]

    def _levels(self, leaf: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, node, branch taken, (4, n) rows) from the root."""
        for k in range(LEVELS):
            node = leaf >> BRANCH_BITS * (LEVELS - k)
            branch = leaf >> BRANCH_BITS * (LEVELS - k - 1) & (BRANCH - 1)
            x = (hashes ^ (node.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(_MIX[k])) * np.uint64(_MIX[3 - k])
            yield k, node, branch, (x >> np.uint64(40)).astype(np.int64) & (len(self.weights[k]) - 1)

    def _terms(self, k: int, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exponents of all branches, bounded, so that none overflows."""
        logits = self.bias[k].take(node, axis=0)
        for r in rows:
            logits += self.weights[k].take(r, axis=0)
        return np.minimum(logits, 80, out=logits)

    def log_prob(self, leaf: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Natural log probability of each leaf."""
        out = np.zeros(len(leaf))
        for a in range(0, len(leaf), BATCH):
            own, at = leaf[a : a + BATCH], np.arange(min(BATCH, len(leaf) - a))
            for k, node, branch, rows in self._levels(own, hashes[:, a : a + BATCH]):
                logits = self._terms(k, node, rows)
                out[a : a + BATCH] += logits[at, branch]
                out[a : a + BATCH] -= np.log(np.exp(logits, out=logits) @ _ONES)
        return out

    def learn(self, leaf: np.ndarray, hashes: np.ndarray, rate: float = RATE) -> None:
        """One gradient step for each batch; a row that n tokens of it share changes by the sum of their gradients over the root of n."""
        for a in range(0, len(leaf), BATCH):
            own = leaf[a : a + BATCH]
            at = np.arange(len(own))
            for k, node, branch, rows in self._levels(own, hashes[:, a : a + BATCH]):
                slope = self._terms(k, node, rows)
                np.exp(slope, out=slope)
                slope *= (-rate / (slope @ _ONES))[:, None]
                slope.ravel()[at * BRANCH + branch] += rate
                row, change = shared_sums(rows.ravel(), slope)
                change += self.weights[k].take(row, axis=0)
                # a row of weights as one item is copied in one go
                self.weights[k].view(_ROW)[row, 0] = change.view(_ROW)[:, 0]
                self.steps[k][row] += 1


def shared_sums(rows: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums over the root of the number of summands); ``rows`` goes over the lines of ``slope`` several times."""
    flat = rows.astype(np.uint16)  # sorted by digits, as there are at most 2**16 rows
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(np.append(first, len(flat)))
    n = len(slope)
    line = order % n if n & (n - 1) else order & (n - 1)
    out = slope.take(line[first], axis=0)
    # most rows have one summand and most others few, for which sums by segments are slow
    several = np.flatnonzero(count > 1)
    if len(several):
        first_of, count_of = first[several], count[several]
        sums = out.take(several, axis=0)
        sums += slope.take(line[first_of + 1], axis=0)
        live = np.flatnonzero(count_of > 2)
        for j in range(2, FEW_SUMMANDS):
            sums[live] += slope.take(line[first_of[live] + j], axis=0)
            live = live[count_of[live] > j + 1]
        if len(live):
            rest = count_of[live] - FEW_SUMMANDS
            start = np.cumsum(rest) - rest
            place = np.arange(rest.sum()) + np.repeat(first_of[live] + FEW_SUMMANDS - start, rest)
            sums[live] += np.add.reduceat(slope.take(line[place], axis=0), start, axis=0)
        sums /= np.sqrt(count_of.astype(np.float32))[:, None]
        out[several] = sums
    return flat[first].astype(np.int64), out


def count_words(texts: DataFrame, most: int = 500_000) -> DataFrame:
    """(word, n) of all tokens of ``texts``, the end among them."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words, n = list(counts), list(counts.values())
            counts.clear()
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[a : a + 50_000]], pa.string()), pa.array(n[a : a + 50_000], pa.int64())], schema=schema)

        for b in batches:
            for t in b.column("text"):
                counts.update(words_of(t.as_py()))
                if len(counts) > most:
                    yield from told()
            counts[END] += b.num_rows
        yield from told()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, dictionary: int = DICTIONARY, head: int = HEAD, tail: int = TAIL) -> Vocabulary:
    """The vocabulary of a table of counts; the driver gets at most ``dictionary`` words and sums of ``tail`` buckets."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # words by the logarithm of their count: as many of the upper classes as the dictionary holds
    grade = F.floor(64 * F.log2("n")).cast("int")
    least, room = 0, dictionary - 1
    for g, n in sorted(map(tuple, counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        least, room = g, room - n
        if room < 0:
            least += 1
            break
    top = counts.where((grade >= least) | (F.col("word") == END.decode())).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    v = Vocabulary([w.encode() for w in top["word"]], top["n"].tolist(), total, distinct, head, tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(v.buckets, np.int64), np.zeros(v.buckets, np.int64)
        lookup = v.lookup
        for b in batches:
            n = b.column("n").to_numpy()
            at = np.fromiter((lookup[w.encode()] for w in b.column("word").to_pylist()), np.int64, len(n)) - len(lookup)
            np.add.at(tokens, at[at >= 0], n[at >= 0])
            np.add.at(words, at[at >= 0], 1)
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(v.buckets), "tokens": tokens, "words": words})

    sums = counts.where(grade < least).mapInArrow(run, "bucket long, tokens long, words long").groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toPandas()
    tokens, words = np.zeros(v.buckets), np.zeros(v.buckets)
    tokens[sums["bucket"]], words[sums["bucket"]] = sums["tokens"], sums["words"]
    own = np.flatnonzero(v.is_tail)
    np.add.at(tokens, v.bucket[own], v.counts[own])
    np.add.at(words, v.bucket[own], 1)
    v.fill(tokens, words)
    return v


_CHANGE = ", ".join(f"w{i} float" for i in range(BRANCH))


def _leaves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(leaves of all tokens, first token of each text) of encoded texts."""
    packed = column.to_pylist()
    lengths = np.array([len(x) // 2 for x in packed], np.int64)
    return np.frombuffer(b"".join(packed), np.uint16).astype(np.int64), np.cumsum(lengths) - lengths


def train(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model after one pass over ``encoded`` texts. The driver holds the weights, whose size is fixed, and what Spark has summed of each row."""
    model, end = Model(v.bias()), v.end
    starts = np.cumsum([0, *(len(w) for w in model.weights)])
    part = F.pmod(F.xxhash64("rid"), F.lit(rounds))
    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            own = Model(model.bias, tuple(len(w) for w in model.weights))
            own.weights = [w.copy() for w in model.weights]
            for b in batches:
                for a in range(0, b.num_rows, SLICE):
                    leaf, first = _leaves(b.column("leaves").slice(a, SLICE))
                    own.learn(leaf, features(leaf, first, end), rate)
            for k, made in enumerate(own.steps):
                row = np.flatnonzero(made)
                change = (own.weights[k][row] - model.weights[k][row]) * made[row, None]
                columns = [pa.array(row + starts[k]), pa.array(made[row]), *(pa.array(np.ascontiguousarray(change[:, i])) for i in range(BRANCH))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "steps", *(f"w{i}" for i in range(BRANCH))])

        changes = encoded.where(part == r).select("leaves").mapInArrow(run, f"row long, steps float, {_CHANGE}")
        summed = changes.groupBy("row").agg(F.sum("steps").alias("steps"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(BRANCH)]).toArrow()
        row, steps = summed.column("row").to_numpy(), summed.column("steps").to_numpy()
        if len(row):
            change = np.stack([summed.column(f"w{i}").to_numpy() for i in range(BRANCH)], axis=1) / steps[:, None]
            for k in range(LEVELS):
                own = (row >= starts[k]) & (row < starts[k + 1])
                model.weights[k][row[own] - starts[k]] += change[own]
    return model


#: Texts that are coded or scored at a time.
SLICE = 500


def encode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """``rows`` with ``leaves`` in place of ``text``, n_tokens, what is known of n_known, base_score and score without the model, and the words outside the dictionary."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    made = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("leaves", pa.binary()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                b = whole.slice(a, SLICE)
                ids, first, words = v.read(b.column("text").to_pylist())
                leaf = v.leaf[ids].astype(np.uint16)
                known = ids < len(v.words)
                rare, packed = [], []
                for own, start, unknown in zip(words, first.tolist(), np.logical_or.reduceat(~known, first).tolist(), strict=True):
                    other = Counter(own[i].decode() for i in np.flatnonzero(~known[start : start + len(own)]).tolist()) if unknown else {}
                    rare.append([{"word": w, "k": k} for w, k in other.items()])
                    packed.append(leaf[start : start + len(own)].tobytes())
                sums = [np.add.reduceat(x[ids], first) for x in (v.base, v.inside)]
                columns = [np.diff(np.append(first, len(ids))), np.add.reduceat(known.astype(np.int64), first), *sums, packed, rare]
                yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(c, t) for c, (_, t) in zip(columns, made, strict=True)], names=[*(f.name for f in kept), *(n for n, _ in made)])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{ddl}, n_tokens long, n_known long, base_score double, score double, leaves binary, rare array<struct<word:string,k:long>>")


def score(encoded: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """The rows of :func:`encode` with the model's part of the score, and with the counts of the words outside the dictionary."""
    end = v.end
    kept = [f for f in encoded.schema.fields if f.name not in ("leaves", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE):
                b = whole.slice(a, SLICE)
                leaf, first = _leaves(b.column("leaves"))
                told = np.add.reduceat(model.log_prob(leaf, features(leaf, first, end)), first) * _LOG10
                columns = [pa.array(b.column("score").to_numpy() + told) if f.name == "score" else b.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept])

    scored = encoded.select(*[f.name for f in kept], "leaves").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept))
    more = encoded.select("rid", F.inline("rare")).join(counts, "word").groupBy("rid").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    names = [f.name for f in kept if f.name not in ("rid", "n_tokens", "n_known", "base_score", "score")]
    return scored.join(more, "rid", "left").select(
        *names, "n_tokens", plus("n_known", "more_known"), F.lit(v.total).cast("long").alias("train_tokens"), plus("base_score", "more"), plus("score", "more")
    )


def lm_score(docs: DataFrame, held_out: Column, keep: tuple[str, ...] = ("doc_id",), dictionary: int = DICTIONARY, head: int = HEAD, tail: int = TAIL) -> DataFrame:
    """``keep``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows that aren't held out train the model.

    Both scores are log10 probabilities of the text's tokens: ``base_score`` of one count for all words, ``score`` of the model.
    """
    # columns that are kept travel under names of their own
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], held_out.alias("held"), "text", F.monotonically_increasing_id().alias("rid"))
    with scratch(docs.sparkSession):
        counts = materialise(count_words(rows.where(~F.col("held"))), "counts")
        v = vocabulary_of(counts, dictionary, head, tail)
        encoded = materialise(encode(rows, v), "encoded")
        model = train(encoded.where(~F.col("held")), v)
        out = score(encoded, counts, v, model)
        return materialise(out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("held").alias("held_out"), *out.columns[len(keep) + 1 :]), "lm_score", keep=True)
