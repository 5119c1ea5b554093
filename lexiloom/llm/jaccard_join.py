"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

Sets are banded by size so that two linked sets lie in one band or in adjacent
ones. For a band, linked sets differ in at most H shingles. The universe is
hashed into segments, and each segment is given a weight: 1 (the subset of the
set in that segment must be equal) or 2 (it may differ by one shingle, found by
its one-deletion neighbourhood). Weights that sum to H + 1 make it sure that
linked sets agree on a segment. Agreements on nothing (two empty segments, or one
element and none) would link most sets of a band by accident, the more the more
sets there are. So the weights sum to more than that, by a slack, and a set whose
segments without content weigh no more than the slack has no signatures of them:
of two linked sets the segments that are so in both weigh no more than those of
either, so they agree on another one, or both have all signatures. How many
segments get weight 2, and the slack, follow a cost
model per band: signatures written against accidental agreements. Signatures are made in a second pass over the texts
and sent in packed runs (see ``linking``), so they are never written row by row.
Candidates pass size and parity-sketch bounds, neither of which can drop a link,
and are verified on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import components, join_hot, lean, materialise, maybe_in, scratch
from lexiloom.llm.linking import KEY_BITS, Keyed, linked_groups, shared_keys

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
NO_ID = -(2**63)  # stands for a missing doc_id inside Python, where a null would turn the column into floats
SKETCH = 1024  # bits of the parity sketch


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K2
    return h ^ (h >> np.uint64(29))


class _WordHashes(dict):
    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; only the ASCII white space 09-0D and 20 separates."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    h = _mix(w[: len(w) - width + 1] + np.uint64(width))
    for i in range(1, width):
        h = _mix(h * _K1 + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def _poisson_above(mean: float, n: int) -> float:
    """Probability of more than ``n`` where ``mean`` is expected."""
    term = below = math.exp(-mean)
    for i in range(1, n + 1):
        term *= mean / i
        below += term
    return max(0.0, 1 - below)


class Scheme:
    """Bands and, for each, the number of segments and how many have weight 2, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.high: list[int] = []  # the largest size of each band

    @lru_cache(maxsize=None)  # noqa: B019  one scheme per process
    def plan(self, band: int) -> tuple[int, int, int]:
        """(segments, of which with weight 2, slack) for pairs whose smaller set is in ``band``: the weights sum to the slack and one more than such a pair may differ."""
        high, low = self._upper(band), self._upper(band - 1) + 1 if band else 1
        total = high + high * 100 // self.percent
        differ = total * (100 - self.percent) // (100 + self.percent)
        best = (math.inf, differ + 1, 0, 0)
        for eighths in range(9):
            for spread in range(-1, 6):
                slack = 0
                for _ in range(3 if spread >= 0 else 1):  # more slack, more segments, and more of them poor
                    double = (differ + 1 + slack) // 2 * eighths // 8
                    parts = differ + 1 + slack - double
                    empty = math.exp(-low / parts)
                    poor = (parts - double) * empty + 2 * double * empty * (1 + low / parts) if parts > 1 else 0.0
                    if spread >= 0:
                        slack = math.ceil(poor + spread * math.sqrt(poor))
                double = (differ + 1 + slack) // 2 * eighths // 8
                parts = differ + 1 + slack - double
                length = high / parts
                written = parts - double + double * (1 + length)
                accidents = 1e4 * _poisson_above(poor, slack) ** 2 + 1e3 * math.exp(-2 * length)
                best = min(best, (written + accidents, parts, double, slack))
        return best[1:]

    def _upper(self, band: int) -> int:
        while len(self.high) <= band:
            low = self.high[-1] + 1 if self.high else 1
            self.high.append(max(low, low * 100 // self.percent))
        return self.high[band]

    def band(self, size: int) -> int:
        at = 0
        while self._upper(at) < size:
            at += 1
        return at

    def signatures(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set, as the smaller or equal one of its own band and as the larger one of the band below."""
        own = self.band(len(h))
        out = []
        with np.errstate(over="ignore"):
            for band in {own, max(0, own - 1)}:
                parts, double, slack = self.plan(band)
                element = _mix(h * _K3)
                place = ((h >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
                sums = np.zeros(parts, np.uint64)
                np.add.at(sums, place, element)
                at = np.arange(parts, dtype=np.uint64)
                salt = _mix(at * _K1 + np.uint64(band + 1) * _K3)
                # what is left of a segment of no element, or of one less that one, is nothing, which most sets share
                count = np.bincount(place, minlength=parts)
                poor = count <= (at < double)
                keep = np.ones(parts, bool) if poor.sum() + poor[:double].sum() > slack else count > 0
                out.append(_mix(sums + salt)[keep])
                near = (place < double) & (keep.all() | (count[place] > 1))
                if near.any():
                    spot = place[near]
                    out.append(_mix(sums[spot] - element[near] + salt[spot]))
        return np.unique(np.concatenate(out) & np.uint64(2**KEY_BITS - 1))

    def written(self, size: int) -> int:
        """About how many keys a set of so many shingles has."""
        out, own = 0, self.band(size)
        for band in {own, max(0, own - 1)}:
            parts, double, _ = self.plan(band)
            out += parts + size * double // parts
        return out


@lru_cache(maxsize=8)
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


def _sketch(h: np.ndarray) -> list[int]:
    bits = np.bincount((h >> np.uint64(5)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _digests(h: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(_mix(h * _K1)).astype(np.int64)), int(np.add.reduce(_mix(h ^ _K3)).astype(np.int64))


def _parity(h: np.ndarray) -> bytes:
    """Parities of the elements by bit, at least two bits an element: sets that differ in x elements differ in at most x bits, also when folded to fewer."""
    bits = 1 << max(6, (2 * len(h) - 1).bit_length())
    place = ((h >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(uid, doc_id, text_hash, n_shingles, c1, c2, n_keys, sketch, parity) of (doc_id, text_hash, text): a number of its own, set size, digest, a short and a long parity sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, uid = scheme(percent), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_hashes(text, n)
                rows.append((uid, len(h), *_digests(h), plan.written(len(h)), _sketch(h), _parity(h)) if len(h) else (uid, 0, 0, 0, 0, [0] * (SKETCH // 64), b""))
                uid += 1
            out = pd.DataFrame(rows, columns=["uid", "n_shingles", "c1", "c2", "n_keys", "sketch", "parity"], index=batch.index)
            yield out.assign(doc_id=batch["doc_id"], text_hash=batch["text_hash"])

    named = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    out = named.mapInPandas(lean(run), "uid long, doc_id long, text_hash long, n_shingles long, c1 long, c2 long, n_keys long, sketch array<long>, parity binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _signatures(n: int, percent: int):
    """Keys of the sets of a batch of texts, each set once, tagged with its first digest."""

    def run(batch: pd.DataFrame) -> Iterator[Keyed]:
        plan = scheme(percent)
        tags: dict[int, np.ndarray] = {}
        held = 0
        for text in batch["text"]:
            h = shingle_hashes(text, n)
            if len(h) and (tag := _digests(h)[0]) not in tags:
                tags[tag] = plan.signatures(h)
                held += len(tags[tag])
            if held > 300_000:
                yield _keyed(tags)
                tags, held = {}, 0
        if tags:
            yield _keyed(tags)

    return run


def _keyed(tags: dict[int, np.ndarray]) -> Keyed:
    sizes = [len(k) for k in tags.values()]
    return np.array(list(tags), np.int64), np.repeat(np.arange(len(sizes)), sizes), np.concatenate(list(tags.values()))


def _can_link(percent: int):
    """Whether sizes and parity sketches allow a link: as a test of columns, and of arrays."""
    # the parity sketches of two sets differ in at most as many bits as the sets differ in shingles

    def columns(x: Column, y: Column) -> Column:
        small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
        differ = F.lit(0)
        for i in range(SKETCH // 64):
            differ = differ + F.bit_count(x[f"s{i}"].bitwiseXOR(y[f"s{i}"]))
        return (small * 100 >= large * percent) & (differ * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent))

    def rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        able = np.minimum(x[:, 0], y[:, 0]) * 100 >= np.maximum(x[:, 0], y[:, 0]) * percent
        differ = np.bitwise_count((x[:, 1:] ^ y[:, 1:]).view(np.uint64))  # of signed numbers it would count the bits of the magnitude
        differ = differ.sum(1, dtype=np.int64)
        return able & (differ * (100 + percent) <= (x[:, 0] + y[:, 0]) * (100 - percent))

    return columns, rows


#: Shingles of the texts that a task compares with each other; larger groups are split into blocks, and each two blocks meet.
BLOCK_SHINGLES = 1_000_000


def coded_sets(texts: list[str], n: int) -> tuple[list[np.ndarray], int]:
    """The shingle sets of texts as sorted numbers, equal for equal shingles and for no others, and how many numbers there are. A text of fewer than n words has none."""
    code: dict[bytes, int] = {}
    words = [[code.setdefault(w, len(code)) for w in words_of(t)] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.array([x for w in words for x in w], np.int64)
    if len(ids) < n:
        return [np.zeros(0, np.int64)] * len(texts), 0
    ranks = ids
    for i in range(1, n):
        # windows that cross texts are numbered too, and left out below
        _, ranks = np.unique(ranks[: len(ids) - i] * len(code) + ids[i:], return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    return [np.unique(ranks[x : x + max(0, k - n + 1)]) for x, k in zip(begin.tolist(), sizes.tolist(), strict=True)], int(ranks.max()) + 1


#: Shingles whose long sketches a task holds, and pairs that it compares.
BLOCK_PARITIES, TASK_PAIRS = 32_000_000, 200_000


def _by_parity(sets: DataFrame, percent: int):
    """Pairs whose long sketches allow a link. ``sets``: (uid, n_shingles, parity). No linked pair is lost, and hardly a text is fetched in vain."""

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        held, pairs = frame[frame["b"] < 0], frame[frame["b"] >= 0]
        own = {a: (np.frombuffer(x, np.uint64), size) for a, x, size in zip(held["a"].tolist(), held["parity"], held["n_shingles"].tolist(), strict=True)}
        good = []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
            (x, size), (y, other) = own[a], own[b]
            if len(x) < len(y):
                x, y = y, x
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            if int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (size + other) * (100 - percent):
                good.append((a, b))
        return pd.DataFrame(good, columns=["a", "b"]).astype("int64")

    def pruned(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select("a", "b"), "pairs")
        ends = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        told = maybe_in(sets.select(F.col("uid").alias("node"), "n_shingles", "parity"), "node", ends, ends.count()).where("_maybe").drop("_maybe")
        told = materialise(told.join(ends, "node", "left_semi"), "parities")
        groups = components(pairs)
        own = told.select("node", "n_shingles").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        sizes = own.groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK_PARITIES).alias("blocks"))
        own = own.join(sizes, "group").select("node", "group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
        own = materialise(own, "blocks")
        end = lambda c: own.select(F.col("node").alias(c), "group", F.col("block").alias(f"block_{c}"))
        met = pairs.join(end("a"), "a").join(end("b").drop("group"), "b").withColumn("low", F.least("block_a", "block_b")).withColumn("high", F.greatest("block_a", "block_b"))
        many = met.groupBy("group", "low", "high").agg(F.ceil(F.count(F.lit(1)) / TASK_PAIRS).alias("parts"))
        met = met.join(many, ["group", "low", "high"]).select(F.xxhash64("group", "low", "high", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("task"), "a", "b")
        met = materialise(met, "met")
        needed = met.select("task", "a").union(met.select("task", "b")).distinct()
        held = needed.join(told.withColumnRenamed("node", "a"), "a").select("task", "a", F.lit(-1).cast("long").alias("b"), "n_shingles", "parity")
        rows = held.unionByName(met, allowMissingColumns=True)
        return materialise(rows.groupBy("task").applyInPandas(lean(near), "a long, b long"), "near")

    return pruned


def _verifier(docs: DataFrame, nodes: DataFrame, sets: DataFrame, n: int, percent: int):
    """``docs``: (doc_id, text_hash, text); ``nodes``: (node, doc_id, text_hash, n_shingles), the text that stands for a node; ``sets`` as in :func:`_by_parity`."""
    pruned = _by_parity(sets, percent)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        held, pairs = frame[frame["b"] < 0], frame[frame["b"] >= 0]  # nodes count from 0
        sets, universe = coded_sets(held["text"].tolist(), n)
        place = {x: i for i, x in enumerate(held["a"].tolist())}
        mark, good = np.zeros(universe, bool), []
        for a, others in pairs.groupby("a")["b"]:
            own = sets[place[a]]
            mark[own] = True
            for b in others.tolist():
                other = sets[place[b]]
                common = int(mark[other].sum())
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    good.append((a, b))
            mark[own] = False
        return pd.DataFrame(good, columns=["a", "b"]).astype("int64")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pruned(pairs)
        # texts meet in groups that no pair crosses, so a text goes to one task, or to one for each block of a group that it is compared with
        groups = components(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        own = nodes.join(ends, "node").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
        sizes = own.groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"))
        own = own.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        own = materialise(own.select("node", "doc_id", "text_hash", "group", "block"), "wanted")
        end = lambda c: own.select(F.col("node").alias(c), "group", F.col("block").alias(f"block_{c}"))
        met = pairs.select("a", "b").join(end("a"), "a").join(end("b").drop("group"), "b")
        met = materialise(met.select(F.xxhash64("group", F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("task"), "a", "b"), "met")
        near = maybe_in(docs, "text_hash", own.select("text_hash"), own.count()).where("_maybe").drop("_maybe")
        texts = near.join(own, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select(F.col("node").alias("a"), "text")
        needed = met.select("task", "a").union(met.select("task", "b")).distinct()
        held = needed.join(texts, "a").select("task", "a", F.lit(-1).cast("long").alias("b"), "text")
        return held.unionByName(met.withColumn("text", F.lit(None).cast("string"))).groupBy("task").applyInPandas(lean(compare), "a long, b long")

    return verify


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their
    sets of ``n``-word shingles; a text of fewer words is one shingle, and null,
    empty or blank texts have no shingle and no link. ``component_id`` is the
    smallest doc_id reachable. Documents of one set are one node, whose copies
    aren't expanded. Rows that share a doc_id but not the text are judged each by
    its own text; rows without doc_id have no links and a null component. Other
    columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    with scratch(df.sparkSession):
        return materialise(_components(docs, n, percent), "components", keep=True)


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    sets = materialise(shingle_sets(docs, n, percent), "sets")
    able = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    total, n_keys = able.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    # one node for each set: the row with the smallest number stands for it
    digest = ["n_shingles", "c1", "c2"]
    classes = able.groupBy(*digest).agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min_by("doc_id", "uid").alias("doc_id"), F.min_by("text_hash", "uid").alias("text_hash")
    )
    classes = materialise(classes, "classes")
    found = materialise(shared_keys(docs.where(F.col("doc_id").isNotNull()), _signatures(n, percent), int(n_keys)), "shared")
    # a tag that sets share by accident stands for each of them
    tagged = materialise(found.select("tag").distinct(), "tags")
    tagged = materialise(classes.select("node", F.col("c1").alias("tag")).join(tagged, "tag", "left_semi"), "tagged")
    info = sets.join(tagged.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), F.struct(F.col("n_shingles").alias("n"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH // 64)]).alias("info"))
    tagged = materialise(tagged.join(info, "node"), "nodes")
    groups = linked_groups(found, tagged, *_can_link(percent), _verifier(docs, classes.select("node", "doc_id", "text_hash", "n_shingles"), sets, n, percent))
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(F.struct(*digest).alias("digest"), "copies", "component_id")
    out = join_hot(able.select("doc_id", "n_shingles", F.struct(*digest).alias("digest")), named, "digest", "copies", total)
    rest = sets.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id").unionByName(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
