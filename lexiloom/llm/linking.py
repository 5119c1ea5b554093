"""Connected groups of a similarity join whose candidates share a key.

Keys are nearly all met once, so they are not dealt out row by row. Each task
sorts the keys of many rows into a unit, which sends every bucket of the key
range one packed run of its distinct keys with their tags, at most SMALL + 1 of
a key; all tags of a key of more are sent as they are to a bucket that takes
turns. A bucket merges its runs and keeps the keys of two tags or more. A key
that a third of all rows have thus costs its bucket a few entries for each unit.
Where tags have bands, as of lengths, a key counts for two neighbouring bands at a
time, so rows that can't be linked for their lengths never meet.

Candidates of a key of up to SMALL nodes are all its pairs that may be linked. Of
a larger key each member meets one node only. Of a node's candidates the
one with most common keys is verified first, then, where two are not in one
component yet, the others. Only for larger keys that still span several components
are the pairs across components compared, so every pair that shares a key is
either in one component already or has been verified: no link between components
is lost.
That last step has to look at the square of the members of a key that stay apart. An
operator may give a way of its own for it, ``blocks`` (see ``in_blocks``): members
travel in blocks and only links become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import components, lean, materialise, shuffle_partitions, tidy

KEY_BITS, RANK_BITS = 40, 24
#: Bits of a tag over the lowest KEY_BITS that hold its band, where tags are banded.
BAND_BITS = 14
#: Steps of a band: a tag holds its step, and tags more steps apart aren't to meet.
STEPS = 8
UNIT_KEYS, BUCKET_KEYS = 1_000_000, 1_500_000
SMALL = 32
_KEY, _RANK = np.uint64((1 << KEY_BITS) - 1), np.uint64((1 << RANK_BITS) - 1)

Keyed = tuple[np.ndarray, np.ndarray, np.ndarray]  # tags of rows, place of each key's row, keys


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each with its kind and length."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64)
    data = head.tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for width, count in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, f"u{width}", count, at))
        at += width * count
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def _entries(keys: np.ndarray, ranks: np.ndarray, tags: np.ndarray) -> bytes:
    """Sorted keys as steps, and their tags by a list of those that occur."""
    used, place = np.unique(ranks, return_inverse=True)
    return _pack(_narrow(np.diff(keys, prepend=np.uint64(0))), tags[used].view(np.uint64), _narrow(place))


def _read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, tags, place = _unpack(blob)
    return np.cumsum(steps, dtype=np.uint64), tags.view(np.int64)[place]


def steps_of(tag: np.ndarray) -> np.ndarray:
    return (tag >> KEY_BITS) & ((1 << BAND_BITS) - 1)


def bands_of(tag: np.ndarray) -> np.ndarray:
    return steps_of(tag) // STEPS


def _in_bands(key: np.ndarray, tag: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, tag) with keys that each stand for two neighbouring bands of a key, sorted; where ``whole``, which has all bands of its keys, none that others cover."""
    at = (key.astype(np.int64) << BAND_BITS) | bands_of(tag)
    below, above = np.ones(len(at), bool), np.ones(len(at), bool)
    if whole:
        held = np.unique(at)
        below, above = np.isin(at - 1, held), np.isin(at + 1, held)
        above |= ~below
    pair, tag = np.concatenate((at[below], at[above] + 1)), np.concatenate((tag[below], tag[above]))
    order = np.lexsort((tag, pair))
    return pair[order], tag[order]


def _unit(tags: list[np.ndarray], places: list[np.ndarray], keys: list[np.ndarray], buckets: int, turn: int, banded: bool = False) -> pd.DataFrame:
    distinct, rank = np.unique(np.concatenate(tags), return_inverse=True)
    packed = ((np.concatenate(keys) & _KEY) << np.uint64(RANK_BITS)) | rank[np.concatenate(places)].astype(np.uint64)
    packed.sort()
    packed = packed[np.append(True, packed[1:] != packed[:-1])]
    key, rank = packed >> np.uint64(RANK_BITS), (packed & _RANK).astype(np.int64)
    new = np.append(True, key[1:] != key[:-1])
    if banded:  # tags are sorted by band
        band = bands_of(distinct)[rank]
        new[1:] |= band[1:] != band[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    out = []
    many = np.repeat(count > SMALL, count)
    if many.any():
        out.append((turn % buckets, 1, _entries(key[many], rank[many], distinct)))
        few = np.arange(len(key)) - np.repeat(first, count) <= SMALL
        key, rank = key[few], rank[few]
    bounds = np.array([(b << KEY_BITS) // buckets for b in range(1, buckets)], np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(key, bounds), [len(key)])).tolist()
    for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if x < y:
            out.append((b, 0, _entries(key[x:y], rank[x:y], distinct)))
    return pd.DataFrame(out, columns=["bucket", "kind", "blob"])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return first, np.diff(np.append(first, len(key)))


def _meet(frame: pd.DataFrame, banded: bool = False) -> pd.DataFrame:
    read = [_read(b) for b in frame.loc[frame["kind"] == 0, "blob"]]
    many = [_read(b) for b in frame.loc[frame["kind"] == 1, "blob"]]
    if banded:
        many = [_in_bands(*x, whole=False) for x in many]
    out = [(k, t, np.ones(len(k), bool)) for k, t in many]
    if read:
        key, tag = (np.concatenate(x) for x in zip(*read, strict=True))
        order = np.argsort(key, kind="stable")
        key, tag = key[order], tag[order]
        _, count = _runs(key)
        shared = np.repeat(count > 1, count)
        key, tag = key[shared], tag[shared]
        if len(key):
            order = np.lexsort((tag, key))
            key, tag = key[order], tag[order]
            new = np.append(True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]))
            key, tag = key[new], tag[new]
            if banded:
                key, tag = _in_bands(key, tag, whole=True)
            _, count = _runs(key)
            live = np.repeat(count > 1, count)
            if banded:  # of a small key, those with another one in reach
                beside = np.append(False, (key[1:] == key[:-1]) & (np.diff(steps_of(tag)) <= STEPS))
                live &= beside | np.append(beside[1:], False) | np.repeat(count > SMALL, count)
            out.append((key[live], tag[live], np.repeat(count > SMALL, count)[live]))
    names = ["key", "tag", "large"]
    if not out:
        return pd.DataFrame({"key": np.zeros(0, np.int64), "tag": np.zeros(0, np.int64), "large": np.zeros(0, bool)})
    key, tag, large = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame(dict(zip(names, (key.astype(np.int64), tag, large), strict=True)))


def shared_keys(rows: DataFrame, keys_of: Callable[[pd.DataFrame], Iterator[Keyed]], total: int, banded: bool = False) -> DataFrame:
    """(key, tag, large) of the keys that two tags or more have; a row of a large key may come twice.

    ``banded``: tags have a number of steps over their lowest KEY_BITS, and only tags at most STEPS apart are to meet: keys returned stand for two neighbouring bands of STEPS steps.

    ``keys_of`` gives, for a batch of ``rows``, the tags of some rows and the
    keys of each, of which KEY_BITS bits count: a key met by accident costs a
    candidate, never a link. ``total`` is about the number of keys in all.
    """
    buckets = max(48, -(-total // BUCKET_KEYS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId()
        held: tuple[list, list, list] = ([], [], [])
        n_rows = n_keys = 0
        for batch in batches:
            for tags, places, keys in keys_of(batch):
                for own, more in zip(held, (tags, places + n_rows, keys), strict=True):
                    own.append(more)
                n_rows, n_keys = n_rows + len(tags), n_keys + len(keys)
                if n_keys >= UNIT_KEYS or n_rows >= 1 << (RANK_BITS - 1):
                    yield _unit(*held, buckets, turn, banded)
                    held, n_rows, n_keys, turn = ([], [], []), 0, 0, turn + 1
        if n_keys:
            yield _unit(*held, buckets, turn, banded)

    dealt = rows.mapInPandas(lean(deal), "bucket int, kind int, blob binary")
    meet = lambda frame: _meet(frame, banded)
    return dealt.groupBy("bucket").applyInPandas(lean(meet), "key long, tag long, large boolean")


def _close_pairs(fields: int, may_link: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Pairs (a, b) with a < b of neighbouring rows (key, node, info) of one key that may be linked."""

    def pairs(key: np.ndarray, node: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
        first, count = _runs(key)
        found = []
        for m in np.unique(count[count > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            starts = first[count == m]
            for at in range(0, len(starts), max(1, 200_000 // len(i))):
                own = starts[at : at + max(1, 200_000 // len(i)), None]
                x, y = (own + i).ravel(), (own + j).ravel()
                near = (node[x] != node[y]) & may_link(info[x], info[y])
                found.append(np.stack((node[x[near]], node[y[near]]), 1))
        both = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2 + fields)]
            held.append((columns[0], columns[1], np.stack(columns[2:], 1)))
            if sum(len(h[0]) for h in held) < 30_000 or held[0][0][0] == columns[0][-1]:
                continue
            key, node, info = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            yield pairs(key[:cut], node[:cut], info[:cut])
            held = [(key[cut:], node[cut:], info[cut:])]
        if held:
            yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


#: Members of a key that travel together, and the sum of their sizes.
BLOCK, BLOCK_SIZE = 1024, 4_000_000


def in_blocks(rows: DataFrame, size: Column, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on each pair of blocks of the rows (key, node, ...) of one key, so that any two of its nodes meet in one call.

    Rows come with ``block``; two of one block are to be compared in the call that has this block alone, in ``one`` and ``two``.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(size) / BLOCK_SIZE, F.lit(1))).cast("int").alias("parts"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("*", other.alias("other")).drop("parts")
    dealt = dealt.select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).drop("other")
    place = ["key", "one", "two"]
    dealt = dealt.repartition(shuffle_partitions(rows.sparkSession), *place).sortWithinPartitions(*place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            at = batch[place].to_numpy()
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1)))
            for x, y in zip(first.tolist(), np.append(first[1:], len(at)).tolist(), strict=True):
                own = batch.iloc[x:y]
                if held and (held[-1][place].iloc[-1].to_numpy() != at[x]).any():
                    yield work(pd.concat(held, ignore_index=True))
                    held = []
                held.append(own)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(lean(run), schema)


def linked_groups(
    found: DataFrame, nodes: DataFrame, may_link: Callable[[Column, Column], Column], may_link_rows: Callable[[np.ndarray, np.ndarray], np.ndarray], verify: Callable[[DataFrame], DataFrame], *, spread: bool = False,
    blocks: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(node, component)`` of every node that is linked and isn't its component's smallest.

    ``found``: (key, tag, large) and ``nodes``: (tag, node, info), written tables; a
    tag may stand for several nodes, and ``info`` is a struct of whole numbers.
    ``may_link``: from two infos, false only for pairs that can't be linked;
    ``may_link_rows``: the same from two arrays of infos.
    ``verify``: from (a, b) with a < b to the pairs that are linked.
    ``spread``: members of a larger key meet another node for each key first, not the smallest one; what is compared in the end is the same.
    ``blocks``: from (key, node, info, component) to the links (a, b) between components that share a key; by default pairs are made by a join and verified.
    """
    fields = [f.name for f in nodes.schema["info"].dataType.fields]
    small = found.where("not large").join(nodes, "tag").select("key", "node", *[F.col(f"info.{f}").alias(f"info_{f}") for f in fields])
    small = small.repartition(shuffle_partitions(found.sparkSession), "key").sortWithinPartitions("key")
    star = small.mapInArrow(lean(_close_pairs(len(fields), may_link_rows)), "a long, b long")
    big = materialise(found.where("large").distinct().join(nodes, "tag").select("key", "node", "info"), "large", compression="zstd")
    has_big = not big.isEmpty()
    if has_big:
        low = big.groupBy("key").agg((F.min_by("node", F.xxhash64("key", "node")) if spread else F.min("node")).alias("low"))
        met = big.join(low, "key").where("node <> low").select("low", "node").distinct()
        info = big.select("node", "info").dropDuplicates(["node"])
        met = met.join(info.select(F.col("node").alias("low"), F.col("info").alias("low_info")), "low").join(info, "node")
        star = star.unionByName(met.where(may_link(F.col("low_info"), F.col("info"))).select(F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b")))
    star = star.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("hits"))
    star = materialise(star, "pairs")
    tidy(found.sparkSession)
    groups = nodes.limit(0).select("node", F.col("node").alias("component"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        named = pairs.join(groups.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left")
        named = named.join(groups.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
        return named.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b", "hits")

    def joined(more: DataFrame) -> DataFrame:
        return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    # twice the likeliest partner of each node, then all that is left
    left = star
    for turn in range(3):
        chosen = left.groupBy("b").agg(F.max_by("a", "hits").alias("a")).select("a", "b") if turn < 2 else left.select("a", "b")
        chosen = materialise(chosen, "chosen")
        links = verify(chosen)
        groups = joined(links) if turn else components(materialise(links, "links"))
        left = materialise(apart(left.join(chosen, ["a", "b"], "left_anti")), "left")
        tidy(found.sparkSession)
        if left.isEmpty():
            break
    if not has_big:
        return groups
    named = big.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = materialise(named.join(mixed, "key", "left_semi").select("key", "node", "info", "component"), "mixed")
    if left.isEmpty():
        return groups
    if blocks is not None:
        return joined(blocks(left))
    one = left.select("key", F.col("node").alias("a"), F.col("info").alias("a_info"), F.col("component").alias("a_group"))
    two = left.select(F.col("key").alias("key_2"), F.col("node").alias("b"), F.col("info").alias("b_info"), F.col("component").alias("b_group"))
    across = one.join(
        two,
        (F.col("key") == F.col("key_2")) & (F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group")) & may_link(F.col("a_info"), F.col("b_info")),
    )
    across = materialise(across.select("a", "b").distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    return groups if across.isEmpty() else joined(verify(across))
