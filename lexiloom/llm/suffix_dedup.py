"""Removal of repeated passages by a common-prefix-aware distributed merge sort.

Documents are packed into units, written once. A window is ``length`` bytes of a
document; its anchor is the least hash of its ``gram``-byte substrings, so equal
windows have equal anchors. Neighbouring windows with one anchor form a suffix: the
bytes from the first of these windows to the end of the last.

1. Distinguishing prefixes: each unit sends the sorted, delta-coded fingerprints
   of its anchors; those met in no other document need not be exchanged further.
2. The remaining suffixes of a unit are sorted into runs, front-coded (length of
   the common prefix with the predecessor, and the rest) and dealt by range. Each
   range brings its runs together by their anchors and, where the suffixes of an anchor
   differ, merges these with a loser tree that carries common-prefix lengths, so
   known prefixes are never compared again.
3. Merged neighbours with one anchor are compared. Equal suffixes settle by the
   smallest doc_id; where different suffixes share an anchor their windows are
   compared. Each unit is told, for its entries, which windows also start in a
   document with a smaller doc_id.
4. Units mark and cut the covered bytes.

A unit sends each distinct suffix once with its smallest doc_id, whatever number
of copies it holds, and replies are bits. Every step rereads the written units.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise

LENGTH, GRAM = 50, 24
NO_ID = 2**63 - 1  # a missing doc_id is larger than any other
_M = np.uint64(0x9E3779B97F4A7C15)
_FP_BITS = 40


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 2**64))


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each ``gram`` bytes, built up by doubling."""
    power = _mix(np.arange(1, 257, dtype=np.uint64))[x]
    size, have, result, done = 1, power, None, 0
    while True:
        if gram & size:
            if result is None:
                result, done = have, size
            else:
                n = len(x) - done - size + 1
                result = result[:n] * _power(size) + have[done : done + n]
                done += size
        if done == gram:
            return _mix(result)
        n = len(x) - 2 * size + 1
        have = have[:n] * _power(size) + have[size : size + n]
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have, size = h, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    return np.minimum(have[: len(h) - width + 1], have[width - size : width - size + len(h) - width + 1])


#: Windows whose hashes are made at a time, so that they stay in a core's cache.
CHUNK = 1 << 15


def anchors(x: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The least hash of a ``gram`` bytes in each window of ``length`` bytes."""
    n = len(x) - length + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        out[a : a + CHUNK] = sliding_min(gram_hashes(x[a : a + CHUNK + length - 1], gram), length - gram + 1)
    return out


class Unit:
    """Texts of a few documents as bytes, with the runs of windows that share an anchor."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, length: int, gram: int):
        self.ids, self.sizes, self.data, self.length = ids, sizes, data, length
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.start = self.count = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(data) < length:
            return
        x = np.frombuffer(data, np.uint8)
        m = anchors(x, length, gram)
        n = len(m)  # windows
        valid = np.zeros(n, bool)
        for b, e in zip(self.begins.tolist(), self.ends.tolist(), strict=True):
            if e - b >= length:
                valid[b : e - length + 1] = True
        cut = np.ones(n, bool)
        cut[1:] = (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])
        first = self.begins[self.begins < n]
        cut[first] = True
        start = np.flatnonzero(cut)
        count = np.diff(np.append(start, n))
        able = valid[start]
        self.start, self.count = start[able], count[able]
        self.anchor = _mix(m[self.start] ^ _M)
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints, whether two doc_ids of the unit have one, and each run's place among them."""
        fp = self.anchor >> np.uint64(64 - _FP_BITS)
        if len(fp) < 1 << (64 - _FP_BITS):  # a fingerprint and its run's number are one number to sort
            both = np.sort((fp << np.uint64(64 - _FP_BITS)) | np.arange(len(fp), dtype=np.uint64))
            run = (both & np.uint64((1 << (64 - _FP_BITS)) - 1)).astype(np.int64)
            both >>= np.uint64(64 - _FP_BITS)
            new = np.append(True, both[1:] != both[:-1])[: len(both)]
            distinct, place = both[new], np.empty(len(fp), np.int64)
            place[run] = np.cumsum(new) - 1
        else:
            distinct, place = np.unique(fp, return_inverse=True)
        low = np.full(len(distinct), NO_ID, np.int64)
        high = np.full(len(distinct), -(2**63), np.int64)
        own = self.ids[self.doc]
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        return distinct, low != high, place

    def entries(self, shared: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct suffixes (anchor, then bytes) of runs in ``shared``, their smallest doc_id, and (run, entry) of each."""
        runs = np.flatnonzero(shared)
        tail = self.length - 1
        heads = self.anchor[runs].astype(">u8").tobytes()
        data = self.data
        keys = [
            heads[8 * i : 8 * i + 8] + data[s : s + c + tail]
            for i, (s, c) in enumerate(zip(self.start[runs].tolist(), self.count[runs].tolist(), strict=True))
        ]
        distinct = sorted(set(keys))
        at = {k: i for i, k in enumerate(distinct)}
        place = np.fromiter((at[k] for k in keys), np.int64, len(keys))
        low = np.full(len(distinct), NO_ID, np.int64)
        np.minimum.at(low, place, self.ids[self.doc[runs]])
        return distinct, low, runs, place


def _cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each range of the sorted values begins, and the end."""
    bounds = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(values, bounds), [len(values)])).astype(np.int64)


def _heads(keys: list[bytes]) -> np.ndarray:
    """The anchors with which keys begin."""
    return np.frombuffer(b"".join([k[:8] for k in keys]), ">u8").astype(np.uint64) if keys else np.zeros(0, np.uint64)


def _head_cuts(keys: list[bytes], buckets: int) -> np.ndarray:
    return _cuts(_heads(keys), buckets, 64)


def front_code(keys: list[bytes], low: np.ndarray) -> bytes:
    """A sorted run: per key the common prefix with its predecessor, the rest, and the smallest doc_id."""
    heads = _heads(keys)
    differ = heads[1:] ^ heads[:-1]
    lcps = [0] * len(keys[:1]) + sum((differ < np.uint64(1 << bits)).astype(np.int64) for bits in range(0, 64, 8)).tolist()
    for i in (np.flatnonzero(differ == 0) + 1).tolist():
        lcps[i] = common_prefix(keys[i - 1], keys[i], 8)
    rests = [k[n:] for k, n in zip(keys, lcps, strict=True)]
    sizes = np.array([len(r) for r in rests], np.uint32)
    head = np.array([len(keys)], np.uint32).tobytes()
    return _pack(head + np.array(lcps, np.uint32).tobytes() + sizes.tobytes() + low.astype(np.int64).tobytes() + b"".join(rests))


def read_run(blob: bytes) -> tuple[list[bytes], list[int], list[int]]:
    data = _unpack(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    lcps = np.frombuffer(data, np.uint32, n, 4).tolist()
    sizes = np.frombuffer(data, np.uint32, n, 4 + 4 * n).tolist()
    low = np.frombuffer(data, np.int64, n, 4 + 8 * n).tolist()
    at, last, keys = 4 + 16 * n, b"", []
    for lcp, size in zip(lcps, sizes, strict=True):
        last = last[:lcp] + data[at : at + size]
        keys.append(last)
        at += size
    return keys, lcps, low


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    if a == b:
        return len(a)
    n, most = known, min(len(a), len(b))
    while n + 16 <= most and a[n : n + 16] == b[n : n + 16]:
        n += 16
    while n < most and a[n] == b[n]:
        n += 1
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, run, place) of all keys in order, from sorted runs with the common prefix of each key and its predecessor.

    A loser tree: each inner node keeps the run that lost there. Beside each
    run's key stands its common prefix with the last winner; of two keys the one
    with the longer common prefix is the smaller, and only keys with equal
    prefixes are compared, from that place on.
    """
    k = len(runs)
    if k == 1:
        for i, key in enumerate(runs[0][0]):
            yield key, 0, i
        return
    keys: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    lcp = [0] * k
    at = [0] * k
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return y is None
        p, q = lcp[a], lcp[b]
        if p != q:
            return p > q
        n = common_prefix(x, y, p)
        won = x[n:] <= y[n:] if n < len(x) and n < len(y) else len(x) <= len(y)
        lcp[b if won else a] = n
        return won

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = build(1)
    while keys[winner] is not None:
        yield keys[winner], winner, at[winner]
        own, prefixes = runs[winner][0], runs[winner][1]
        i = at[winner] = at[winner] + 1
        if i < len(own):
            keys[winner], lcp[winner] = own[i], prefixes[i]
        else:
            keys[winner] = None
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node >>= 1


def settle(group: list[tuple[bytes, int, int]], lows: list[list[int]], length: int) -> Iterator[tuple[int, int, np.ndarray | bool]]:
    """(run, place, windows covered by a smaller doc_id) for the merged entries of one anchor; True or False where that is all or none."""
    kinds: list[tuple[bytes, int, list[tuple[int, int]]]] = []
    for key, r, i in group:
        if kinds and key == kinds[-1][0]:
            kinds[-1] = (key, min(kinds[-1][1], lows[r][i]), kinds[-1][2])
            kinds[-1][2].append((r, i))
        else:
            kinds.append((key, lows[r][i], [(r, i)]))
    best: dict[bytes, int] = {}
    for key, least, _ in kinds:
        for o in range(8, len(key) - length + 1):
            w = key[o : o + length]
            if best.get(w, least) >= least:
                best[w] = least
    for key, _, members in kinds:
        holders = [best[key[o : o + length]] for o in range(8, len(key) - length + 1)]
        low, high = min(holders), max(holders)
        for r, i in members:
            own = lows[r][i]
            yield r, i, (np.array(holders, np.int64) < own) if low < own <= high else high < own


def _merge(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("unit", kind="stable")
        bucket = int(frame["bucket"].iloc[0])
        read = [read_run(b) for b in frame["blob"]]
        lows = [r[2] for r in read]
        sizes = np.array([len(r[0]) for r in read], np.int64)
        begins = np.cumsum(sizes) - sizes
        # runs meet by their anchors; entries of one anchor that aren't all the same are merged with their common prefixes
        every = [k for r in read for k in r[0]]
        low = np.concatenate([np.array(x, np.int64) for x in lows])
        heads = _heads(every)
        order = np.argsort(heads, kind="stable")
        new = np.append(True, heads[order[1:]] != heads[order[:-1]])
        first = np.flatnonzero(new)
        same = np.fromiter((a is b or a == b for a, b in _neighbours(every, order.tolist())), bool, len(order) - 1)
        differ = np.logical_or.reduceat(np.append(False, ~same) & ~new, first)
        code = np.zeros(len(every), np.uint8)
        code[order] = low[order] > np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(order))))
        masks: list[list[tuple[int, np.ndarray]]] = [[] for _ in read]
        mixed = np.repeat(differ, np.diff(np.append(first, len(order))))
        own, starts = order[mixed], new[mixed]
        run_of = np.repeat(np.arange(len(read)), sizes)[own]
        # parts: the entries that a run has of an anchor, which stand together
        part = np.flatnonzero(starts | np.append(True, run_of[1:] != run_of[:-1])[: len(own)])
        parts = zip(starts[part].tolist(), run_of[part].tolist(), (own[part] - begins[run_of[part]]).tolist(), np.diff(np.append(part, len(own))).tolist(), strict=True)
        at: list[int] = []
        what: list[int] = []

        def close(group: list[tuple[int, int, int]]) -> None:
            merged = merge_runs([(read[r][0][i : i + n], read[r][1][i : i + n]) for r, i, n in group])
            for r, i, covered in settle([(key, group[p][0], group[p][1] + k) for key, p, k in merged], lows, length):
                at.append(starts_of[r] + i)
                if covered is True or covered is False:
                    what.append(covered)
                else:
                    what.append(2)
                    masks[r].append((i, covered))

        starts_of, group = begins.tolist(), []
        for opens, r, i, n in parts:
            if opens and group:
                close(group)
                group = []
            group.append((r, i, n))
        if group:
            close(group)
        code[at] = what
        out = []
        for unit, begin, size, mask in zip(frame["unit"], begins.tolist(), sizes.tolist(), masks, strict=True):
            mask.sort(key=lambda x: x[0])
            bits = np.concatenate([m for _, m in mask]) if mask else np.zeros(0, bool)
            out.append((unit, 2, bucket, _pack(code[begin : begin + size].tobytes() + np.packbits(bits).tobytes())))
        return pd.DataFrame(out, columns=["unit", "kind", "bucket", "reply"])

    return run


def _neighbours(keys: list[bytes], order: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """Each key and the next one, in ``order``."""
    return pairwise(map(keys.__getitem__, order))


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Which fingerprints of each unit are met in another unit, or in two documents of the unit."""
    read = []
    for blob in frame["blob"]:
        data = _unpack(blob)
        n = int.from_bytes(data[:4], "little")
        read.append((np.cumsum(np.frombuffer(data, np.uint64, n, 4)), np.unpackbits(np.frombuffer(data, np.uint8, -1, 4 + 8 * n), count=n).astype(bool)))
    every = np.sort(np.concatenate([r[0] for r in read]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for unit, (fp, many) in zip(frame["unit"], read, strict=True):
        spot = np.minimum(np.searchsorted(twice, fp), max(len(twice) - 1, 0))
        hit = (twice[spot] == fp) | many if len(twice) else many
        out.append((unit, 1, int(frame["bucket"].iloc[0]), _pack(np.packbits(hit).tobytes())))
    return pd.DataFrame(out, columns=["unit", "kind", "bucket", "reply"])


_UNIT = "unit long, ids binary, sizes binary, data binary"
_REPLY = "unit long, kind int, bucket int, reply binary"


def pack_units(docs: DataFrame, unit_bytes: int) -> DataFrame:
    """Units of about ``unit_bytes`` of text; a longer document is a unit of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        unit = context.partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            row = (unit, np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), _pack(b"".join(texts)))
            return pd.DataFrame([row], columns=["unit", "ids", "sizes", "data"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if held and held + len(data) > unit_bytes:
                    yield flush()
                    unit, held = unit + 1, 0
                    ids.clear()
                    texts.clear()
                ids.append(doc)
                texts.append(data)
                held += len(data)
        if ids:
            yield flush()

    return docs.mapInPandas(run, _UNIT)


def _open(row, length: int, gram: int) -> Unit:
    return Unit(np.frombuffer(row.ids, np.int64), np.frombuffer(row.sizes, np.int64), _unpack(row.data), length, gram)


def _anchors(length: int, gram: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                fp, many, _ = _open(row, length, gram).fingerprints()
                cuts, out = _cuts(fp, buckets, _FP_BITS), []
                for b in range(buckets):
                    own = fp[cuts[b] : cuts[b + 1]]
                    if len(own):
                        step = np.diff(own, prepend=np.uint64(0))
                        flags = np.packbits(many[cuts[b] : cuts[b + 1]])
                        out.append((row.unit, b, _pack(len(own).to_bytes(4, "little") + step.tobytes() + flags.tobytes())))
                yield pd.DataFrame(out, columns=["unit", "bucket", "blob"])

    return run


def _shared_runs(unit: Unit, replies: pd.DataFrame, buckets: int) -> np.ndarray:
    fp, _, place = unit.fingerprints()
    cuts, hit = _cuts(fp, buckets, _FP_BITS), np.zeros(len(fp), bool)
    for b, reply in zip(replies["bucket"], replies["reply"], strict=True):
        n = int(cuts[b + 1] - cuts[b])
        hit[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(_unpack(reply), np.uint8), count=n).astype(bool)
    return hit[place]


def _suffixes(length: int, gram: int, buckets: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            unit = _open(row, length, gram)
            keys, low, _, _ = unit.entries(_shared_runs(unit, right, buckets))
            cuts = _head_cuts(keys, buckets)
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    out.append((row.unit, b, front_code(keys[cuts[b] : cuts[b + 1]], low[cuts[b] : cuts[b + 1]])))
        return pd.DataFrame(out, columns=["unit", "bucket", "blob"])

    return run


def _remove(length: int, gram: int, buckets: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            unit = _open(row, length, gram)
            keys, low, runs, place = unit.entries(_shared_runs(unit, right[right["kind"] == 1], buckets))
            cuts = _head_cuts(keys, buckets)
            code = np.zeros(len(keys), np.uint8)
            masks: dict[int, np.ndarray] = {}
            second = right[right["kind"] == 2]
            for b, reply in zip(second["bucket"], second["reply"], strict=True):
                data, n = _unpack(reply), int(cuts[b + 1] - cuts[b])
                own = np.frombuffer(data, np.uint8, n)
                code[cuts[b] : cuts[b + 1]] = own
                bits, at = np.unpackbits(np.frombuffer(data, np.uint8, -1, n)).astype(bool), 0
                for i in np.flatnonzero(own == 2).tolist():
                    windows = len(keys[cuts[b] + i]) - 8 - length + 1
                    masks[int(cuts[b]) + i] = bits[at : at + windows]
                    at += windows
            step = np.zeros(len(unit.data) + 1, np.int32)
            # a run of a document above the unit's smallest holder is covered; the holder's own by the reply
            whole = (unit.ids[unit.doc[runs]] > low[place]) | (code[place] == 1)
            begin = unit.start[runs[whole]]
            np.add.at(step, begin, 1)
            np.add.at(step, begin + unit.count[runs[whole]] + length - 1, -1)
            for r, i in zip(runs[~whole].tolist(), place[~whole].tolist(), strict=True):
                if code[i] == 2:
                    hit = unit.start[r] + np.flatnonzero(masks[i])
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            x = np.frombuffer(unit.data, np.uint8)
            for doc, b, e in zip(unit.ids.tolist(), unit.begins.tolist(), unit.ends.tolist(), strict=True):
                own = gone[b:e]
                removed = int(own.sum())
                kept = x[b:e][~own].tobytes() if removed else unit.data[b:e]
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                out.append((doc, e - b, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
        return pd.DataFrame(out, columns=names)

    return run


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, unit_bytes: int = 2_000_000, bucket_bytes: int = 24_000_000, texts: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept`` (bytes).

    Each byte of the UTF-8 text that lies in a ``length``-byte string which also
    starts in a document with a smaller doc_id is removed; overlaps count, strings
    are judged on the input, and none crosses documents. Null texts are empty.
    Documents with equal doc_id don't remove each other's bytes; a null doc_id is
    larger than any other. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    units = materialise(pack_units(docs, unit_bytes), "units")
    total = units.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(12, -(-int(total) * 3 // bucket_bytes))

    def tidy() -> None:
        """Let Spark delete the shuffle files of the step before."""
        gc.collect()
        spark._jvm.System.gc()

    sent = units.mapInPandas(_anchors(length, gram, buckets), "unit long, bucket int, blob binary")
    first = materialise(sent.groupBy("bucket").applyInPandas(_shared, _REPLY), "anchors")
    tidy()
    runs = units.groupBy("unit").cogroup(first.groupBy("unit")).applyInPandas(_suffixes(length, gram, buckets), "unit long, bucket int, blob binary")
    second = materialise(runs.groupBy("bucket").applyInPandas(_merge(length), _REPLY), "merged")
    tidy()
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    out = units.groupBy("unit").cogroup(first.unionByName(second).groupBy("unit")).applyInPandas(_remove(length, gram, buckets, texts), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
