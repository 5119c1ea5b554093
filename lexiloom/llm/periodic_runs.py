"""Periodic runs in texts by Crochemore's partition refinement.

Positions of a text that start the same factor of L words form a class. Classes
are refined from L to L + 1: of a class that was split all parts but the largest
are taken, and the positions before their members leave their classes (the
smaller half, so a text of n words costs n log n moves). Two neighbours of a class
at distance L begin a square of period L, and they are told when the pair is
parted: it was in one class at length L if it met at or before L and parts after.
Squares that begin at consecutive positions merge into a run.

Runs of fewer than ``LEAST`` words don't count, so every run holds a factor of
``LEAST // 2`` words that repeats at the run's period. Refinement starts at that
length, with the positions whose factor repeats in their text; others are alone
in their class and stay so.

Many texts are refined side by side in NumPy arrays, a chunk of texts at a time:
nothing is shuffled, and a task holds one chunk (or one text, where that is longer).

Null texts have no words and no runs; a null doc_id is never made periodic.
Repeated rows are treated each by itself, other columns are carried by ``keep``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12  # words of a run
_HALF = LEAST // 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def repeated_factors(ids: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class): where a factor of half the least run starts that stands elsewhere in its text too.

    ``doc`` is the text of each word, ``last`` whether a factor fits no more. A hash
    leaves out positions alone in their class; classes are told by the words themselves.
    """
    n = len(ids) - _HALF + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ids.astype(np.uint64)
    h = doc[:n].astype(np.uint64)
    for k in range(_HALF):
        h = (h ^ word[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(~last[:n])
    h = h[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    if not len(at):
        return at, at
    columns = [ids[at + k] for k in range(_HALF - 1, -1, -1)] + [doc[at]]
    order = np.lexsort(columns)
    new = np.zeros(len(at), bool)
    new[0] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    cls = np.empty(len(at), np.int64)
    cls[order] = np.cumsum(new) - 1
    many = size[cls] > 1
    at, cls = at[many], cls[many]
    return at, np.unique(cls, return_inverse=True)[1] if len(cls) else cls


class Refiner:
    """Classes of positions, refined length by length, and the squares that they reveal."""

    def __init__(self, at: np.ndarray, cls: np.ndarray, limit: np.ndarray):
        m = len(at)
        self.at, self.limit = at, limit
        self.cls = cls.astype(np.int64)
        self.level = _HALF
        self.elems = np.argsort(self.cls, kind="stable")  # members of a class stand together
        self.loc = np.empty(m, np.int64)
        self.loc[self.elems] = np.arange(m)
        own = self.cls[self.elems]
        self.size = np.zeros(m + 1, np.int64)
        self.start = np.zeros(m + 1, np.int64)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if m else np.empty(0, np.int64)
        self.n = len(first)
        self.start[: self.n] = first
        self.size[: self.n] = np.diff(np.append(first, m))
        # neighbours by position
        self.next, self.prev = np.full(m, -1), np.full(m, -1)
        a, b = self.elems[:-1], self.elems[1:]
        pair = own[1:] == own[:-1]
        self.next[a[pair]], self.prev[b[pair]] = b[pair], a[pair]
        self.born = np.full(m, _HALF)
        self.flag = np.zeros(m, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        d = np.where(self.next >= 0, at[self.next] - at, 0)
        short = np.flatnonzero((d > 0) & (d < _HALF))  # periods below the first length show at that length
        self.found.append((at[short], d[short]))
        self.after = np.zeros(m, bool)  # whether the next position has a class
        self.after[:-1] = at[1:] == at[:-1] + 1

    def _told(self, x: np.ndarray, until: np.ndarray | int) -> None:
        """Squares of the pairs (x, next) that were neighbours up to length ``until``."""
        d = self.at[self.next[x]] - self.at[x]
        good = (self.next[x] >= 0) & (self.born[x] <= d) & (d <= until)
        if good.any():
            self.found.append((self.at[x[good]], d[good]))

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of every primitive square that matters for runs."""
        m = len(self.at)
        if m:
            all_ = np.arange(m)
            by = np.where(self.after, self.cls[np.minimum(all_ + 1, m - 1)], self.n + all_)
            small = self.split(all_[self.limit > self.level], by[self.limit > self.level])
            most = int(self.limit.max())
            while len(small) and self.level < most:
                e = small[small > 0] - 1
                e = e[self.after[e]]
                e = e[(self.limit[e] > self.level) & (self.size[self.cls[e]] > 1)]
                small = self.split(e, self.cls[e + 1])
            self._told(all_, self.limit)
        return np.concatenate([p for p, _ in self.found]), np.concatenate([d for _, d in self.found])

    def split(self, e: np.ndarray, by: np.ndarray) -> np.ndarray:
        """One length more: elements ``e`` leave their classes in groups of equal ``by``. Returns all parts of split classes but the largest, in order."""
        level, self.level = self.level, self.level + 1
        if not len(e):
            return e
        own = self.cls[e]
        order = np.lexsort((e, by, own))
        e, own, by = e[order], own[order], by[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (by[1:] != by[:-1])))
        length = np.diff(np.append(first, len(e)))
        of = own[first]
        head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        classes, moved = of[head], np.add.reduceat(length, head)
        rest = self.size[classes] - moved
        count = np.diff(np.append(head, len(of)))
        per = np.repeat(np.arange(len(classes)), count)
        top = np.maximum.reduceat(length, head)
        tops = np.flatnonzero(length == top[per])
        big = tops[np.append(True, per[tops][1:] != per[tops][:-1])]  # the first largest group of each class
        stays = np.zeros(len(length), bool)
        stays[big[rest == 0]] = True  # nothing else is left: the largest group keeps the class
        large = stays.copy()
        swap = (rest > 0) & (top > rest)  # the part left behind is the smaller one
        large[big[swap]] = True
        goes = ~stays
        if not goes.any():
            return e[:0]
        out = np.repeat(goes, length)
        x, xown, glen = e[out], own[out], length[goes]
        small = [e[np.repeat(goes & ~large, length)]]
        gone = np.bincount(per[goes], weights=glen, minlength=len(classes)).astype(np.int64)
        self._unlink(x, xown, glen, level)
        # members of the groups go to the end of their class's place
        keep = gone > 0
        zone = self.start[classes[keep]] + self.size[classes[keep]] - gone[keep]
        slots = _ranges(zone, gone[keep])
        self.flag[x] = True
        there = self.elems[slots]
        strangers = there[~self.flag[there]]
        self.flag[x] = False
        at = self.loc[x]
        holes = at[at < np.repeat(zone, gone[keep])]
        self.elems[holes], self.loc[strangers] = strangers, holes
        self.elems[slots], self.loc[x] = x, slots
        self.size[classes] -= gone
        new = self.n + np.arange(len(glen))
        self.n += len(glen)
        self.cls[x] = np.repeat(new, glen)
        self.size[new] = glen
        self.start[new] = slots[np.cumsum(glen) - glen]
        if swap.any():
            small.append(self.elems[_ranges(self.start[classes[swap]], self.size[classes[swap]])])
        return np.sort(np.concatenate(small))

    def _unlink(self, x: np.ndarray, own: np.ndarray, glen: np.ndarray, level: int) -> None:
        """Take ``x`` (groups of ``glen``, in order) out of the lists of their classes and link each group."""
        order = np.lexsort((x, own))
        r = x[order]
        cut = np.flatnonzero(np.append(True, self.next[r[:-1]] != r[1:]))
        first, last = r[cut], r[np.append(cut[1:], len(r)) - 1]
        before, behind = self.prev[first], self.next[last]
        b = before >= 0
        self._told(before[b], level)
        fresh = np.full(len(x), -1)
        fresh[:-1] = x[1:]
        ends = np.cumsum(glen) - 1
        fresh[ends] = -1
        parted = fresh != self.next[x]
        self._told(x[parted], level)
        self.born[before[b]] = level + 1
        self.next[before[b]] = behind[b]
        a = behind >= 0
        self.prev[behind[a]] = before[a]
        self.born[x[parted]] = level + 1
        self.next[x] = fresh
        back = np.full(len(x), -1)
        back[1:] = x[:-1]
        back[ends - glen + 1] = -1
        self.prev[x] = back


def runs_of(position: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that squares at consecutive positions make."""
    order = np.lexsort((position, period))
    p, q = position[order], period[order]
    first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1))) if len(p) else np.empty(0, np.int64)
    start, q, end = p[first], q[first], p[np.append(first[1:], len(p)) - 1] if len(p) else p
    length = end - start + q + np.maximum(q, _HALF)
    long_ = length >= np.maximum(LEAST, 2 * q)
    return start[long_], length[long_], q[long_]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words that is made periodic from a place on; None for most texts."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return self.setdefault(word, len(self))


#: Words of a chunk, words of a slice whose repeated factors are sought at once, words that keep their number from slice to slice.
CHUNK_WORDS, SLICE_WORDS, VOCABULARY = 4_000_000, 500_000, 300_000


class Chunk:
    """Texts whose runs are found together."""

    def __init__(self) -> None:
        self.ids = _Ids()
        self._clear()

    def _clear(self) -> None:
        self.texts: list[tuple] = []  # key, text, number of words
        self.words = 0
        self.at: list[np.ndarray] = []
        self.cls: list[np.ndarray] = []
        self.n_classes = 0
        self._slice: list[np.ndarray] = []
        self._sliced = 0

    def add(self, key: tuple, doc_id: int | None, text: str | None) -> None:
        words = (text or "").encode().split()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        order = planted(len(words), doc_id)
        self.texts.append((key, doc_id, text, len(words)))
        self._slice.append(ids if order is None else ids[order])
        self._sliced += len(words)
        self.words += len(words)
        if self._sliced >= SLICE_WORDS:
            self._factors()

    def _factors(self) -> None:
        lengths = np.array([len(x) for x in self._slice], np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(doc))
        at, cls = repeated_factors(np.concatenate(self._slice) if len(lengths) else np.empty(0, np.int32), doc, left < _HALF)
        self.at.append(at + self.words - self._sliced)
        self.cls.append(cls + self.n_classes)
        self.n_classes += int(cls.max()) + 1 if len(cls) else 0
        self._slice, self._sliced = [], 0
        if len(self.ids) > VOCABULARY:
            self.ids.clear()

    def results(self) -> Iterator[tuple]:
        """(key, runs, kept words) of each text; runs are (start, length, period) in order."""
        self._factors()
        lengths = np.array([t[3] for t in self.texts], np.int64)
        ends = np.cumsum(lengths)
        at = np.concatenate(self.at)
        text = np.searchsorted(ends, at, "right")
        start, length, period = runs_of(*Refiner(at, np.concatenate(self.cls), lengths[text] // 2).squares())
        order = np.lexsort((period, start))
        start, length, period = start[order], length[order], period[order]
        text = np.searchsorted(ends, start, "right")
        start = start - (ends - lengths)[text]
        cuts = np.searchsorted(text, np.arange(len(lengths) + 1))
        for i, (key, doc_id, body, n) in enumerate(self.texts):
            words = (body or "").encode().split()
            moved = planted(n, doc_id)
            if moved is not None:
                words = [words[k] for k in moved.tolist()]
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, start[a:b] + period[a:b], 1)
                np.add.at(steps, start[a:b] + length[a:b], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            yield key, list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)), words
        self._clear()


RESULT = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_DDL = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _row(n: int, runs: list[tuple[int, int, int]], words: list[bytes]) -> tuple:
    s, ell, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return n, len(runs), s, ell, q, 1000 * ell // q if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_runs, the longest run, digests) of each row of ``docs``.

    The longest run is ``start``, ``length``, ``period`` and ``exponent_milli``, null
    where there is none (ties: the smaller start, then period). ``runs_sha256`` digests every
    run, ``collapsed_sha256`` the words that stay once repetitions of a period go; with ``texts`` the
    runs and the collapsed text are there themselves. ``plant`` first makes some texts periodic, by a rule on doc_id.
    """
    more = [("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())] if texts else []
    schema = pa.schema([("doc_id", pa.int64()), *RESULT, *more])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def settled(chunk: Chunk) -> pa.RecordBatch:
        n = [t[3] for t in chunk.texts]
        rows = []
        for i, (doc_id, runs, words) in enumerate(chunk.results()):
            extra = ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(words).decode()) if texts else ()
            rows.append((doc_id, *_row(n[i], runs, words), *extra))
        return batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                chunk.add(doc_id, doc_id if plant else None, text.as_py())
                if chunk.words >= CHUNK_WORDS:
                    yield settled(chunk)
        if chunk.texts:
            yield settled(chunk)

    ddl = "doc_id long, " + _DDL + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
