"""Best-fit packing of documents into sequences, repacked where a bound shows a gap.

1. Documents become identifiers plus an end mark; longer ones are cut into full
   pieces, of which the first may be shorter.
2. Pieces are spread over partitions of bounded size, and each partition runs
   best-fit decreasing on its histogram of lengths.
3. Dual feasible functions give each partition a lower bound on its sequences. A
   partition that meets its bound is certified optimal and settled. A partition
   with a gap first reruns best-fit decreasing with slightly different orders.
   Partitions that still have one keep their full sequences, exchange the other
   documents among each other and rerun, for ``rounds`` rounds; what is left of
   the gap is told by ``bound`` and ``bins``.

The work and memory of a task depend on ``items_per_partition``, not on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import lean, materialise
from lexiloom.llm.tokens import coder, default_vocabulary

CAPACITY, END = 1024, 2
NO_ID = -(2**63)  # stands for a missing doc_id inside Python, where a null would turn the column into floats
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def tokenize_pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, salt`` (and ``ids``: packed 32-bit identifiers) of each piece; a null doc_id is NO_ID."""
    path = vocabulary or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = coder(path), 0
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    part = ids[4 * at : 4 * (at + size)]
                    crc = zlib.crc32(part)
                    salt = zlib.crc32(row.to_bytes(8, "little"), crc) & 0x7FFFFFFF
                    out.append((doc, k, at, size, crc, salt, *([part] if with_ids else [])))
                    at, k, row = at + size, k + 1, row + 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt", *(["ids"] if with_ids else [])])
            yield frame

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(cut), PIECES + (", ids binary" if with_ids else ""))


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the area bound, the two-class bound and dual feasible functions over the sizes."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        # items above capacity - k alone, those above half kept, those under k dropped
        above = int(count[capacity - k + 1 :].sum())
        middle = (x > capacity // 2) & (x <= capacity - k)
        small = (x >= k) & (x <= capacity // 2)
        n, used = int(count[middle].sum()), int((count * x)[middle].sum())
        rest = int((count * x)[small].sum()) - (n * capacity - used)
        best = max(best, above + n + max(0, -(-rest // capacity)))
    for k in range(1, 65):
        # steps of 1 / (k + 1) of the capacity, each counted as 1 / k; exact multiples count as they are
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        total = int((count * np.where(exact, x * k, (scaled // capacity) * capacity)).sum())
        best = max(best, -(-total // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Longest first, or in ``order``, each into the fullest bin that takes it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    open_rooms = 0  # bit r: some bin has r tokens of room
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def repacked(sizes: np.ndarray, capacity: int = CAPACITY, tries: int = 6, items: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing, and where its bins are more than the bound says, the best of a few reruns with orders a little different.

    A rerun takes the full bins as they are and packs the items of the others
    anew, as many as ``items`` of them from the emptiest bin up.
    """
    bins, offsets, fill = best_fit_decreasing(sizes, capacity)
    rng = np.random.default_rng(len(sizes))
    for k in range(tries):
        if len(fill) <= lower_bound(sizes, capacity):
            break
        loose = np.flatnonzero(fill < capacity)
        loose = loose[np.argsort(fill[loose], kind="stable")]
        held = np.cumsum(np.bincount(bins, minlength=len(fill))[loose])
        loose = loose[: max(2, int(np.searchsorted(held, items, side="right")))]
        own = np.flatnonzero(np.isin(bins, loose))
        jitter = sizes[own] * (1 + rng.uniform(-0.03, 0.03, len(own)) * (k + 1))
        new_bins, new_offsets, new_fill = best_fit_decreasing(sizes[own], capacity, np.argsort(-jitter, kind="stable"))
        if len(new_fill) < len(loose):
            number = np.append(loose[: len(new_fill)], [])
            bins[own], offsets[own] = number[new_bins], new_offsets
            used, bins = np.unique(bins, return_inverse=True)
            fill = np.bincount(bins, weights=sizes, minlength=len(used)).astype(np.int64)
    return bins, offsets, fill


def _packer(names: list[str], turn: int, capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy(np.int64)
        part = int(frame["part"].iloc[0])
        bins, offsets, fill = repacked(sizes, capacity)
        out = frame[names].copy()
        out["sequence_id"] = (turn << 58) + (part << 26) + bins
        out["offset"] = offsets
        out["fill"] = fill[bins]
        out["bound"], out["bins"] = lower_bound(sizes, capacity), len(fill)
        return out

    return pack


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, items_per_partition: int = 250_000, rounds: int = 2) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``; ``pieces`` has ``length`` (1 to capacity) and ``salt`` and should be a written table.

    The columns ``bound`` and ``bins`` say, for the partition that packed a row
    last, the certified lower bound and the sequences it made.
    """
    names = [f.name for f in pieces.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    done: list[DataFrame] = []
    todo, parts = pieces, max(1, -(-pieces.count() // items_per_partition))
    for turn in range(rounds + 1):

        schema = f"{kinds}, sequence_id long, `offset` long, fill long, bound long, bins long"
        spread = F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(parts)).cast("int")
        packed = todo.withColumn("part", spread).groupBy("part").applyInPandas(lean(_packer(names, turn, capacity)), schema)
        packed = materialise(packed, "packed") if parts > 1 or turn else packed
        # sequences at most half full, of which a partition has one or so, are also worth an exchange
        loose = (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | (2 * F.col("fill") <= capacity))
        if turn == rounds or parts == 1:
            done.append(packed)
            break
        gaps = packed.where(loose).agg(F.count(F.lit(1)), F.count_distinct(F.expr("shiftright(sequence_id, 26)"))).first()
        if not gaps[0] or gaps[1] < 2:
            done.append(packed)
            break
        done.append(packed.where(~loose))
        todo, parts = packed.where(loose).select(*names), max(1, -(-gaps[0] // (2 * items_per_partition)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("fill")


def pack_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END, items_per_partition: int = 250_000, rounds: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack every document: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset, bound, bins``.

    A null or empty text is the end mark alone. Each row is a document of its
    own, also where rows or identifiers repeat; a null doc_id stays null. Other
    columns are ignored. An empty table gives no rows.
    """
    pieces = materialise(tokenize_pieces(df, id_col=id_col, text_col=text_col, vocabulary=vocabulary, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    packed = pack_pieces(pieces, capacity=capacity, items_per_partition=items_per_partition, rounds=rounds).drop("salt")
    return packed.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from rows with ``ids``: ``sequence_id, n_tokens, ids`` (at most ``capacity`` tokens each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids")
    )
