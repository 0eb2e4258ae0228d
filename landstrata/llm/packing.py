"""Best-fit packing of document pieces into token sequences of bounded length."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from landstrata.llm.common import cut_lineage, number_within
from landstrata.llm.tokens import REMEMBERED, encoded

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of whole texts: ``doc_id, piece, start, length, ids`` (u32 little-endian bytes).

    Each document is its ids and ``end_id``. One of at most ``capacity`` ids is one piece; a longer one is cut into
    pieces of ``capacity`` ids, of which the first takes what is over. A null or empty text is the end id alone.
    Only ``doc_id`` and ``text`` are read; rows that repeat are documents of their own.
    """

    def cut(batches):
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids"]
        for (keys,), packed in encoded(batches, tokenizer, ["doc_id"], remembered):
            rows = []
            for key, data in zip(keys, packed):
                data += end
                n = len(data) // 4
                first = n - (-(-n // capacity) - 1) * capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(key, i, a, b - a, data[4 * a:4 * b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class OpenBins:
    """Segment tree over the remaining capacities 0..capacity: which have open bins. Bins are kept as ranges of numbers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: dict[int, deque] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.ranges.setdefault(room, deque()).append((first, count))
        self._count(room, count)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of one range with exactly this room."""
        first, count = self.ranges[room].popleft()
        if count > most:
            self.ranges[room].appendleft((first + most, count - most))
            count = most
        self._count(room, -count)
        return first, count

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open bin has, in logarithmic time."""
        i = least + self.leaves
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces: rows (length, first rank, pieces, first bin, offset).

    Pieces of one length are alike, so they are placed many at a time: the tightest open bins take as many as fit,
    and new bins are opened when none has room. This is what placing them one by one in best-fit decreasing order
    gives. The work and the rows depend on the distinct lengths, at most ``capacity``, not on the number of pieces.
    """
    open_bins, rows, bins = OpenBins(capacity), [], 0

    def put(length, rank, first, count, each, room):
        """``each`` pieces into every one of ``count`` bins."""
        for i in range(each):
            rows.append((length, rank, count, first, capacity - room + i * length))
            rank += count
        left = room - each * length
        if left:
            open_bins.add(left, first, count)
        return rank

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = open_bins.tightest(length)
            if room is None:
                need = -(-(total - rank) // (capacity // length))
                open_bins.add(capacity, bins, need)
                bins += need
                room = capacity
            each, left = room // length, total - rank
            if left >= each:
                first, count = open_bins.take(room, left // each)
            else:
                (first, count), each = open_bins.take(room, 1), left
            rank = put(length, rank, first, count, each, room)
    return rows


def pack(pieces: DataFrame, order: list[Column], spread: Column, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` by best-fit decreasing over all rows; ``pieces`` needs ``length`` (1..capacity).

    Only the histogram of lengths (at most ``capacity`` rows) comes to the driver, where the plan is made; the plan's
    rows are bounded by ``capacity`` too and go to the tasks. Each piece is numbered within its length and looks its
    place up. ``order`` tells pieces apart, ``spread`` deals the pieces of a common length over tasks. ``pieces`` is
    read several times, so it should be a written table.
    """
    found = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if found and not all(isinstance(x, int) and 1 <= x <= capacity for x in found):
        raise ValueError(f"lengths must be 1 to {capacity}")
    by_length: dict[int, list] = {}
    for length, *row in plan_bins(found, capacity):
        by_length.setdefault(length, []).append(row)
    plan = {k: np.array(v, np.int64) for k, v in by_length.items()}
    numbered = number_within(pieces, ["length"], order, spread, "__rank")
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                sel = np.flatnonzero(length == k)
                rows = shared.value[int(k)]
                i = np.searchsorted(rows[:, 0], rank[sel], "right") - 1
                bins[sel] = rows[i, 2] + rank[sel] - rows[i, 0]
                offset[sel] = rows[i, 3]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bins), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = pieces.columns
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(place, f"{names}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``remembered`` bounds the pieces of text that a Python worker keeps with their ids: memory against time.
    The ids themselves are not carried through the shuffles; join ``cut_pieces`` on doc_id and piece to fill sequences.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, capacity, remembered)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    return pack(cut_lineage(digest), order, F.struct("doc_id", "piece", "ids_crc32"), capacity)
