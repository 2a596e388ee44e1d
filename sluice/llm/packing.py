"""Best-fit packing of token sequences by large-item matching.

A plan is made from the histogram of piece lengths alone (at most `capacity` counts, whatever the corpus holds):

* Pieces above a third of the capacity go at most two to a bin. From the longest down, each is matched greedily
  with the longest other such piece that fits beside it.
* The others, from the longest down, go to the smallest gap that still takes them, and open new bins after that.

All pieces of one length are alike, so steps are taken for whole groups of bins. The plan says, for each length
and each range of ranks within it, which sequences and which offset these pieces get. Pieces then learn their rank
from counts per task and length, and look their place up: no task sees more than its own pieces and the plan.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sliced, texts
from .tokens import BYTE_BPE, encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset, pieces a sequence) for all pieces counted.

    Ranks first ... first + number - 1 of a length fill consecutive sequences, `pieces a sequence` to each, side by
    side from the offset. The number of sequences is within that of best-fit decreasing on the same lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    taken: dict[int, int] = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, number)
    sequences = 0

    def place(length: int, first: int, number: int, offset: int, each: int = 1) -> None:
        out.append((length, taken[length], number * each, first, offset, each))
        taken[length] += number * each
        left[length] -= number * each

    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and (left[m] > (m == n))), None)
            if mate is None:
                number, used = left[n], n
                place(n, sequences, number, 0)
            else:
                number, used = (left[n] // 2 if mate == n else min(left[n], left[mate])), n + mate
                place(n, sequences, number, 0)
                place(mate, sequences, number, n)
            bins[capacity - used].append((sequences, number))
            sequences += number
    gaps = [g for g in range(1, capacity + 1) if bins[g]]
    for n in sorted((n for n in left if n <= third), reverse=True):
        fitting = [g for g in gaps if g >= n]
        heapq.heapify(fitting)
        while left[n]:
            if not fitting:
                each = min(capacity // n, left[n])
                number = left[n] // each
                place(n, sequences, number, 0, each)
                bins[capacity - n * each].append((sequences, number))
                gaps.append(capacity - n * each)
                sequences += number
                if left[n]:  # the last bin of this length is not full
                    heapq.heappush(fitting, capacity - n * each) if capacity - n * each >= n else None
                continue
            gap = fitting[0]
            if not bins[gap]:
                heapq.heappop(fitting)
                continue
            first, number = bins[gap].pop()
            each = gap // n
            used = min(number, left[n] // each)
            if not used:  # fewer are left than one bin takes
                used, each = 1, left[n]
            place(n, first, used, capacity - gap, each)
            if used < number:
                bins[gap].append((first + used, number - used))
            rest = gap - n * each
            bins[rest].append((first, used))
            gaps.append(rest)
        gaps = sorted({g for g in gaps if g and bins[g]})
    return out


class Lookup:
    """Places of pieces by length and rank, from a plan; vectorised."""

    def __init__(self, rows: list[tuple], capacity: int):
        rows = sorted(rows)
        self.shift = max((r[1] + r[2] for r in rows), default=1).bit_length() + 1
        if (capacity + 1) << self.shift >= 1 << 63:
            raise ValueError("too many pieces of one length")
        a = np.array(rows, np.int64).reshape(-1, 6)
        self.key = (a[:, 0] << self.shift) + a[:, 1]
        self.rank, self.first, self.offset, self.each = a[:, 1], a[:, 3], a[:, 4], a[:, 5]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.shift) + rank, "right") - 1
        k = rank - self.rank[at]
        return self.first[at] + k // self.each[at], self.offset[at] + k % self.each[at] * length


def pieces(docs: DataFrame, capacity: int, vocabulary: str = BYTE_BPE, end_id: int = 2) -> DataFrame:
    """Each text's ids with the end id, cut from its end into pieces of `capacity`; `part` and `nth` number equal lengths within a task."""

    def run(batches):
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(np.frombuffer(encode.ids(text), "<u2"), np.uint32(end_id)).astype("<u4").tobytes()
                n, at = len(ids) // 4, 0
                for k in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if k == 0 else capacity
                    rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), seen[length]))
                    seen[length] += 1
                    at += length
            doc, *rest = zip(*rows)
            kinds = [pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(doc, pa.int64()), *(pa.array(x, t) for x, t in zip(rest, kinds)), pa.array([part] * len(doc), pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long")


def best_fit_packing(docs: DataFrame, capacity: int = 1024, vocabulary: str = BYTE_BPE, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents.

    Null texts are empty: one piece with the end id alone. Null doc_ids and repeated rows are packed as rows of
    their own. An empty table gives no rows. Only documents longer than the capacity are cut, into pieces of the
    capacity; the first piece is shorter where the length is no multiple.
    """
    cut = materialise(pieces(docs, capacity, vocabulary, end_id), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # a row for each task and length at most; running sums over the tasks give each task's first rank
    base = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    look = Lookup(plan(histogram, capacity), capacity)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "rank"))
            sequence, offset = look(length, rank)
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
