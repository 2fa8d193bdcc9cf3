"""Best-fit-decreasing packing of token sequences.

Tokenising deals out over the documents.  Only lengths decide a packing, so best fit runs
on the histogram of lengths (at most ``capacity`` rows, whatever the corpus): lengths fall,
and each finds the tightest open bins in a segment tree over remaining capacities, in
logarithmic time; equal lengths go to equal bins together, with the outcome that placing
them one at a time has.  The outcome is a short list of runs: the pieces ``first`` to
``last`` of a length go to bins from ``bin`` on.  Each piece gets its rank within its length
from a distributed running count and looks up its run.

Defined cases: a null text counts as empty and has the closing id only; repeated rows are
packed as often as they occur; rows with a null id are packed too; ties of length are
ordered by hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_start

CAPACITY = 2048
END_ID = 0


class CapacityTree:
    """A segment tree over 0..capacity: which remaining capacities have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = on
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity >= need."""
        i = self.leaves + need
        if self.any[i]:
            return need
        while i > 1:  # up to the first right neighbour with an open leaf, then down its left
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """counts: pieces by length.  Runs (length, first rank, bin, pieces per bin, offset):
    the rank-th piece of the length goes to bin + (rank - first) // per and to
    offset + (rank - first) % per * length there.  Bins are numbered from 0."""
    tree, opened, runs, bins = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            opened.setdefault(remaining, deque()).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                per = room // length
                first, n = opened[room].popleft()
                if not opened[room]:
                    tree.set(room, False)
            used = min(n, -(-left // per))
            put = min(left, used * per)
            runs.append((length, rank, first, per, capacity - room))
            whole, part = divmod(put, per)
            keep(room - per * length, first, whole)
            if part:
                keep(room - part * length, first + whole, 1)
            keep(room, first + used, n - used)
            rank, left = rank + put, left - put
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the documents' ids, closed by
    ``END_ID``.  Longer ones than ``capacity`` are cut so that the first piece is the short one."""

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        from .token_ids import ids_of

        encode = ids_of(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            kept: list = []
            for doc, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(s.as_py() or ""), END_ID], dtype="<u4")
                start, length = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    part = ids[start:start + length]
                    for to, v in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes()))):
                        to.append(v)
                    if keep_ids:
                        kept.append(part.astype("i4"))
                    start, length = start + length, capacity
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            cols = [pa.array(v, t) for v, t in zip(out, types)]
            if keep_ids:
                names, cols = [*names, "ids"], [*cols, pa.array(kept, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """The pieces with sequence_id and offset.  The pieces are written once, so texts are
    tokenised once; the driver sees the histogram of lengths only."""
    cut = materialize(pieces(docs, tokenizer, capacity, **options).withColumn(
        "_rid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = best_fit_decreasing(counts, capacity)
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    ranked = running_start(cut.withColumn("_one", F.lit(1)), ["length"], ["ids_crc32", "doc_id", "_rid"],
                           "_one", "_rank", n_rows=sum(counts.values()))
    names = [c for c in cut.columns if c != "_rid"]
    shift = max(counts.values(), default=0) + 1

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            run = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(run[:, 2] + nth // run[:, 3]),
                 pa.array(run[:, 4] + nth % run[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = cut.select(*names).schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    return ranked.select(*names, "_rank").mapInArrow(place, schema)
