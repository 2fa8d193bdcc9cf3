"""Audit of how text filters interact, on sorted posting lists.

Each filter keeps, per part and range of row numbers, the sorted list of the rows that fail
it.  Within a range, unions of lists are galloping k-way merges and differences gallop
through both lists; only their sizes leave the task, and sums over the ranges give every
count of every order of the filters.  A filter's loss in an order depends on the set of
filters before it, so 80 pairs (filter, set before) cover all 120 orders.

Texts are read once, in the task that scans them; from there on a row is its number, part,
failed filters and the hash of its text.  Row numbers are dense, so a range has at most
``RANGE_ROWS`` rows of a part however the table is laid out, and a hot part is spread over
its ranges.

Defined cases: a null text counts as empty, a null part as the empty string; repeated rows
count as often as they occur; a row with a null id neither copies another nor is copied, and
has no label; labels that repeat count as 1 where any of them is 1; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
RANGE_ROWS = 1 << 14
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"


# ---------------------------------------------------------------------- sorted lists
def gallop(xs: list[int], lo: int, x: int) -> int:
    """The first place at or after ``lo`` whose value is >= x: steps double until they pass
    it, then a binary search within the last step."""
    n, step = len(xs), 1
    hi = lo
    while hi < n and xs[hi] < x:
        lo = hi + 1
        hi += step
        step += step
    return bisect_left(xs, x, lo, min(hi, n))


def union(lists: list[list[int]]) -> list[int]:
    """K-way merge: the list with the least head gives its whole run below the next head."""
    heads = [(xs[0], i, 0) for i, xs in enumerate(lists) if xs]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        head, i, at = heads[0]
        xs = lists[i]
        limit = min(heads[1][0], heads[2][0]) if len(heads) > 2 else heads[1][0]
        end = gallop(xs, at, limit) if head < limit else at + 1  # an equal head comes from the other list
        if head < limit:
            out += xs[at:end]
        if end < len(xs):
            heapreplace(heads, (xs[end], i, end))
        else:
            heappop(heads)
    for _, i, at in heads:
        out += lists[i][at:]
    return out


def minus(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    i = j = 0
    while i < len(a):
        j = gallop(b, j, a[i])
        if j == len(b):
            out += a[i:]
            break
        end = gallop(a, i, b[j])
        out += a[i:end]
        i = end + (end < len(a) and a[end] == b[j])
    return out


def shared(a: list[int], b: list[int]) -> int:
    """How many values both lists hold."""
    if len(a) > len(b):
        a, b = b, a
    j = n = 0
    for x in a:
        j = gallop(b, j, x)
        if j == len(b):
            break
        n += b[j] == x
    return n


def range_counts(failed: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, ...]]:
    """(filter, set before, failing, removed, good lost, toxic lost, failing it only) for every
    filter and set of other filters; a set is the sum of 2^filter."""
    k = len(failed)
    unions = {s: union([failed[i] for i in range(k) if s >> i & 1]) for s in range(1 << k)}
    for f in range(k):
        others = (1 << k) - 1 - (1 << f)
        alone = len(minus(failed[f], unions[others]))
        for s in range(1 << k):
            if s >> f & 1:
                continue
            gone = minus(failed[f], unions[s])
            yield f, s, len(failed[f]), len(gone), shared(gone, good), shared(gone, toxic), alone


# --------------------------------------------------------------------------- the job
def failing(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """_row, _id, _part, _fails (bits of the filters A to D), _hash: one row per document."""

    def judge(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            fails, hashes = [], []
            for value, size in zip(batch.column("_text"), batch.column("_size").to_pylist()):
                t = value.as_py() or b""
                words = t.split()  # bytes: splits at space and U+0009 to U+000D only
                n = len(words)
                bits = n < 50
                bits |= (100 * len(set(words)) < 65 * n) << 1
                bits |= (100 * (len(t) - len(t.translate(None, CAPITALS))) > 5 * (size or 0)) << 2
                bits |= (len(t.translate(None, SYMBOLS)) < len(t)) << 3
                fails.append(int(bits))
                hashes.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), batch.column("_part"),
                 pa.array(fails, pa.int32()), pa.array(hashes, pa.binary())],
                ["_row", "_id", "_part", "_fails", "_hash"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
        F.col(f"`{text}`").cast("binary").alias("_text"), F.length(f"`{text}`").alias("_size"))
    return rows.mapInArrow(judge, "_row long, _id long, _part string, _fails int, _hash binary")


def numbered(rows: DataFrame) -> DataFrame:
    """Row numbers without gaps: a scan task's rows follow those of the tasks before it."""
    task, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(task.alias("_task")).agg(F.count("*").alias("_n")).select(
        "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per scan task
    return rows.withColumn("_task", task).join(starts, "_task").withColumn("_row", F.col("_start") + place)


def postings(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """_part, _range, _n and the sorted lists _A to _E, _good and _toxic of row numbers."""
    copied = rows.groupBy("_hash").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"))
    copied = copied.filter("_copies > 1").select(F.col("_hash").alias("_copied"), "_first")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("_good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("_toxic"))
    at = numbered(rows).join(copied, F.col("_hash") == F.col("_copied"), "left").join(
        marks, F.col("_id") == F.col("_labelled"), "left")
    fails = F.col("_fails") + F.when(F.col("_id") > F.col("_first"), 16).otherwise(0)
    at = at.select("_part", "_row", F.shiftright("_row", RANGE_ROWS.bit_length() - 1).alias("_range"),
                   fails.alias("_fails"), "_good", "_toxic")

    def listed(where):
        return F.sort_array(F.collect_list(F.when(where, F.col("_row"))))

    lists = [listed(F.col("_fails").bitwiseAND(1 << i) > 0).alias(f"_{f}") for i, f in enumerate(FILTERS)]
    return at.groupBy("_part", "_range").agg(F.count("*").alias("_n"), *lists,
                                             listed(F.col("_good") == 1).alias("_good"),
                                             listed(F.col("_toxic") == 1).alias("_toxic"))


def sizes(lists: DataFrame) -> DataFrame:
    """Per part, filter and set of filters before it, the sums over all ranges."""
    names = ["filter", "before", "failing", "removed", "good_lost", "toxic_lost", "unique_fails"]

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in batch.to_pylist():
                found = range_counts([block[f"_{f}"] for f in FILTERS], block["_good"], block["_toxic"])
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block["_part"]] * len(columns[0]), pa.string()),
                     pa.array([block["_n"]] * len(columns[0]), pa.int64()),
                     *[pa.array(c, pa.int64()) for c in columns]], ["_part", "_n", *names])

    out = lists.mapInArrow(merge, "_part string, _n long, " + ", ".join(f"{n} long" for n in names))
    return out.groupBy("_part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("_n", *names[2:])])


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, set of filters before it) for every order of the filters."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, start=1):
            out.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley: one row per part, order of the filters and step."""
    rows = materialize(failing(docs, id_col, text, part))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, _f long, _before long")
    at = sizes(postings(rows, labels)).join(  # 600 rows, whatever the input
        F.broadcast(steps), (F.col("filter") == F.col("_f")) & (F.col("before") == F.col("_before")))
    so_far = Window.partitionBy("_part", "filter_order").orderBy("step")
    return at.select(
        F.col("_part").alias("part"), "filter_order", "step",
        (F.col("_n") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("_part", "filter")).alias("shapley"))
