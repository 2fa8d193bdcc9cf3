"""Ranked lexical search for many items at once, with shared partial scores.

A document's score for an item is a sum over the item's terms, so items that share a set of
terms share a partial sum.  The shared sets are mined among the items: terms that occur in
the same items form one set, and then, again and again, the pair of sets that most items
hold together becomes a set of its own.  This gives a graph in which every node is the sum
of two nodes below it; items that share a node share its value.  A task takes documents in
small batches, computes each node once for the batch, adds up the items from what is left of
them, and keeps each item's best documents.

The texts are read once per block of items.  What is kept of a document is its number of
terms and the counts of the items' terms in it; totals and document frequencies come from
there.  A first round over one document in ``SAMPLED`` (by hash) gives each item a score
that ``top`` documents reach, and tasks return nothing below it: the result is the same, and
what tasks return does not grow with their number.

Blocks of items have at most ``BLOCK_TERMS`` terms unless a single item has more, so the
driver and the tasks hold a bounded part of the items; any number of items takes as many
rounds.

Defined cases: a null or empty text has no term and is never found; an item without a term,
or whose terms no document holds, gets no row; repeated documents are ranked as often as they
occur and repeated items answered as often; equal scores go by id, null ids last; empty
tables give an empty result; other columns are ignored."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOP = 50
BLOCK_TERMS = 200_000
#: Bounds of one graph: pairs that mining counts at most, and cells of its value matrix.
GRAPH_PAIRS, CELLS = 1_000_000, 1 << 21
SAMPLED = 64
SEPARATORS = [c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)]
LOWER = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters above U+007F, A-Z lower-cased."""
    return text.translate(LOWER).split()


# ------------------------------------------------------------------ the sharing graph
class Graph:
    """The sums of some items as a graph.  Nodes 0..len(leaves)-1 are sets of terms that occur
    in the same items, the following ones sums of two earlier nodes; an item is the sum of its
    ``parts``.  ``additions`` counts what one document costs, ``plain`` what it would without
    sharing."""

    def __init__(self, items: list[list[int]]):
        holders: dict[int, list[int]] = defaultdict(list)
        for i, ts in enumerate(items):
            for t in ts:
                holders[t].append(i)
        sets: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for t, where in holders.items():
            sets[tuple(where)].append(t)
        self.leaves = list(sets.values())
        parts: list[set[int]] = [set() for _ in items]
        for node, where in enumerate(sets):
            for i in where:
                parts[i].add(node)
        self.sums: list[tuple[int, int]] = []
        self._mine(parts, {node for node, where in enumerate(sets) if len(where) > 1})
        self.parts = [sorted(p) for p in parts]
        self.plain = sum(len(ts) - 1 for ts in items if ts)
        self.additions = (sum(len(x) - 1 for x in self.leaves) + len(self.sums)
                          + sum(len(p) - 1 for p in self.parts if p))

    def _mine(self, parts: list[set[int]], shared: set[int]) -> None:
        """Replaces the pair of nodes that most items hold by its sum until no pair is in two."""
        together: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, p in enumerate(parts):
            for pair in itertools.combinations(sorted(p & shared), 2):
                together[pair].add(i)
        heap = [(-len(where), pair) for pair, where in together.items() if len(where) > 1]
        heapq.heapify(heap)
        node = len(self.leaves)
        while heap:
            n, pair = heapq.heappop(heap)
            where = together[pair]
            if len(where) != -n:  # an older count
                if len(where) > 1:
                    heapq.heappush(heap, (-len(where), pair))
                continue
            self.sums.append(pair)
            met: dict[int, set[int]] = defaultdict(set)
            for i in where:
                parts[i] -= set(pair)
                for other in parts[i] & shared:
                    for gone in pair:
                        together[min(gone, other), max(gone, other)].discard(i)
                    met[other].add(i)
            for i in where:
                parts[i].add(node)
            del together[pair]
            for other, both in met.items():
                together[other, node] = both
                if len(both) > 1:
                    heapq.heappush(heap, (-len(both), (other, node)))
            shared.add(node)
            node += 1


class Plan:
    """A graph laid out for evaluation over batches of documents, in plain arrays."""

    def __init__(self, item_rows: list[int], items: list[list[int]]):
        graph = Graph(items)
        self.graph_size = (graph.additions, graph.plain)
        self.item_rows = np.array(item_rows, np.int64)
        order = [t for leaf in graph.leaves for t in leaf]
        self.terms = np.array(sorted(order), np.int64)
        place = {t: i for i, t in enumerate(order)}
        self.place = np.array([place[t] for t in self.terms.tolist()], np.int64)
        self.leaf_starts = np.cumsum([0] + [len(x) for x in graph.leaves[:-1]])
        n = len(graph.leaves)
        self.n_nodes = n + len(graph.sums)
        depth, levels = [0] * n, defaultdict(list)
        for at, (a, b) in enumerate(graph.sums):
            depth.append(1 + max(depth[a], depth[b]))
            levels[depth[-1]].append((n + at, a, b))
        self.levels = [tuple(np.array(c) for c in zip(*levels[d])) for d in sorted(levels)]
        self.parts = np.array([p for ps in graph.parts for p in ps])
        self.part_starts = np.cumsum([0] + [len(p) for p in graph.parts[:-1]])
        self.batch = max(1, CELLS // max(1, len(order) + self.n_nodes + len(self.parts)))

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """items x documents; (doc, term) are distinct pairs, ``value`` what they add."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        ours = self.terms[at] == term
        leaf = np.zeros((len(self.terms), n_docs), np.int64)
        leaf[self.place[at[ours]], doc[ours]] = value[ours]
        node = np.empty((self.n_nodes, n_docs), np.int64)
        node[:len(self.leaf_starts)] = np.add.reduceat(leaf, self.leaf_starts, axis=0)
        for to, a, b in self.levels:
            node[to] = node[a] + node[b]
        return np.add.reduceat(node[self.parts], self.part_starts, axis=0)


def plans(items: list[list[int]]) -> list[Plan]:
    """Graphs over runs of items, each within ``GRAPH_PAIRS`` unless a single item is above."""
    out, run, pairs = [], [], 0
    for i, ts in enumerate(items):
        if not ts:
            continue
        if run and pairs + len(ts) ** 2 > 2 * GRAPH_PAIRS:
            out.append(Plan(run, [items[j] for j in run]))
            run, pairs = [], 0
        run.append(i)
        pairs += len(ts) ** 2
    if run:
        out.append(Plan(run, [items[j] for j in run]))
    return out


# --------------------------------------------------------------------------- the job
class Best:
    """The best ``top`` documents of each item seen so far, ties by id, null ids last."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floors, self.top = floors.copy(), top
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        self.held.append((item, score, missing, doc_id))
        self.n += len(item)
        if self.n > 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, missing, doc_id = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((doc_id, missing, -score, item))
        item, score, missing, doc_id = item[order], score[order], missing[order], doc_id[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.top - 1
        self.floors[item[full]] = np.maximum(self.floors[item[full]], score[full])
        keep = rank < self.top
        self.held = [(item[keep], score[keep], missing[keep], doc_id[keep])]
        self.n = int(keep.sum())
        return self.held[0]


def profiles(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _n (terms of the document), _terms and _tfs (the vocabulary's terms in it, by number)."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            sizes, found, tfs = [], [], []
            for value in batch.column("_text"):
                ts = terms(value.as_py() or b"")
                sizes.append(len(ts))
                tf = {number[t]: c for t, c in Counter(ts).items() if t in number}
                found.append(list(tf))
                tfs.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["_id", "_n", "_terms", "_tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("_text"))
    return rows.mapInArrow(count, "_id long, _n long, _terms array<int>, _tfs array<long>")


def best(profile: DataFrame, graphs: list[Plan], weights: np.ndarray, n_docs: int, n_terms: int,
         floors: np.ndarray, top: int) -> DataFrame:
    """_item (row number), _id, _score: each item's ``top`` documents above 0 and not below its floor."""

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept = Best(floors, top)
        step = min(p.batch for p in graphs)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes = part.column("_n").to_pylist()
                # Python's integers: the product passes 64 bits on very large tables.
                m = np.array([50 + 50 * n * n_docs // n_terms for n in sizes], np.int64)
                listed = part.column("_terms")
                doc = np.repeat(np.arange(len(sizes)), listed.value_lengths().to_numpy(zero_copy_only=False))
                if not len(doc):
                    continue
                term = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column("_tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                ids = part.column("_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for plan in graphs:
                    scores = plan.scores(doc, term, value, len(sizes))
                    item, at = np.nonzero((scores > 0) & (scores >= kept.floors[plan.item_rows][:, None]))
                    kept.add(plan.item_rows[item], scores[item, at], missing[at], ids[at])
        item, score, missing, doc_id = kept.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=missing), pa.array(score, pa.int64())],
            ["_item", "_id", "_score"])

    found = profile.mapInArrow(search, "_item long, _id long, _score long")
    ranked = Window.partitionBy("_item").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))
    return found.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= top)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], id_col: str, text: str,
                  top: int) -> DataFrame | None:
    vocabulary = sorted({t for _, ts in block for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    spark = docs.sparkSession
    profile = materialize(profiles(docs, vocabulary, id_col, text))
    total = profile.agg(F.count_if(F.col("_n") > 0).alias("n"), F.sum("_n").alias("l")).first()
    if not total["n"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in profile.select(F.explode("_terms").alias("t")).groupBy("t").count().collect():  # the vocabulary at most
        df[row["t"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    graphs = plans([sorted(number[t] for t in ts if df[number[t]]) for _, ts in block])
    if not graphs:
        return None
    floors = np.zeros(len(block), np.int64)
    some = profile.filter(F.pmod(F.xxhash64("_id", "_n", "_terms"), F.lit(SAMPLED)) == 0)
    for row in best(some, graphs, weights, total["n"], total["l"], floors, top).filter(F.col("_rank") == top).collect():
        floors[row["_item"]] = row["_score"]
    found = best(profile, graphs, weights, total["n"], total["l"], floors, top)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "_no long, item_id long")
    return found.join(names, F.col("_item") == F.col("_no")).select(
        "item_id", F.col("_rank").alias("rank"), F.col("_id").alias("doc_id"), F.col("_score").alias("score"))


def blocks(items: DataFrame, id_col: str = "item_id", text: str = "text",
           block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items with their distinct terms, some at a time."""
    block: list = []
    size = 0
    at = items.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("binary"))
    for item_id, value in at.toLocalIterator():
        ts = sorted(set(terms(bytes(value or b""))))
        if block and size + len(ts) > block_terms:
            yield block
            block, size = [], 0
        block.append((item_id, ts))
        size += len(ts)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0."""
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, block_terms=block_terms):
        if (part := _search_block(docs, block, id_col, text, top)) is not None:
            found = found.unionAll(part)
    return found
