"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors (``FIT_ROWS`` distinct ones, by hash; a documented bound)
the graph of nearest neighbours is cut into balanced parts, so that neighbours share a part
as often as can be: each bisection starts from the graph's second eigenvector and then swaps
equal numbers of nodes between the sides as long as edges are won.  A small classifier
(softmax regression on the neighbours' parts) learns which part a vector's neighbours are
in.  How many parts a query needs for ``RECALL`` is read off a held-out eighth of the sample.

Every vector is indexed: it goes to its most probable part, and a part is dealt over as many
blocks as its size asks for, so neither a large part nor many queries meet in one task.  Each
query goes to all blocks of its most probable parts and is compared with every vector there,
by the exact cosine in double precision.  Equal vectors are compared once; of their ids only
the k + 1 smallest can be among the k nearest, and those are kept.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component
takes no part, as query or candidate, nor does a row with a null id or a vector whose length
is not the most common one; a query's own row is left out once, so a repeated row finds its
twin; repeated query rows are answered as often; ties go to the smaller id; with fewer
candidates than k all are returned; empty tables give an empty result; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY = 5, 50
FIT_ROWS, NEIGHBOURS, RECALL = 8192, 10, 0.95
#: Vectors per part that are aimed at, most parts (32 sampled vectors each), vectors of a
#: block, queries of a tile.
PART_ROWS, MAX_PARTS, BLOCK_ROWS, TILE_ROWS = 256, FIT_ROWS // 32, 2048, 4096


# --------------------------------------------------------------- fitting, on the sample
def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def nearest(vectors: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """Places of the ``k`` vectors of largest cosine for each query, its ``own`` place left out."""
    out = np.empty((len(queries), k), np.int64)
    for start in range(0, len(queries), 512):
        s = queries[start:start + 512] @ vectors.T
        s[np.arange(len(s)), own[start:start + 512]] = -np.inf
        out[start:start + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(n: int, a: np.ndarray, b: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Two sides of equal size (up to one) with few edges (a, b) between them; every edge is
    listed both ways."""
    degree = np.bincount(a, minlength=n).astype(float)
    root = np.sqrt(np.maximum(degree, 1.0))
    top = root / np.linalg.norm(root)
    x = np.random.default_rng(n).standard_normal(n)
    for _ in range(rounds):  # power iteration beside the first eigenvector
        x -= top * (top @ x)
        x = x / np.linalg.norm(x) + np.bincount(a, (x / root)[b], n) / root
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2:]] = True
    for _ in range(rounds):  # swaps
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - degree
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        won = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not won:
            break
        take = max(1, won // 2)
        trial = side.copy()
        trial[left[:take]], trial[right[:take]] = True, False
        if (trial[a] != trial[b]).sum() >= across.sum():
            break
        side = trial
    return side


def balanced_parts(neighbours: np.ndarray, n_parts: int) -> np.ndarray:
    """Part numbers 0..n_parts - 1 (a power of two) of the nodes, by recursive bisection."""
    n, k = neighbours.shape
    a = np.repeat(np.arange(n), k)
    a, b = np.concatenate([a, neighbours.ravel()]), np.concatenate([neighbours.ravel(), a])
    part = np.zeros(n, np.int64)
    for _ in range(n_parts.bit_length() - 1):
        deeper = np.zeros(n, np.int64)
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[members] = np.arange(len(members))
            inside = (place[a] >= 0) & (place[b] >= 0)
            deeper[members] = bisect(len(members), place[a[inside]], place[b[inside]])
        part = 2 * part + deeper
    return part


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def with_one(units: np.ndarray) -> np.ndarray:
    return np.hstack([units, np.ones((len(units), 1))])


def fit_classifier(units: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.3) -> np.ndarray:
    """Weights (dimensions + 1, parts) of a softmax regression on target shares, by Adam steps."""
    x = with_one(units)
    w = np.zeros((x.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x.T @ (softmax(x @ w) - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit(sample: np.ndarray, n_parts: int, k: int = K, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """The classifier's weights, and the number of parts a query is sent to."""
    units = unit(sample)
    n = len(units)
    if n_parts < 2 or n < 8 * k:
        return np.zeros((sample.shape[1] + 1, 1)), 1
    held = np.arange(n) % 8 == 7
    base = units[~held]
    near = nearest(base, base, min(NEIGHBOURS, len(base) - 1), np.arange(len(base)))
    part = balanced_parts(near, n_parts)
    target = np.zeros((len(base), n_parts))
    np.add.at(target, (np.repeat(np.arange(len(base)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    w = fit_classifier(base, target)
    home = np.argmax(with_one(units) @ w, axis=1)
    asked = np.flatnonzero(held)
    true = nearest(units, units[asked], k, asked)
    order = np.argsort(-(with_one(units[asked]) @ w), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n_parts)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, home[true], axis=1).ravel())
    return w, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def n_parts(n: int) -> int:
    """The power of two nearest to n / PART_ROWS, within 1 and MAX_PARTS."""
    return 1 << max(0, min(MAX_PARTS.bit_length() - 1, round(np.log2(max(1, n / PART_ROWS)))))


# --------------------------------------------------------------------------- the job
def prepared(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int, str]:
    """(_id, _vec, _key) of the vectors that take part, with their length and type; _key is a
    128-bit hash of the vector's bytes."""
    kind = "f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    at = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector}`").alias("_v")).filter(
        "_id is not null and size(_v) > 0")
    length = at.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = length["n"] if length else 1

    def check(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            column = batch.column("_v")
            flat = column.flatten().cast(pa.float64(), safe=False)
            a = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            good = np.isfinite(a).all(axis=1) & (a != 0).any(axis=1)
            raw = [x.tobytes() for x in a[good].astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").filter(pa.array(good)), pa.array(raw, pa.binary()),
                 pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary())],
                ["_id", "_vec", "_key"])

    out = at.filter(F.size("_v") == dims).mapInArrow(check, "_id long, _vec binary, _key binary")
    return out, dims, kind


def matrix(raw, dims: int, kind: str) -> np.ndarray:
    """The vectors as doubles, each scaled by a power of two (which leaves cosines as they
    are) so that no sum of squares overflows or vanishes."""
    a = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)
    return np.ldexp(a, -np.frexp(np.abs(a).max(axis=1))[1][:, None]) if len(a) else a


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids, in order.  The limit on the
    rank holds before the shuffle too, so a very common vector brings few rows."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_id"))).filter(
        F.col("_r") <= keep)
    return ranked.groupBy("_key").agg(F.first("_vec").alias("_vec"), F.sort_array(F.collect_list("_id")).alias("_ids"))


def routed(rows: DataFrame, w: np.ndarray, probes: int, dims: int, kind: str) -> DataFrame:
    """``rows`` with _part, once for each of the ``probes`` most probable parts."""

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = with_one(unit(matrix(batch.column("_vec").to_pylist(), dims, kind)))
                best = np.argsort(-(x @ w), axis=1, kind="stable")[:, :probes]
                again = batch.take(pa.array(np.repeat(np.arange(len(x)), best.shape[1])))
                yield again.append_column("_part", pa.array(best.ravel(), pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(route, f"{fields}, _part long")


def compare(queries, block, dims: int, kind: str, keep: int):
    """The ``keep`` best (query, id, score) of a block for each of the queries."""
    import pandas as pd

    a, b = matrix(queries["_vec"], dims, kind), matrix(block["_vec"], dims, kind)
    ua, ub = unit(a), unit(b)
    ids = block["_ids"].tolist()
    counts = np.array([len(x) for x in ids])
    flat, starts = np.concatenate(ids).astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    qkeys, bkeys = queries["_key"].tolist(), block["_key"].tolist()
    out: list = []
    for start in range(0, len(a), 512):
        s = ua[start:start + 512] @ ub.T
        limit = np.partition(s, -keep, axis=1)[:, -keep] if len(b) > keep else np.full(len(s), -np.inf)
        q, c = np.nonzero(s >= limit[:, None] - 1e-9)
        q = q + start
        score = (a[q] * b[c]).sum(axis=1) / (norm_a[q] * norm_b[c])
        row = np.repeat(np.arange(len(q)), counts[c])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts[c]) - counts[c], counts[c])
        found = flat[starts[c[row]] + nth]
        order = np.lexsort((found, -score[row], q[row]))
        at = q[row][order]
        order = order[np.arange(len(at)) - np.searchsorted(at, at) < keep]
        for r, i in zip(row[order].tolist(), found[order].tolist()):
            out.append((qkeys[q[r]], i, float(score[r]), qkeys[q[r]] == bkeys[c[r]]))
    return pd.DataFrame(out, columns=["_key", "_id", "_score", "_same"])


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector: str = "embedding",
           recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id meets ``is_query`` (a function of
    the id column), the ``k`` nearest rows found."""
    spark, keep = vectors.sparkSession, k + 1
    rows, dims, kind = prepared(vectors, id_col, vector)
    base = materialize(distinct(rows, keep))
    asked = materialize(rows.filter(is_query(F.col("_id"))))
    n = base.count()
    share = min(1.0, 1.2 * FIT_ROWS / max(n, 1))  # hashes are spread evenly
    order = F.xxhash64("_key")
    sample = base.select("_vec", order.alias("_h")).filter(
        F.col("_h") <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True))
    sample = matrix([bytes(x["_vec"]) for x in sample.orderBy("_h").limit(FIT_ROWS).collect()], dims, kind)
    w, probes = fit(sample, n_parts(n), k, recall)

    placed = routed(base, w, 1, dims, kind)
    sizes = {x["_part"]: x["count"] for x in placed.groupBy("_part").count().collect()}  # MAX_PARTS rows at most
    tiles = max(1, -(-asked.count() * probes // (w.shape[1] * TILE_ROWS)))
    blocks = spark.createDataFrame([(p, -(-c // BLOCK_ROWS)) for p, c in sizes.items()], "_at long, _blocks long")
    on = F.col("_part") == F.col("_at")
    deal = lambda salt, n: F.pmod(F.xxhash64("_key", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    tiles_c = F.lit(tiles).cast("long")
    index = placed.join(F.broadcast(blocks), on).select(
        "_key", "_vec", "_ids", "_part", deal(1, F.col("_blocks")).alias("_block"), every(tiles_c).alias("_tile"))
    queries = asked.groupBy("_key").agg(F.first("_vec").alias("_vec"))
    queries = routed(queries, w, probes, dims, kind).join(F.broadcast(blocks), on).select(
        "_key", "_vec", "_part", every(F.col("_blocks")).alias("_block"), deal(2, tiles_c).alias("_tile"))
    keys = ["_part", "_block", "_tile"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(
        lambda q, b: compare(q, b, dims, kind, keep), "_key binary, _id long, _score double, _same boolean")

    best = Window.partitionBy("_key").orderBy(F.desc("_score"), "_id")
    entry = F.struct(F.col("_rank").alias("rank"), F.col("_id").alias("id"), F.col("_score").alias("score"),
                     F.col("_same").alias("same"))
    lists = found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= keep).groupBy("_key").agg(
        F.sort_array(F.collect_list(entry)).alias("_list")).withColumnRenamed("_key", "_found")
    own = F.array_position(F.transform("_list", lambda e: e["same"] & (e["id"] == F.col("_id"))), True)
    others = F.slice(F.filter("_list", lambda e, i: i + 1 != F.col("_own")), 1, k)
    at = asked.select("_id", "_key").join(lists, F.col("_key") == F.col("_found")).withColumn("_own", own)
    return at.select(F.col("_id").alias("query_id"), F.posexplode(others).alias("_p", "_e")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_e.id").alias("vec_id"),
        F.col("_e.score").alias("score"))
