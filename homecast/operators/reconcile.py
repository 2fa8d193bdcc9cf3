"""Reconciliation of forecasts across a hierarchy (M15, with A23).

Nodes are the leaves (e.g. counties), every aggregate of them (regions) and the total; the
quantities are additive (sums or counts), never means.  Base forecasts come from any per-node
model.  A node is named by the array of its level values, so no name can be mistaken for a
path; the root is the empty array.

* Bottom-up: leaf forecasts joined to the mapping and summed per node.
* Least squares (optionally weighted per node): the coherent forecasts nearest to the base
  forecasts.  On a tree that is two passes: going up, a subtree is summed up by its best total
  and how stiffly it holds to it; going down, what a parent's total differs from its
  children's is dealt to them by that stiffness.  Joins and sums by parent and month; no matrix.
* Shrunken covariance (MinT): the same problem under the covariance W of the one-step errors,
  W = s diag(C) + (1 - s) C with C the second moments of the errors over the months that every
  node has, and s the intensity of Schaefer and Strimmer (2005) on the errors scaled to unit
  moment.  The intensity needs no pair of nodes: sums over pairs of nodes of squared products
  are sums over pairs of months of products summed over nodes.  With U the differences parent
  - children (one column per inner node) the result is y - W U (U' W U)^-1 U' y; W U comes from
  products of errors with the errors' differences, a row per node and inner node, and only the
  square matrix of the inner nodes is inverted (in one row).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hierarchy_series(df: DataFrame, levels, value: str, index: str = "month") -> DataFrame:
    """(node, index, value) for every node in one ROLLUP."""
    levels = [levels] if isinstance(levels, str) else list(levels)
    g = df.rollup(index, *levels).agg(F.sum(value).alias(value), F.grouping(index).alias("_gi"),
                                      *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(levels)])
    node = F.array().cast("array<string>")
    for i in range(len(levels)):
        path = F.array(*[F.col(c).cast("string") for c in levels[:i + 1]])
        node = F.when(F.col(f"_g{i}") == 0, path).otherwise(node)
    return g.filter("_gi = 0").select(node.alias("node"), index, value)


def hierarchy_mapping(df: DataFrame, levels) -> DataFrame:
    """(node, leaf) for each leaf and each of its ancestors, the leaf included."""
    levels = [levels] if isinstance(levels, str) else list(levels)
    leaf = F.array(*[F.col(c).cast("string") for c in levels])
    return df.select(leaf.alias("leaf")).distinct().select(
        "leaf", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(levels))),
                                      lambda k: F.slice("leaf", F.lit(1), k))).alias("node"))


def bottom_up(forecasts: DataFrame, mapping: DataFrame, index: str = "month") -> DataFrame:
    """Every node = sum of its leaves' base forecasts (join + aggregate)."""
    leaf_fc = forecasts.select(F.col("node").alias("leaf"), index, "mean")
    return leaf_fc.join(mapping, "leaf").groupBy("node", index).agg(F.sum("mean").alias("mean"))


def _parent(node: Column) -> Column:
    """The root's parent is the root; callers leave it out."""
    return F.slice(node, F.lit(1), F.greatest(F.size(node) - 1, F.lit(0)))


# ------------------------------------------------------------------------ least squares
def least_squares(forecasts: DataFrame, depth: int, index: str = "month", weight: str | None = None) -> DataFrame:
    """(node, index, mean): the coherent forecasts with the least (weighted) sum of squared
    changes.  ``forecasts`` has node, index, mean, and perhaps a positive weight; leaves have
    ``depth`` levels.

    Defined cases: an inner node without a base forecast takes the sum of its children; a node
    whose children have no forecast counts as a leaf; nodes without any are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = forecasts.filter("mean is not null").select("node", index, F.col("mean").alias("_y"), w.alias("_w"))
    up: dict[int, DataFrame] = {}
    for level in range(depth, -1, -1):
        own = base.filter(F.size("node") == level)
        if level == depth:
            none = F.lit(None).cast("double")
            up[level] = own.select("node", index, F.col("_w").alias("_a"), F.col("_y").alias("_m"),
                                   none.alias("_sum"), none.alias("_soft"))
            continue
        # What the children together want (_sum), and how far they give way (_soft).
        kids = up[level + 1].groupBy(_parent(F.col("node")).alias("node"), index).agg(
            F.sum("_m").alias("_sum"), F.sum(1 / F.col("_a")).alias("_soft"))
        both = own.join(kids, ["node", index], "full_outer")
        held, stiff = F.coalesce("_w", F.lit(0.0)), F.coalesce(1 / F.col("_soft"), F.lit(0.0))
        pull = held * F.coalesce("_y", F.lit(0.0)) + stiff * F.coalesce("_sum", F.lit(0.0))
        up[level] = both.select("node", index, (held + stiff).alias("_a"), (pull / (held + stiff)).alias("_m"), "_sum", "_soft")
    down = up[0].select("node", index, F.col("_m").alias("mean"), "_sum", "_soft")
    out = down.select("node", index, "mean")
    for level in range(1, depth + 1):
        above = down.select(F.col("node").alias("_p"), F.col(index).alias("_i"),
                            ((F.col("mean") - F.col("_sum")) / F.col("_soft")).alias("_share"))
        at = up[level].withColumn("_up", _parent(F.col("node")))
        down = at.join(above, (F.col("_up") == F.col("_p")) & (F.col(index) == F.col("_i"))).select(
            "node", index, (F.col("_m") + F.col("_share") / F.col("_a")).alias("mean"), "_sum", "_soft")
        out = out.unionByName(down.select("node", index, "mean"))
    return out


# ------------------------------------------------------------------ shrunken covariance
def common_errors(residuals: DataFrame, index: str = "month", value: str = "resid") -> DataFrame:
    """(node, index, e, x): the errors of the months in which every node has one, as they are
    and scaled to a second moment of one (zero for a node without errors)."""
    r = residuals.filter(F.col(value).isNotNull()).select("node", index, F.col(value).alias("e"))
    nodes = r.select(F.count_distinct("node").alias("n"))
    full = r.groupBy(index).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == nodes.scalar()).select(index)
    r = r.join(full, index, "left_semi")
    moment = F.avg(F.col("e") * F.col("e")).over(Window.partitionBy("node"))
    return r.select("node", index, "e", F.coalesce(F.try_divide("e", F.sqrt(moment)), F.lit(0.0)).alias("x"))


def shrinkage(errors: DataFrame, index: str = "month") -> DataFrame:
    """One row: nodes, months and intensity of ``common_errors``.  Months are paired within a
    node (the calendar bounds them), nodes are not."""
    x = errors.select("node", F.col(index).alias("t"), "x")
    y = x.select("node", F.col("t").alias("s"), F.col("x").alias("z"))
    months = x.join(y, "node").filter("t <= s").groupBy("t", "s").agg(F.sum(F.col("x") * F.col("z")).alias("g"))
    square = F.col("g") * F.col("g")
    pairs = months.agg(F.sum(F.when(F.col("t") == F.col("s"), square).otherwise(2 * square)).alias("_f"),
                       F.sum(F.when(F.col("t") == F.col("s"), square)).alias("_d"))
    x2 = F.col("x") * F.col("x")
    own = x.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(x2 * x2).alias("q"), F.sum(x2).alias("s")).agg(
        F.count(F.lit(1)).alias("nodes"), F.max("n").alias("months"), F.sum("q").alias("_q"),
        F.sum(F.col("s") * F.col("s")).alias("_s"))
    one = own.withColumn("_p", pairs.select(F.struct("_f", "_d")).scalar()).select("nodes", "months", "_q", "_s", "_p.*")
    t = F.col("months")
    across = F.col("_f") - F.col("_s")  # sum over pairs of different nodes of (sum over months of x x)^2
    noise = (F.col("_d") - F.col("_q") - across / t) / (t * (t - 1))
    ratio = F.try_divide(noise, across / (t * t))
    return one.select("nodes", "months", F.least(F.greatest(F.coalesce(ratio, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("intensity"))


def _gaps(df: DataFrame, value: str, index: str) -> DataFrame:
    """(at, index, u): for each inner node, its ``value`` less that of its children."""
    inner = df.filter(F.size("node") > 0).select(_parent(F.col("node")).alias("at"), index, (-F.col(value)).alias("u"))
    inner_names = inner.select(F.col("at").alias("node")).distinct()
    own = df.join(inner_names, "node", "left_semi").select(F.col("node").alias("at"), index, F.col(value).alias("u"))
    return own.unionByName(inner).groupBy("at", index).agg(F.sum("u").alias("u"))


def gains(errors: DataFrame, index: str = "month") -> DataFrame:
    """(node, at, gain): how much a node's forecast changes per unit by which the base forecast
    of the inner node ``at`` exceeds that of its children: -W U (U' W U)^-1."""
    intensity = shrinkage(errors, index).select("intensity").scalar()
    months = F.col("_n")
    u = _gaps(errors, "e", index)
    cross = errors.join(u, index).groupBy("node", "at").agg(
        F.sum(F.col("e") * F.col("u")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    own = errors.groupBy("node").agg(F.avg(F.col("e") * F.col("e")).alias("_var"))
    side = F.when(F.col("node") == F.col("at"), 1.0).when(_parent(F.col("node")) == F.col("at"), -1.0).otherwise(0.0)
    wu = cross.join(own, "node").select("node", "at", (
        (1 - intensity) * F.col("_c") / months + intensity * side * F.col("_var")).alias("wu"))
    # U' W U: the same differences of the rows of W U.
    square = _gaps(wu.select("node", F.col("at").alias("_to"), "wu"), "wu", "_to").select(
        F.col("at").alias("_from"), "_to", "u")

    def invert(batches):
        for pdf in batches:
            for cells in pdf["cells"]:
                names = sorted({tuple(c["_from"]) for c in cells})
                place = {n: i for i, n in enumerate(names)}
                m = np.zeros((len(names), len(names)))
                for c in cells:
                    m[place[tuple(c["_from"])], place[tuple(c["_to"])]] = c["u"]
                inverse = np.linalg.pinv((m + m.T) / 2, hermitian=True)
                yield pd.DataFrame([(list(a), list(b), float(inverse[i, j])) for i, a in enumerate(names)
                                    for j, b in enumerate(names)], columns=["_from", "_at", "_v"])

    cells = square.agg(F.collect_list(F.struct("_from", "_to", "u")).alias("cells"))  # inner nodes, squared
    inverse = cells.filter(F.size("cells") > 0).mapInPandas(invert, "_from array<string>, _at array<string>, _v double")
    return wu.join(inverse, F.col("at") == F.col("_from")).groupBy("node", F.col("_at").alias("at")).agg(
        (-F.sum(F.col("wu") * F.col("_v"))).alias("gain"))


def min_trace(forecasts: DataFrame, residuals: DataFrame, index: str = "month") -> DataFrame:
    """(node, index, mean): ``forecasts`` reconciled under the shrunken covariance of the
    one-step ``residuals`` (node, index, resid).  Every node needs both; indexes at which a node
    has no forecast are left out."""
    nodes = forecasts.select(F.count_distinct("node").alias("n")).scalar()
    full = forecasts.groupBy(index).agg(F.count("mean").alias("_c")).filter(F.col("_c") == nodes).select(index)
    base = forecasts.select("node", index, "mean").join(full, index, "left_semi")
    moved = gains(common_errors(residuals, index), index).join(_gaps(base, "mean", index), "at").groupBy("node", index).agg(
        F.sum(F.col("gain") * F.col("u")).alias("_by"))
    return base.join(moved, ["node", index], "left").select(
        "node", index, (F.col("mean") + F.coalesce("_by", F.lit(0.0))).alias("mean"))
