"""Decompositions M1, M2 and M4 of keyed, gap-free series (M3: ``loess``).

Classical (M1, M2) and the X-11 filter cascade (M4) are pure window
expressions partitioned by the series keys.
Output columns: keys, index, y, trend, seasonal, remainder, season_adjust.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 12


def _w(keys, index="month"):
    return Window.partitionBy(*keys).orderBy(index)


def _with_key(df: DataFrame, keys) -> tuple[DataFrame, list[str], bool]:
    """A single series gets a constant key so the windows by index and by
    (key, cycle position) share one hash partitioning (no re-shuffles)."""
    keys = list(keys)
    if keys:
        return df, keys, False
    return df.withColumn("_k", F.lit(0)), ["_k"], True


def centred_ma(y: str, keys, index: str = "month", period: int = PERIOD) -> Column:
    """Centred moving average of order ``period`` (2x12 for even periods);
    NULL unless the full window exists."""
    w = _w(keys, index)
    h = period // 2
    if period % 2 == 0:
        full = w.rowsBetween(-h, h)
        inner = w.rowsBetween(-h + 1, h - 1)
        val = (F.sum(y).over(full) + F.sum(y).over(inner)) / (2 * period)
        return F.when(F.count(y).over(full) == period + 1, val)
    full = w.rowsBetween(-h, h)
    return F.when(F.count(y).over(full) == period, F.sum(y).over(full) / period)


def classical(df: DataFrame, value: str, keys=(), index: str = "month",
              kind: str = "additive", period: int = PERIOD) -> DataFrame:
    """M1 / M2 classical decomposition (moving-average trend, seasonal figure
    per cycle position counted from each series' first observation, centred
    to sum 0 or average 1).  Series shorter than two periods get NULLs.

    All windows partition by the series keys (the per-position windows by
    keys and position, which the keys' hash partitioning already satisfies),
    so the series is read once and shuffled once."""
    df, keys, dummy = _with_key(df, keys)
    mult = kind == "multiplicative"
    w = _w(keys, index)
    wk = Window.partitionBy(*keys)
    wkp = Window.partitionBy(*keys, "_pos")
    d = df.select(*keys, index, F.col(value).cast("double").alias("y"))
    d = d.select(*keys, index, "y", ((F.row_number().over(w) - 1) % period).alias("_pos"),
                 F.count(F.lit(1)).over(wk).alias("_n"),
                 centred_ma("y", keys, index, period).alias("trend"))
    d = d.withColumn("_det", F.try_divide("y", "trend") if mult else F.col("y") - F.col("trend"))
    # Mean detrended value per position; the mean over positions weighs each
    # position once: sum over rows of fig / rows-at-position, divided by the
    # number of positions.
    d = d.select("*", F.avg("_det").over(wkp).alias("_fig"),
                 F.count(F.lit(1)).over(wkp).alias("_np"))
    npos = F.least(F.col("_n"), F.lit(period))
    fig_mean = F.sum(F.col("_fig") / F.col("_np")).over(wk) / npos
    seasonal0 = F.try_divide(F.col("_fig"), fig_mean) if mult else F.col("_fig") - fig_mean
    short = F.col("_n") < 2 * period
    d = d.select(*keys, index, "y", F.when(~short, F.col("trend")).alias("trend"),
                 F.when(~short, seasonal0).alias("seasonal"))
    if mult:
        rem = F.try_divide(F.col("y"), F.col("trend") * F.col("seasonal"))
        adj = F.try_divide(F.col("y"), F.col("seasonal"))
    else:
        rem = F.col("y") - F.col("trend") - F.col("seasonal")
        adj = F.col("y") - F.col("seasonal")
    out = d.select(*keys, index, "y", "trend", "seasonal", rem.alias("remainder"),
                   adj.alias("season_adjust"))
    return out.drop("_k") if dummy else out


# --------------------------------------------------------------------- X-11 (M4)
def henderson_weights(terms: int) -> list[float]:
    """Symmetric Henderson trend weights from the closed form (Henderson 1916)."""
    m = (terms - 1) // 2
    n = m + 2
    out = []
    for j in range(-m, m + 1):
        num = 315 * ((n - 1) ** 2 - j * j) * (n * n - j * j) * ((n + 1) ** 2 - j * j) \
            * (3 * n * n - 16 - 11 * j * j)
        den = 8 * n * (n * n - 1) * (4 * n * n - 1) * (4 * n * n - 9) * (4 * n * n - 25)
        out.append(num / den)
    return out


#: Noise-to-signal ratio that the 13-term end filters assume.
HENDERSON_RATIO = 3.5
#: End weights of the 3x3 and 3x5 seasonal averages, by how many of the later
#: values are missing (most first); oldest value first.
ENDS_3X3 = {2: [5 / 27, 11 / 27, 11 / 27], 1: [3 / 27, 7 / 27, 10 / 27, 7 / 27]}
ENDS_3X5 = {3: [9 / 60, 17 / 60, 17 / 60, 17 / 60], 2: [4 / 60, 11 / 60, 15 / 60, 15 / 60, 15 / 60],
            1: [4 / 60, 8 / 60, 13 / 60, 13 / 60, 13 / 60, 9 / 60]}


def end_weights(weights: list[float], missing: int, ratio: float = HENDERSON_RATIO) -> list[float]:
    """The filter for a row with ``missing`` of the later values absent: the one whose
    result is revised least once they arrive, for a straight line plus noise (Musgrave 1964)."""
    m, n = len(weights) - missing, len(weights)
    d = 4 / (math.pi * ratio * ratio)
    lost = sum(weights[m:])
    moment = sum((i - (m + 1) / 2) * weights[i - 1] for i in range(m + 1, n + 1))
    scale = d / (1 + m * (m - 1) * (m + 1) / 12 * d)
    return [weights[j - 1] + lost / m + (j - (m + 1) / 2) * scale * moment for j in range(1, m + 1)]


def filter_table(weights: list[float], ends: dict[int, list[float]]) -> list[list[float]]:
    """The weights for a row by how many values stand before and after it (up to half the
    length each): place before * (half + 1) + after."""
    h, out = len(weights) // 2, []
    for before in range(h + 1):
        for after in range(h + 1):
            if before == h:
                out.append(ends[h - after] if after < h else weights)
            elif after == h:
                out.append(ends[h - before][::-1])
            else:
                short = weights[h - before:h + after + 1]
                out.append([x / sum(short) for x in short])
    return out


def _filtered(y: str, weights: list[float], ends: dict[int, list[float]], w: Window, part: Window) -> Column:
    """Centred weighted sum over the ordered rows (none of them NULL).  Rows near an end use
    the filter in ``ends`` for the number of values that are missing there, mirrored at the
    start; rows short of values on both sides use what there is of the centred weights."""
    h = len(weights) // 2
    place = F.row_number().over(w)
    before, after = F.least(place - 1, F.lit(h)), F.least(F.count(F.lit(1)).over(part) - place, F.lit(h))
    table = F.from_json(F.lit(json.dumps(filter_table(weights, ends))), "array<array<double>>")
    at = F.get(table, (before * (h + 1) + after).cast("int"))
    terms = F.zip_with(F.collect_list(y).over(w.rowsBetween(-h, h)), at, lambda v, x: v * x)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _nearest(c: str, w: Window) -> Column:
    """The value, or the nearest one in order (earlier ones first) where it is NULL."""
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))


def _season(d: DataFrame, si: str, out: str, keys, index: str, weights, ends, period: int) -> DataFrame:
    """Add the seasonal figure: ``si`` averaged across the years, centred by its moving average."""
    cycle = Window.partitionBy(*keys, "_pos").orderBy(index)
    known = Window.partitionBy(*keys, "_pos", F.isnull(si))
    d = d.withColumn("_s", F.when(F.col(si).isNotNull(), _filtered(si, weights, ends, known.orderBy(index), known)))
    d = d.withColumn("_s", _nearest("_s", cycle))
    d = d.withColumn("_c", centred_ma("_s", keys, index, period))
    return d.withColumn(out, F.col("_s") - _nearest("_c", _w(keys, index)))


def _cascade(d: DataFrame, y: str, keys, index: str, period: int) -> DataFrame:
    """Add _seasonal and _trend of ``y``: 2x12 trend, 3x3 season, Henderson trend, 3x5 season,
    Henderson trend."""
    w, wk = _w(keys, index), Window.partitionBy(*keys)
    h13 = henderson_weights(13)
    ends13 = {gone: end_weights(h13, gone) for gone in range(1, 7)}
    d = d.withColumn("_t1", centred_ma(y, keys, index, period)).withColumn("_si", F.col(y) - F.col("_t1"))
    d = _season(d, "_si", "_s1", keys, index, [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9], ENDS_3X3, period)
    d = d.withColumn("_a1", F.col(y) - F.col("_s1"))
    d = d.withColumn("_t2", _filtered("_a1", h13, ends13, w, wk)).withColumn("_si", F.col(y) - F.col("_t2"))
    d = _season(d, "_si", "_seasonal", keys, index, [1 / 15, 2 / 15, 3 / 15, 3 / 15, 3 / 15, 2 / 15, 1 / 15],
                ENDS_3X5, period)
    d = d.withColumn("_a2", F.col(y) - F.col("_seasonal"))
    return d.withColumn("_trend", _filtered("_a2", h13, ends13, w, wk))


def _median_of(values: Column) -> Column:
    v, n = F.sort_array(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def _extreme_weight(irregular: str, lower: float, upper: float) -> Column:
    """1 up to ``lower`` moving sigmas, 0 from ``upper`` on, linear between."""
    u = F.try_divide(F.abs(irregular), F.col("_sigma"))
    return F.when((F.col("_sigma") <= 0) | (u <= lower), 1.0).when(u >= upper, 0.0).otherwise((upper - u) / (upper - lower))


def x11(df: DataFrame, value: str, keys=(), index: str = "month", period: int = PERIOD,
        lower: float = 1.5, upper: float = 2.5, years: int = 5, passes: int = 2) -> DataFrame:
    """M4: the additive X-11 cascade with its end filters and its treatment of extreme values;
    no ARIMA extension.  Irregulars beyond ``lower`` sigmas (over ``years`` centred years,
    recomputed without the ones beyond ``upper``) are drawn towards zero in the series that the
    next pass reads.  The first irregulars come from running medians, as an outlier in averages
    would put the values around it out too.  The last pass's seasonal figure and trend are the
    result, the remainder is what the values themselves leave.  Series shorter than three
    periods, and those with a NULL value, get NULLs."""
    df, keys, dummy = _with_key(df, keys)
    w, wk = _w(keys, index), Window.partitionBy(*keys)
    d = df.select(*keys, index, F.col(value).cast("double").alias("y"))
    d = d.withColumn("_pos", (F.row_number().over(w) - 1) % period)
    d = d.withColumn("_long", (F.count("y").over(wk) >= 3 * period) & (F.count("y").over(wk) == F.count(F.lit(1)).over(wk)))
    frame = w.rowsBetween(-years * period // 2, years * period // 2)
    keep = [*keys, index, "y", "_pos", "_long", "_i"]
    d = d.withColumn("_si", F.col("y") - centred_ma("y", keys, index, period))
    known = Window.partitionBy(*keys, "_pos", F.isnull("_si")).orderBy(index)
    d = d.withColumn("_s", F.when(F.col("_si").isNotNull(), _median_of(F.collect_list("_si").over(known.rowsBetween(-2, 2)))))
    d = d.withColumn("_a", F.col("y") - _nearest("_s", Window.partitionBy(*keys, "_pos").orderBy(index)))
    half = period // 2
    d = d.withColumn("_i", F.col("_a") - _median_of(F.collect_list("_a").over(w.rowsBetween(-half, half)))).select(*keep)
    for n in range(passes):
        square = F.col("_i") * F.col("_i")
        d = d.withColumn("_sigma", F.sqrt(F.avg(square).over(frame)))
        d = d.withColumn("_kept", F.when(F.abs("_i") < upper * F.col("_sigma"), square))
        d = d.withColumn("_sigma", F.coalesce(F.sqrt(F.avg("_kept").over(frame)), F.lit(0.0)))
        d = d.withColumn("_w", _extreme_weight("_i", lower, upper))
        d = d.withColumn("_read", F.col("y") - (1 - F.col("_w")) * F.col("_i"))
        d = _cascade(d, "_read", keys, index, period)
        if n < passes - 1:
            d = d.withColumn("_i", F.col("y") - F.col("_seasonal") - F.col("_trend")).select(*keep)
    part = lambda c: F.when(F.col("_long"), c)
    d = d.select(*keys, index, "y", part(F.col("_trend")).alias("trend"), part(F.col("_seasonal")).alias("seasonal"))
    out = d.select("*", (F.col("y") - F.col("seasonal") - F.col("trend")).alias("remainder"),
                   (F.col("y") - F.col("seasonal")).alias("season_adjust"))
    return out.drop("_k") if dummy else out
