"""M3: seasonal-trend decomposition by local regression (Cleveland et al. 1990), in windows.

Each local fit is a window over the nearest rows: the values within reach are gathered from a
row frame and reduced to five weighted sums (tricube weights), from which the fitted value at
the row follows in closed form.  The cycle positions (months of the year) are smoothed over
the years, one period beyond both ends; three moving averages and a local fit take the level
out; what is left is the season, and a local fit of the rest the trend.  The inner loop runs
a fixed number of times; each outer loop derives weights against outliers from the exact
median of the absolute remainders of a key.

All windows are by key, or by key and cycle position, so a series is shuffled once.

Defined cases: series shorter than two periods have NULL parts; a NULL value has NULL
remainder and is left out of all fits; a fit whose weights are all zero gives the value
itself.  Output as in ``decompose``: keys, index, y, trend, seasonal, remainder, season_adjust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decompose import PERIOD, _with_key


def odd_from(x: float) -> int:
    """The least odd number >= x."""
    n = -int(-x // 1)
    return n + 1 - n % 2


def local_fit(value: str, at: str, n: Column, span: int, degree: int, w, weight: str | None = None) -> Column:
    """The local regression of ``value`` on ``at`` (1..n; rows beyond have no value), evaluated
    at the row itself.  ``w`` orders the rows; ``span`` rows are within reach."""
    t, half = F.col(at), (span - 1) // 2
    left = F.greatest(F.lit(1), F.least(t - half, n - span + 1))
    right = F.least(n, left + span - 1)
    reach = F.greatest(t - left, right - t) + F.greatest(F.lit(0), F.floor((span - n) / 2.0))
    held = F.struct(t.alias("j"), F.col(value).alias("y"), (F.col(weight) if weight else F.lit(1.0)).alias("r"))
    near = F.collect_list(held).over(w.rowsBetween(-span, span))
    near = F.filter(near, lambda p: p["j"].between(left, right) & p["y"].isNotNull())
    zero = F.lit(0.0)
    names = ("s0", "s1", "s2", "sy", "sxy")

    def add(s: Column, p: Column) -> Column:
        x = (p["j"] - t).cast("double")
        u = F.try_divide(F.abs(x), reach.cast("double"))
        tri = F.when(F.abs(x) <= 0.001 * reach, 1.0).when(u <= 0.999, F.pow(1 - u * u * u, F.lit(3.0))).otherwise(0.0)
        g = tri * p["r"]
        terms = (g, g * x, g * x * x, g * p["y"], g * x * p["y"])
        return F.struct(*[(s[c] + v).alias(c) for c, v in zip(names, terms)])

    def fitted(s: Column) -> Column:
        mean, centre = s["sy"] / s["s0"], s["s1"] / s["s0"]
        if not degree:
            return F.when(s["s0"] > 0, mean)
        spread = s["s2"] / s["s0"] - centre * centre
        slope = (s["sxy"] / s["s0"] - centre * mean) / spread
        flat = ~(spread > 0) | (F.sqrt(F.greatest(spread, zero)) <= 0.001 * (n - 1))
        return F.when(s["s0"] > 0, F.when(flat, mean).otherwise(mean - centre * slope))

    start = F.struct(*[zero.alias(c) for c in names])
    return F.coalesce(F.aggregate(near, start, add, fitted), F.col(value))


def stl(df: DataFrame, value: str, keys=(), index: str = "month", period: int = PERIOD, season_window: int = 11,
        trend_window: int | None = None, season_degree: int = 0, inner: int = 2, outer: int = 0) -> DataFrame:
    """M3.  ``outer`` counts the rounds of weights against outliers (0: none)."""
    df, keys, dummy = _with_key(df, keys)
    trend_window = trend_window or odd_from(1.5 * period / (1 - 1.5 / season_window))
    low_window = odd_from(period)
    w, wk = Window.partitionBy(*keys).orderBy("_t"), Window.partitionBy(*keys)
    wc = Window.partitionBy(*keys, "_pos").orderBy("_t")
    by_index = Window.partitionBy(*keys).orderBy(index)
    d = df.select(*keys, index, F.col(value).cast("double").alias("y"), F.row_number().over(by_index).alias("_t"),
                  F.count(F.lit(1)).over(wk).alias("_n"))
    # A period of rows without a value beyond both ends, for the cycle fits.
    long = F.col("_n") >= 2 * period
    span = F.when(long & (F.col("_t") == 1), F.sequence(F.lit(1 - period), F.lit(1))) \
        .when(long & (F.col("_t") == F.col("_n")), F.sequence(F.col("_n"), F.col("_n") + period)).otherwise(F.array("_t"))
    d = d.select(*keys, index, "y", "_n", F.col("_t").alias("_own"), F.explode(span).alias("_t"))
    real = F.col("_t") == F.col("_own")
    d = d.select(*keys, index, F.when(real, F.col("y")).alias("y"), "_n", "_t", real.alias("_real"),
                 F.lit(0.0).alias("trend"), F.lit(1.0).alias("_rho"))
    d = d.withColumn("_pos", F.pmod(F.col("_t") - 1, F.lit(period)))
    # The place within the cycle position: 1.. over the series' own rows, 0 and beyond outside.
    d = d.withColumn("_c", F.floor((F.col("_t") - 1) / period).cast("int") + 1)
    d = d.withColumn("_nc", F.sum(F.col("_real").cast("int")).over(Window.partitionBy(*keys, "_pos")).cast("int"))
    for turn in range(outer + 1):
        for _ in range(inner):
            d = d.withColumn("_d", F.col("y") - F.col("trend"))
            d = d.withColumn("_cycle", local_fit("_d", "_c", F.col("_nc"), season_window, season_degree, wc, "_rho"))
            for name, source, rows in (("_a1", "_cycle", period), ("_a2", "_a1", period), ("_a3", "_a2", 3)):
                d = d.withColumn(name, F.avg(source).over(w.rowsBetween(0, rows - 1)))
            d = d.withColumn("_low", F.when(F.col("_real"), F.lag("_a3", period).over(w)))
            d = d.withColumn("_low", local_fit("_low", "_t", F.col("_n"), low_window, 1, w))
            d = d.withColumn("seasonal", F.when(F.col("_real"), F.col("_cycle") - F.col("_low")))
            d = d.withColumn("_v", F.col("y") - F.col("seasonal"))
            d = d.withColumn("trend", F.when(F.col("_real"), local_fit("_v", "_t", F.col("_n"), trend_window, 1, w, "_rho")))
        if turn < outer:
            d = d.withColumn("_r", F.abs(F.col("y") - F.col("seasonal") - F.col("trend")))
            d = d.withColumn("_far", 6 * F.median("_r").over(wk))
            u = F.try_divide("_r", "_far")
            d = d.withColumn("_rho", F.when(F.col("_r").isNull() | (F.col("_r") <= 0.001 * F.col("_far")), 1.0).when(
                u <= 0.999, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0))
    part = lambda c: F.when(F.col("_n") >= 2 * period, c)
    d = d.filter("_real").select(*keys, index, "y", part(F.col("trend")).alias("trend"), part(F.col("seasonal")).alias("seasonal"))
    out = d.select("*", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder"),
                   (F.col("y") - F.col("seasonal")).alias("season_adjust"))
    return out.drop("_k") if dummy else out
