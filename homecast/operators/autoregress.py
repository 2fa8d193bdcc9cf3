"""Autoregressions of keyed, gap-free series by lag regression, and their forecasts.

One aggregate per key brings the sums of lagged products of the series and of its first and
second differences; everything after it is arithmetic on one row per key:

* differencing: the least d of 0, 1, 2 whose KPSS statistic does not reject a level at 5 %
  (Kwiatkowski et al. 1992; Bartlett weights over 4 (n / 100)^(1/4) lags);
* order and coefficients: the Levinson-Durbin recursion solves the Yule-Walker equations of
  every order up to ``max_order`` as a fold over the lags; the order of least AICc is kept.
  Yule-Walker autoregressions are always stationary;
* forecasts: a fold over the steps carries the last values and the psi weights, whose running
  sum of squares gives the variance.

This is the autoregressive part of an ARIMA model: moving-average and seasonal terms are not
fitted.  The differenced series keeps its mean (a drift for d = 1), except for d = 2.

Defined cases: keys with fewer than 3 observations, and constant series, have order 0; a
series must be without gaps (``fill_gaps``); NULL values are left out of the sums, so a
forecast from them is NULL.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .forecast import _h, with_bands

MAX_ORDER = 5
#: 5 % point of the KPSS statistic for a level.
KPSS_LEVEL = 0.463
KPSS_LAGS = 12


def _dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, over the shorter."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def lagged_products(series: DataFrame, value: str, keys=(), index: str = "month",
                    max_order: int = MAX_ORDER) -> DataFrame:
    """One row per key: n, last_index, ``tail`` (the latest values first), and for each d of
    0, 1, 2 a struct ``w<d>`` of n, mean, kpss and g (the lagged products over n, lags from 0)."""
    keys = list(keys)
    lags = max(max_order, KPSS_LAGS)
    w = Window.partitionBy(*keys).orderBy(index)
    wk = Window.partitionBy(*keys)
    s = series.select(*keys, index, F.col(value).cast("double").alias("_y0"))
    s = s.withColumn("_y1", F.col("_y0") - F.lag("_y0").over(w))
    s = s.withColumn("_y2", F.col("_y1") - F.lag("_y1").over(w))
    back = Window.partitionBy(*keys).orderBy(F.desc(index))
    s = s.select("*", F.row_number().over(back).alias("_back"), F.avg("_y0").over(wk).alias("_m0"),
                 F.avg("_y1").over(wk).alias("_m1"), F.lit(0.0).alias("_m2"))
    s = s.select("*", *[(F.col(f"_y{d}") - F.col(f"_m{d}")).alias(f"_e{d}") for d in range(3)])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", *[F.sum(f"_e{d}").over(running).alias(f"_s{d}") for d in range(3)],
                 *[(F.col(f"_e{d}") * F.lag(f"_e{d}", k).over(w)).alias(f"_p{d}_{k}")
                   for d in range(3) for k in range(1, lags + 1)])
    sums = [F.count("_y0").alias("n"), F.max(index).alias("last_index"),
            F.sort_array(F.collect_list(F.when(F.col("_back") <= max_order + 2, F.struct("_back", "_y0")))).alias("_tail")]
    for d in range(3):
        e, n = F.col(f"_e{d}"), F.count(f"_e{d}")
        g = [F.coalesce(F.sum(x), F.lit(0.0)) for x in (e * e, *[F.col(f"_p{d}_{k}") for k in range(1, lags + 1)])]
        sums += [n.alias(f"_n{d}"), F.max(f"_m{d}").alias(f"_mean{d}"),
                 F.sum(F.col(f"_s{d}") * F.col(f"_s{d}")).alias(f"_ss{d}"), F.array(*[F.try_divide(x, n) for x in g]).alias(f"_g{d}")]
    out = s.groupBy(*keys).agg(*sums)

    def kpss(d: int) -> Column:
        n = F.col(f"_n{d}")
        top = F.floor(4 * F.pow(n / 100.0, F.lit(0.25)))
        weights = F.transform(F.sequence(F.lit(1), F.lit(KPSS_LAGS)),
                              lambda k: F.greatest(F.lit(0.0), 1 - k / (top + 1.0)))
        g = F.col(f"_g{d}")
        spread = F.get(g, 0) + 2 * _dot(weights, F.slice(g, 2, KPSS_LAGS))
        return F.try_divide(F.col(f"_ss{d}"), n * n * spread)

    return out.select(*keys, "n", "last_index", F.transform("_tail", lambda x: x["_y0"]).alias("tail"), *[
        F.struct(F.col(f"_n{d}").alias("n"), F.col(f"_mean{d}").alias("mean"), kpss(d).alias("kpss"),
                 F.slice(f"_g{d}", 1, max_order + 1).alias("g")).alias(f"w{d}") for d in range(3)])


def levinson(g: Column, max_order: int = MAX_ORDER) -> Column:
    """Array of (order, phi, v) for the orders 0..max_order, from the products ``g`` of the
    lags 0..max_order; ``v`` is the variance that is left."""
    empty = F.array().cast("array<double>")
    fit = lambda order, phi, v: F.struct(
        order.cast("int").alias("order"), phi.alias("phi"), v.alias("v"))
    g0 = F.get(g, 0)
    start = F.struct(empty.alias("phi"), g0.alias("v"), F.array(fit(F.lit(0), empty, g0)).alias("fits"))

    def step(a: Column, m: Column) -> Column:
        left = F.get(g, m) - _dot(a["phi"], F.reverse(F.slice(g, F.lit(2), m - 1)))
        k = F.coalesce(F.try_divide(left, a["v"]), F.lit(0.0))
        phi = F.concat(F.zip_with(a["phi"], F.reverse(a["phi"]), lambda x, y: x - k * y), F.array(k))
        v = a["v"] * (1 - k * k)
        return F.struct(phi.alias("phi"), v.alias("v"), F.concat(a["fits"], F.array(fit(m, phi, v))).alias("fits"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max_order)), start, step, lambda a: a["fits"])


def ar_fit(series: DataFrame, value: str, keys=(), index: str = "month", max_order: int = MAX_ORDER) -> DataFrame:
    """One row per key: n, d, order, phi, mean (of the differenced series), sigma2, aicc,
    kpss (of the undifferenced series), last_index and tail."""
    keys = list(keys)
    g = lagged_products(series, value, keys, index, max_order)
    rejects = lambda d: F.col(f"w{d}.kpss") >= KPSS_LEVEL
    d = F.when(F.coalesce(rejects(0), F.lit(False)), F.when(F.coalesce(rejects(1), F.lit(False)), 2).otherwise(1)).otherwise(0)
    g = g.withColumn("d", d)
    g = g.withColumn("_w", F.when(F.col("d") == 0, F.col("w0")).when(F.col("d") == 1, F.col("w1")).otherwise(F.col("w2")))
    g = g.select(*keys, "n", "last_index", "tail", "d", F.col("w0.kpss").alias("kpss"),
                 F.col("_w.n").alias("_n"), F.col("_w.mean").alias("mean"),
                 F.explode(levinson(F.col("_w.g"), max_order)).alias("_f"))
    n, order, v = F.col("_n"), F.col("_f.order"), F.col("_f.v")
    k = order + 2
    aicc = F.when((v > 0) & (n - k - 1 > 0), n * F.log(v) + 2 * k + F.try_divide(2.0 * k * (k + 1), n - k - 1))
    rank = F.struct(F.coalesce(aicc, F.when(order == 0, F.lit(float("inf")))).alias("a"), order.alias("o"))
    found = g.filter((order == 0) | aicc.isNotNull()).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("d").cast("int").alias("d"), F.first("kpss").alias("kpss"),
        F.first("last_index").alias("last_index"), F.first("tail").alias("tail"), F.first("mean").alias("mean"),
        F.first("_n").alias("_n"), F.min_by(F.struct("_f.order", "_f.phi", "_f.v", aicc.alias("aicc")), rank).alias("_b"))
    left = F.col("_n") - F.col("_b.order") - 1
    return found.select(*keys, "n", "d", F.col("_b.order").alias("order"), F.col("_b.phi").alias("phi"), "mean",
                        F.try_divide(F.col("_b.v") * F.col("_n"), F.when(left > 0, left)).alias("sigma2"),
                        F.col("_b.aicc").alias("aicc"), "kpss", "last_index", "tail")


def _differenced(poly: Column) -> Column:
    """The polynomial times (1 - B)."""
    zero = F.array(F.lit(0.0))
    return F.zip_with(F.concat(poly, zero), F.concat(zero, poly), lambda a, b: a - b)


def level_weights(fit: DataFrame) -> DataFrame:
    """Add ``_a`` (y_t = _c + sum of a_j y_(t-j)) and ``_c`` to an ``ar_fit``."""
    poly = F.concat(F.array(F.lit(1.0)), F.transform("phi", lambda x: -x))
    once = _differenced(poly)
    poly = F.when(F.col("d") == 0, poly).when(F.col("d") == 1, once).otherwise(_differenced(once))
    total = F.aggregate("phi", F.lit(0.0), lambda s, x: s + x)
    return fit.withColumn("_a", F.transform(F.slice(poly, F.lit(2), F.col("order") + F.col("d")), lambda x: -x)) \
        .withColumn("_c", F.col("mean") * (1 - total))


def ar_forecast(fit: DataFrame, h, keys=(), index: str = "month") -> DataFrame:
    """M13 for ``ar_fit``: ``h`` steps (an int, a column name or a Column) with bands.  The
    fold's state is the latest values, the latest psi weights and their sum of squares."""
    keys = list(keys)
    f = level_weights(fit)
    a, size = F.col("_a"), F.col("order") + F.col("d")
    zero = F.lit(0.0)
    first = F.struct(F.slice("tail", F.lit(1), size).alias("y"), F.transform(a, lambda x: zero).alias("psi"), zero.alias("var"),
                     F.array().cast("array<struct<step:int,mean:double,var:double>>").alias("out"))

    def advance(s: Column, step: Column) -> Column:
        # A NULL among the latest values makes the forecast NULL, not zero.
        known = F.forall(s["y"], lambda y: y.isNotNull())
        mean = F.when(known, F.col("_c") + _dot(a, s["y"]))
        psi = F.when(step == 1, F.lit(1.0)).otherwise(_dot(a, s["psi"]))
        var = s["var"] + psi * psi
        latest = lambda x, xs: F.slice(F.concat(F.array(x), xs), F.lit(1), size)
        row = F.struct(step.cast("int").alias("step"), mean.alias("mean"), var.alias("var"))
        return F.struct(latest(mean, s["y"]).alias("y"), latest(psi, s["psi"]).alias("psi"), var.alias("var"),
                        F.concat(s["out"], F.array(row)).alias("out"))

    steps = F.aggregate(F.sequence(F.lit(1), _h(h)), first, advance, lambda s: s["out"])
    f = f.select(*keys, "last_index", "sigma2", F.explode(steps).alias("_s"))
    return with_bands(f.select(*keys, F.add_months("last_index", F.col("_s.step")).alias(index),
                               F.col("_s.mean").alias("mean"), F.sqrt(F.col("sigma2") * F.col("_s.var")).alias("sigma")))


def ar_augment(series: DataFrame, fit: DataFrame, value: str, keys=(), index: str = "month") -> DataFrame:
    """M16 for ``ar_fit``: one-step fitted values and residuals; NULL for the first order + d rows."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(index)
    lags = MAX_ORDER + 2
    s = series.select(*keys, index, F.col(value).cast("double").alias("y")).withColumn(
        "_lags", F.array(*[F.lag("y", k).over(w) for k in range(1, lags + 1)]))
    f = level_weights(fit).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct("_a", "_c").alias("_f"))
    if keys:
        j = s.join(f, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
    else:  # a keyless fit is one row
        j = s.withColumn("_f", f.scalar())
    j = j.select("*", "_f._a", "_f._c")
    used = F.slice("_lags", F.lit(1), F.size("_a"))
    fitted = F.when(F.forall(used, lambda x: x.isNotNull()), F.col("_c") + _dot(F.col("_a"), used))
    return j.select(*keys, index, "y", fitted.alias("fitted"), (F.col("y") - fitted).alias("resid"))
