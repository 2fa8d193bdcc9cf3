"""Exponential smoothing of keyed, gap-free series over a grid of parameters, and its
forecasts (M13).

A key's values are one ordered array (a row per month).  Every parameter set of the grid is a
row per key, and the state recursion is a fold over the array, so keys and parameter sets run
in parallel; the set of least AICc is kept by ``min_by``.  There is no optimiser: the grid is
the model space, and a finer one is a longer list.

Forms (additive errors): level; level and trend, plain or damped; each with or without an
additive season.  Starts: without a season, the line through the first ten values (their mean
for a level alone); with one, level and trend from the means of the first two cycles and the
season from those cycles less that line.

Defined cases: seasonal forms need two cycles and take no part on shorter series; a series
with a NULL value has NULL fits and no row; a series that a form fits without error has the
AICc of minus infinity; equal AICc go to the earlier set of the grid.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forecast import _h, with_bands

PERIOD = 12
ALPHA = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
BETA_SHARE, GAMMA_SHARE = (0.05, 0.2, 0.5), (0.05, 0.2, 0.5)
DAMPING = (1.0, 0.9, 0.98)
GRID_DDL = "no int, trend string, season string, alpha double, beta double, gamma double, phi double"


def grid() -> list[tuple]:
    """(no, trend N / A / Ad, season N / A, alpha, beta, gamma, phi); beta is a share of alpha
    and gamma one of 1 - alpha, which keeps the recursions stable."""
    out = []
    for season, alpha in itertools.product("NA", ALPHA):
        gammas = [round(g * (1 - alpha), 10) for g in GAMMA_SHARE] if season == "A" else [0.0]
        trends = [("N", 0.0, 0.0)] + [("A" if phi == 1 else "Ad", round(b * alpha, 10), phi)
                                      for phi in DAMPING for b in BETA_SHARE]
        for gamma, (trend, beta, phi) in itertools.product(gammas, trends):
            out.append((len(out), trend, season, alpha, beta, gamma, phi))
    return out


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def _mean(xs: Column) -> Column:
    return F.try_divide(_sum(xs), F.size(xs).cast("double"))


def ordered_values(series: DataFrame, value: str, keys=(), index: str = "month") -> DataFrame:
    """One row per key: n, last_index and y, the values in order."""
    at = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("y"))))
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(index).alias("last_index"), at.alias("_at")) \
        .withColumn("y", F.transform("_at", lambda x: x["y"])).drop("_at")


def with_starts(values: DataFrame, period: int = PERIOD) -> DataFrame:
    """Add the starting level, trend and season of the forms without and with a season."""
    y = F.col("y")
    head = F.slice(y, 1, 10)
    m = F.size(head)
    t_mean = (m + 1) / 2.0
    moved = F.zip_with(head, F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda v, t: v * (t - t_mean))
    slope = F.coalesce(F.try_divide(_sum(moved), m * (m * m - 1) / 12.0), F.lit(0.0))
    one, two = F.slice(y, 1, period), F.slice(y, period + 1, period)
    rise = (_mean(two) - _mean(one)) / float(period)
    base = _mean(one) - rise * ((period + 1) / 2.0)
    season = F.zip_with(F.zip_with(one, two, lambda a, b: a + b), F.sequence(F.lit(1), F.lit(period)),
                        lambda v, i: v / 2.0 - base - rise * (i + period / 2.0))
    return values.select("*", _mean(head).alias("_mean"), slope.alias("_slope"),
                         (_mean(head) - slope * t_mean).alias("_line"), rise.alias("_rise"), base.alias("_base"),
                         season.alias("_season"))


def _dampened(b: Column) -> Column:
    return F.col("phi") * b


def ets_states(series: DataFrame, value: str, keys=(), index: str = "month", period: int = PERIOD,
               parameters: list[tuple] | None = None) -> DataFrame:
    """One row per key and parameter set: the final level, trend and season (the next period's
    first), the sum of squared one-step errors and the AICc."""
    rows = grid() if parameters is None else parameters
    sets = F.from_json(F.lit("[" + ",".join(
        '{"no":%d,"trend":"%s","season":"%s","alpha":%r,"beta":%r,"gamma":%r,"phi":%r}' % r for r in rows) + "]"),
        f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in GRID_DDL.split(', '))}>>")
    s = with_starts(ordered_values(series, value, keys, index), period)
    s = s.withColumn("_p", F.explode(sets)).select("*", "_p.*").drop("_p")
    s = s.filter((F.col("season") == "N") | (F.col("n") >= 2 * period))
    seasonal, trending = F.col("season") == "A", F.col("trend") != "N"
    level = F.when(seasonal, F.when(trending, F.col("_base")).otherwise(F.col("_base") + F.col("_rise") * (period + 0.5))) \
        .otherwise(F.when(trending, F.col("_line")).otherwise(F.col("_mean")))
    trend = F.when(trending, F.when(seasonal, F.col("_rise")).otherwise(F.col("_slope"))).otherwise(0.0)
    season = F.when(seasonal, F.col("_season")).otherwise(F.array().cast("array<double>"))
    # Nullable from the start: a NULL value makes all that follows NULL.
    some = lambda c: F.when(F.col("n") > 0, c)
    first = F.struct(some(level).alias("l"), some(trend).alias("b"), some(season).alias("s"), some(F.lit(0.0)).alias("sse"))

    def step(a: Column, y: Column) -> Column:
        at = F.coalesce(F.get(a["s"], 0), F.lit(0.0))
        base = a["l"] + _dampened(a["b"])
        e = y - base - at
        turned = F.when(seasonal, F.concat(F.slice(a["s"], 2, period - 1), F.array(at + F.col("gamma") * e))).otherwise(a["s"])
        return F.struct((base + F.col("alpha") * e).alias("l"), (_dampened(a["b"]) + F.col("beta") * e).alias("b"),
                        turned.alias("s"), (a["sse"] + e * e).alias("sse"))

    s = s.withColumn("_f", F.explode(F.array(F.aggregate("y", first, step))))  # the fold runs once
    n = F.col("n")
    k = 3 + F.when(trending, F.when(F.col("trend") == "Ad", 3).otherwise(2)).otherwise(0) + F.when(seasonal, period + 1).otherwise(0)
    aicc = F.when(n - k - 1 > 0, F.when(F.col("_f.sse") <= 0, F.lit(float("-inf"))).otherwise(
        n * F.log(F.col("_f.sse") / n) + 2 * k + F.try_divide(2.0 * k * (k + 1), n - k - 1)))
    return s.select(*keys, "n", "last_index", "no", "trend", "season", "alpha", "beta", "gamma", "phi",
                    F.col("_f.l").alias("level"), F.col("_f.b").alias("slope"), F.col("_f.s").alias("seasonal"),
                    F.col("_f.sse").alias("sse"), F.try_divide(F.col("_f.sse"), F.when(n - k > 0, n - k)).alias("sigma2"),
                    aicc.alias("aicc"))


def ets_fit(series: DataFrame, value: str, keys=(), index: str = "month", period: int = PERIOD,
            parameters: list[tuple] | None = None) -> DataFrame:
    """The parameter set of least AICc of each key, with its final state."""
    keys = list(keys)
    states = ets_states(series, value, keys, index, period, parameters).filter("aicc is not null")
    rest = [c for c in states.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("aicc", "no")).alias("_b")
    return states.groupBy(*keys).agg(best).select(*keys, "_b.*")


def ets_forecast(fit: DataFrame, h, keys=(), index: str = "month", period: int = PERIOD) -> DataFrame:
    """M13 for ``ets_fit``: ``h`` steps with bands.  The response j steps on to an error is
    alpha + beta (phi + ... + phi^j), and gamma more on each full cycle; the variance is the
    running sum of its squares."""
    keys = list(keys)
    first = F.struct(F.lit(0.0).alias("run"), F.lit(1.0).alias("var"),
                     F.array().cast("array<struct<step:int,run:double,var:double>>").alias("out"))

    def advance(s: Column, step: Column) -> Column:
        run = s["run"] + F.pow(F.col("phi"), step)
        c = F.col("alpha") + F.col("beta") * run + F.when(F.pmod(step, F.lit(period)) == 0, F.col("gamma")).otherwise(0.0)
        row = F.struct(step.cast("int").alias("step"), run.alias("run"), s["var"].alias("var"))
        return F.struct(run.alias("run"), (s["var"] + c * c).alias("var"), F.concat(s["out"], F.array(row)).alias("out"))

    steps = F.aggregate(F.sequence(F.lit(1), _h(h)), first, advance, lambda s: s["out"])
    f = fit.withColumn("_s", F.explode(steps))
    at = F.coalesce(F.get("seasonal", F.pmod(F.col("_s.step") - 1, F.lit(period))), F.lit(0.0))
    return with_bands(f.select(*keys, F.add_months("last_index", F.col("_s.step")).alias(index),
                               (F.col("level") + F.col("slope") * F.col("_s.run") + at).alias("mean"),
                               F.sqrt(F.col("sigma2") * F.col("_s.var")).alias("sigma")))
