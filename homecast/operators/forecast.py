"""Forecasts (M13) and prediction bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Z80, Z95


def with_bands(df: DataFrame, mean: str = "mean", sd: str = "sigma") -> DataFrame:
    """80% and 95% normal prediction intervals."""
    m, s = F.col(mean), F.col(sd)
    return df.withColumns({"lo80": m - Z80 * s, "hi80": m + Z80 * s,
                           "lo95": m - Z95 * s, "hi95": m + Z95 * s})


def _h(h) -> Column:
    return F.lit(h) if isinstance(h, int) else (F.col(h) if isinstance(h, str) else h)


def trend_forecast(fit: DataFrame, h, keys=(), index: str = "month") -> DataFrame:
    """M13 for ``TSLM(y ~ trend())``: h steps after each key's last month.
    ``h`` is an int, a column name or a Column (per-key horizons, see C18)."""
    keys = list(keys)
    f = fit.select(*keys, "n", "intercept", "slope", "sigma", "sxx", "tbar", "last_index",
                   F.explode(F.sequence(F.lit(1), _h(h))).alias("step"))
    t0 = F.col("n") + F.col("step")
    se = F.col("sigma") * F.sqrt(1 + 1 / F.col("n")
                                 + F.try_divide((t0 - F.col("tbar")) ** 2, F.col("sxx")))
    out = f.select(*keys, F.add_months(F.col("last_index"), F.col("step")).alias(index),
                   (F.col("intercept") + F.col("slope") * t0).alias("mean"), se.alias("sigma"))
    return with_bands(out)


def trend_season_forecast(fit: DataFrame, h, keys=(), index: str = "month") -> DataFrame:
    """M13 for ``trend_season_fit``: a step's level is its calendar month's, moved along
    the trend; a month that the series has never had gives NULL."""
    keys = list(keys)
    f = fit.select(*keys, "n", "slope", "sxx", "sigma2", "last_index", "seasons",
                   F.explode(F.sequence(F.lit(1), _h(h))).alias("step"))
    f = f.withColumn("_at", F.add_months("last_index", F.col("step")))
    f = f.withColumn("_s", F.get(F.filter("seasons", lambda s: s["pos"] == F.month("_at")), 0))
    ahead = F.col("n") + F.col("step") - F.col("_s.tbar")
    se = F.sqrt(F.col("sigma2") * (1 + 1 / F.col("_s.n") + F.try_divide(ahead * ahead, F.col("sxx"))))
    return with_bands(f.select(*keys, F.col("_at").alias(index),
                               (F.col("_s.ybar") + F.col("slope") * ahead).alias("mean"), se.alias("sigma")))
