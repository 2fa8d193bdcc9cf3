"""Linear models per key: M5-M10, M16-M18.

Rows are reduced by Catalyst first: a trend model needs only the
``regr_*`` aggregates; a general OLS needs one partial aggregate of centred
Gram sums (k*(k+1)/2 + k + 2 numbers per key).  Python sees only those k x k
sums, one row per key, in ``mapInPandas``.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import with_position

LOG2PI = math.log(2 * math.pi)


def _keyed(df: DataFrame, keys) -> tuple[DataFrame, list[str], bool]:
    """A keyless (single) series gets a constant key so joins stay equi-joins."""
    keys = list(keys)
    if keys:
        return df, keys, False
    return df.withColumn("_k", F.lit(0)), ["_k"], True


# ------------------------------------------------------------------ M5 trend model
def trend_fit(series: DataFrame, value: str, keys=(), index: str = "month") -> DataFrame:
    """M5 ``TSLM(y ~ trend())``: t = 1..n per key; one aggregate per key."""
    keys = list(keys)
    s = with_position(series, keys, index, "t")
    y, t = F.col(value).cast("double"), F.col("t").cast("double")
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept(y, t).alias("intercept"),
        F.regr_slope(y, t).alias("slope"), F.regr_sxx(y, t).alias("sxx"),
        F.regr_syy(y, t).alias("syy"), F.regr_sxy(y, t).alias("sxy"),
        F.avg(t).alias("tbar"), F.max(index).alias("last_index"))
    rss = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")),
                     F.lit(0.0))
    return g.withColumn("rss", rss).withColumn(
        "sigma", F.sqrt(F.try_divide(F.col("rss"), F.col("n") - 2)))


def trend_report(fit: DataFrame, keys=()) -> DataFrame:
    """M18 for the trend model: coefficients and fit statistics per key."""
    k = 2
    n = F.col("n").cast("double")
    ll = -n / 2 * (F.lit(LOG2PI) + F.log(F.col("rss") / n) + 1)
    aic = -2 * ll + 2 * (k + 1)
    r2 = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
    return fit.select(
        *keys, "n", "intercept", "slope", (F.col("sigma") * F.col("sigma")).alias("sigma2"),
        r2.alias("r2"), (1 - F.try_divide((1 - r2) * (n - 1), n - k)).alias("adj_r2"),
        ll.alias("loglik"), aic.alias("aic"),
        (aic + F.try_divide(F.lit(2.0 * (k + 1) * (k + 2)), n - k - 2)).alias("aicc"),
        (-2 * ll + F.log(n) * (k + 1)).alias("bic"))


def trend_augment(series: DataFrame, value: str, keys=(), index: str = "month") -> DataFrame:
    """M16 ``augment``: fitted values and residuals of the trend model.  The
    ``regr_*`` aggregates run as window functions over each key, so the
    series is read once (no join back to a separate fit)."""
    keys = list(keys)
    s = with_position(series, keys, index, "t")
    wk = Window.partitionBy(*keys)
    y, t = F.col(value).cast("double"), F.col("t").cast("double")
    fitted = F.regr_intercept(y, t).over(wk) + F.regr_slope(y, t).over(wk) * t
    d = s.select(*keys, index, y.alias("y"), fitted.alias("fitted"))
    return d.withColumn("resid", F.col("y") - F.col("fitted"))


# ------------------------------------------------------------------ M17 diagnostics
def acf(resid: DataFrame, keys=(), index: str = "month", value: str = "resid",
        max_lag: int = 24) -> DataFrame:
    """M17 autocorrelation for lags 1..max_lag:
    sum_t (e_t - mean)(e_{t-k} - mean) / sum_t (e_t - mean)^2.
    ``lag`` windows over each key's ordered rows, then one aggregate on the
    same keys (the window's partitioning is reused)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(index)
    wk = Window.partitionBy(*keys)
    d = resid.select(*keys, index, (F.col(value) - F.avg(value).over(wk)).alias("d"))
    prods = [(F.col("d") * F.lag("d", k).over(w)).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    p = d.select(*keys, "d", *prods)
    g = p.groupBy(*keys).agg(F.sum(F.col("d") * F.col("d")).alias("_den"),
                             *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, max_lag + 1)])
    long = g.select(*keys, "_den", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("num"))
        for k in range(1, max_lag + 1)])).alias("_a"))
    return long.select(*keys, F.col("_a.lag").alias("lag"),
                       F.try_divide(F.col("_a.num"), F.col("_den")).alias("acf"))


def histogram(df: DataFrame, value: str, keys=(), bins: int = 10) -> DataFrame:
    """M17 residual histogram: equal-width bins between each key's min and max."""
    keys = list(keys)
    wk = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(wk), F.max(value).over(wk)
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins) + 1, F.lit(bins))
    d = df.withColumn("bin", F.when(hi > lo, b).otherwise(F.lit(1)).cast("int"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ M8 OLS kernel
def _gram(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """Means and centred Gram sums per key: one aggregate, combined map-side, over the
    complete rows.  ``covar_pop`` merges partial states stably, so no pass for the
    means comes first and no key meets in one task."""
    cols = [y, *xs]
    pairs = itertools.combinations_with_replacement(cols, 2)
    n = F.count(F.lit(1))
    return df.dropna(subset=cols).groupBy(*keys).agg(
        n.alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.covar_pop(a, b) * n for a, b in pairs]).alias("gram"))


def _unpack(gram_row, k1: int) -> np.ndarray:
    g = np.zeros((k1, k1))
    it = iter(gram_row)
    for a, b in itertools.combinations_with_replacement(range(k1), 2):
        g[a, b] = g[b, a] = next(it)
    return g


def _solve(g: np.ndarray, means, n: int, idx: list[int]):
    """OLS on the centred Gram matrix: column 0 is y, ``idx`` the regressors."""
    sxx = g[np.ix_(idx, idx)]
    sxy = g[idx, 0]
    syy = g[0, 0]
    if len(idx):
        beta, *_ = np.linalg.lstsq(sxx, sxy, rcond=None)
        rss = max(syy - float(beta @ sxy), 0.0)
    else:
        beta, rss = np.zeros(0), syy
    intercept = means[0] - float(np.dot(beta, [means[i] for i in idx]))
    return beta, intercept, rss, syy, sxx


def _stats(n: int, p: int, rss: float, syy: float) -> dict:
    """p = number of coefficients including the intercept."""
    ll = -n / 2 * (LOG2PI + math.log(rss / n) + 1) if rss > 0 else float("inf")
    aic = -2 * ll + 2 * (p + 1)
    return {"rss": rss, "sigma2": rss / (n - p) if n > p else float("nan"),
            "r2": 1 - rss / syy if syy > 0 else float("nan"),
            "adj_r2": 1 - (rss / (n - p)) / (syy / (n - 1)) if n > p and syy > 0 else float("nan"),
            "loglik": ll, "aic": aic,
            "aicc": aic + 2 * (p + 1) * (p + 2) / (n - p - 2) if n - p - 2 > 0 else float("nan"),
            "bic": -2 * ll + math.log(n) * (p + 1)}


_STAT_COLS = ["rss", "sigma2", "r2", "adj_r2", "loglik", "aic", "aicc", "bic"]


def _key_ddl(df: DataFrame, keys) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def ols(df: DataFrame, y: str, terms: dict[str, Column] | list[str], keys=()) -> DataFrame:
    """M8 ``lm(y ~ terms)`` per key.  ``terms`` maps a term name to a Column
    (e.g. C19 interactions) or lists existing columns.  Returns one row per
    key: n, terms, coefficient and standard-error arrays (intercept first)
    and the fit statistics (M10 AIC among them)."""
    df, keys, dummy = _keyed(df, keys)
    if not isinstance(terms, dict):
        terms = {t: F.col(t) for t in terms}
    names = list(terms)
    xs = [f"_x{i}" for i in range(len(names))]
    d = df.select(*keys, F.col(y).cast("double").alias("_y"),
                  *[c.cast("double").alias(x) for c, x in zip(terms.values(), xs)])
    g = _gram(d, "_y", xs, keys)
    k1 = len(xs) + 1
    schema = (_key_ddl(d, keys) + "n long, terms array<string>, coef array<double>, "
              "se array<double>, " + ", ".join(f"{c} double" for c in _STAT_COLS))

    def fn(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                gm = _unpack(r["gram"], k1)
                idx = list(range(1, k1))
                beta, icpt, rss, syy, sxx = _solve(gm, list(r["means"]), n, idx)
                st = _stats(n, len(idx) + 1, rss, syy)
                try:
                    inv = np.linalg.inv(sxx)
                    se = [math.sqrt(max(st["sigma2"] * v, 0.0)) for v in np.diag(inv)]
                    xm = np.array([r["means"][i] for i in idx])
                    se0 = math.sqrt(max(st["sigma2"] * (1.0 / n + xm @ inv @ xm), 0.0))
                except np.linalg.LinAlgError:
                    se, se0 = [float("nan")] * len(idx), float("nan")
                row = {k: r[k] for k in keys}
                row.update(n=n, terms=["(Intercept)", *names], coef=[icpt, *beta.tolist()],
                           se=[se0, *se], **st)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*keys, "n", "terms", "coef", "se", *_STAT_COLS])

    out = g.mapInPandas(fn, schema)
    return out.drop("_k") if dummy else out


def coefficients(fit: DataFrame, keys=()) -> DataFrame:
    """Long form of an ``ols`` fit: keys, term, estimate, std_error, statistic."""
    z = F.arrays_zip("terms", "coef", "se")
    return fit.select(*keys, F.explode(z).alias("c")).select(
        *keys, F.col("c.terms").alias("term"), F.col("c.coef").alias("estimate"),
        F.col("c.se").alias("std_error"),
        F.try_divide(F.col("c.coef"), F.col("c.se")).alias("statistic"))


def trend_season_terms(index: str = "month", period: int = 12) -> dict[str, Column]:
    """M6 regressors of ``TSLM(y ~ trend() + season())``: t and calendar-month
    dummies 2..12 (t must be added by ``with_position``)."""
    terms = {"trend()": F.col("t")}
    for m in range(2, period + 1):
        terms[f"season()year{m}"] = (F.month(index) == m).cast("double")
    return terms


def best_subsets(df: DataFrame, y: str, terms: dict[str, Column], keys=()) -> DataFrame:
    """M9 ``regsubsets``: every subset of ``terms`` solved on one Gram pass;
    one row per (key, size) with the lowest RSS and its Mallows' Cp,
    Cp = RSS / sigma2_full - n + 2 (p + 1) with p regressors."""
    df, keys, dummy = _keyed(df, keys)
    names = list(terms)
    xs = [f"_x{i}" for i in range(len(names))]
    d = df.select(*keys, F.col(y).cast("double").alias("_y"),
                  *[c.cast("double").alias(x) for c, x in zip(terms.values(), xs)])
    g = _gram(d, "_y", xs, keys)
    k1 = len(xs) + 1
    schema = (_key_ddl(d, keys) + "size int, terms array<string>, rss double, r2 double, "
              "adj_r2 double, cp double, bic double")

    def fn(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                gm = _unpack(r["gram"], k1)
                full = _solve(gm, list(r["means"]), n, list(range(1, k1)))
                s2 = full[2] / (n - k1) if n > k1 else float("nan")
                for size in range(1, k1):
                    for sub in itertools.combinations(range(1, k1), size):
                        _, _, rss, syy, _ = _solve(gm, list(r["means"]), n, list(sub))
                        st = _stats(n, size + 1, rss, syy)
                        row = {k: r[k] for k in keys}
                        row.update(size=size, terms=[names[i - 1] for i in sub], rss=rss,
                                   r2=st["r2"], adj_r2=st["adj_r2"],
                                   cp=rss / s2 - n + 2 * (size + 1) if s2 > 0 else float("nan"),
                                   bic=n * math.log(rss / n) + math.log(n) * (size + 1)
                                   if rss > 0 else float("-inf"))
                        rows.append(row)
            yield pd.DataFrame(rows, columns=[*keys, "size", "terms", "rss", "r2", "adj_r2",
                                              "cp", "bic"])

    all_subsets = g.mapInPandas(fn, schema)
    w = Window.partitionBy(*keys, "size").orderBy("rss")
    out = all_subsets.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return out.drop("_k") if dummy else out


def ols_augment(df: DataFrame, fit: DataFrame, y: str, terms: dict[str, Column] | list[str],
                keys=(), index: str = "month") -> DataFrame:
    """M16 for an ``ols`` fit: fitted values and residuals per row.  The fit
    has one row per key, so the join back is on the keys."""
    keys = list(keys)
    if not isinstance(terms, dict):
        terms = {t: F.col(t) for t in terms}
    xs = [c.cast("double") for c in terms.values()]
    # A keyless fit is one row (a scalar subquery); without a row the fitted values are NULL.
    j = df.join(fit.select(*keys, "coef"), keys) if keys else df.withColumn("coef", fit.select("coef").scalar())
    fitted = F.get(F.col("coef"), 0)
    for i, x in enumerate(xs, start=1):
        fitted = fitted + F.get(F.col("coef"), i) * x
    out = j.select(*keys, index, F.col(y).cast("double").alias("y"), fitted.alias("fitted"))
    return out.withColumn("resid", F.col("y") - F.col("fitted"))


# ------------------------------------------------------------------ M6 as a forecastable fit
def trend_season_fit(series: DataFrame, value: str, keys=(), index: str = "month") -> DataFrame:
    """M6 in the form that M13 extends: the trend is the slope within calendar months (the
    month dummies partialled out), a month's level its mean.  One row per key: n, slope,
    sxx, sigma2, last_index and ``seasons`` (pos, n, ybar, tbar; at most 12)."""
    keys = list(keys)
    s = with_position(series, keys, index, "t")
    y, t = F.col(value).cast("double"), F.col("t").cast("double")
    per = s.groupBy(*keys, F.month(index).alias("pos")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("ybar"), F.avg(t).alias("tbar"),
        F.regr_sxx(y, t).alias("sxx"), F.regr_sxy(y, t).alias("sxy"), F.regr_syy(y, t).alias("syy"),
        F.max(index).alias("last_index"))
    g = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy"), F.sum("syy").alias("syy"),
        F.count(F.lit(1)).alias("levels"), F.max("last_index").alias("last_index"),
        F.collect_list(F.struct("pos", "n", "ybar", "tbar")).alias("seasons"))
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    rss = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    return g.select(*keys, "n", slope.alias("slope"), "sxx",
                    F.try_divide(rss, F.col("n") - F.col("levels") - 1).alias("sigma2"), "last_index", "seasons")
