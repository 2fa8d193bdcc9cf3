"""Registered queries of the series models: M3, M4, M11, M12, M13, M15, and the views on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import autoregress as AR
from ..operators import loess as L
from ..operators import reconcile as REC
from ..operators import series as S
from ..operators import smooth as SM
from ..operators.aggregate import money_sum
from ..session import written
from .catalog import HIERARCHY, VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT, _app, query, rounded, significant
from .pipeline import Pipeline


def terms(fit, keys):
    """One row per term of an ``ar_fit``: kpss, mean, sigma2, aicc, ar1, ar2, ..."""
    named = [F.struct(F.lit(c).alias("term"), F.col(c).alias("estimate")) for c in ("kpss", "mean", "sigma2", "aicc")]
    ar = F.transform("phi", lambda x, i: F.struct(F.concat(F.lit("ar"), (i + 1).cast("string")).alias("term"), x.alias("estimate")))
    long = fit.select(*keys, "d", F.col("order").alias("ar_order"), F.explode(F.concat(F.array(*named), ar)).alias("_t"))
    return long.select(*keys, "d", "ar_order", "_t.term", "_t.estimate")


@query("M11_region")
def q_m11(spark, d):
    fit = AR.ar_fit(Pipeline(spark, d).region_ts(), "mean_sale", keys=["Region"])
    return significant(terms(fit, ["Region"]), "estimate")


@query("M13_ar")
def q_m13_ar(spark, d):
    fit = AR.ar_fit(Pipeline(spark, d).region_ts(), "mean_sale", keys=["Region"])
    return rounded(AR.ar_forecast(fit, 12, keys=["Region"]))


ETS = ["alpha", "beta", "gamma", "phi", "level", "slope", "sse", "sigma2", "aicc"]


@query("M12_region")
def q_m12(spark, d):
    fit = SM.ets_fit(Pipeline(spark, d).region_ts(), "mean_sale", keys=["Region"])
    return significant(fit.select("Region", "trend", "season", *ETS), *ETS)


@query("M13_ets")
def q_m13_ets(spark, d):
    fit = SM.ets_fit(Pipeline(spark, d).region_ts(), "mean_sale", keys=["Region"])
    return rounded(SM.ets_forecast(fit, 24, keys=["Region"]))


@query("M3")
def q_m3(spark, d):
    return rounded(L.stl(Pipeline(spark, d).report_ts("mean_sale"), "mean_sale"))


@query("M3_robust")
def q_m3_robust(spark, d):
    return rounded(L.stl(Pipeline(spark, d).report_ts("mean_sale"), "mean_sale", outer=1))


# ------------------------------------------------------------------ reconciliation M15
def node_series(spark, d):
    """Monthly totals of every node of the hierarchy over the same months, without gaps."""
    leaves = Pipeline(spark, d).sold("all").groupBy("month", *HIERARCHY).agg(money_sum("price").alias("price"))
    ts = written(REC.hierarchy_series(leaves, HIERARCHY, "price"))
    bounds = [ts.select(f("month")).scalar() for f in (F.min, F.max)]
    return S.fill_gaps(ts, keys=["node"], fill={"price": 0.0}, bounds=bounds)


def named(df):
    return df.withColumn("node", F.array_join("node", " > "))


@query("M15_ols")
def q_m15_ols(spark, d):
    # Every node's own autoregression, made coherent by least squares.
    fit = AR.ar_fit(node_series(spark, d), "price", keys=["node"])
    out = REC.least_squares(AR.ar_forecast(fit, 5, keys=["node"]), len(HIERARCHY))
    return significant(named(out), "mean")


def _errors(spark, d):
    ts = written(node_series(spark, d))
    fit = written(AR.ar_fit(ts, "price", keys=["node"]))
    return fit, AR.ar_augment(ts, fit, "price", keys=["node"])


@query("M15_shrinkage")
def q_m15_shrinkage(spark, d):
    _, residuals = _errors(spark, d)
    return significant(REC.shrinkage(REC.common_errors(residuals)), "intensity")


@query("M15_gains")
def q_m15_gains(spark, d):
    _, residuals = _errors(spark, d)
    out = named(REC.gains(REC.common_errors(residuals)))
    return significant(out.withColumn("at", F.array_join("at", " > ")).withColumn("gain", F.round("gain", 6) + F.lit(0.0)), "gain")


@query("M15_mint")
def q_m15_mint(spark, d):
    # The same forecasts under the shrunken covariance of their one-step errors.
    fit, residuals = _errors(spark, d)
    return significant(named(REC.min_trace(AR.ar_forecast(fit, 5, keys=["node"]), residuals)), "mean")


# ------------------------------------------------------------------ views Q6, Q7
@query("Q6_ar")
def q_q6_ar(spark, d):
    return rounded(_app(spark, d).forecast("1 year", model="ar"))


@query("Q6_ar_selection")
def q_q6_ar_selection(spark, d):
    return rounded(_app(spark, d).forecast("3 years", VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT, scope="selection", model="ar"))


@query("Q6_ar_menu")
def q_q6_ar_menu(spark, d):
    # Every menu entry's own series, a year ahead, in one job.
    return rounded(_app(spark, d).forecast_menu("1 year"))


@query("Q7_ar")
def q_q7_ar(spark, d):
    return rounded(_app(spark, d).forecast_table("1 year", VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT, model="ar"))
