"""Properties of gap filling, decompositions, linear models and reconciliation."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from homecast.operators import decompose as D
from homecast.operators import reconcile as REC
from homecast.operators import regress as R
from homecast.operators import series as S

from .conftest import SF_SMALL


def _months(n, start=(2015, 1)):
    y, m = start
    out = []
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        m += 1
        if m > 12:
            y, m = y + 1, 1
    return out


def test_fill_gaps_contiguous_unique(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 11, 1), 1.0), ("a", dt.date(2021, 2, 1), 2.0),
                                ("b", dt.date(2021, 1, 1), 3.0), (None, dt.date(2021, 1, 1), 4.0),
                                (None, dt.date(2021, 3, 1), 5.0)], "k string, month date, v double")
    out = S.fill_gaps(df, keys=["k"], fill={"v": 0.0}).orderBy("k", "month").collect()
    a = [(r.month, r.v) for r in out if r.k == "a"]
    assert a == [(dt.date(2020, 11, 1), 1.0), (dt.date(2020, 12, 1), 0.0),
                 (dt.date(2021, 1, 1), 0.0), (dt.date(2021, 2, 1), 2.0)]
    assert len([r for r in out if r.k is None]) == 3     # NULL key is a key too
    assert S.series_duplicates(S.fill_gaps(df, keys=["k"]), ["k"]).count() == 0
    bounds = (dt.date(2020, 10, 1), dt.date(2021, 3, 1))
    common = S.fill_gaps(df, keys=["k"], fill={"v": 0.0}, bounds=bounds).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in common} == {"a": 6, "b": 6, None: 6}


def _seasonal_frame(spark, n=60, keys=("x", "y")):
    rows = []
    rng = np.random.default_rng(0)
    for k in keys:
        for i, m in enumerate(_months(n)):
            rows.append((k, m, float(100 + i + 10 * np.sin(2 * np.pi * i / 12) + rng.normal())))
    return spark.createDataFrame(rows, "k string, month date, y double")


def test_classical_additive_identities(spark):
    out = D.classical(_seasonal_frame(spark), "y", keys=["k"]).toPandas()
    full = out.dropna()
    assert np.allclose(full.trend + full.seasonal + full.remainder, full.y)
    # seasonal figure sums to zero over one cycle of 12 positions
    for _, g in out.groupby("k"):
        assert abs(g.sort_values("month").seasonal.iloc[:12].sum()) < 1e-6


def test_classical_multiplicative_and_short(spark):
    out = D.classical(_seasonal_frame(spark), "y", keys=["k"], kind="multiplicative").toPandas()
    for _, g in out.groupby("k"):
        assert abs(g.sort_values("month").seasonal.iloc[:12].mean() - 1) < 1e-9
    short = D.classical(_seasonal_frame(spark, n=20), "y", keys=["k"]).toPandas()
    assert short.trend.isna().all()


def test_x11_reconstructs(spark):
    df = _seasonal_frame(spark)
    x11 = D.x11(df, "y", keys=["k"]).toPandas().dropna()
    assert len(x11) > 0
    assert np.allclose(x11.trend + x11.seasonal + x11.remainder, x11.y)
    w = D.henderson_weights(13)
    assert abs(sum(w) - 1) < 1e-12 and abs(w[6] - 0.240) < 1e-3


def test_ols_matches_numpy_and_residuals_orthogonal(spark):
    rng = np.random.default_rng(1)
    n = 200
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y"] = 3 + 2 * pdf.a - pdf.b + 0.5 * pdf.a * pdf.b + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pdf)
    fit = R.ols(df, "y", {"a": F.col("a"), "b": F.col("b"), "a:b": F.col("a") * F.col("b")},
                keys=["g"]).toPandas()
    for _, r in fit.iterrows():
        sub = pdf[pdf.g == r.g]
        X = np.c_[np.ones(len(sub)), sub.a, sub.b, sub.a * sub.b]
        beta = np.linalg.lstsq(X, sub.y, rcond=None)[0]
        assert np.allclose(r.coef, beta, atol=1e-8)
        resid = sub.y - X @ beta
        assert np.allclose(X.T @ resid, 0, atol=1e-6)
        assert abs(r.rss - resid @ resid) < 1e-6


def test_best_subsets_rss_monotone(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=["a", "b", "c"])
    pdf["y"] = pdf.a + 2 * pdf.b + rng.normal(size=80)
    terms = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "a:b": F.col("a") * F.col("b")}
    best = R.best_subsets(spark.createDataFrame(pdf), "y", terms).orderBy("size").toPandas()
    assert list(best["size"]) == [1, 2, 3, 4]
    assert all(np.diff(best.rss) <= 1e-9)
    assert set(best.terms[1]) == {"a", "b"}


def test_trend_fit_and_acf(spark):
    months = _months(48)
    df = spark.createDataFrame([(m, 10.0 + 2.0 * i) for i, m in enumerate(months)], "month date, y double")
    fit = R.trend_fit(df, "y").first()
    assert abs(fit.slope - 2) < 1e-9 and abs(fit.intercept - 8) < 1e-9
    aug = R.trend_augment(df, "y")
    assert max(abs(r.resid) for r in aug.collect()) < 1e-9
    noise = spark.createDataFrame([(m, float(np.sin(i))) for i, m in enumerate(months)], "month date, e double")
    acf = {r.lag: r.acf for r in R.acf(noise, value="e", max_lag=3).collect()}
    e = np.sin(np.arange(48)); d = e - e.mean()
    assert abs(acf[1] - (d[1:] @ d[:-1]) / (d @ d)) < 1e-12


def test_bottom_up_children_sum_to_parent(spark):
    rng = np.random.default_rng(3)
    rows = [(r, c, float(rng.normal(100, 10))) for r in ("N", "S") for c in ("a", "b/x", "c") for _ in range(3)]
    sales = spark.createDataFrame(rows, "Region string, County string, price double")
    mapping = REC.hierarchy_mapping(sales, ["Region", "County"])
    assert mapping.count() == 6 * 3                    # every leaf with 3 nodes incl. itself
    nodes = REC.hierarchy_series(sales.withColumn("month", F.lit("2020-01-01").cast("date")),
                                 ["Region", "County"], "price")
    assert {tuple(x.node) for x in nodes.collect()} == {tuple(x.node) for x in mapping.collect()}
    leaves = nodes.filter(F.size("node") == 2).withColumnRenamed("price", "mean")
    up = {tuple(x.node): x.mean for x in REC.bottom_up(leaves, mapping).collect()}
    base = {tuple(x.node): x.price for x in nodes.collect()}
    assert set(up) == set(base) and all(abs(up[k] - base[k]) < 1e-9 for k in up)


def test_sample_per_group_caps_rows(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(50)], "g int, i int")
    out = S.sample_per_group(df, "g", 7, "i")
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    assert counts == {0: 7, 1: 7, 2: 7}
    assert S.sample_per_group(df, "g", 7, "i").exceptAll(df).count() == 0


def test_smoke_entry(spark):
    from __spark_entry__ import entry
    assert entry(spark).count() > 0
    assert SF_SMALL.endswith("0.001")


def test_assert_series_and_first_per_group(spark):
    from homecast.operators import enrich as EN
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("a", dt.date(2020, 1, 1))],
                               "k string, month date")
    try:
        S.assert_series(df, ["k"])
        raise AssertionError("duplicates not detected")
    except ValueError:
        pass
    z = spark.createDataFrame([("C1", "47106"), ("C1", "47001"), ("C2", "47106")], "County string, zip string")
    first = {r.County: r.zip for r in EN.first_per_group(z, ["County"], ["zip"]).collect()}
    assert first == {"C1": "47001", "C2": "47106"}
