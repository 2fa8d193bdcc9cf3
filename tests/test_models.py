"""M3, M4, M11, M12, M13 and M15 on series with known answers and odd ones."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from homecast.operators import autoregress as AR
from homecast.operators import decompose as D
from homecast.operators import loess as L
from homecast.operators import reconcile as REC
from homecast.operators import smooth as SM

MONTHS = [dt.date(1990 + m // 12, m % 12 + 1, 1) for m in range(400)]


def frame(spark, series: dict):
    rows = [(k, MONTHS[i], None if v is None else float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, month date, y double").repartition(3)


def autoregression(phi, n, seed, mean=0.0):
    r = np.random.default_rng(seed)
    y = np.zeros(n + 100)
    for t in range(len(phi), n + 100):
        y[t] = sum(p * y[t - 1 - j] for j, p in enumerate(phi)) + r.standard_normal()
    return y[100:] + mean


# ------------------------------------------------------------------------- M11
def test_levinson_solves_the_normal_equations(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(20):
        x = r.standard_normal(60)
        x -= x.mean()
        rows.append(([float((x[k:] * x[:60 - k]).sum() / 60) for k in range(6)],))
    df = spark.createDataFrame(rows, "g array<double>")
    for row in df.select("g", AR.levinson(F.col("g")).alias("f")).collect():
        g = np.array(row.g)
        for fit in row.f[1:]:
            p = fit.order
            toeplitz = g[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
            phi = np.linalg.solve(toeplitz, g[1:p + 1])
            assert np.allclose(fit.phi, phi) and fit.v == pytest.approx(g[0] - phi @ g[1:p + 1])


def test_orders_and_coefficients_are_found(spark):
    series = {"ar2": autoregression([0.6, -0.4], 400, 3, mean=50), "walk": np.cumsum(autoregression([], 300, 4)) + 100,
              "noise": autoregression([], 300, 7, mean=9), "flat": [5.0] * 40, "one": [1.0], "two": [1.0, 4.0],
              "smooth": np.cumsum(np.cumsum(autoregression([], 300, 6)))}
    fit = {x.k: x for x in AR.ar_fit(frame(spark, series), "y", keys=["k"]).collect()}
    assert (fit["ar2"].d, fit["ar2"].order) == (0, 2)
    assert np.allclose(fit["ar2"].phi, [0.6, -0.4], atol=0.1) and fit["ar2"].sigma2 == pytest.approx(1, abs=0.15)
    assert fit["walk"].d >= 1 and (fit["smooth"].d, fit["noise"].d) == (2, 0)
    assert (fit["flat"].d, fit["flat"].order, fit["one"].order, fit["two"].order) == (0, 0, 0, 0)


def recursion(fit, y, h):
    """Forecasts and standard deviations by plain recursion on the differenced series."""
    poly = np.array([1.0, *[-p for p in fit.phi]])
    for _ in range(fit.d):
        poly = np.convolve(poly, [1.0, -1.0])
    a, c = -poly[1:], fit.mean * (1 - sum(fit.phi))
    ys, psi = list(y), [1.0]
    for _ in range(h):
        ys.append(c + sum(x * ys[-1 - j] for j, x in enumerate(a)))
        psi.append(sum(x * psi[-1 - j] for j, x in enumerate(a) if j < len(psi)))
    return ys[len(y):], [np.sqrt(fit.sigma2 * sum(p * p for p in psi[:i + 1])) for i in range(h)]


def test_forecasts_follow_the_recursion(spark):
    series = {"ar": autoregression([0.5, 0.2], 120, 5, mean=20), "walk": np.cumsum(autoregression([0.4], 200, 2)) + 9,
              "smooth": np.cumsum(np.cumsum(autoregression([], 300, 6))), "flat": [5.0] * 30}
    fits = AR.ar_fit(frame(spark, series), "y", keys=["k"]).cache()
    fc = AR.ar_forecast(fits, 8, keys=["k"]).orderBy("k", "month").collect()
    for fit in fits.collect():
        got = [x for x in fc if x.k == fit.k]
        mean, sd = recursion(fit, series[fit.k], 8)
        assert [x.month for x in got] == MONTHS[len(series[fit.k]):len(series[fit.k]) + 8]
        assert np.allclose([x["mean"] for x in got], mean) and np.allclose([x.sigma for x in got], sd)


def test_one_step_errors_and_the_keyless_form(spark):
    y = autoregression([0.7], 90, 8, mean=3)
    df = frame(spark, {"a": y}).drop("k")
    fit = AR.ar_fit(df, "y")
    one = AR.ar_augment(df, fit, "y").orderBy("month").collect()
    f = fit.first()
    assert [x.fitted is None for x in one] == [i < f.order + f.d for i in range(90)]
    assert one[40].fitted == pytest.approx(f.mean * (1 - sum(f.phi)) + sum(p * y[39 - j] for j, p in enumerate(f.phi)))
    empty = df.limit(0)
    assert AR.ar_fit(empty, "y", keys=["month"]).count() == 0
    assert AR.ar_augment(df, AR.ar_fit(empty, "y"), "y").filter("fitted is not null").count() == 0


# ------------------------------------------------------------------------- M12
def smoothing(y, p, period=12):
    """The recursion for one parameter set, and its sum of squares."""
    y = np.array(y, float)
    seasonal, trending = p["season"] == "A", p["trend"] != "N"
    if seasonal:
        one, two = y[:period].mean(), y[period:2 * period].mean()
        rise = (two - one) / period
        base = one - rise * (period + 1) / 2
        s = [(y[i] + y[i + period]) / 2 - base - rise * (i + 1 + period / 2) for i in range(period)]
        level, b = (base, rise) if trending else ((one + two) / 2, 0.0)
    else:
        head = y[:10]
        slope, line = np.polyfit(np.arange(1, len(head) + 1), head, 1)
        s, (level, b) = [0.0], (line, slope) if trending else (head.mean(), 0.0)
    sse = 0.0
    for v in y:
        e = v - level - p["phi"] * b - s[0]
        level, b = level + p["phi"] * b + p["alpha"] * e, p["phi"] * b + p["beta"] * e
        s = [*s[1:], s[0] + p["gamma"] * e] if seasonal else s
        sse += e * e
    return level, b, s, sse


def test_the_fold_is_the_recursion(spark):
    r = np.random.default_rng(9)
    t = np.arange(60)
    y = 100 + t + 10 * np.sin(2 * np.pi * t / 12) + r.standard_normal(60)
    some = SM.grid()[::37]
    got = SM.ets_states(frame(spark, {"a": y}), "y", keys=["k"], parameters=some).collect()
    assert len(got) == len(some)
    for x in got:
        level, b, s, sse = smoothing(y, x.asDict())
        assert np.allclose([x.level, x.slope, x.sse], [level, b, sse])
        assert x.season == "N" or np.allclose(x.seasonal, s)


def test_forms_are_told_apart(spark):
    r = np.random.default_rng(2)
    t = np.arange(120)
    series = {"season": 50 + 20 * np.sin(2 * np.pi * t / 12) + r.standard_normal(120) * 0.3,
              "trend": 10 + 3.0 * t + r.standard_normal(120), "level": 5 + r.standard_normal(120),
              "short": [1.0, 2.0, 1.5, 3.0, 2.5, 2.0, 3.5, 4.0, 3.0, 4.5], "hole": [1.0, None, *range(30)], "tiny": [1.0, 2.0]}
    fit = {x.k: x for x in SM.ets_fit(frame(spark, series), "y", keys=["k"]).collect()}
    assert fit["season"].season == "A" and fit["trend"].trend != "N" and fit["trend"].season == "N"
    assert (fit["level"].trend, fit["level"].season, fit["short"].season) == ("N", "N", "N")
    assert "hole" not in fit and "tiny" not in fit
    fc = SM.ets_forecast(SM.ets_fit(frame(spark, {"season": series["season"]}), "y", keys=["k"]), 12, keys=["k"])
    at = np.array([x["mean"] for x in fc.orderBy("month").collect()])
    assert np.allclose(at, 50 + 20 * np.sin(2 * np.pi * np.arange(120, 132) / 12), atol=2)


def test_smoothing_variance_is_that_of_the_responses(spark):
    y = 10 + np.arange(40) + np.random.default_rng(1).standard_normal(40)
    p = [(0, "Ad", "A", 0.3, 0.1, 0.2, 0.9)]
    fit = SM.ets_fit(frame(spark, {"a": y}), "y", keys=["k"], parameters=p).cache()
    sd = [x.sigma for x in SM.ets_forecast(fit, 15, keys=["k"]).orderBy("month").collect()]

    def path(shock, h=15):  # forecasts h steps on after an error of the size of shock in step 1
        level, b, s, out = 0.0, 0.0, [0.0] * 12, []
        for step in range(h):
            e = shock if step == 0 else 0.0
            out.append(level + 0.9 * b + s[0] + e)
            level, b, s = level + 0.9 * b + 0.3 * e, 0.9 * b + 0.1 * e, [*s[1:], s[0] + 0.2 * e]
        return np.array(out)

    psi = path(1.0)
    assert np.allclose(sd, np.sqrt(fit.first().sigma2 * np.cumsum(psi ** 2)))


# --------------------------------------------------------------------- M3 and M4
def seasonal_series(n=96, outlier=None):
    t = np.arange(n)
    y = 200 + 0.5 * t + np.tile([5, -3, 0, 8, -10, 2, 4, -6, 1, 3, -2, -2], n // 12 + 1)[:n] \
        + np.random.default_rng(3).standard_normal(n) * 0.2
    if outlier is not None:
        y[outlier] += 60
    return y


@pytest.mark.parametrize("decompose", [L.stl, lambda *a, **k: L.stl(*a, outer=1, **k), D.x11])
def test_parts_add_up_and_keys_do_not_mix(spark, decompose):
    a, b = seasonal_series(), autoregression([0.5], 70, 3, mean=40)
    both = decompose(frame(spark, {"a": a, "b": b, "short": [1.0] * 20}), "y", keys=["k"]).toPandas()
    assert len(both) == 96 + 70 + 20 and both[both.k == "short"].trend.isna().all()
    full = both[both.k != "short"]
    assert np.allclose(full.trend + full.seasonal + full.remainder, full.y) and np.allclose(full.y - full.seasonal, full.season_adjust)
    alone = decompose(frame(spark, {"a": a}).drop("k"), "y").toPandas().sort_values("month")
    assert np.allclose(both[both.k == "a"].sort_values("month").trend, alone.trend)
    season = alone.seasonal.to_numpy()[36:48]
    assert np.allclose(season, [5, -3, 0, 8, -10, 2, 4, -6, 1, 3, -2, -2], atol=0.5)


@pytest.mark.parametrize("decompose", [lambda *a, **k: L.stl(*a, outer=2, **k), D.x11])
def test_an_outlier_does_not_move_the_season(spark, decompose):
    plain = decompose(frame(spark, {"a": seasonal_series()}), "y", keys=["k"]).orderBy("month").toPandas()
    hit = decompose(frame(spark, {"a": seasonal_series(outlier=50)}), "y", keys=["k"]).orderBy("month").toPandas()
    assert np.abs(plain.seasonal - hit.seasonal).max() < 2 and np.abs(plain.trend - hit.trend).max() < 1.5
    assert hit.remainder[50] > 55


def test_end_filters_keep_lines():
    h13 = D.henderson_weights(13)
    for missing in range(1, 7):
        w = D.end_weights(h13, missing)
        assert len(w) == 13 - missing and sum(w) == pytest.approx(1)
    assert D.end_weights(h13, 0) == pytest.approx(h13)
    for ends in (D.ENDS_3X3, D.ENDS_3X5):
        assert all(sum(w) == pytest.approx(1) for w in ends.values())


def test_decompositions_leave_values_out(spark):
    y = list(seasonal_series())
    y[30] = None
    out = L.stl(frame(spark, {"a": y}), "y", keys=["k"]).orderBy("month").toPandas()
    assert out.remainder.isna().sum() == 1 and out.trend.notna().all()
    assert D.x11(frame(spark, {"a": y}), "y", keys=["k"]).filter("trend is not null").count() == 0


# -------------------------------------------------------------------------- M15
TREE = [[], ["A"], ["B"], ["C"], ["A", "1"], ["A", "2"], ["A", "3"], ["B", "1"], ["C", "1"], ["C", "2"]]
LEAVES = [n for n in TREE if len(n) == 2]
SUMS = np.array([[float(leaf[:len(n)] == n) for leaf in LEAVES] for n in TREE])


def node_frame(spark, values, name="mean"):
    rows = [(n, MONTHS[m], float(values[i, m])) for i, n in enumerate(TREE) for m in range(values.shape[1])]
    return spark.createDataFrame(rows, f"node array<string>, month date, {name} double").repartition(3)


def as_matrix(df):
    got = {(tuple(x.node), x.month): x["mean"] for x in df.collect()}
    months = sorted({m for _, m in got})
    return np.array([[got[tuple(n), m] for m in months] for n in TREE])


@pytest.mark.parametrize("weighted", [False, True])
def test_tree_passes_are_the_projection(spark, weighted):
    r = np.random.default_rng(4)
    y, w = r.standard_normal((len(TREE), 3)) * 10 + 100, r.random(len(TREE)) + 0.2 if weighted else np.ones(len(TREE))
    df = node_frame(spark, y)
    if weighted:
        weights = spark.createDataFrame([(n, float(x)) for n, x in zip(TREE, w)], "node array<string>, w double")
        df = df.join(weights, "node")
    got = as_matrix(REC.least_squares(df, 2, weight="w" if weighted else None))
    want = SUMS @ np.linalg.solve(SUMS.T @ (w[:, None] * SUMS), SUMS.T @ (w[:, None] * y))
    assert np.allclose(got, want)


def test_tree_passes_with_missing_nodes(spark):
    y = np.arange(10.0)[:, None] + 1
    df = node_frame(spark, y).filter("node <> array('A') and not (size(node) = 2 and node[0] = 'C')")
    got = {tuple(x.node): x["mean"] for x in REC.least_squares(df, 2).collect()}
    assert len(got) == 8 and got[("A",)] == pytest.approx(got["A", "1"] + got["A", "2"] + got["A", "3"])
    assert got[()] == pytest.approx(got[("A",)] + got[("B",)] + got[("C",)]) and got[("B",)] == pytest.approx(got["B", "1"])


def shrunken(e):
    """W and its intensity, by pairs of nodes."""
    n, t = e.shape
    c = e @ e.T / t
    sd = np.sqrt(np.diag(c))
    x = e / sd[:, None]
    r = c / np.outer(sd, sd)
    v = ((x * x) @ (x * x).T - (x @ x.T) ** 2 / t) / (t * (t - 1))
    off = ~np.eye(n, dtype=bool)
    s = min(1.0, max(0.0, v[off].sum() / (r[off] ** 2).sum()))
    return s, s * np.diag(np.diag(c)) + (1 - s) * c


def test_shrunken_covariance_is_the_dense_formula(spark):
    r = np.random.default_rng(6)
    e = r.standard_normal((len(TREE), 30)) * (1 + np.arange(len(TREE)))[:, None] + 3 * r.standard_normal(30)
    y = r.standard_normal((len(TREE), 4)) * 10 + 100
    residuals = node_frame(spark, e, "resid")
    extra = spark.createDataFrame([(["A"], MONTHS[50], 5.0), (["B"], MONTHS[51], None)], residuals.schema)
    residuals = residuals.unionByName(extra)  # months that not every node has
    s, w = shrunken(e)
    one = REC.shrinkage(REC.common_errors(residuals)).first()
    assert (one.nodes, one.months) == (10, 30) and one.intensity == pytest.approx(s)
    got = as_matrix(REC.min_trace(node_frame(spark, y), residuals))
    inverse = np.linalg.inv(w)
    want = SUMS @ np.linalg.solve(SUMS.T @ inverse @ SUMS, SUMS.T @ inverse @ y)
    assert np.allclose(got, want) and np.allclose(got, SUMS @ got[4:])
