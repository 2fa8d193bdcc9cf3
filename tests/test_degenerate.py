"""Every per-key model and series operator runs on degenerate keys: one or
three points, a constant series, all zeros (a real key set contains them)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from homecast.operators import decompose as D
from homecast.operators import forecast as FC
from homecast.operators import quantile as Q
from homecast.operators import regress as R
from homecast.operators import series as S


@pytest.fixture(scope="module")
def df(spark):
    def months(n):
        return [dt.date(2010 + i // 12, i % 12 + 1, 1) for i in range(n)]
    series = {"one": [5.0], "three": [1.0, 2.0, 3.0], "thirteen": list(np.arange(13.0)),
              "const": [7.0] * 40, "zeros": [0.0] * 30,
              "normal": list(100 + np.sin(np.arange(50)))}
    rows = [(k, m, float(v)) for k, ys in series.items() for m, v in zip(months(len(ys)), ys)]
    return spark.createDataFrame(rows, "k string, month date, y double")


CASES = {
    "classical": lambda df: D.classical(df, "y", keys=["k"], kind="multiplicative"),
    "x11": lambda df: D.x11(df, "y", keys=["k"]),
    "trend_report": lambda df: R.trend_report(R.trend_fit(df, "y", keys=["k"]), keys=["k"]),
    "season_fc": lambda df: FC.trend_season_forecast(R.trend_season_fit(df, "y", keys=["k"]), 3, keys=["k"]),
    "trend_fc": lambda df: FC.trend_forecast(R.trend_fit(df, "y", keys=["k"]), 3, keys=["k"]),
    "ols": lambda df: R.ols(S.with_position(df, ["k"], name="t"), "y", ["t"], keys=["k"]),
    "subsets": lambda df: R.best_subsets(S.with_position(df, ["k"], name="t"), "y",
                                         {"t": F.col("t"), "t2": F.col("t") * F.col("t")},
                                         keys=["k"]),
    "acf": lambda df: R.acf(df, keys=["k"], value="y", max_lag=5),
    "hist": lambda df: R.histogram(df, "y", keys=["k"]),
    "fill": lambda df: S.fill_gaps(df, keys=["k"], fill={"y": 0.0}),
    "median": lambda df: Q.median_by(df, ["k"], {"m": "y"}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_runs_on_degenerate_series(df, name):
    out = CASES[name](df).collect()
    assert len(out) > 0
