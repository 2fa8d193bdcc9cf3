"""The distributed exact median equals numpy's, also when groups need several
rounds, one group holds most rows, or values are extreme."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from homecast.operators import quantile as Q


def test_exact_median_of_odd_groups(spark):
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.lognormal(12, 1, 30000), "even": rng.normal(0, 1, 20000), "ties": np.repeat([5.0, 7.0], 5000),
        "few ties": np.repeat([5.0, 7.0], 500), "same": np.full(9000, 3.5),
        "spread": np.r_[rng.normal(0, 1, 998), 1e300, -1.7e308], "one": [3.0], "nulls": [np.nan, np.nan],
        "denormal": rng.integers(0, 40, 5001) * 5e-324, "infinite": np.r_[np.full(3000, -np.inf), np.full(3000, np.inf), 1, 2],
        "log": 10.0 ** rng.uniform(-300, 300, 12001)}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    x = spark.createDataFrame(pdf).select("g", F.when(~F.isnan("v"), F.col("v")).alias("_v"))
    got = {r.g: r._q for r in Q.exact_quantile_long(x, ["g"]).collect()}
    for g, v in groups.items():
        v = np.asarray(v)[~np.isnan(v)]
        assert got[g] == (np.median(v) if len(v) else None), g


def test_other_quantiles_and_null_keys(spark):
    rng = np.random.default_rng(3)
    v = rng.exponential(size=7001)
    df = spark.createDataFrame([(None, float(x)) for x in v], "k string, v double")
    for q in (0.0, 0.1, 0.999, 1.0):
        got = Q.median_by(df, ["k"], {"m": "v"}, q=q).first().m
        assert abs(got - np.quantile(v, q)) < 1e-12


def test_median_by_several_measures(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 1, 2, 2], "a": [1.0, 2.0, 4.0, 10.0, 5.0, 6.0],
                        "b": [4, 3, 2, 1, 9, 9]})
    got = Q.median_by(spark.createDataFrame(pdf), ["k"], {"ma": "a", "mb": "b"}).orderBy("k").collect()
    assert [(r.ma, r.mb) for r in got] == [(3.0, 2.5), (5.5, 9.0)]


def test_rounds_on_pipeline_equal_builtin(spark, monkeypatch):
    from homecast.plans.pipeline import Pipeline
    si = Pipeline(spark, "/root/testdata/sf0.01").sold("viz")
    monkeypatch.setattr(Q, "GRID", 64)       # months hold ~70 sales: forces a second round
    mp = Q.median_by(si, ["month", "Region"], {"m": "price"})
    bi = Q.median_by(si, ["month", "Region"], {"m": "price"}, method="builtin")
    bad = mp.join(bi.withColumnRenamed("m", "b"), ["month", "Region"], "full") \
            .filter(~F.col("m").eqNullSafe(F.col("b")))
    assert mp.count() == bi.count() and bad.count() == 0
