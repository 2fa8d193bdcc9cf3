"""Parameterised views Q1-Q7: the history and forecast tabs of the app.

Parameters arrive as plain Python values (what a user picks); everything
else stays a lazy DataFrame.  A label chosen in a menu is resolved by a join
with the menu table, not by pulling values to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import autoregress as AR
from ..operators import forecast as FC
from ..operators import regress as R
from ..operators import series as S
from ..operators import smooth as SM

HORIZONS = ("1 year", "3 years", "6 years")
#: Forecast models: fit and forecast of a keyed series.
MODELS = {"trend": (R.trend_fit, FC.trend_forecast), "ar": (AR.ar_fit, AR.ar_forecast), "ets": (SM.ets_fit, SM.ets_forecast)}


def _ahead(series: DataFrame, horizon: str, model: str, keys=()) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"unknown model {model}: one of {', '.join(MODELS)}")
    fit, forecast = MODELS[model]
    return forecast(fit(series, "mean_sale", keys=keys).withColumn("h", T.horizon_months(F.lit(horizon))), "h", keys=keys)


class App:
    """``si`` is the sold-home fact (app form); ``ts`` the statewide model
    input (B7).  With ``cache=True`` the fact is persisted once (memory, then
    disk), as an interactive session serving many views should do; lost
    blocks are recomputed from lineage."""

    def __init__(self, si: DataFrame, ts: DataFrame | None = None, cache: bool = False):
        if cache:
            from pyspark import StorageLevel
            si = si.persist(StorageLevel.MEMORY_AND_DISK)
        self.si = si
        self.ts = ts
        self.options = A.menu_options(si)

    # Q1
    def county_menu(self) -> DataFrame:
        return A.sorted_distinct(self.options, "County")

    # Q2
    def bed_bath_menu(self, county: str) -> DataFrame:
        return self.options.filter(F.col("County") == county).select("bdba").orderBy("bdba")

    # Q3
    def resolve(self, county: str, bdba: str) -> DataFrame:
        """beds and baths (typed) of the chosen label."""
        o = self.options.filter((F.col("County") == county) & (F.col("bdba") == bdba))
        return o.select("County", F.col("beds").try_cast("int").alias("beds"),
                        F.col("baths").try_cast("double").alias("baths"))

    def chosen(self, county: str, bdba: str) -> Column:
        """The condition of a label's sales, on their typed columns."""
        return (F.col("County") == county) & (T.bed_bath_label("beds", "baths") == bdba)

    # Q4
    def size_slider(self, county: str, bdba: str) -> DataFrame:
        """Least and largest size of the selection; NULLs if it is no menu entry."""
        found = self.si.filter(self.chosen(county, bdba)).agg(
            F.min("sqft").alias("_lo"), F.max("sqft").alias("_hi"), F.count_distinct("month").alias("_n"))
        listed = F.col("_n") >= A.MIN_MONTHS_PER_OPTION
        return found.select(F.when(listed, F.col("_lo")).alias("mini"), F.when(listed, F.col("_hi")).alias("maxi"))

    def selected_series(self, county: str, bdba: str, sqft_range=None) -> DataFrame:
        """Monthly mean sale of the selection (F5, F6): one pass over the fact.  Whether the
        label is a menu entry shows in its months, before the size range applies."""
        sold = self.si.filter(self.chosen(county, bdba))
        inside = F.lit(True) if sqft_range is None else F.col("sqft").between(*sqft_range)
        price = F.when(inside, F.col("price"))
        m = sold.groupBy("month").agg(A.money_mean(price).alias("mean_sale"), F.count(F.when(inside, 1)).alias("_sales"))
        m = m.withColumn("_months", F.count(F.lit(1)).over(Window.partitionBy()))
        return m.filter((F.col("_months") >= A.MIN_MONTHS_PER_OPTION) & (F.col("_sales") > 0)).select("month", "mean_sale")

    # Q5
    def history(self, county: str, bdba: str, sqft_range=None) -> DataFrame:
        """Monthly mean of the selection with its display columns."""
        m = self.selected_series(county, bdba, sqft_range)
        return m.select("month", "mean_sale", T.month_label("month").alias("Date"),
                        T.dollar_column("mean_sale").alias("mean_sale_text"))

    # Q6
    def forecast(self, horizon: str, county=None, bdba=None, sqft_range=None,
                 scope: str = "global", model: str = "trend") -> DataFrame:
        """Forecast of the mean sale price ``horizon`` ahead ('1 year' ...) by ``model``
        (``MODELS``: trend, ar, ets).  ``global`` fits the statewide series; ``selection`` fits
        the selected series itself."""
        if scope == "global":
            series = self.ts.select("month", "mean_sale")
        else:
            series = S.fill_gaps(self.selected_series(county, bdba, sqft_range), fill={"mean_sale": 0.0})
        return _ahead(series, horizon, model)

    def forecast_menu(self, horizon: str, model: str = "ar") -> DataFrame:
        """Forecasts of every menu entry's own series, all in one job: County, bdba, month,
        mean, bands."""
        keys = ["County", "beds", "baths"]
        m = A.mean_series(self.si, keys=keys)
        m = m.withColumn("_months", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(
            F.col("_months") >= A.MIN_MONTHS_PER_OPTION).drop("_months")
        fc = _ahead(S.fill_gaps(m, keys=keys, fill={"mean_sale": 0.0}), horizon, model, keys)
        return fc.select("County", T.bed_bath_label("beds", "baths").alias("bdba"),
                         *[c for c in fc.columns if c not in keys])

    # Q7
    def forecast_table(self, horizon: str, county: str, bdba: str, sqft_range=None,
                       scope: str = "global", model: str = "trend") -> DataFrame:
        """Projected month, difference from the selection's last sale, price."""
        last = S.last_observation(self.selected_series(county, bdba, sqft_range))
        fc = self.forecast(horizon, county, bdba, sqft_range, scope, model)
        # The last sale (one row) reaches the forecast rows through a window
        # over the horizon-sized union, not a join.
        u = fc.select("month", "mean", F.lit(None).cast("date").alias("base_month"),
                      F.lit(None).cast("double").alias("last_sale")).unionByName(
            last.select(F.lit(None).cast("date").alias("month"),
                        F.lit(None).cast("double").alias("mean"),
                        F.col("month").alias("base_month"), F.col("mean_sale").alias("last_sale")))
        wall = Window.partitionBy()
        j = u.select("month", "mean", F.max("base_month").over(wall).alias("base_month"),
                     F.max("last_sale").over(wall).alias("last_sale")).filter(
            F.col("month").isNotNull())
        diff = F.col("mean") - F.col("last_sale")
        return j.select("month", T.month_label("month").alias("Date"),
                        diff.alias("price_diff"), T.dollar_column(diff).alias("price_diff_text"),
                        F.col("mean").alias("total_sale"),
                        T.dollar_column("mean").alias("total_sale_text"),
                        T.month_label("base_month").alias("base_month"))
