"""Aggregations A1-A23.

Every aggregate is a declarative ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate, one hash exchange on the grouping keys and a final
aggregate: a hot month or region is pre-reduced in every task before the
shuffle, so no task ever holds a whole group.  Exact medians go through
``quantile.median_by`` which also never gathers a group in one task.

Money columns, named by the argument ``money``, are summed exactly in cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import quantile

# Fixed value: the price-per-square-foot outlier excluded by the reports.
PRICE_SQFT_OUTLIER = 75000.0
MIN_MONTHS_PER_OPTION = 3


MONEY = "decimal(20,2)"


def money_sum(c: str | Column) -> Column:
    """Sum of a money column, exact in cents (order-independent)."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(MONEY)).cast("double")


def money_mean(c: str | Column) -> Column:
    """Mean of a money column from the exact cent sum: bit-identical however
    the rows are partitioned or ordered."""
    return money_sum(c) / F.count(c)


MONEY_COLUMNS = ("price",)


def _mean(c: str, money) -> Column:
    return money_mean(c) if c in money else F.avg(c)


def by_period(df: DataFrame, keys=(), period: str = "month", index: str = "month") -> DataFrame:
    """Re-index sales to a coarser period: month (as is), quarter or year."""
    if period == "month":
        return df
    expr = {"quarter": T.to_quarter(index), "year": T.to_year(index)}[period]
    return df.withColumn(period, expr)


def mean_series(df: DataFrame, keys=(), value: str = "price", name: str = "mean_sale",
                index: str = "month", na_rm: bool = True, money=MONEY_COLUMNS) -> DataFrame:
    """Mean of ``value`` per (index, keys).  With
    ``na_rm=False`` a group holding a NULL gets a NULL mean, as R's ``mean``."""
    m = _mean(value, money)
    if not na_rm:
        m = F.when(F.count(F.lit(1)) == F.count(value), m)
    return df.groupBy(index, *keys).agg(m.alias(name))


def means(df: DataFrame, measures: dict[str, str], keys=(), index: str = "month", money=MONEY_COLUMNS) -> DataFrame:
    """Several means in one pass; ``measures`` maps output -> input column."""
    return df.groupBy(index, *keys).agg(*[_mean(c, money).alias(n) for n, c in measures.items()])


def r_sum(c: str, money=MONEY_COLUMNS) -> Column:
    """R's ``sum`` without ``na.rm``: NULL as soon as one input is NULL."""
    total = money_sum(c) if c in money else F.sum(c)
    return F.when(F.count(F.lit(1)) == F.count(c), total)


def total_and_count(df: DataFrame, keys=(), value: str = "price", index: str = "month",
                    na_rm: bool = True, money=MONEY_COLUMNS) -> DataFrame:
    """total_sales and count_sales per (index, keys)."""
    total = (money_sum(value) if value in money else F.sum(value)) if na_rm else r_sum(value, money)
    return df.groupBy(index, *keys).agg(total.alias("total_sales"),
                                        F.count(F.lit(1)).alias("count_sales"))


def count_series(df: DataFrame, keys=(), index: str = "month") -> DataFrame:
    """Number of sales per (index, keys)."""
    return df.groupBy(index, *keys).agg(F.count(F.lit(1)).alias("count_sales"))


def median_series(df: DataFrame, keys=(), value: str = "price", name: str = "median_sale",
                  index: str = "month", method: str = "exact") -> DataFrame:
    """Median per (index, keys).  ``exact`` interpolates
    between the two middle values; ``builtin`` is Spark's aggregate."""
    return quantile.median_by(df, [index, *keys], {name: value}, method=method)


def medians(df: DataFrame, measures: dict[str, str], keys=(), index: str = "month",
            method: str = "exact") -> DataFrame:
    """Medians of several measures per (index, keys)."""
    return quantile.median_by(df, [index, *keys], measures, method=method)


def with_size_bucket(df: DataFrame, sqft: str = "sqft") -> DataFrame:
    """C9 column ``sq_int``."""
    return df.withColumn("sq_int", T.size_bucket(sqft))


def menu_options(si: DataFrame, min_months: int = MIN_MONTHS_PER_OPTION) -> DataFrame:
    """A17 + F8 + C10 + C15: (beds, baths, County) with sales in at least
    ``min_months`` distinct months, plus the 'b beds, c baths' label.  The
    reference's two-step aggregate computes a mean it never uses; counting
    distinct months is the same answer in one aggregate."""
    opts = (si.groupBy("beds", "baths", "County")
              .agg(F.count_distinct("month").alias("n"))
              .filter(F.col("n") >= min_months))
    return opts.select(T.as_factor("beds").alias("beds"), T.as_factor("baths").alias("baths"),
                       "County", T.bed_bath_label("beds", "baths").alias("bdba"))


def size_bounds(si: DataFrame, keys=("County", "beds", "baths")) -> DataFrame:
    """Min and max size for every selection key at once."""
    return si.groupBy(*keys).agg(F.min("sqft").alias("mini"), F.max("sqft").alias("maxi"))


def price_per_sqft_series(si: DataFrame, outlier: float = PRICE_SQFT_OUTLIER) -> DataFrame:
    """Monthly mean price per square foot without the outlier value."""
    d = si.withColumn("price_sqft", T.price_per_sqft("price", "sqft"))
    d = d.filter(F.col("price_sqft") != F.lit(outlier))
    return d.groupBy("month").agg(F.avg("price_sqft").alias("mean_pricesqft"))


def cpi_adjusted(si: DataFrame, cpi: DataFrame) -> DataFrame:
    """J5 + C13: sales with ``price_adj``; CPI has one row per month."""
    return si.join(cpi, "month", "left").withColumn("price_adj", T.cpi_adjust("price", "Index"))


def nominal_and_adjusted(sales_adj: DataFrame) -> DataFrame:
    """Monthly mean nominal and CPI-adjusted price of complete rows."""
    from .clean import complete_rows
    return complete_rows(sales_adj).groupBy("month").agg(
        money_mean("price").alias("mean_sale"), F.avg("price_adj").alias("mean_adj"))


def unpivot_measures(df: DataFrame, ids, measures, name: str = "name",
                     value: str = "Price") -> DataFrame:
    """P10 ``pivot_longer``."""
    return df.unpivot(list(ids), list(measures), name, value)


def selection(si: DataFrame, county=None, beds=None, baths=None, sqft_range=None) -> DataFrame:
    """F5 + F6: the app's selection filter; a None parameter is not applied."""
    cond = F.lit(True)
    if county is not None:
        cond = cond & (F.col("County") == county)
    if beds is not None:
        cond = cond & (F.col("beds") == beds)
    if baths is not None:
        cond = cond & (F.col("baths") == baths)
    if sqft_range is not None:
        cond = cond & F.col("sqft").between(sqft_range[0], sqft_range[1])
    return si.filter(cond)


def selection_mean(si: DataFrame, **params) -> DataFrame:
    """Monthly mean of the selected homes."""
    return mean_series(selection(si, **params))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    """A22 ``levels(as.factor(x))``."""
    return df.select(column).distinct().orderBy(column)


def hierarchy_totals(si: DataFrame, levels=("Region", "County"), value: str = "price",
                     index: str = "month") -> DataFrame:
    """Totals for every node of the hierarchy (all, Region, Region/County)
    in one ROLLUP; ``level`` is the grouping id (0 = leaf)."""
    g = si.rollup(index, *levels).agg(
        money_sum(value).alias("total_sales"), F.count(F.lit(1)).alias("count_sales"),
        F.grouping_id().cast("int").alias("level"), F.grouping(index).alias("_gi"))
    return g.filter(F.col("_gi") == 0).drop("_gi")


def require_sales(selected: DataFrame) -> DataFrame:
    """one row saying how many sales a selection has, and whether it has any."""
    return selected.agg(F.count(F.lit(1)).alias("n_sales")).withColumn("has_sales", F.col("n_sales") > 0)
