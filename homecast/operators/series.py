"""Series operators W1-W16: declare, gap-fill, lag, order, sample, page.

A series is a DataFrame (keys..., index, measures...).  Every ordered
kernel is a window partitioned by the keys, so a key's rows stay together
and keys spread across tasks.  These run after the monthly aggregate, where
a key holds at most one row per month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

STEPS = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS"}


def series_duplicates(df: DataFrame, keys=(), index: str = "month") -> DataFrame:
    """(keys, index) pairs present more than once (must be empty)."""
    return df.groupBy(*keys, index).count().filter("count > 1")


def assert_series(df: DataFrame, keys=(), index: str = "month") -> DataFrame:
    """W2 ``as_tsibble``: raise if (keys, index) is not unique; returns ``df``."""
    bad = series_duplicates(df, keys, index).limit(1).count()
    if bad:
        raise ValueError(f"duplicate ({', '.join([*keys, index])}) rows: not a series")
    return df


def fill_gaps(df: DataFrame, keys=(), index: str = "month", step: str = "month",
              fill: dict | None = None, bounds: tuple | None = None) -> DataFrame:
    """W4 / W5 ``fill_gaps``: one row per key and step from the key's first to
    last index.  Missing rows get ``fill`` values (W4) or NULLs (W5).
    ``step`` is 'month', 'quarter' or 'year' (integer index).  With
    ``bounds`` (two values: first and last index) every key spans that
    common range instead, as a hierarchy needs.

    Single pass: each row looks at its neighbours (``lag``/``lead``) and
    expands to itself plus the missing steps up to the next row, so the
    series is read once and no calendar is joined back."""
    keys = list(keys)
    fill = fill or {}
    measures = [c for c in df.columns if c not in set(keys) | {index}]
    w = Window.partitionBy(*keys).orderBy(index)
    df = df.select("*", F.lag(index).over(w).alias("_prev"), F.lead(index).over(w).alias("_next"))
    if bounds is not None:
        lo, hi = F.lit(bounds[0]), F.lit(bounds[1])
    else:
        lo = hi = F.col(index)
    start = F.when(F.col("_prev").isNull(), F.least(lo, F.col(index))).otherwise(F.col(index))
    if step == "year":
        end = F.when(F.col("_next").isNull(), F.greatest(hi, F.col(index))) \
            .otherwise(F.col("_next") - 1)
        seq = F.sequence(start, end)
    else:
        months = 3 if step == "quarter" else 1
        end = F.when(F.col("_next").isNull(), F.greatest(hi, F.col(index))) \
            .otherwise(F.add_months(F.col("_next"), -months))
        seq = F.sequence(start, end, F.expr(STEPS[step]))
    g = df.select(*keys, index, *measures, F.explode(seq).alias("_idx"))
    own = F.col("_idx") == F.col(index)
    cols = []
    for m in measures:
        typ = df.schema[m].dataType
        gap = F.lit(fill[m]).cast(typ) if m in fill else F.lit(None).cast(typ)
        cols.append(F.when(own, F.col(m)).otherwise(gap).alias(m))
    return g.select(*keys, F.col("_idx").alias(index), *cols)


def with_position(df: DataFrame, keys=(), index: str = "month", name: str = "t") -> DataFrame:
    """Row number (1-based) of each observation within its key."""
    w = Window.partitionBy(*keys).orderBy(index)
    return df.withColumn(name, F.row_number().over(w))


def with_lags(df: DataFrame, value: str, lags=(1,), keys=(), index: str = "month",
              diff: bool = False) -> DataFrame:
    """Lagged values (or differences) per key."""
    w = Window.partitionBy(*keys).orderBy(index)
    for k in lags:
        lagged = F.lag(value, k).over(w)
        df = df.withColumn(f"{value}_{'d' if diff else 'l'}{k}",
                           F.col(value) - lagged if diff else lagged)
    return df


def last_observation(df: DataFrame, keys=(), index: str = "month") -> DataFrame:
    """W9 / F9 ``filter(Date == max(Date))`` per key, keeping ties."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_mx", F.max(index).over(w)).filter(F.col(index) == F.col("_mx")) \
             .drop("_mx")


def ordered(df: DataFrame, keys=(), index: str = "month") -> DataFrame:
    """Order by key and index (only at the output edge)."""
    return df.orderBy(*keys, index)


def seeded_hash(column: str, seed: int = 42) -> Column:
    """Repeatable pseudo-random sort key: md5 of the value and the seed (the
    same digest in any engine, so samples can be checked independently)."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"#{seed}")))


def shuffled(df: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """W11 ``random.shuffle``: a repeatable random order, as ``position`` (from 1).  The global
    sort takes its splits from a sample of the rows themselves (hash, then the values), so
    there are as many splits as the table needs and rows of equal hash are divided too.  The
    sorted rows are written once; a split's rows are counted on from those of the splits
    before it."""
    order = df.withColumn("_h", seeded_hash(column, seed)).orderBy("_h", column, *df.columns)
    rows = written(order.select(*df.columns, F.monotonically_increasing_id().alias("_id")))
    split, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("_n")).select(  # a row per split
        "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_split", split).join(starts, "_split").select(
        *df.columns, (F.col("_before") + place + 1).alias("position"))


def sample_per_group(df: DataFrame, group: str, n: int, order_col: str,
                     seed: int = 42) -> DataFrame:
    """At most ``n`` rows per group, chosen by a seeded hash (a sampling
    operator: the cap is the feature).  ``row_number() <= n`` lets Spark plan a
    partial WindowGroupLimit before the shuffle, so no task receives more than
    ``n`` rows per group from each map task."""
    w = Window.partitionBy(group).orderBy(seeded_hash(order_col, seed), order_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """W13."""
    return df.limit(n)


def page(df: DataFrame, order, page_no: int = 1, page_size: int = 10) -> DataFrame:
    """One page of a sorted result table."""
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def row_count(df: DataFrame) -> DataFrame:
    """W15 as a one-row DataFrame (stays lazy)."""
    return df.agg(F.count(F.lit(1)).alias("n"))
