"""Exact quantiles (medians) per group without gathering a group in one task.

Spark's ``percentile``/``median`` aggregate merges every distinct value of a group into one
buffer, so a hot month would land in one task.  Here the order statistic is found by
narrowing a bracket, all steps being partial aggregates:

1. per group, a bounded sketch gives ``GRID + 1`` evenly spaced approximate quantiles of the
   values inside the bracket (at first: all values);
2. the target rank lies between two of them, a step of the grid further out than its place
   says (the sketch's error is a tenth of a step).  The values below, at, between and above
   the two are counted exactly.  If the rank falls on one of the two, the group is done;
   otherwise the values strictly between them are the new bracket.

A bracket of up to ``GRID / 4`` values needs no second step: grid and sketch then tell single
ranks apart, and the two targets are grid values.  Every round leaves about a 500th of a
larger bracket and at least one value fewer, so the rounds end by themselves: two for a
group of a million values, three for one of 10 ** 9.  Values are only compared, so
infinities and denormals need no care.

The answer interpolates ``v[k1] + frac * (v[k2] - v[k1])`` like Spark's ``percentile`` and
DuckDB's ``quantile_cont``.  The (keys, value) projection is written once to the shared folder;
groups meet it in a join on salted keys, so no group's values meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

GRID = 2048
#: The sketch's rank error is a share of 1 / ACCURACY of the bracket.
ACCURACY = 20_000
SALTS = 16


def _value(col: str) -> Column:
    """The measure as a double; NaN counts as missing, like NULL."""
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v)


def _long_input(df: DataFrame, keys, measures: dict) -> DataFrame:
    items = list(measures.items())
    if len(items) == 1:
        name, col = items[0]
        return df.select(*keys, F.lit(name).alias("_m"), _value(col).alias("_v"))
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("_m"), _value(c).alias("_v"))
                            for n, c in items])).alias("_s")
    return df.select(*keys, s).select(*keys, "_s._m", "_s._v")


def _inside(x: DataFrame, state: DataFrame, keys, *columns: str) -> DataFrame:
    """Rows of ``x`` with the state of their group; NULL keys match."""
    salted = state.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *columns,
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s2"))
    on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    on.append(F.pmod(F.xxhash64("_v"), F.lit(SALTS)) == F.col("_s2").cast("long"))
    return x.join(salted, reduce(lambda a, b: a & b, on)).drop("_s2", *[f"_g{i}" for i in range(len(keys))])


def _sketch(value: str) -> Column:
    steps = ", ".join(f"{k / GRID}D" for k in range(GRID + 1))
    return F.expr(f"percentile_approx({value}, array({steps}), {ACCURACY})").alias("grid")


def exact_quantile_long(x: DataFrame, keys, q: float = 0.5) -> DataFrame:
    """``x`` has columns keys + ``_v``; returns keys + ``_q`` (one row per group).  Runs one
    job per round; ``x`` is read in each."""
    keys = list(keys)
    pos = (F.col("cnt") - 1) * F.lit(q)
    none = F.lit(None).cast("double")
    state = x.groupBy(*keys).agg(F.count("_v").alias("cnt"), F.min("_v").alias("first"),
                                 F.max("_v").alias("last"), _sketch("_v"))
    state = state.select(
        *keys, "cnt", "first", "last", "grid", F.floor(pos).alias("k1"), F.ceil(pos).alias("k2"),
        (pos - F.floor(pos)).alias("frac"), none.alias("above"), none.alias("v1"), none.alias("v2"))
    done = []

    def place(rank: Column) -> Column:
        return F.floor((rank + 0.5) / F.col("cnt") * GRID).cast("int")

    while True:
        state = written(state)
        few = (F.col("cnt") <= GRID // 4) | (F.col("first") == F.col("last"))
        v1 = F.coalesce("v1", F.get("grid", place(F.col("k1")) + 1))
        v2 = F.coalesce("v2", F.when(F.col("k2") < F.col("cnt"), F.get("grid", place(F.col("k2")) + 1))
                        .otherwise(F.col("above")))
        value = F.when((F.col("frac") == 0) | (v1 == v2), v1).otherwise(v1 + F.col("frac") * (v2 - v1))
        ready = F.col("v1").isNotNull() | few
        done.append(state.filter(ready).select(*keys, F.when(F.col("v1").isNotNull() | (F.col("cnt") > 0), value).alias("_q")))
        state = state.filter(~ready)
        if state.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
        bracket = state.select(
            *keys, "k1", "k2", "frac", "first", "last", F.col("above").alias("next"),
            F.get("grid", F.greatest(place(F.col("k1")) - 1, F.lit(0))).alias("lo"),
            F.get("grid", F.least(place(F.col("k1")) + 3, F.lit(GRID))).alias("hi"))
        known = ["k1", "k2", "frac", "next", "lo", "hi"]
        v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
        rows = _inside(x, bracket, keys, *known, "first", "last").filter(v.between(F.col("first"), F.col("last")))
        rows = rows.withColumn("_in", F.when((v > lo) & (v < hi), v))
        counted = rows.groupBy(*keys, *known).agg(
            F.count(F.when(v < lo, 1)).alias("n_below"), F.count(F.when(v == lo, 1)).alias("n_lo"),
            F.count("_in").alias("cnt"), F.count(F.when((v == hi) & (hi > lo), 1)).alias("n_hi"),
            F.min("_in").alias("first"), F.max("_in").alias("last"),
            F.min(F.when(v > hi, v)).alias("over"), _sketch("_in"))
        inner = F.col("n_below") + F.col("n_lo")
        upper = inner + F.col("cnt")
        top = upper + F.col("n_hi")

        def at(rank: Column) -> Column:
            """The value at ``rank`` if it is lo, hi or the one next above hi."""
            return F.when(rank < F.col("n_below"), F.raise_error(F.lit("rank below the bracket")).cast("double")) \
                .when(rank < inner, lo).when(rank < upper, F.lit(None)).when(rank < top, hi) \
                .when(rank == top, F.coalesce("over", "next")) \
                .otherwise(F.raise_error(F.lit("rank above the bracket")).cast("double"))

        k1, k2 = F.col("k1"), F.col("k2")
        after = F.when((k1 < inner) & (k2 == inner) & (F.col("cnt") > 0), F.col("first")).otherwise(at(k2))
        found = at(k1)
        state = counted.select(
            *keys, "cnt", "first", "last", "grid", (k1 - inner).alias("k1"), (k2 - inner).alias("k2"), "frac",
            hi.alias("above"), found.alias("v1"), F.when(found.isNotNull(), after).alias("v2"))


def median_by(df: DataFrame, keys, measures: dict, method: str = "exact",
              q: float = 0.5) -> DataFrame:
    """Quantile ``q`` (median by default) of each measure per group.
    ``measures`` maps output name -> input column.  ``builtin`` is Spark's aggregate (a
    group per buffer), for comparison."""
    if method not in ("exact", "builtin"):
        raise ValueError(f"unknown method {method}: exact or builtin")
    keys = list(keys)
    if method == "builtin":
        return df.groupBy(*keys).agg(*[
            F.percentile(F.col(c).cast("double"), F.lit(q)).alias(n) for n, c in measures.items()])
    res = exact_quantile_long(written(_long_input(df, keys, measures)), [*keys, "_m"], q)
    if len(measures) == 1:
        (name, _), = measures.items()
        return res.select(*keys, F.col("_q").alias(name))
    return res.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_m") == n, F.col("_q"))).alias(n) for n in measures])
