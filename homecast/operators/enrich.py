"""Lookups, joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import pinned
from .clean import ADDRESS_KEYS, EVENT_SOLD, complete_rows

LOOKUP_MODES = ("first_zip", "zip_region", "all")


def zip_lookup(county_zips: DataFrame, county_regions: DataFrame, mode: str = "all") -> DataFrame:
    """ZIP dimension.

    * ``all``        every (zip, County, Region) pair (report form);
    * ``zip_region`` distinct (zip, Region) (visualisation form);
    * ``first_zip``  distinct, then one ZIP per county: the smallest (app form).
    """
    if mode not in LOOKUP_MODES:
        raise ValueError(mode)
    zr = county_zips.join(county_regions, "County", "left")                      # J3
    if mode == "all":
        return zr.select("zip", "County", "Region")
    if mode == "zip_region":
        return zr.select("zip", "Region").dropDuplicates()                 # X1
    first = zr.dropDuplicates().groupBy("County").agg(                    # W1
        F.min(F.struct("zip", "Region")).alias("f"))
    return first.select(F.col("f.zip").alias("zip"), "County", F.col("f.Region").alias("Region"))


def first_per_group(df: DataFrame, keys, order) -> DataFrame:
    """W1 ``filter(row_number() == 1)`` per group, ordered by ``order``."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_home_info(h: DataFrame, i: DataFrame, how: str = "left") -> DataFrame:
    """Sale rows joined to home info on the four address keys."""
    return h.join(i, ADDRESS_KEYS, how)


def with_zip_lookup(df: DataFrame, zr: DataFrame, how: str = "left") -> DataFrame:
    """ZIP -> County/Region; a ZIP in several counties fans the sale out."""
    return df.join(zr, "zip", how)


def sold_homes(h: DataFrame, i: DataFrame, zr: DataFrame, event: str = EVENT_SOLD,
               dedup: bool = True) -> DataFrame:
    """B4 (app and visualisation form): h ⟕ i ⟕ zr, complete rows, no
    duplicates, one event type.  Column order follows the reference:
    month, zip, street, city, state, Event, price, link, beds, baths, sqft,
    then the lookup columns.

    Joins of tables without duplicates have none when all columns are kept, so each side is
    de-duplicated before the joins: the sales on the address keys, whose hash partitioning
    the de-duplication and the join share, and nothing is shuffled after the lookup's fan-out."""
    h = complete_rows(h).filter(F.col("Event") == event)                   # F3, F4
    i = complete_rows(i)
    if dedup:                                                              # X1
        h = h.repartition(*ADDRESS_KEYS).dropDuplicates()
        i, zr = i.dropDuplicates(), zr.dropDuplicates()
    hi = with_zip_lookup(with_home_info(h, i, "inner"), complete_rows(zr), "inner")
    cols = ["month", "zip", "street", "city", "state", "Event", "price",
            "link", "beds", "baths", "sqft"] + [c for c in zr.columns if c != "zip"]
    return hi.select(*cols)


def sold_homes_report(h_text: DataFrame, i: DataFrame, county_zips: DataFrame,
                      parse_month, parse_price) -> DataFrame:
    """B5 (report form): the event filter first, the info join, complete rows of
    text, then parsing (a price or date that fails to parse stays NULL) and the
    ZIP join (County may stay NULL).  Parsing is by row, so it comes before the
    lookup multiplies the rows.  No de-duplication."""
    sold = h_text.filter(F.col("Event") == EVENT_SOLD)
    si = complete_rows(with_home_info(complete_rows(sold), complete_rows(i), "inner"))
    si = pinned(si.withColumnRenamed("price", "_price"), month=parse_month(F.col("Date")),
                price=parse_price(F.col("_price"))).drop("_price")
    si = with_zip_lookup(si, county_zips.select("zip", "County"))
    return si.select("month", "County", "street", "city", "state", "zip", "Event", "price",
                     "link", "beds", "baths", "sqft")


def natural_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on all common column names."""
    common = [c for c in a.columns if c in set(b.columns)]
    return a.join(b, common, "full")


def pair_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J7 as intended: pair rows of two link lists that share ``key`` (an
    equi-join, never the all-pairs product)."""
    return a.join(b, key)


def remove_visited(work: DataFrame, visited: DataFrame, key: str = "link") -> DataFrame:
    """Drop work items already visited (left anti join)."""
    return work.join(visited.select(key).distinct(), key, "left_anti")


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by column name; columns missing on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """X4 for bags: each row of ``b`` removes one copy from ``a``."""
    return a.exceptAll(b)


def lookup_fanout(df: DataFrame, lookups: dict[str, DataFrame], key: str = "zip") -> DataFrame:
    """How much each lookup join multiplies rows, one row per lookup (``mode``): rows_in (rows
    with a key), rows_out (rows after the inner join = sum of matches per key), the fan-out
    factor and the rows whose key has no match.  One pass over ``df``: the lookups bring one row
    of match counts per key together."""
    tagged = [zr.select(key, F.lit(i).alias("_mode")) for i, zr in enumerate(lookups.values())]
    n = range(len(tagged))
    matches = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(
        *[F.count(F.when(F.col("_mode") == i, 1)).alias(f"_m{i}") for i in n])
    j = df.filter(F.col(key).isNotNull()).select(key).join(matches, key, "left")
    m = [F.coalesce(F.col(f"_m{i}"), F.lit(0)) for i in n]
    one = j.agg(F.count(F.lit(1)).alias("rows_in"), *[F.sum(m[i]).alias(f"_o{i}") for i in n],
                *[F.sum(F.when(m[i] == 0, 1).otherwise(0)).alias(f"_u{i}") for i in n])
    rows = F.explode(F.array(*[F.struct(F.lit(mode).alias("mode"), F.col(f"_o{i}").alias("rows_out"),
                                        F.col(f"_u{i}").alias("rows_unmatched")) for i, mode in enumerate(lookups)]))
    out = one.select("rows_in", rows.alias("_r")).select("rows_in", "_r.rows_out", "_r.rows_unmatched", "_r.mode")
    return out.withColumn("fanout", F.try_divide(F.col("rows_out").cast("double"), F.col("rows_in")))
