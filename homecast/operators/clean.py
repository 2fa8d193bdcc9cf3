"""Cleaning of raw history and home info (B1, B2, B6; P1-P7, F1-F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pages import pinned

ADDRESS_KEYS = ["zip", "street", "city", "state"]
EVENT_SOLD, EVENT_LISTED, EVENT_CHANGE = "Sold", "Listed for sale", "Price change"


def split_history(raw: DataFrame) -> DataFrame:
    """History with the address split and the price token kept as text
    (the report form: street, city, state, zip, Date, Event, price)."""
    d = pinned(raw, _pieces=F.split("address", ", "), _price=T.first_token("Price"))
    street, city, state, zip_ = T.address_parts("_pieces")
    d = pinned(d.select("_pieces", "_price", "Date", "Event"), street=street, city=city, state=state, zip=zip_)
    return d.select("street", "city", "state", "zip", "Date", "Event", F.col("_price").alias("price"))


def clean_history(raw: DataFrame) -> DataFrame:
    """B1: month, zip, street, city, state, Event, price (numeric).  Each text is matched
    once per row, whatever filters follow."""
    d = pinned(raw, _pieces=F.split("address", ", "), _mdy=T.mdy_text("Date"), _money=T.first_token("Price")) \
        .select("Event", "_pieces", "_mdy", "_money")
    street, city, state, zip_ = T.address_parts("_pieces")
    d = pinned(d, month=T.to_month(T.mdy_date("_mdy")), zip=zip_, street=street, city=city, state=state,
               price=T.money_to_double("_money"))
    return d.select("month", "zip", "street", "city", "state", "Event", "price")


def clean_info(raw: DataFrame, require_sqft: bool = True) -> DataFrame:
    """B2: link, street, city, state, zip, beds, baths, sqft of homes with
    positive attributes (F1; F2 when ``require_sqft`` is False)."""
    cols = ["link", *T.split_address("address")]
    df = raw.select(*cols, F.col("beds").cast("int").alias("beds"),
                    F.col("baths").cast("double").alias("baths"),
                    F.col("sqft").cast("double").alias("sqft"))
    cond = (F.col("beds") > 0) & (F.col("baths") > 0)
    if require_sqft:
        cond = cond & (F.col("sqft") > 0)
    return df.filter(cond)


def events(h: DataFrame, name: str) -> DataFrame:
    """rows of one event type."""
    return h.filter(F.col("Event") == name)


def price_changes(raw: DataFrame) -> DataFrame:
    """Price-change rows with the price split into ``to`` and ``pct``."""
    return raw.filter(F.col("Event") == EVENT_CHANGE).select(
        "address", "Date", "Event",
        T.part("Price", " ", 0).alias("to"), T.part("Price", " ", 1).alias("pct"))


def complete_rows(df: DataFrame, subset=None) -> DataFrame:
    """F4 ``complete.cases``: name the columns so Catalyst can turn an
    outer join whose right columns are required into an inner join."""
    cols = list(subset) if subset is not None else df.columns
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """The contiguous column range first..last."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def select_range(df: DataFrame, first: str, last: str, drop=()) -> DataFrame:
    """``select(first:last & !drop)``."""
    return df.select(*[c for c in cols_between(df, first, last) if c not in set(drop)])


def relocate(df: DataFrame, column: str, before: str) -> DataFrame:
    """Move ``column`` in front of ``before``."""
    names = [c for c in df.columns if c != column]
    names.insert(names.index(before), column)
    return df.select(*names)


def rename_by_position(df: DataFrame, position: int, name: str) -> DataFrame:
    """P5: ``colnames(df)[position] <- name`` (1-based as in R)."""
    names = list(df.columns)
    names[position - 1] = name
    return df.toDF(*names)


def history_rejects(h: DataFrame) -> DataFrame:
    """Per event type: rows and rows whose month, price or address failed to
    parse (what ``complete.cases`` later drops), in one aggregate."""
    def bad(c):
        return F.sum(F.when(c, 1).otherwise(0))
    return h.groupBy("Event").agg(
        F.count(F.lit(1)).alias("rows"), bad(F.col("month").isNull()).alias("bad_date"),
        bad(F.col("price").isNull()).alias("bad_price"),
        bad(F.col("zip").isNull() | F.col("state").isNull() | F.col("city").isNull()
            | F.col("street").isNull()).alias("bad_address"))
