"""Explicit schemas of the inputs and derived tables (never inferred)."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


HISTORY_RAW = _s(("address", StringType()), ("Date", StringType()),
                 ("Event", StringType()), ("Price", StringType()))

INFO_RAW = _s(("link", StringType()), ("address", StringType()), ("list_price", StringType()),
              ("beds", IntegerType()), ("baths", DoubleType()), ("sqft", DoubleType()))

# ZIP is text: leading zeros and ZIP+4 must survive the read.
COUNTY_ZIPS = _s(("County", StringType()), ("Zip", StringType()))
COUNTY_REGIONS = _s(("County", StringType()), ("Region", StringType()))
CPI_RAW = _s(("Date", StringType()), ("Index", DoubleType()))
LINK_LIST = _s(("idx", StringType()), ("0", StringType()))

HOUSE_SAMPLE = _s(*[(c, IntegerType()) for c in (
    "ID", "Price", "Sqft", "Bedroom", "Bathroom", "Airconditioning", "Garage", "Pool",
    "YearBuild", "Quality", "Lot", "AdjHighway")])
