"""Scalar functions C1-C19 as Column expressions.

All of them are null-tolerant under ANSI mode: ``get`` instead of ``[]``,
``try_cast`` / ``try_to_date`` / ``try_divide`` instead of the throwing forms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size buckets and their labels, prediction-band quantiles.
SIZE_BUCKETS = ("0-1000 sqft", "1000-1500 sqft", "1500+ sqft")
Z80, Z95 = 1.2815515655446004, 1.959963984540054


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(text, sep: str, i: int) -> Column:
    """i-th (zero-based) piece of ``text`` split on the regex ``sep``; NULL when
    missing, extra pieces ignored (C1, C2, C3, C4)."""
    return F.get(F.split(_c(text), sep), i)


def split_address(address="address") -> list[Column]:
    """C1 + C2: 'street, city, ST zip' -> street, city, state, zip."""
    return address_parts(F.split(_c(address), ", "))


def address_parts(pieces) -> list[Column]:
    """street, city, state, zip from the address split at ', '."""
    p = _c(pieces)
    statezip = F.split(F.get(p, 2), " ")
    return [F.get(p, 0).alias("street"), F.get(p, 1).alias("city"),
            F.get(statezip, 0).alias("state"), F.get(statezip, 1).alias("zip")]


def money_to_double(text) -> Column:
    """Strip '$' and ',' then parse; bad text -> NULL."""
    return F.regexp_replace(_c(text), "[$,]", "").try_cast("double")


def first_token(text) -> Column:
    """Keep the first space-separated token (price of '$1,234 (-3%)')."""
    return part(text, " ", 0)


MDY = r"^=\s*([0-9]{1,2})[-/. ,]+([0-9]{1,2})[-/. ,]+([0-9]{4}|[0-9]{2})\s*$"
YMD = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
# Fixed value: two-digit years from here on are of the 1900s, smaller ones of the 2000s.
CENTURY_FROM = 69


def mdy_text(text) -> Column:
    """The date as ``#year-month-day`` text by one match; any other text comes back with ``=``
    in front."""
    return F.regexp_replace(F.concat(F.lit("="), _c(text)), MDY, "#$3-$1-$2")


def mdy_date(marked) -> Column:
    """DATE from ``mdy_text``; NULL where the mark is missing or the day does not exist."""
    t = _c(marked)
    short = t.like("#__-%")
    date = F.try_to_date(F.when(t.like("#%"), F.when(short, F.concat(
        F.when(t >= F.lit(f"#{CENTURY_FROM}"), "19").otherwise("20"), F.substring(t, 2, 99))).otherwise(F.substring(t, 2, 99))),
        "yyyy-M-d")
    return date


def parse_mdy(text) -> Column:
    """C6 mdy(): month, day and year (four digits, or two) with '/', '-', '.', ',' or blanks
    between them -> DATE; anything else NULL."""
    return mdy_date(mdy_text(text))


def parse_ymd(text) -> Column:
    """C6 ymd()."""
    t = _c(text)
    return F.when(t.rlike(YMD), F.try_to_date(t, "yyyy-M-d"))


def to_month(d) -> Column:
    """C7 yearmonth: first day of the month as DATE (works on date and timestamp_ntz)."""
    return F.trunc(_c(d), "MM")


def to_quarter(d) -> Column:
    return F.trunc(_c(d), "quarter")


def to_year(d) -> Column:
    return F.year(_c(d))


def month_label(d) -> Column:
    """Yearmonth printed as '2022 Apr'."""
    return F.date_format(_c(d), "yyyy MMM")


def size_bucket(sqft="sqft") -> Column:
    """<=1000, (1000,1500), >=1500; NULL size -> NULL bucket."""
    s = _c(sqft)
    return (F.when(s <= 1000, SIZE_BUCKETS[0])
            .when((s > 1000) & (s < 1500), SIZE_BUCKETS[1])
            .when(s >= 1500, SIZE_BUCKETS[2]))


def number_text(x) -> Column:
    """R's paste0 of a number: 2.0 -> '2', 2.5 -> '2.5'."""
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def bed_bath_label(beds="beds", baths="baths") -> Column:
    """C10: 'b beds, c baths'."""
    return F.concat(number_text(beds), F.lit(" beds, "), number_text(baths), F.lit(" baths"))


def dollar(x) -> Column:
    """C11 for one value: '$1,234' / '-$1,234' (rounded to whole dollars)."""
    v = F.round(_c(x).cast("decimal(38,10)"), 0).cast("double")
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 0))


# Fixed value: the largest amount still printed with cents by the money formatter.
LARGEST_WITH_CENTS = 100000


def dollar_column(x, over=None) -> Column:
    """C11 applied to a whole column, like the money formatter of the reports:
    cents are shown only when every value is at most 100,000 and not all
    values are whole dollars.  ``over`` is the window spanning the column
    (default: the whole result, meant for small view tables)."""
    from pyspark.sql import Window
    w = over if over is not None else Window.partitionBy()
    v = _c(x)
    cents = (F.max(F.abs(v)).over(w) <= LARGEST_WITH_CENTS) & \
        (F.max(F.when(v != F.floor(v), 1).otherwise(0)).over(w) == 1)
    r2 = F.round(v.cast("decimal(38,10)"), 2)
    with_cents = F.concat(F.when(r2 < 0, "-").otherwise(""), F.lit("$"),
                          F.format_number(F.abs(r2).cast("double"), 2))
    return F.when(cents, with_cents).otherwise(dollar(v))


def price_per_sqft(price="price", sqft="sqft") -> Column:
    """Guarded division (NULL for a zero or NULL size)."""
    return F.try_divide(_c(price), _c(sqft))


def cpi_adjust(price="price", index="Index") -> Column:
    """Price / Index * 100."""
    return F.try_divide(_c(price), _c(index)) * 100


def digits_only(text) -> Column:
    """Keep only the digits and parse."""
    return F.regexp_replace(_c(text), "[^0-9]", "").try_cast("double")


def strip(text) -> Column:
    """Python's ``str.strip``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(text), r"^\s++|(?<!\s)\s++$", "")


def squish(text) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def horizon_months(h) -> Column:
    """C18: '1 year' -> 12, '3 years' -> 36, '10 months' -> 10."""
    t = F.lower(F.trim(_c(h)))
    n = part(t, " ", 0).try_cast("int")
    return n * F.when(t.like("%year%"), 12).otherwise(1)


def interaction(a, b) -> Column:
    """The a:b term of a model formula."""
    return _c(a) * _c(b)


def as_factor(x) -> Column:
    """C15."""
    return number_text(x)


def with_levels(x, levels) -> Column:
    """Factor with declared levels; other values -> NULL."""
    return F.when(_c(x).isin(list(levels)), _c(x))
