"""Raw inputs of the housing pipeline derived from the driver tables.

The stand-in mapping (one row of output per row of input, no sampling):

* property            <- ``customer``: street ``<custkey> Oak St``, city ``c_mktsegment``,
                          state ``IN``, ZIP ``46000 + 4*nationkey + custkey % 5``
* sale history event  <- ``orders``: ``o_orderdate`` -> Date text ``M/d/yyyy``,
                          ``o_orderstatus`` F/O/P -> Sold / Listed for sale / Price change,
                          ``o_totalprice`` -> Price text ``$1,234.56`` (``(-k.5%)`` on changes)
* home attributes     <- ``customer``: beds ``custkey % 6``, baths ``1 + 0.5*(custkey % 4)``,
                          sqft ``c_acctbal`` (so non-positive sizes exist)
* county, region      <- ``nation``, ``region``; each county owns five ZIPs and neighbouring
                          counties share one, so the ZIP lookup fans out like the real one
* CPI                 <- one index value per month of ``orders``
* listing pages       <- markup built per order (meta tags, ``<tr label>``, spans)

Some history rows are broken on purpose, chosen by ``o_orderkey % 101``:
7 drops the state/ZIP part, 13 gives price ``--``, 29 writes a two-digit
year, 41 adds an extra comma part, 53 gives a month 13, 59 writes dashes.

Listing pages vary by key too: attribute order, quotes, case, line breaks, child tags, and
parts that are missing (no beds, a short size block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as PG

# Fixed values of the stand-in encoding.
EVENT_NAMES = {"F": "Sold", "O": "Listed for sale", "P": "Price change"}
STATE = "IN"
ZIP_BASE = 46000
ZIPS_PER_COUNTY = 5
BREAK_MOD = 101
BREAK_NO_ZIP, BREAK_NO_PRICE, BREAK_SHORT_YEAR, BREAK_EXTRA_PART = 7, 13, 29, 41
BREAK_BAD_DATE, BREAK_DASHES = 53, 59


def _zip(nationkey: Column, custkey: Column) -> Column:
    return (F.lit(ZIP_BASE) + nationkey * 4 + custkey % ZIPS_PER_COUNTY).cast("string")


def properties(customer: DataFrame) -> DataFrame:
    """One row per property with its address parts."""
    return customer.select(
        "c_custkey", "c_nationkey", "c_acctbal",
        F.concat(F.col("c_custkey").cast("string"), F.lit(" Oak St")).alias("street"),
        F.col("c_mktsegment").alias("city"),
        F.lit(STATE).alias("state"),
        _zip(F.col("c_nationkey"), F.col("c_custkey")).alias("zip"))


def _address(street, city, state, zip_) -> Column:
    return F.concat_ws(", ", street, city, F.concat_ws(" ", state, zip_))


def event_name(status: Column) -> Column:
    e = F.when(status == "F", EVENT_NAMES["F"]).when(status == "O", EVENT_NAMES["O"])
    return e.when(status == "P", EVENT_NAMES["P"])


def history_raw(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """address, Date, Event, Price as text, like the scraped history table."""
    p = properties(customer)
    # Dealt out by the join's key while the rows are narrow: the texts are made and parsed
    # by all tasks, and a shuffled join uses the same exchange.
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").repartition("o_custkey")
    j = o.join(p, o.o_custkey == p.c_custkey)
    brk = F.col("o_orderkey") % BREAK_MOD
    address = (F.when(brk == BREAK_NO_ZIP, F.concat_ws(", ", "street", "city"))
               .when(brk == BREAK_EXTRA_PART,
                     F.concat_ws(", ", F.col("street"), F.lit("Apt 4"), F.col("city"),
                                 F.concat_ws(" ", "state", "zip")))
               .otherwise(_address(F.col("street"), F.col("city"), F.col("state"), F.col("zip"))))
    date = F.when(brk == BREAK_SHORT_YEAR, F.date_format("o_orderdate", "M/d/yy")) \
            .when(brk == BREAK_DASHES, F.date_format("o_orderdate", "MM-dd-yyyy")) \
            .when(brk == BREAK_BAD_DATE, F.date_format("o_orderdate", "'13'/d/yyyy")) \
            .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    change = F.concat(F.lit(" (-"), (F.col("o_orderkey") % 10).cast("string"), F.lit(".5%)"))
    price = (F.when(brk == BREAK_NO_PRICE, F.lit("--"))
             .when(F.col("o_orderstatus") == "P", F.concat(money, change))
             .otherwise(money))
    return j.select(address.alias("address"), date.alias("Date"),
                    event_name(F.col("o_orderstatus")).alias("Event"), price.alias("Price"))


def info_raw(customer: DataFrame) -> DataFrame:
    """link, address, list_price, beds, baths, sqft per property."""
    p = properties(customer)
    k = F.col("c_custkey")
    return p.select(
        F.concat(F.lit("/homedetails/"), k.cast("string"), F.lit("_zpid/")).alias("link"),
        _address(F.col("street"), F.col("city"), F.col("state"), F.col("zip")).alias("address"),
        F.concat(F.lit("$"), F.format_number(F.abs(F.col("c_acctbal")) * 100, 0)).alias("list_price"),
        (k % 6).cast("int").alias("beds"),
        ((k % 4).cast("double") * 0.5 + 1.0).alias("baths"),
        F.col("c_acctbal").alias("sqft"))


def county_zips(nation: DataFrame) -> DataFrame:
    """County, zip: every county owns ZIPS_PER_COUNTY consecutive-by-4 ZIPs;
    the last ZIP of county k is the first of county k+1 (ZIP fan-out).
    Size is bounded by |nation| * ZIPS_PER_COUNTY."""
    return nation.select(
        F.col("n_name").alias("County"),
        F.explode(F.sequence(F.lit(0), F.lit(ZIPS_PER_COUNTY - 1))).alias("j"),
        "n_nationkey",
    ).select("County", (F.lit(ZIP_BASE) + F.col("n_nationkey") * 4 + F.col("j"))
             .cast("string").alias("zip"))


def county_regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey) \
        .select(F.col("n_name").alias("County"), F.col("r_name").alias("Region"))


def cpi_raw(orders: DataFrame) -> DataFrame:
    """Date (y-m-d text, first of month), Index: 100 + 0.25 per month since 1995-01."""
    m = F.trunc(F.col("o_orderdate"), "MM")
    months = orders.select(m.alias("m")).distinct()
    idx = 100.0 + 0.25 * ((F.year("m") - 1995) * 12 + F.month("m") - 1)
    return months.select(F.date_format("m", "yyyy-MM-dd").alias("Date"),
                         idx.cast("double").alias("Index"))


def listing_pages(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One stored listing page per order: address/beds/baths meta tags, a labelled table row,
    a size block of spans whose span 6 (zero-based) holds the size, a summary row and three
    links.  The order's key picks the markup's form."""
    p = properties(customer)
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    # Dealt out by the order while the rows are narrow, into a set number of parts: a page is
    # many times wider than its row, so parts merged by the rows' bytes would be few.
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = o.join(p, o.o_custkey == p.c_custkey).repartition(parts, "o_orderkey", "o_custkey", "o_totalprice")
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    addr = _address(F.col("street"), F.col("city"), F.col("state"), F.col("zip"))
    beds, baths = (k % 6).cast("string"), ((k % 4) * 0.5 + 1.0).cast("string")
    lit = F.lit

    def meta(prop: str, value: Column) -> Column:
        name, content = lit(f'property="{prop}"'), F.concat(lit('content="'), value, lit('"'))
        plain = F.concat(lit("<meta "), name, lit(" "), content, lit(">"))
        turned = F.concat(lit("<META "), content, lit("\n "), name, lit(" />"))
        single = F.concat(lit(f"<meta property = '{prop}' content='"), value, lit("'>"))
        return F.when(n % 3 == 0, plain).when(n % 3 == 1, turned).otherwise(single)

    label = F.concat(lit("Date: "), F.date_format("o_orderdate", "M/d/yyyy"),
                     lit(", Event: "), event_name(F.col("o_orderstatus")),
                     lit(", Price: $"), F.format_number("o_totalprice", 2))
    row = F.when(n % 2 == 0, F.concat(lit('<tr label="'), label, lit('">'))).otherwise(
        F.concat(lit("<TR class='x'\n LABEL='"), label, lit("'>")))
    size = F.format_number(F.abs(F.col("c_acctbal")), 0)
    size = F.when(n % 5 == 0, F.concat(lit("<b>"), size, lit("</b>\n sqft"))).otherwise(F.concat(size, lit(" sqft")))
    gap = F.when(n % 4 == 1, lit("\n  ")).otherwise(lit(""))

    def span(text: Column) -> Column:
        return F.concat(lit("<span>"), text, lit("</span>"), gap)

    first = F.concat(span(beds), span(lit("bd")), span(lit("|")), span(baths), span(lit("ba")), span(lit("|")))
    block = F.concat(lit(f'<span data-testid="{PG.SIZE_BLOCK}">'), first,
                     F.when(n % BREAK_MOD == BREAK_EXTRA_PART, lit("")).otherwise(F.concat(span(size), span(lit("sqft")))),
                     lit("</span><span>after</span>"))
    cells = {2: F.concat(lit("$"), F.format_number("o_totalprice", 0)), 5: beds, 9: baths, 13: size}
    summary = F.concat(lit(f'<div class="box {PG.SUMMARY_CLASS}">'), *[
        span(cells.get(i, lit(f"s{i}"))) for i in range(14)], lit("</div>"))
    title = F.concat(lit(f'<h1 id="{PG.ADDRESS_ID}">'), F.col("street"), lit(",\n <i>"), F.col("city"), lit("</i>, "),
                     F.concat_ws(" ", "state", "zip"), lit("</h1>"))
    links = F.concat(lit('<a href="/a/'), k.cast("string"), lit("\">a</a><A HREF='/b?x=1&amp;y="), k.cast("string"),
                     lit("'>b</A><a data-href=\"/no\" href = \"/c/"), k.cast("string"), lit('">c</a>'))
    html = F.concat(
        lit("<html><head>"),
        F.when(n % BREAK_MOD == BREAK_NO_ZIP, lit("")).otherwise(meta(PG.ADDRESS_PROP, addr)),
        F.when(n % BREAK_MOD == BREAK_NO_PRICE, lit("")).otherwise(meta(PG.BEDS_PROP, beds)),
        meta(PG.BATHS_PROP, baths), lit("</head><body>"), title, links, lit("<table>"), row,
        lit("<td>event</td></tr><tr><td>no label</td></tr></table>"), block, summary, lit("</body></html>"))
    return PG.pinned(j, html=html).select(
        n.alias("page_id"), F.concat(lit("/homedetails/"), k.cast("string"), lit("_zpid/")).alias("url"), "html")
