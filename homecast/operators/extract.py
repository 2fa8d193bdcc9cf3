"""Page extraction jobs E1-E17 over a stored-pages table (page_id, url, html).

All steps are narrow (per page) until a de-duplication; a page that fails
to parse is routed to a rejects table instead of stopping the job (E17).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as PG
from ..functions.text import digits_only

# The link predicates of the link-discovery steps.
NEWEST = "/newest-homes"
COUNTY_PART = "-county/"
HOME_DETAILS = ("/homedetails", "/home-details/")


def links(pages: DataFrame) -> DataFrame:
    """One row per href: page_id, url, pos (0-based), href."""
    return pages.select("page_id", "url", F.posexplode(PG.hrefs("html")).alias("pos", "href"))


def has(pattern: str, col: str = "href") -> Column:
    """A link predicate as a column expression (regex search)."""
    return F.col(col).rlike(pattern)


def newest(col: str = "href", pattern: str = NEWEST) -> Column:
    """E2."""
    return has(pattern, col)


def other(col: str = "href", pattern: str = NEWEST) -> Column:
    """E3."""
    return ~has(pattern, col)


def other_county(col: str = "href", pattern: str = NEWEST, county: str = COUNTY_PART) -> Column:
    """E4."""
    return ~has(pattern, col) & has(county, col)


def has_zip(col: str = "href", digits: int = 5) -> Column:
    """E5: a run of ``digits`` digits."""
    return has(f"[0-9]{{{digits}}}", col)


def address_link(col: str = "href") -> Column:
    """Digit followed by slash, and no letters."""
    return has("[0-9]/", col) & ~has("[a-zA-Z]", col)


def home_link(col: str = "href", patterns=HOME_DETAILS) -> Column:
    """E7."""
    return has("|".join(p.replace("-", r"\-") for p in patterns), col)


def absolute(href: str = "href", base: Column | str | None = None) -> Column:
    """Base + href (base defaults to the page's own scheme and host)."""
    b = PG.base_url("url") if base is None else (F.lit(base) if isinstance(base, str) else base)
    return F.concat(b, F.col(href))


def listing_history(pages: DataFrame, address_prop: str = PG.ADDRESS_PROP) -> DataFrame:
    """One history row per labelled table row: page_id, address,
    Date, Event, Price.  Rows come out even when the page lacks other parts."""
    d = PG.pinned(pages.select("page_id", "html"), _shown=PG.visible("html")).drop("html")
    d = PG.pinned(d, _metas=PG.metas("_shown"), _labels=PG.row_labels(shown="_shown"))
    lab = d.select("page_id", PG.meta_content(address_prop, found="_metas").alias("address"), F.explode("_labels").alias("label"))
    e = lab.select("page_id", "address", PG.label_entries("label").alias("kv"))
    return e.select("page_id", "address", PG.label_value("kv", "Date").alias("Date"),
                    PG.label_value("kv", "Event").alias("Event"),
                    PG.label_value("kv", "Price").alias("Price"))


def listing_parts(pages: DataFrame, props=(PG.ADDRESS_PROP, PG.BEDS_PROP, PG.BATHS_PROP),
                  block: str = PG.SIZE_BLOCK, span: int = PG.SIZE_SPAN) -> DataFrame:
    """The parts of an info record as text (NULL: not on the page), and ``missing``, the
    first part that is not there."""
    d = PG.pinned(pages.select("page_id", "url", "html"), _shown=PG.visible("html")).drop("html")
    d = PG.pinned(d, _metas=PG.metas("_shown"))
    d = PG.pinned(d, **{c: PG.meta_content(p, found="_metas") for p, c in zip(props, ("address", "beds", "baths"))}).drop("_metas")
    d = PG.with_element(d, "_block", "data-testid", block, shown="_shown").drop("_shown")
    d = PG.with_spans(d, "_block", {"sqft": span}).drop("_block", "_block_tags")
    return d.withColumn("missing", F.coalesce(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in ("address", "beds", "baths", "sqft")]))


def listing_info(pages: DataFrame, **names) -> DataFrame:
    """Link, address, beds, baths, sqft of the pages that have all parts."""
    return listing_parts(pages, **names).filter("missing IS NULL").select(
        "page_id", F.col("url").alias("link"), "address", F.col("beds").try_cast("int").alias("beds"),
        F.col("baths").try_cast("double").alias("baths"), digits_only("sqft").alias("sqft"))


def listing_rejects(pages: DataFrame, **names) -> DataFrame:
    """The other pages (the scraper skips them), with the first part they lack."""
    return listing_parts(pages, **names).filter("missing IS NOT NULL").select("page_id", "url", "missing")


def listing_summary(pages: DataFrame, row_class: str = PG.SUMMARY_CLASS, spans: dict | None = None,
                    address_id: str = PG.ADDRESS_ID) -> DataFrame:
    """E14 for the summary row: link, address (by element id) and the texts of numbered spans."""
    spans = spans or PG.SUMMARY_SPANS
    d = PG.pinned(pages.select("page_id", F.col("url").alias("link"), "html"), _shown=PG.visible("html")).drop("html")
    d = PG.with_element(d, "_title", "id", address_id, shown="_shown")
    d = PG.pinned(d, address=PG.text_of(F.col("_title"))).drop("_title", "_title_tags")
    d = PG.with_element(d, "_row", "class", row_class, shown="_shown").drop("_shown")
    d = PG.with_spans(d, "_row", spans)
    return d.select("page_id", "link", "address", *spans)
