"""Hand-sized goldens for parsing and scalar functions (FIXTURES.md section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from homecast.functions import pages as PG
from homecast.functions import text as T
from homecast.operators import clean


def _hist(spark, rows):
    return spark.createDataFrame(rows, "address string, Date string, Event string, Price string")


def test_address_edge_cases(spark):
    raw = _hist(spark, [
        ("12 Oak St, Muncie, IN 47302", "4/12/2022", "Sold", "$250,000 (-3.1%)"),
        ("12 Oak St, Muncie", "4/12/2022", "Sold", "$1"),
        ("12 Oak St, Apt 4, Muncie, IN 47302", "4/12/2022", "Sold", "$1"),
        ("12 Oak St, Muncie, IN 47302-1234", "4/12/2022", "Sold", "--"),
    ])
    got = [r.asDict() for r in clean.clean_history(raw).collect()]
    assert got[0] == {"month": dt.date(2022, 4, 1), "zip": "47302", "street": "12 Oak St",
                      "city": "Muncie", "state": "IN", "Event": "Sold", "price": 250000.0}
    assert got[1]["state"] is None and got[1]["zip"] is None
    assert got[2]["city"] == "Apt 4" and got[2]["zip"] is None
    assert got[3]["zip"] == "47302-1234" and got[3]["price"] is None


def test_date_forms(spark):
    forms = {"4/12/22": dt.date(2022, 4, 1), "3/14/98": dt.date(1998, 3, 1), "3-14-1998": dt.date(1998, 3, 1),
             "03.14.1998 ": dt.date(1998, 3, 1), "1/2/68": dt.date(2068, 1, 1), "1/2/69": dt.date(1969, 1, 1),
             "13/1/1998": None, "2/30/1998": None, "1998-03-14": None, "1/2/199": None, "x": None, None: None}
    raw = _hist(spark, [("a, b, IN 1", d, "Sold", "$1") for d in forms])
    assert [r["month"] for r in clean.clean_history(raw).collect()] == list(forms.values())


def test_label_parsing(spark):
    df = spark.createDataFrame([("Date: 4/12/2022, junk, a:1, a:2, T: a:b, Event: Sold",)], "l string")
    kv = df.select(PG.label_entries("l").alias("kv"))
    r = kv.select(PG.label_value("kv", "Date").alias("d"), PG.label_value("kv", "a").alias("a"),
                  PG.label_value("kv", "T").alias("t"), PG.label_value("kv", "junk").alias("j"),
                  PG.label_value("kv", "Event").alias("e")).first()
    assert (r.d, r.a, r.t, r.j, r.e) == ("4/12/2022", "2", "a:b", None, "Sold")


def test_size_buckets_and_labels(spark):
    df = spark.createDataFrame([(1000.0, 2, 2.5), (1001.0, 3, 2.0), (1499.0, 1, 1.0),
                                (1500.0, 4, 3.5), (None, 2, 1.5)], "sqft double, beds int, baths double")
    rows = df.select(T.size_bucket("sqft").alias("b"), T.bed_bath_label("beds", "baths").alias("l"),
                     T.dollar(F.col("sqft") * 1000).alias("d")).collect()
    assert [r.b for r in rows] == ["0-1000 sqft", "1000-1500 sqft", "1000-1500 sqft", "1500+ sqft", None]
    assert rows[0].l == "2 beds, 2.5 baths" and rows[1].l == "3 beds, 2 baths"
    assert rows[0].d == "$1,000,000"


def test_horizons_and_money(spark):
    df = spark.createDataFrame([("1 year",), ("3 years",), ("10 months",), ("5 months",)], "h string")
    assert [r[0] for r in df.select(T.horizon_months("h")).collect()] == [12, 36, 10, 5]
    m = spark.createDataFrame([("$1,234.50",), ("--",), (None,)], "p string")
    assert [r[0] for r in m.select(T.money_to_double("p")).collect()] == [1234.5, None, None]


def test_page_parts(spark):
    html = ("<meta content='A, B, IN 1' property=\"home:address\"><META\n PROPERTY='home:address' content=\"C &amp; D, IN 2\">"
            '<div data-testid="size-block"><span>3</span><span>bd<span>x</span></span>\n<span>|</span>'
            '<span>2</span><span>ba</span><span> <b>1,234</b>\n sqft</span></div><span>after</span>'
            "<a href='/x'>x</a><A HREF=\"/y/1?a=1&amp;b\">y</A><a data-href='/no'>z</a>")
    df = spark.createDataFrame([(html,), ("<p>none</p>",), (None,)], "html string")
    df = PG.with_spans(PG.with_element(df, "_b", "data-testid", "size-block"), "_b", {f"s{k}": k for k in (1, 2, 6, 7)})
    r, none, null = df.select("*", PG.meta_content("home:address").alias("a"), PG.hrefs("html").alias("h")).collect()
    assert r.a == "C & D, IN 2"          # the last one counts
    assert (r.s1, r.s2, r.s6, r.s7) == ("bdx", "x", "1,234 sqft", None)
    assert r.h == ["/x", "/y/1?a=1&b"]
    assert none.a is None and none.s1 is None and none.h == [] and null.a is None


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert clean.select_range(df, "b", "d", drop=["c"]).columns == ["b", "d"]
    assert clean.relocate(df, "d", before="b").columns == ["a", "d", "b", "c"]
    assert clean.rename_by_position(df, 2, "County").columns == ["a", "County", "c", "d"]


def test_dollar_column_rule(spark):
    cases = [([1234.5, 99.0], ["$1,234.50", "$99.00"]), ([1234.0, 5.0], ["$1,234", "$5"]),
             ([250000.4, 3.5], ["$250,000", "$4"]), ([-12.345, 7.0], ["-$12.35", "$7.00"])]
    for vals, want in cases:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
        got = [r[1] for r in df.select("i", T.dollar_column("x")).orderBy("i").collect()]
        assert got == want, (vals, got)


# ------------------------------------------------------------------ broken and very long pages
LONG = 1_000_000
BROKEN = ["<a " + "x" * LONG, "a<b " + "y" * LONG, "<a<a" * (LONG // 4), '<a "' * (LONG // 4), "<" * LONG,
          "<script>" * (LONG // 8), "<!--" * (LONG // 4), "<span class='" + "q " * (LONG // 2), "<a\n" * (LONG // 3),
          '<div id="summary-address">' + "<span>" * (LONG // 6), "<meta property='home:beds' content=" + "9" * LONG + ">"]


def test_broken_pages_of_a_megabyte_are_only_rejected(spark):
    """Each within the stack and in linear time: all of them together in some seconds."""
    from homecast.operators import extract as E
    good = "<A title='a > b' href = /un><a href=\"/q&amp;r\">x</a><!-- <a href='/no'> --><script>'<a href=\"/js\">'</script>"
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate([*BROKEN, good])],
                                  "page_id long, url string, html string").repartition(6).cache()
    assert {(x.page_id, x.href) for x in E.links(pages).collect()} == {(len(BROKEN), "/un"), (len(BROKEN), "/q&r")}
    assert E.listing_history(pages).count() == 0
    assert E.listing_rejects(pages).count() == len(BROKEN) + 1
    E.listing_summary(pages).collect()
    E.listing_info(pages).collect()


def test_dates_are_matched_once_and_strictly(spark):
    from homecast.functions import text as T
    texts = ["1/2/1995", "01-02-95", " 3. 4, 2001 ", "2/30/2000", "1995-1-2", "13/1/2000", "1/2/69", "1/2/68", "", None,
             "#1995-1-2", "1/2/1995x", "1/2/995"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if x.d is None else str(x.d) for x in df.select(T.parse_mdy("t").alias("d")).collect()]
    assert got == ["1995-01-02", "1995-01-02", "2001-03-04", None, None, None, "1969-01-02", "2068-01-02", None, None,
                   None, None, None]
