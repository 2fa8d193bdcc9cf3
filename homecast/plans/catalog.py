"""Registered queries: SURVEY id -> f(spark, sf_dir) -> DataFrame.

Doubles that come out of aggregates are rounded to 4 decimals (money sums to
2) so the order-insensitive hash comparison against DuckDB is stable; the
library functions themselves never round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import clean
from .pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round_half_up(c, digits: int):
    """Round through DECIMAL(38,10) so ties round the same way in Spark and DuckDB."""
    return F.round(F.col(c).cast("decimal(38,10)"), digits).cast("double")


# Columns computed exactly (cent sums) need no rounding for comparison.
EXACT = {"mean_sale", "total_sales", "mini", "maxi", "price"}


def rounded(df: DataFrame, digits: int = 4, money=()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType) and f.name not in EXACT:
            cols.append(round_half_up(f.name, 2 if f.name in money else digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


P = Pipeline

# ---------------------------------------------------------------- pipelines B1-B6
@query("B1")
def q_b1(spark, d):
    return P(spark, d).h


@query("B2")
def q_b2(spark, d):
    return P(spark, d).i()


@query("B3_first_zip")
def q_b3_first(spark, d):
    return P(spark, d).zr("first_zip")


@query("B3_zip_region")
def q_b3_zr(spark, d):
    return P(spark, d).zr("zip_region")


@query("B3_all")
def q_b3_all(spark, d):
    return P(spark, d).zr("all")


@query("B4")
def q_b4(spark, d):
    return P(spark, d).sold("app")


@query("B4_viz")
def q_b4_viz(spark, d):
    return P(spark, d).sold("viz")


@query("B5")
def q_b5(spark, d):
    return P(spark, d).sold("report")


@query("B6_listed")
def q_b6_listed(spark, d):
    return clean.events(P(spark, d).h, clean.EVENT_LISTED)


@query("B6_changes")
def q_b6_changes(spark, d):
    return clean.price_changes(P(spark, d).history_raw)


# ---------------------------------------------------------------- aggregates A1-A23
@query("A1")
def q_a1(spark, d):
    return rounded(A.mean_series(P(spark, d).sold("app")))


@query("A2")
def q_a2(spark, d):
    return rounded(A.means(P(spark, d).sold("app"),
                           {"mean_sale": "price", "mean_baths": "baths", "mean_beds": "beds"}))


@query("A3")
def q_a3(spark, d):
    return rounded(A.mean_series(P(spark, d).sold_complete(), keys=["County"]))


@query("A4")
def q_a4(spark, d):
    return rounded(A.mean_series(P(spark, d).sold("viz"), keys=["Region"]))


@query("A5")
def q_a5(spark, d):
    si = A.by_period(P(spark, d).sold_complete(), period="quarter")
    return rounded(A.mean_series(si, index="quarter"))


@query("A6")
def q_a6(spark, d):
    si = A.by_period(P(spark, d).sold_complete(), period="year")
    return rounded(A.total_and_count(si, index="year"), money=("total_sales",))


@query("A7")
def q_a7(spark, d):
    return rounded(A.total_and_count(P(spark, d).sold("report"), keys=["County"], na_rm=False),
                   money=("total_sales",))


@query("A8")
def q_a8(spark, d):
    return A.count_series(P(spark, d).sold_complete())


@query("A9")
def q_a9(spark, d):
    return rounded(A.median_series(P(spark, d).sold("viz")))


@query("A10")
def q_a10(spark, d):
    return rounded(A.median_series(P(spark, d).sold("viz"), keys=["Region"]))


@query("A11")
def q_a11(spark, d):
    return rounded(A.medians(P(spark, d).sold_complete(), {
        "median_sqft": "sqft", "median_price": "price", "median_baths": "baths",
        "median_beds": "beds"}))


@query("A12")
def q_a12(spark, d):
    si = A.with_size_bucket(P(spark, d).sold("viz"))
    return rounded(A.mean_series(si, keys=["sq_int", "Region"]))


@query("A13")
def q_a13(spark, d):
    si = A.with_size_bucket(P(spark, d).sold("viz"))
    return rounded(A.median_series(si, keys=["sq_int", "Region"]))


@query("A14")
def q_a14(spark, d):
    si = A.with_size_bucket(P(spark, d).sold("viz"))
    return rounded(A.mean_series(si, keys=["sq_int"]))


@query("A15")
def q_a15(spark, d):
    si = A.with_size_bucket(P(spark, d).sold("viz"))
    return rounded(A.median_series(si, keys=["sq_int"]))


@query("A16")
def q_a16(spark, d):
    return rounded(A.means(P(spark, d).sold_complete(), {"mean_sale": "price", "mean_sqft": "sqft"},
                           keys=["zip", "County", "beds", "baths"]))


@query("A17")
def q_a17(spark, d):
    return A.menu_options(P(spark, d).sold("app"))


@query("A18")
def q_a18(spark, d):
    return A.size_bounds(P(spark, d).sold("app"))


@query("A19")
def q_a19(spark, d):
    return rounded(A.price_per_sqft_series(P(spark, d).sold_complete()))


@query("A20")
def q_a20(spark, d):
    p = P(spark, d)
    return rounded(A.nominal_and_adjusted(A.cpi_adjusted(p.sold("report"), p.cpi)))


@query("P10")
def q_p10(spark, d):
    p = P(spark, d)
    wide = rounded(A.nominal_and_adjusted(A.cpi_adjusted(p.sold("report"), p.cpi)))
    long = A.unpivot_measures(wide, ["month"], ["mean_sale", "mean_adj"])
    return long.withColumn("level", T.with_levels("name", ["mean_sale", "mean_adj"]))


@query("A21")
def q_a21(spark, d):
    # Selection of the app's history tab: one county, 3 beds, 1.5 baths, size 1000-5000.
    si = P(spark, d).sold("app")
    return rounded(A.selection_mean(si, county="NATION_3", beds=3, baths=1.5,
                                    sqft_range=(1000.0, 5000.0)))


@query("A22")
def q_a22(spark, d):
    return A.sorted_distinct(A.menu_options(P(spark, d).sold("app")), "County")


@query("A23")
def q_a23(spark, d):
    return rounded(A.hierarchy_totals(P(spark, d).sold("all")), money=("total_sales",))


# ---------------------------------------------------------------- series W1-W16, B7
from ..operators import decompose as D  # noqa: E402
from ..operators import forecast as FC  # noqa: E402
from ..operators import regress as R  # noqa: E402
from ..operators import series as S  # noqa: E402


@query("B7")
def q_b7(spark, d):
    return rounded(P(spark, d).statewide_ts())


@query("W2")
def q_w2(spark, d):
    # The sales themselves are no series: months and regions with several sales.
    return S.series_duplicates(P(spark, d).sold("viz"), ["Region"])


def _county_ts(spark, d):
    m = A.mean_series(P(spark, d).sold_complete(), keys=["County"])
    return S.fill_gaps(m, keys=["County"], fill={"mean_sale": 0.0})


@query("W4")
def q_w4(spark, d):
    return _county_ts(spark, d)


@query("W5")
def q_w5(spark, d):
    si = A.by_period(P(spark, d).sold_complete(), period="year")
    y = A.total_and_count(si, keys=["County"], index="year")
    return S.fill_gaps(y, keys=["County"], index="year", step="year")


@query("W8")
def q_w8(spark, d):
    return rounded(S.with_lags(P(spark, d).statewide_ts(), "mean_sale", lags=(1, 12), diff=True))


@query("W9")
def q_w9(spark, d):
    return S.last_observation(_county_ts(spark, d), keys=["County"])


@query("W13")
def q_w13(spark, d):
    return S.head(S.ordered(A.mean_series(P(spark, d).sold_complete())), 5)


@query("W14")
def q_w14(spark, d):
    return S.page(A.mean_series(P(spark, d).sold_complete()), ["month"], page_no=2, page_size=10)


@query("W15")
def q_w15(spark, d):
    return S.row_count(P(spark, d).sold("app"))


# ---------------------------------------------------------------- decompositions M1-M4
@query("M1")
def q_m1(spark, d):
    return rounded(D.classical(P(spark, d).report_ts("mean_sale"), "mean_sale"))


@query("M1_count")
def q_m1_count(spark, d):
    return rounded(D.classical(P(spark, d).report_ts("count_sales"), "count_sales"))


@query("M1_region")
def q_m1_region(spark, d):
    return rounded(D.classical(P(spark, d).region_ts(), "mean_sale", keys=["Region"]))


@query("M2")
def q_m2(spark, d):
    return rounded(D.classical(P(spark, d).report_ts("mean_sale"), "mean_sale",
                               kind="multiplicative"))


@query("M2_pricesqft")
def q_m2_psqft(spark, d):
    return rounded(D.classical(P(spark, d).report_ts("mean_pricesqft"), "mean_pricesqft",
                               kind="multiplicative"))


@query("M4")
def q_m4(spark, d):
    return rounded(D.x11(P(spark, d).report_ts("mean_sale"), "mean_sale"))


# ---------------------------------------------------------------- linear models
def _trend(spark, d):
    return R.trend_fit(P(spark, d).report_ts("mean_sale"), "mean_sale")


@query("M5")
def q_m5(spark, d):
    return rounded(_trend(spark, d).select("n", "intercept", "slope", "sigma"))


@query("M18")
def q_m18(spark, d):
    return rounded(R.trend_report(_trend(spark, d)))


@query("M13")
def q_m13(spark, d):
    # Ten months ahead; the horizon text goes through C18.
    fit = _trend(spark, d).withColumn("h", T.horizon_months(F.lit("10 months")))
    return rounded(FC.trend_forecast(fit, "h"))


@query("M16")
def q_m16(spark, d):
    return rounded(R.trend_augment(P(spark, d).report_ts("mean_sale"), "mean_sale"))


@query("M17")
def q_m17(spark, d):
    aug = R.trend_augment(P(spark, d).report_ts("mean_sale"), "mean_sale")
    return rounded(R.acf(aug, max_lag=24))


@query("M17_hist")
def q_m17_hist(spark, d):
    aug = R.trend_augment(P(spark, d).report_ts("mean_sale"), "mean_sale")
    return R.histogram(aug, "resid", bins=10)


def significant(df: DataFrame, *columns: str) -> DataFrame:
    """Seven significant digits, so that the comparison does not hang on the last bits of a
    solve; NaN as NULL."""
    def short(c):
        v = F.col(c)
        return F.when(v.isNotNull() & ~F.isnan(v), F.format_string("%.6e", v).cast("double")).alias(c)
    return df.select(*[short(c) if c in columns else c for c in df.columns])


COEFFICIENT = ("estimate", "std_error", "statistic")
FIT = ("rss", "sigma2", "r2", "adj_r2", "loglik", "aic", "aicc", "bic", "cp")


@query("M6")
def q_m6(spark, d):
    ts = S.with_position(P(spark, d).statewide_ts(), name="t")
    return significant(R.coefficients(R.ols(ts, "mean_sale", R.trend_season_terms())), *COEFFICIENT)


@query("M13_season")
def q_m13_season(spark, d):
    # The trend + season fit, a year ahead with bands.
    fit = R.trend_season_fit(P(spark, d).statewide_ts(), "mean_sale")
    return rounded(FC.trend_season_forecast(fit, 12))


def model_best_terms():
    """The chosen terms of the median price: size, and beds with baths and with size."""
    return {"median_sqft": F.col("median_sqft"),
            "median_beds:median_baths": T.interaction("median_beds", "median_baths"),
            "median_beds:median_sqft": T.interaction("median_beds", "median_sqft")}


def subset_terms():
    """The six candidate terms of the best-subset search."""
    return {"median_beds": F.col("median_beds"), "median_baths": F.col("median_baths"),
            "median_sqft": F.col("median_sqft"),
            "median_beds:median_baths": T.interaction("median_beds", "median_baths"),
            "median_beds:median_sqft": T.interaction("median_beds", "median_sqft"),
            "median_baths:median_sqft": T.interaction("median_baths", "median_sqft")}


@query("M7")
def q_m7(spark, d):
    fit = R.ols(P(spark, d).median_ts(), "median_price", model_best_terms())
    return significant(R.coefficients(fit), *COEFFICIENT)


@query("M8")
def q_m8(spark, d):
    # Keyed OLS: price on size, beds and baths per Region, straight from the sales.
    fit = R.ols(P(spark, d).sold("viz"), "price", ["sqft", "beds", "baths"], keys=["Region"])
    return significant(R.coefficients(fit, keys=["Region"]), *COEFFICIENT)


@query("M9")
def q_m9(spark, d):
    best = R.best_subsets(P(spark, d).median_ts(), "median_price", subset_terms())
    return significant(best, *FIT)


@query("M10")
def q_m10(spark, d):
    fit = R.ols(P(spark, d).median_ts(), "median_price", model_best_terms())
    return significant(fit.select("n", "rss", "loglik", "aic", "aicc", "bic"), *FIT)


@query("M18_ols")
def q_m18_ols(spark, d):
    # The report of the trend + season fit.
    ts = S.with_position(P(spark, d).statewide_ts(), name="t")
    fit = R.ols(ts, "mean_sale", R.trend_season_terms())
    return significant(fit.select("n", "sigma2", "r2", "adj_r2", "loglik", "aic", "aicc", "bic"), *FIT)


# ---------------------------------------------------------------- views Q1-Q7
from .views import App  # noqa: E402

VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT = "NATION_3", "3 beds, 1.5 baths", (1000.0, 5000.0)


def _app(spark, d):
    p = P(spark, d)
    return App(p.sold("app"), p.statewide_ts())


@query("Q1")
def q_q1(spark, d):
    return _app(spark, d).county_menu()


@query("Q2")
def q_q2(spark, d):
    return _app(spark, d).bed_bath_menu(VIEW_COUNTY)


@query("Q3")
def q_q3(spark, d):
    return _app(spark, d).resolve(VIEW_COUNTY, VIEW_LABEL)


@query("Q4")
def q_q4(spark, d):
    return _app(spark, d).size_slider(VIEW_COUNTY, VIEW_LABEL)


@query("Q5")
def q_q5(spark, d):
    return _app(spark, d).history(VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT)


@query("Q6_trend")
def q_q6(spark, d):
    return rounded(_app(spark, d).forecast("1 year"))


@query("Q6_trend_selection")
def q_q6_sel(spark, d):
    return rounded(_app(spark, d).forecast("3 years", VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT,
                                           scope="selection"))


@query("Q7_trend")
def q_q7(spark, d):
    return rounded(_app(spark, d).forecast_table("1 year", VIEW_COUNTY, VIEW_LABEL, VIEW_SQFT))


# ---------------------------------------------------------------- page extraction E1-E17
from ..operators import extract as E  # noqa: E402
from ..sources import standin as SI  # noqa: E402
from ..sources.tables import table as _table  # noqa: E402

# Link predicates are parameters: the stored pages use their own vocabulary.
E_WORD, E_CAPITAL, E_URL_DIGITS = "/the", "/[A-Z]", 3


def _links(spark, d):
    return E.links(_table(spark, d, "pages", "page_id", "url", "html"))


def _listing_pages(spark, d):
    p = P(spark, d)
    return SI.listing_pages(p.orders, p.customer)


@query("E1")
def q_e1(spark, d):
    return _links(spark, d).select("page_id", "pos", "href")


@query("E2")
def q_e2(spark, d):
    return _links(spark, d).filter(E.newest(pattern=E_WORD)).select("page_id", "pos", "href")


@query("E3")
def q_e3(spark, d):
    return _links(spark, d).filter(E.other(pattern=E_WORD)).select("page_id", "pos", "href")


@query("E4")
def q_e4(spark, d):
    return _links(spark, d).filter(E.other_county(pattern=E_WORD, county=E_CAPITAL)) \
        .select("page_id", "pos", "href")


@query("E5")
def q_e5(spark, d):
    pages = _table(spark, d, "pages", "page_id", "url")
    return pages.filter(E.has_zip("url", E_URL_DIGITS))


@query("E1_markup")
def q_e1_markup(spark, d):
    # Either quote, any case, entities, and no data-href.
    return E.links(_listing_pages(spark, d)).select("page_id", "pos", "href")


@query("E6")
def q_e6(spark, d):
    # ZIP paths hold digits and slashes only; the county paths among them are left out.
    z = P(spark, d).county_zips
    paths = z.select(F.concat(F.lit("/"), "zip", F.lit("/")).alias("href")).union(
        z.select(F.concat(F.lit("/"), F.lower("County"), F.lit("-county/"), "zip", F.lit("/"))))
    return paths.filter(E.address_link("href"))


@query("E14_summary")
def q_e14_summary(spark, d):
    return E.listing_summary(_listing_pages(spark, d))


@query("E7")
def q_e7(spark, d):
    return _listing_pages(spark, d).filter(E.home_link("url")).select("page_id", "url")


@query("E8")
def q_e8(spark, d):
    return _links(spark, d).filter(E.newest(pattern=E_WORD)).select(
        "page_id", "pos", E.absolute("href").alias("link"))


@query("E12")
def q_e12(spark, d):
    return E.listing_history(_listing_pages(spark, d))


@query("E16")
def q_e16(spark, d):
    return E.listing_info(_listing_pages(spark, d))


@query("E17")
def q_e17(spark, d):
    return E.listing_rejects(_listing_pages(spark, d))


@query("W11")
def q_w11(spark, d):
    return S.shuffled(_links(spark, d).select("page_id", "pos", "href"), "href")


@query("W12")
def q_w12(spark, d):
    # At most 3 links per page, chosen by a seeded hash (the reference samples 200).
    return S.sample_per_group(_links(spark, d).select("page_id", "pos", "href"), "page_id", 3,
                              "pos")


# ---------------------------------------------------------------- hierarchy sums M15
from ..operators import reconcile as REC  # noqa: E402


HIERARCHY = ["Region", "County"]


@query("M15")
def q_m15(spark, d):
    # Monthly totals of the counties, each with its own linear trend, 5 months ahead, summed
    # up the hierarchy county -> region -> all (M13 per leaf, then M15).
    si = P(spark, d).sold("all")
    leaves = si.groupBy("month", *HIERARCHY).agg(A.money_sum("price").alias("price"))
    leaves = S.fill_gaps(leaves.select(F.array(*HIERARCHY).alias("node"), "month", "price"),
                         keys=["node"], fill={"price": 0.0})
    fc = FC.trend_forecast(R.trend_fit(leaves, "price", keys=["node"]), 5, keys=["node"])
    out = REC.bottom_up(fc, REC.hierarchy_mapping(si, HIERARCHY))
    return rounded(out.select(F.array_join("node", " > ").alias("node"), "month", "mean"))


# ---------------------------------------------------------------- joins, set operations, sources
import uuid  # noqa: E402

from ..operators import enrich as EN  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import files as FS  # noqa: E402
from ..streaming import ingest as ING  # noqa: E402


@query("J4")
def q_j4(spark, d):
    # Sales of the report form with their region, monthly means per region.
    p = P(spark, d)
    si = p.sold("report").join(p.county_regions, "County", "left")
    m = A.mean_series(si, keys=["Region"], na_rm=False)
    return clean.complete_rows(m)


@query("J6")
def q_j6(spark, d):
    si = P(spark, d).sold("viz")
    return rounded(EN.natural_full_join(A.mean_series(si), A.median_series(si)))


@query("J6_region")
def q_j6_region(spark, d):
    si = P(spark, d).sold("viz")
    j = EN.natural_full_join(A.mean_series(si, keys=["Region"]),
                             A.median_series(si, keys=["Region"]))
    return rounded(A.unpivot_measures(j, ["month", "Region"], ["mean_sale", "median_sale"],
                                      "measure", "price"))


@query("J7")
def q_j7(spark, d):
    # County pages paired with the ZIP pages of the same county (equi-join).
    p = P(spark, d)
    counties = p.county_zips.select("County").distinct().withColumn(
        "county_link", F.concat(F.lit("/"), F.lower("County"), F.lit("-county/")))
    pairs = EN.pair_by_key(counties, p.county_zips, "County")
    return pairs.select("County", "zip", F.concat("county_link", "zip").alias("link"))


@query("J8")
def q_j8(spark, d):
    # Work list: home links not yet visited (visited = homes with a stored page of a sale).
    p = P(spark, d)
    homes = p.info_raw.select("link")
    pages = E.listing_history(_listing_pages(spark, d)).filter(F.col("Event") == "Sold")
    visited = _listing_pages(spark, d).join(pages.select("page_id"), "page_id", "left_semi") \
        .select(F.col("url").alias("link"))
    return EN.remove_visited(homes, visited, "link")


@query("X2")
def q_x2(spark, d):
    # Info rows from stored pages appended to the scraped info table (list_price only there).
    p = P(spark, d)
    scraped = E.listing_info(_listing_pages(spark, d)).drop("page_id")
    return EN.append_rows(p.info_raw, scraped)


@query("X4")
def q_x4(spark, d):
    h = P(spark, d).h
    return EN.bag_difference(h, clean.events(h, clean.EVENT_SOLD))


@query("S1")
def q_s1(spark, d):
    # S6 then S1: the history table written as CSV into the shared checkpoint
    # folder and read back with its explicit schema, then cleaned (B1).
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    FS.write_csv(P(spark, d).history_raw, folder)
    return clean.clean_history(FS.read_history(spark, folder))


@query("U1")
def q_u1(spark, d):
    return ING.ingest_batch(_table(spark, d, "events"))


# ---------------------------------------------------------------- residual diagnostics of the fits
@query("M16_ols")
def q_m16_ols(spark, d):
    # Fitted values and residuals of the regression with the chosen terms.
    ts = P(spark, d).median_ts()
    fit = R.ols(ts, "median_price", model_best_terms())
    return rounded(R.ols_augment(ts, fit, "median_price", model_best_terms()))


@query("M17_ols")
def q_m17_ols(spark, d):
    # Autocorrelation of that regression's residuals.
    ts = P(spark, d).median_ts()
    fit = R.ols(ts, "median_price", model_best_terms())
    return rounded(R.acf(R.ols_augment(ts, fit, "median_price", model_best_terms()), max_lag=24))


@query("B4_fanout")
def q_b4_fanout(spark, d):
    # Fan-out of the ZIP lookup over cleaned sales with home info, per lookup mode.
    p = P(spark, d)
    base = clean.complete_rows(EN.with_home_info(p.h, p.i(), "inner"))
    return rounded(EN.lookup_fanout(base, {m: p.zr(m) for m in EN.LOOKUP_MODES}))


@query("U1_stream")
def q_u1_stream(spark, d):
    # The streaming ingest itself: an availableNow run over the events files
    # into a fresh sink (and checkpoint) in the shared checkpoint folder.
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    events = _table(spark, d, "events")
    ING.run_ingest(spark, f"{d.rstrip('/')}/events*.parquet", events.schema,
                   f"{root}/sink", f"{root}/checkpoint")
    return ING.read_sink(spark, f"{root}/sink")


@query("B1_rejects")
def q_b1_rejects(spark, d):
    return clean.history_rejects(P(spark, d).h)


@query("S6")
def q_s6(spark, d):
    # The app's sold fact materialised as Parquet partitioned by sale year,
    # then one year's monthly means read back: the scan prunes to the
    # sale_year=1998 partition (PartitionFilters in the plan).
    si = P(spark, d).materialized_sold("app")
    return A.mean_series(si.filter(F.col("sale_year") == 1998), keys=["Region"])


# ---------------------------------------------------------------- readers, empty tables, replays
def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("S3")
def q_s3(spark, d):
    # S7 then S3: a link list as pandas writes it (an index column, then column "0").
    folder = _folder(spark, "links")
    links = P(spark, d).info_raw.select(F.monotonically_increasing_id().alias("idx"), F.col("link").alias("0"))
    FS.write_csv(links, folder)
    return FS.read_link_list(spark, folder)


@query("S4")
def q_s4(spark, d):
    # A space-delimited table of integers, written and read with its explicit schema.
    from .. import schema as SC
    folder, k = _folder(spark, "houses"), F.col("c_custkey")
    cols = [(k * (i + 1) % 1009).cast("int").alias(f.name) for i, f in enumerate(SC.HOUSE_SAMPLE.fields)]
    P(spark, d).customer.select(*cols).write.option("header", True).option("sep", " ").csv(folder)
    return FS.read_house_sample(spark, folder)


@query("S5")
def q_s5(spark, d):
    folder = _folder(spark, "cpi")
    FS.write_csv(SI.cpi_raw(P(spark, d).orders), folder)
    return FS.read_cpi(spark, folder).select(T.to_month(T.parse_ymd("Date")).alias("month"), "Index")


@query("S9")
def q_s9(spark, d):
    # An empty table with its schema, to which scraped rows are appended.
    from .. import schema as SC
    return EN.append_rows(FS.empty_table(spark, SC.INFO_RAW), P(spark, d).info_raw).drop("list_price")


@query("P5")
def q_p5(spark, d):
    return clean.rename_by_position(P(spark, d).county_regions, 2, "Area")


@query("F11")
def q_f11(spark, d):
    # Whether a selection has sales: one with, one without (no home has 0 beds).
    si = P(spark, d).sold("app")
    rows = [A.require_sales(A.selection(si, county=VIEW_COUNTY, beds=b)).withColumn("beds", F.lit(b)) for b in (3, 0)]
    return rows[0].unionByName(rows[1])


@query("U1_replay")
def q_u1_replay(spark, d):
    # The same batch twice, some of its records without a time.
    sink = _folder(spark, "replay")
    batch = _table(spark, d, "events").withColumn("ts", F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    for _ in range(2):
        ING.append_new(batch, sink)
    return ING.read_sink(spark, sink)


@query("U1_state")
def q_u1_state(spark, d):
    # The ingest with state and ledger over several deliveries and two runs: every delivery
    # repeats a part of the one before, the last ones bring late records, some records have no
    # time, and the second run comes after a restart.
    root = _folder(spark, "state")
    events = _table(spark, d, "events").withColumn("ts", F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    k = F.pmod(F.xxhash64("event_type", "value", "user_id", "props"), F.lit(10))
    spans = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    third = events.withColumn("_s", spans.select(F.struct("lo", "hi")).scalar()).withColumn(
        "_third", F.coalesce(F.width_bucket(F.unix_micros(F.col("ts").cast("timestamp")),
                                            F.unix_micros(F.col("_s.lo").cast("timestamp")),
                                            F.unix_micros(F.col("_s.hi").cast("timestamp")) + 1, F.lit(3)), F.lit(1))).drop("_s")
    for delivery, run_after in ((1, False), (2, False), (3, True), (4, True)):
        on_time = (F.col("_third") == delivery) & (k > 0)
        again = (F.col("_third") == delivery - 1) & (k == 5)
        late = F.lit(delivery == 4) & (k <= 1)
        third.filter(on_time | again | late).drop("_third").write.parquet(f"{root}/landing/d={delivery}")
        if run_after:
            ING.run_stateful_ingest(spark, f"{root}/landing/*", events.schema, f"{root}/sink", f"{root}/checkpoint",
                                    delay="1 hour", max_files_per_trigger=1)
    return ING.read_committed(spark, f"{root}/sink", events.schema).select(*ING.RECORD_KEYS)
