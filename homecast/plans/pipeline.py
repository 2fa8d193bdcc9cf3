"""Builds the cleaned tables and the sold-home facts from the driver tables.

Everything is lazy; call ``.cache()`` on a fact only when several actions
reuse it (the app does: history view, menus, model input).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate, clean, enrich, series
from ..sources import standin
from ..sources.tables import table


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str, *cols: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, *cols)

    # --- raw stand-ins -------------------------------------------------
    @property
    def customer(self) -> DataFrame:
        return self.t("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    @property
    def orders(self) -> DataFrame:
        return self.t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority")

    @property
    def history_raw(self) -> DataFrame:
        return standin.history_raw(self.orders, self.customer)

    @property
    def info_raw(self) -> DataFrame:
        return standin.info_raw(self.customer)

    @property
    def county_zips(self) -> DataFrame:
        return standin.county_zips(self.t("nation", "n_nationkey", "n_name"))

    @property
    def county_regions(self) -> DataFrame:
        return standin.county_regions(self.t("nation", "n_nationkey", "n_name", "n_regionkey"),
                                      self.t("region", "r_regionkey", "r_name"))

    @property
    def cpi(self) -> DataFrame:
        """(month, Index) from the CPI text table."""
        raw = standin.cpi_raw(self.orders)
        return raw.select(T.to_month(T.parse_ymd("Date")).alias("month"), "Index")

    # --- cleaned tables -------------------------------------------------
    @property
    def h(self) -> DataFrame:
        return clean.clean_history(self.history_raw)

    def i(self, require_sqft: bool = True) -> DataFrame:
        return clean.clean_info(self.info_raw, require_sqft=require_sqft)

    def zr(self, mode: str = "all") -> DataFrame:
        return enrich.zip_lookup(self.county_zips, self.county_regions, mode)

    # --- facts ------------------------------------------------------------
    def sold(self, form: str = "app") -> DataFrame:
        """Sold-home fact.

        * ``app``    first ZIP per county, size must be positive (County, Region);
        * ``viz``    distinct (zip, Region) lookup (Region only);
        * ``all``    app cleaning with every (zip, County, Region) pair;
        * ``report`` report form: parse after joining, no de-duplication.
        """
        if form == "report":
            return enrich.sold_homes_report(
                clean.split_history(self.history_raw), self.i(require_sqft=False),
                self.county_zips,
                parse_month=lambda c: T.to_month(T.parse_mdy(c)),
                parse_price=T.money_to_double)
        mode = {"app": "first_zip", "viz": "zip_region", "all": "all"}[form]
        return enrich.sold_homes(self.h, self.i(require_sqft=(form != "viz")), self.zr(mode))

    def materialized_sold(self, form: str = "app", path: str | None = None) -> DataFrame:
        """The sold fact written once as Parquet partitioned by sale year
        and read back: later queries on a period read only its partitions and
        never recompute the pipeline.  ``path`` defaults to a fresh folder
        under the shared checkpoint directory."""
        import uuid

        from ..session import ensure_checkpoint_dir
        from ..sources.files import write_parquet
        if path is None:
            path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/sold-{form}-{uuid.uuid4().hex}"
        si = self.sold(form)
        write_parquet(si.withColumn("sale_year", F.year("month")), path,
                      partition_by=["sale_year"])
        return self.spark.read.parquet(path)

    def sold_complete(self) -> DataFrame:
        """Report form with ``filter(complete.cases(si))``."""
        return clean.complete_rows(self.sold("report"))

    # --- series -----------------------------------------------------------
    def statewide_ts(self) -> DataFrame:
        """The app's model input: monthly means of price, baths and beds,
        calendar gaps filled with 0."""
        m = aggregate.means(self.sold("app"), {"mean_sale": "price", "mean_baths": "baths",
                                                "mean_beds": "beds"})
        return series.fill_gaps(m, fill={"mean_sale": 0.0, "mean_baths": 0.0, "mean_beds": 0.0})

    def report_ts(self, measure: str = "mean_sale") -> DataFrame:
        """Report series: monthly mean sale (or count / price per sqft) of
        complete sold rows, gaps filled with 0."""
        si = self.sold_complete()
        if measure == "mean_sale":
            m = aggregate.mean_series(si)
        elif measure == "count_sales":
            m = aggregate.count_series(si)
        elif measure == "mean_pricesqft":
            m = aggregate.price_per_sqft_series(si)
        else:
            raise ValueError(measure)
        return series.fill_gaps(m, fill={measure: 0})

    def median_ts(self) -> DataFrame:
        """Medians of size, price, baths and beds per month, gaps filled with 0
        (input of the regression reports)."""
        m = aggregate.medians(self.sold_complete(), {
            "median_sqft": "sqft", "median_price": "price", "median_baths": "baths",
            "median_beds": "beds"})
        return series.fill_gaps(m, fill={c: 0.0 for c in (
            "median_sqft", "median_price", "median_baths", "median_beds")})

    def region_ts(self) -> DataFrame:
        """Monthly mean sale per Region (visualisation form), gaps filled with 0."""
        m = aggregate.mean_series(self.sold("viz"), keys=["Region"])
        return series.fill_gaps(m, keys=["Region"], fill={"mean_sale": 0.0})
