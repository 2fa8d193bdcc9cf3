"""Text-file scans and sinks (S1-S7, S9) with explicit schemas.

Spark's CSV reader strips a UTF-8 BOM and CRLF line ends, so lookups saved
from spreadsheets need no column renaming.  An unquoted empty field reads as
NULL, and ``NA`` is treated as NULL as in R's ``read.csv``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema as S


def read_csv(spark: SparkSession, path: str, schema: StructType, sep: str = ",",
             header: bool = True) -> DataFrame:                                   # S1, S2, S5
    return (spark.read.schema(schema)
            .option("header", header).option("sep", sep)
            .option("nullValue", "NA").option("mode", "PERMISSIVE")
            .option("enforceSchema", True)
            .csv(path))


def read_history(spark, path):
    return read_csv(spark, path, S.HISTORY_RAW)


def read_info(spark, path):
    return read_csv(spark, path, S.INFO_RAW)


def read_county_zips(spark, path) -> DataFrame:
    """County -> ZIP lookup; the ZIP column is renamed to ``zip``."""
    return read_csv(spark, path, S.COUNTY_ZIPS).withColumnRenamed("Zip", "zip")


def read_county_regions(spark, path) -> DataFrame:
    return read_csv(spark, path, S.COUNTY_REGIONS)


def read_cpi(spark, path) -> DataFrame:                                            # S5
    return read_csv(spark, path, S.CPI_RAW)


def read_link_list(spark, path) -> DataFrame:                                      # S3
    """A pandas-written list: unnamed index column plus a column named ``0``."""
    return read_csv(spark, path, S.LINK_LIST).select(F.col("`0`").alias("link"))


def read_house_sample(spark, path) -> DataFrame:                                   # S4
    return read_csv(spark, path, S.HOUSE_SAMPLE, sep=" ")


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:            # S9
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:          # S6, S7
    """CSV sink without an index column.  Never point it at a path the same plan reads."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
