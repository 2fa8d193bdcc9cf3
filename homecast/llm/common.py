"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The white space of every word rule: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
#: Rows of one bucket of a distributed running sum (one task sorts one bucket).
BUCKET_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, and a lost executor costs nothing that is not in the folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which stay until the driver
    happens to collect its garbage; what the last step's listeners hold goes the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def text_or_empty(column: str | Column = "text") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of non-white characters, in order (none for an empty text)."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WHITE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def unit_interval(*columns: Column) -> Column:
    """A reproducible number in [0, 1) from the hash of ``columns``."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def running_start(df: DataFrame, keys: list[str], tie: list[str], value: str, out: str,
                  bucket_rows: int = BUCKET_ROWS, n_rows: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that stand
    before this row.  Rows are dealt into hash buckets of about ``bucket_rows`` (so no
    task sorts a whole hot key); inside a key the order is (bucket, ``tie``).  ``tie``
    must tell the rows of a key apart.  One row per key and bucket is summed a second
    time.  The result depends on the rows only, not on their partitioning."""
    n = df.count() if n_rows is None else n_rows
    buckets = max(1, -(-n // bucket_rows))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*tie).rowsBetween(
        Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(outer), F.lit(0)).cast("long"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                       F.col("_bucket").alias("_b"), "_base")
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    return local.join(sums, on).withColumn(out, F.col("_base") + F.col("_local")).drop(
        "_b", "_bucket", "_base", "_local", *[f"_k{i}" for i in range(len(keys))])


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a public tokenizer file: in ``folder``, or where the installed
    ``public_tokenizers`` has it (the same on the driver and the executors)."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """The rows as one struct column, so that no name of theirs can clash in a join."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def field(name: str) -> Column:
    return F.col(f"_doc.`{name}`")


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    return df.select(*[replaced.get(c, field(c)).alias(c) for c in columns])


def keyed(docs: DataFrame) -> DataFrame:
    """The packed rows with a key of their own (``_row``).  Decisions about rows go by this
    key: ids may repeat or be null.  Rows of Parquet files are named by file and place in
    it, which needs no copy of them; any others are written with a number."""
    rows = _placed(docs)
    return materialize(packed(docs).withColumn("_row", F.monotonically_increasing_id())) if rows is None else rows


def _placed(docs: DataFrame) -> DataFrame | None:
    """The rows keyed by their place, if ``docs`` is nothing but files that tell it."""
    try:
        if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
            return None
        place = docs.metadataColumn("_metadata")
        path, at = place["file_path"].alias("_path"), place["row_index"].alias("_at")
        places = docs.select(path, at)
    except (AnalysisException, AttributeError):
        return None
    files = places.groupBy("_path").agg(F.count("*").alias("n"), F.max("_at").alias("last")).orderBy("_path").collect()
    if any(f["n"] != f["last"] + 1 for f in files):  # a file that is read twice
        return None
    numbers = docs.sparkSession.createDataFrame(
        [(f["_path"], i << 33) for i, f in enumerate(files)], "_file string, _base long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), path, at)
    return rows.join(F.broadcast(numbers), F.col("_path") == F.col("_file")).select(
        "_doc", (F.col("_base") + F.col("_at")).alias("_row"))


def rows_with_keys(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The ``keyed`` rows whose key is among ``keys(_key)``."""
    return unpacked(rows.join(keys, F.col("_row") == F.col("_key"), "left_semi"), columns)
