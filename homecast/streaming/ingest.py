"""Incremental ingest of scraped records.

The reference re-reads its whole store, appends the new records and
overwrites the file.  Here new record files land in a folder and a
Structured Streaming query with ``trigger(availableNow=True)`` picks up only
files it has not seen (the checkpoint replaces the work list).  Scrapes
arrive in any event-time order, so no watermark may drop "late" records:
each micro-batch is de-duplicated, anti-joined (null-safe) against the
records already in the sink and appended.  The sink is partitioned by event
month and the join carries the month, so a batch only reads the months it
touches.  A retried batch finds its own rows already present, so re-runs
after a lost executor or driver neither lose nor duplicate records.

``start_stateful_ingest`` keeps the sink out of the common case.  Records are de-duplicated in
the state store (watermark and ``dropDuplicatesWithinWatermark``); only records that are later
than the watermark, and records without a time, take the anti-join path.  Batches are
committed by a ledger: a batch writes its own folder, over what an earlier attempt may have
left there, and then one ledger entry; readers see the batches in the ledger only.  So a
batch that dies half-way leaves nothing that can be read, and one that dies after its entry
is passed over when it comes again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# Record identity: every field except the arrival id.
RECORD_KEYS = ("ts", "user_id", "event_type", "value", "props")
PART = "ym"
NO_TIME = "no-time"


def dedup_records(df: DataFrame, keys=RECORD_KEYS) -> DataFrame:
    """Distinct records by identity (batch form of the ingest)."""
    return df.dropDuplicates(list(keys))


def ingest_batch(events: DataFrame) -> DataFrame:
    """U1 over a whole table: the de-duplicated records."""
    return dedup_records(events).select(*RECORD_KEYS)


def _sink(spark: SparkSession, sink_dir: str, schema: StructType) -> DataFrame | None:
    """The sink's rows; None before the first append."""
    try:
        return spark.read.schema(schema).parquet(sink_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _months(rows: DataFrame) -> list[str]:
    """The months of the rows; the calendar bounds them."""
    return [r[PART] for r in rows.select(PART).distinct().collect()]


def _not_held(rows: DataFrame, held: DataFrame, keys) -> DataFrame:
    """The rows that ``held`` does not have (null-safe on ``keys``).  Both sides are shuffled:
    what a sink holds grows with it and must not go through the driver."""
    held = held.select(*[F.col(k).alias("_o_" + k) for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_o_" + k)) for k in keys])
    return rows.join(held.hint("merge"), same, "left_anti")


def append_new(batch: DataFrame, sink_dir: str, keys=RECORD_KEYS) -> None:
    """Append the records of ``batch`` that the sink does not hold yet.  A record
    without a time goes to the partition ``NO_TIME``."""
    spark = batch.sparkSession
    new = dedup_records(batch, keys).select(*keys).withColumn(
        PART, F.coalesce(F.date_format(F.col("ts"), "yyyy-MM"), F.lit(NO_TIME)))
    new = new.persist()
    try:
        old = _sink(spark, sink_dir, new.schema)
        out = new
        if old is not None:
            # The sink's scan is pruned to the batch's months.
            out = _not_held(new, old.filter(F.col(PART).isin(_months(new))), (*keys, PART))
        out.write.mode("append").partitionBy(PART).parquet(sink_dir)
    finally:
        new.unpersist()


def start_ingest(spark: SparkSession, landing_dir: str, schema: StructType, sink_dir: str,
                 checkpoint_dir: str, max_files_per_trigger: int = 64) -> StreamingQuery:
    """Start the availableNow ingest; call ``awaitTermination()`` on the result."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(landing_dir))
    return (src.writeStream.foreachBatch(lambda df, _id: append_new(df, sink_dir))
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def read_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).select(*RECORD_KEYS)


def run_ingest(spark, landing_dir, schema, sink_dir, checkpoint_dir) -> int:
    """Run one availableNow pass to completion; returns rows now in the sink."""
    q = start_ingest(spark, landing_dir, schema, sink_dir, checkpoint_dir)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    sink = _sink(spark, sink_dir, schema)
    return 0 if sink is None else read_sink(spark, sink_dir).count()


# ------------------------------------------------------------------ state and ledger
LEDGER = "batch_id long, records long, latest timestamp"
#: What the ledger's watermark allows for against the query's own (whole milliseconds).
SLACK = "INTERVAL 1 SECOND"


def _read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_ledger(spark: SparkSession, sink_dir: str) -> DataFrame:
    """batch_id, records, latest (event time) of the committed batches."""
    found = _read_if_there(spark, f"{sink_dir.rstrip('/')}/ledger", LEDGER)
    return spark.createDataFrame([], LEDGER) if found is None else found


def read_committed(spark: SparkSession, sink_dir: str, schema: StructType, keys=RECORD_KEYS) -> DataFrame:
    """The records of the committed batches, with their month (``PART``)."""
    fields = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    rows = _read_if_there(spark, f"{sink_dir.rstrip('/')}/data", f"{fields}, _batch long, {PART} string")
    if rows is None:
        return spark.createDataFrame([], f"{fields}, {PART} string")
    done = read_ledger(spark, sink_dir).select(F.col("batch_id").alias("_done"))
    return rows.join(done, F.col("_batch") == F.col("_done"), "left_semi").drop("_batch")


def _commit(spark: SparkSession, sink_dir: str, batch_id: int, records: int, latest) -> None:
    """The ledger entry, in a folder of its own name: written again it is the same entry."""
    entry = spark.createDataFrame([(batch_id, records, latest)], LEDGER).coalesce(1)
    entry.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/ledger/entry={batch_id}")


def write_batch(batch: DataFrame, batch_id: int, sink_dir: str, schema: StructType, delay: str, keys=RECORD_KEYS) -> None:
    """One micro-batch of ``start_stateful_ingest``: rows tagged ``state`` have passed the
    state store, rows tagged ``raw`` are all rows as they came."""
    spark = batch.sparkSession
    ledger = read_ledger(spark, sink_dir)
    if not ledger.filter(F.col("batch_id") == batch_id).isEmpty():
        batch.write.format("noop").mode("overwrite").save()  # the state store still has to take the batch
        return
    known = ledger.agg(F.max("latest").alias("latest")).first()["latest"]
    batch = batch.persist()
    try:
        month = F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit(NO_TIME))
        state = batch.filter(F.col("_path") == "state").select(*keys, month.alias(PART))
        raw = batch.filter(F.col("_path") == "raw")
        late = F.col("_event").isNull()
        if known is not None:
            late = late | (F.col("_event") <= F.lit(known) - F.expr(f"INTERVAL {delay}") + F.expr(SLACK))
        late = dedup_records(raw.filter(late), keys).select(*keys, month.alias(PART))
        if not late.isEmpty():
            # What the sink or this batch's state path has already; only the late months are read.
            held = read_committed(spark, sink_dir, schema, keys).filter(F.col(PART).isin(_months(late)))
            held = held.select(*keys, PART).unionByName(state)
            state = state.unionByName(_not_held(late, held, (*keys, PART)))
        path = f"{sink_dir.rstrip('/')}/data/_batch={batch_id}"
        # Files by size, not one a task and month: every later batch lists them.
        state.hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(path)
        _commit(spark, sink_dir, batch_id, state.count(), raw.agg(F.max("_event").alias("m")).first()["m"])
    finally:
        batch.unpersist()


def start_stateful_ingest(spark: SparkSession, landing_dir: str, schema: StructType, sink_dir: str,
                          checkpoint_dir: str, delay: str = "7 days", max_files_per_trigger: int = 64,
                          keys=RECORD_KEYS) -> StreamingQuery:
    """Start the availableNow ingest with state; call ``awaitTermination()`` on the result.
    The state holds the records of ``delay``; a record's identity includes its time, so a
    repeated record either finds its first in the state or is late itself."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(landing_dir)).withColumn("_event", F.col("ts").cast("timestamp"))
    timed = src.filter("_event is not null").withWatermark("_event", delay)
    state = timed.dropDuplicatesWithinWatermark(list(keys)).select(*keys, "_event", F.lit("state").alias("_path"))
    both = state.unionByName(src.select(*keys, "_event", F.lit("raw").alias("_path")))
    return (both.writeStream.foreachBatch(lambda df, n: write_batch(df, n, sink_dir, schema, delay, keys))
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def run_stateful_ingest(spark, landing_dir, schema, sink_dir, checkpoint_dir, **options) -> None:
    """Run one availableNow pass to completion."""
    q = start_stateful_ingest(spark, landing_dir, schema, sink_dir, checkpoint_dir, **options)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
