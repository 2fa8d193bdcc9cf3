"""CSV sources with BOM and CRLF, and the streaming ingest."""

import os
import tempfile

from pyspark.sql import functions as F

from homecast.sources import files as FS
from homecast.streaming import ingest as ING

from .conftest import SF_SMALL


def test_lookup_csv_with_bom_crlf(spark):
    d = tempfile.mkdtemp(prefix="hc-csv-", dir="/tmp")
    p = os.path.join(d, "cz.csv")
    with open(p, "wb") as f:
        f.write("﻿County,Zip\r\nClark,47106\r\nFloyd,47106\r\nAdams,04601\r\n".encode("utf-8"))
    df = FS.read_county_zips(spark, p)
    assert df.columns == ["County", "zip"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("Adams", "04601"), ("Clark", "47106"), ("Floyd", "47106")]


def test_house_sample_space_delimited(spark):
    d = tempfile.mkdtemp(prefix="hc-hs-", dir="/tmp")
    p = os.path.join(d, "h.txt")
    cols = '"ID" "Price" "Sqft" "Bedroom" "Bathroom" "Airconditioning" "Garage" "Pool" "YearBuild" "Quality" "Lot" "AdjHighway"'
    with open(p, "w") as f:
        f.write(cols + "\n1 360000 3032 4 4 1 2 0 1972 2 22221 0\n")
    r = FS.read_house_sample(spark, p).first()
    assert r.ID == 1 and r.Price == 360000 and r.AdjHighway == 0


def test_streaming_two_batches_equal_one(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    schema = events.schema
    root = tempfile.mkdtemp(prefix="hc-stream-", dir="/tmp")
    landing, sink, ckpt = (os.path.join(root, x) for x in ("landing", "sink", "ckpt"))
    first = events.filter(F.col("event_id") % 2 == 0)
    second = events.filter(F.col("event_id") % 2 == 1).unionByName(first.limit(50))  # re-scraped rows
    first.write.parquet(os.path.join(landing, "b1"))
    n1 = ING.run_ingest(spark, landing + "/*", schema, sink, ckpt)
    assert n1 == first.count()
    second.write.parquet(os.path.join(landing, "b2"))
    n2 = ING.run_ingest(spark, landing + "/*", schema, sink, ckpt)
    assert n2 == ING.ingest_batch(events).count()
    got = ING.read_sink(spark, sink)
    assert got.exceptAll(ING.ingest_batch(events)).count() == 0


def test_link_list_roundtrip_and_empty_table(spark):
    from homecast import schema as SC
    d = tempfile.mkdtemp(prefix="hc-links-", dir="/tmp")
    p = os.path.join(d, "homes.csv")
    with open(p, "w") as f:            # a pandas-written list: index column, then column "0"
        f.write(",0\n0,/homedetails/1_zpid/\n1,/homedetails/2_zpid/\n")
    links = FS.read_link_list(spark, p)
    assert [r.link for r in links.orderBy("link").collect()] == ["/homedetails/1_zpid/",
                                                                "/homedetails/2_zpid/"]
    out = os.path.join(d, "out")
    FS.write_csv(links, out)                                   # S7
    assert spark.read.option("header", True).csv(out).count() == 2
    empty = FS.empty_table(spark, SC.HISTORY_RAW)             # S9
    assert empty.count() == 0 and empty.columns == ["address", "Date", "Event", "Price"]


def test_ingest_rerun_is_idempotent(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    root = tempfile.mkdtemp(prefix="hc-stream2-", dir="/tmp")
    landing, sink, ckpt = (os.path.join(root, x) for x in ("landing", "sink", "ckpt"))
    events.write.parquet(os.path.join(landing, "b1"))
    n1 = ING.run_ingest(spark, landing + "/*", events.schema, sink, ckpt)
    n2 = ING.run_ingest(spark, landing + "/*", events.schema, sink, ckpt)   # nothing new
    ING.append_new(events, sink)                                          # a replayed batch
    assert n1 == n2 == ING.read_sink(spark, sink).count() == ING.ingest_batch(events).count()


def test_more_readers_and_parquet_sink(spark):
    d = tempfile.mkdtemp(prefix="hc-more-", dir="/tmp")
    with open(os.path.join(d, "cpi.csv"), "w") as f:
        f.write("Date,Index\n2022-04-01,289.1\n2022-05-01,NA\n")
    with open(os.path.join(d, "regions.csv"), "w") as f:
        f.write("County,Region\nAdams,N\n")
    with open(os.path.join(d, "info.csv"), "w") as f:
        f.write("link,address,list_price,beds,baths,sqft\n/h/1,\"1 A St, B, IN 46001\",,3,2.5,1500\n")
    cpi = FS.read_cpi(spark, os.path.join(d, "cpi.csv")).collect()
    assert cpi[0]["Index"] == 289.1 and cpi[1]["Index"] is None
    assert FS.read_county_regions(spark, os.path.join(d, "regions.csv")).first().Region == "N"
    info = FS.read_info(spark, os.path.join(d, "info.csv")).first()
    assert info.list_price is None and info.beds == 3 and info.sqft == 1500.0
    out = os.path.join(d, "pq")
    FS.write_parquet(FS.read_cpi(spark, os.path.join(d, "cpi.csv")), out, partition_by=["Date"])
    assert spark.read.parquet(out).count() == 2
