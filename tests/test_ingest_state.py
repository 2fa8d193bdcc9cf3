"""The ingest with state and ledger: late, repeated and untimed records, restarts, and batches
that die half-way."""

import datetime as dt

import pytest

from homecast.streaming import ingest as ING

SCHEMA = "ts timestamp_ntz, user_id long, event_type string, value double, props string, event_id long"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def record(n, ts):
    return (ts, n, "view", float(n), None if n % 2 else "p")


def deliver(spark, folder, name, rows):
    rows = [(*r, i) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/landing/d={name}")


def run(spark, folder):
    ING.run_stateful_ingest(spark, f"{folder}/landing/*", spark.createDataFrame([], SCHEMA).schema, f"{folder}/sink",
                            f"{folder}/checkpoint", delay="1 day", max_files_per_trigger=1)


def committed(spark, folder):
    rows = ING.read_committed(spark, f"{folder}/sink", spark.createDataFrame([], SCHEMA).schema).select(*ING.RECORD_KEYS).collect()
    return sorted((tuple(x) for x in rows), key=repr)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_late_repeated_and_untimed_records(spark, tmp_path, few_partitions, monkeypatch):
    folder = str(tmp_path)
    one = [record(n, at(n)) for n in range(4)] + [record(90, None), record(90, None)]
    deliver(spark, folder, 1, one + one[:2])
    run(spark, folder)
    deliver(spark, folder, 2, [record(5, at(9)), one[3], record(90, None)])   # a repeat, still in the state
    run(spark, folder)                                                        # a restart
    read = []
    keep = ING.read_committed
    monkeypatch.setattr(ING, "read_committed", lambda *a: read.append(1) or keep(*a))
    deliver(spark, folder, 3, [record(6, at(9, 5)), record(5, at(9))])        # nothing late: the sink is not read
    run(spark, folder)
    assert not read
    late = [record(50, at(1)), record(50, at(1)), one[0], record(51, at(2))]  # late: new, twice, known, new
    deliver(spark, folder, 4, [*late, record(7, at(12))])
    run(spark, folder)
    assert read
    monkeypatch.undo()
    want = {*one, record(5, at(9)), record(6, at(9, 5)), record(50, at(1)), record(51, at(2)), record(7, at(12))}
    assert committed(spark, folder) == sorted(want, key=repr)


def test_a_batch_that_dies_leaves_nothing_and_comes_again(spark, tmp_path, few_partitions, monkeypatch):
    folder = str(tmp_path)
    rows = [record(n, at(n)) for n in range(6)]
    deliver(spark, folder, 1, rows[:3])
    run(spark, folder)
    commit = ING._commit

    def die(*_):
        raise RuntimeError("between write and commit")

    monkeypatch.setattr(ING, "_commit", die)
    deliver(spark, folder, 2, rows[2:])
    with pytest.raises(Exception, match="between write and commit"):
        run(spark, folder)
    assert committed(spark, folder) == sorted(rows[:3], key=repr)             # written, but not to be read
    monkeypatch.setattr(ING, "_commit", commit)
    run(spark, folder)
    assert committed(spark, folder) == sorted(rows, key=repr)

    def then_die(*a):
        commit(*a)
        raise RuntimeError("after the commit")

    monkeypatch.setattr(ING, "_commit", then_die)
    deliver(spark, folder, 3, [record(8, at(8))])
    with pytest.raises(Exception, match="after the commit"):
        run(spark, folder)
    monkeypatch.setattr(ING, "_commit", commit)
    run(spark, folder)
    assert committed(spark, folder) == sorted([*rows, record(8, at(8))], key=repr)
    assert ING.read_ledger(spark, f"{folder}/sink").groupBy("batch_id").count().filter("count > 1").count() == 0


def test_what_the_sink_holds_is_not_broadcast(spark, tmp_path, few_partitions, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    plans, join = [], DataFrame.join

    def seen(left, right, on=None, how=None):
        out = join(left, right, on, how)
        if how == "left_anti":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(DataFrame, "join", seen)
    folder = str(tmp_path)
    rows = [record(1, at(1)), record(2, at(9)), record(3, None)]
    deliver(spark, folder, 1, rows)
    run(spark, folder)
    deliver(spark, folder, 2, [record(4, at(2)), *rows])                      # late, known and untimed
    run(spark, folder)
    batch = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    for _ in range(2):
        ING.append_new(batch, f"{folder}/plain")
    assert len(plans) >= 3
    for plan in plans:
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        assert not any("BroadcastHashJoin" in x and "LeftAnti" in x for x in plan.splitlines())
    assert committed(spark, folder) == sorted([*rows, record(4, at(2))], key=repr)
    assert ING.read_sink(spark, f"{folder}/plain").count() == 3
