import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clean import monday, utc_day
from tidemark.operators import rawcache, revlog
from tidemark.operators.panes import pane_changes, window_corrections
from tidemark.streaming.ingest import current_states, start_day_states, start_ingestion
from tidemark.streaming.panes import read_late, read_windows, start_panes

MONDAY = date(2025, 1, 6)
RECORDS = "k string, day date, at timestamp, seq long, v long"


def at(days, hours=9):
    return datetime(2025, 1, 6, tzinfo=timezone.utc) + timedelta(days=days, hours=hours)


def brute_windows(rows, size):
    whole = pane_changes(rows, keys=["k"], item=["day"], pane=monday("day"), arrived_on=utc_day("at"), latest_by=[F.col("at"), F.col("seq")], amount=F.col("v"), cut_off_days=21)
    return sorted((r.k, r.window_start, r.observed_on, r.total) for r in window_corrections(whole, keys=["k"], size=size).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_streamed_panes_equal_the_batch_result_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [("a", MONDAY, at(0), 1, 10), (None, MONDAY, at(1), 4, 1), ("a", MONDAY, at(21), 9, 99), ("a", MONDAY, None, 9, 99), ("b", None, at(1), 9, 99)]
    for seq in range(10, 70):
        day = r.randint(0, 20)
        rows.append((r.choice("ab"), MONDAY + timedelta(day), at(day + r.randint(0, 25), r.randint(0, 23)), seq, r.choice([None, 0, 5, 7, 9])))
    shuffled = r.sample(rows, len(rows))
    batches = [shuffled[:25], shuffled[25:], rows[:10]]  # late before early, and some again
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    for batch in batches:
        spark.createDataFrame(batch, RECORDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORDS).parquet(source)
        start_panes(
            stream, keys=["k"], item=["day"], pane=monday("day"), arrived_on=utc_day("at"), latest_by=[F.col("at"), F.col("seq")], amount=F.col("v"), cut_off_days=21, store=store, checkpoint=check, size=2
        ).awaitTermination()
    found = sorted((x.k, x.window_start, x.observed_on, x.total) for x in read_windows(spark, store, ["k"]).collect())
    whole = spark.createDataFrame(rows, RECORDS)
    assert found == brute_windows(whole, 2) and len(found) > 20
    late = sum(1 for b in batches for x in b if x[1] and x[2] and (x[2].date() - (x[1] - timedelta(x[1].weekday()))).days >= 21)
    assert sum(x.n_late for x in read_late(spark, store).collect()) == late


def test_a_stream_without_records_in_time(spark, tmp_path):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    spark.createDataFrame([("a", MONDAY, at(30), 1, 10)], RECORDS).write.parquet(source)
    stream = spark.readStream.schema(RECORDS).parquet(source)
    start_panes(stream, keys=["k"], item=["day"], pane=monday("day"), arrived_on=utc_day("at"), latest_by=[F.col("at")], amount=F.col("v"), cut_off_days=21, store=store, checkpoint=check).awaitTermination()
    assert read_windows(spark, store, ["k"]).count() == 0


RAW = "symbol string, open string, high string, low string, close string, volume long, turnover string, provider_timestamp timestamp, retrieved_at timestamp, provider string, sdk_version string, historical_data_semantics string, provider_payload string"


def raw(day, hour, minute, close="4.00", symbol="510300.SH"):
    stamp = datetime(2024, 1, day, 16, tzinfo=timezone.utc) - timedelta(days=1)
    return (symbol, "3.95", "4.10", "3.90", close, 100, "400", stamp, datetime(2024, 1, day, hour, minute, tzinfo=timezone.utc), "longbridge", "1", "historical_latest", None)


def test_streamed_ingestion_is_once_and_only_of_finalized_days(spark, tmp_path):
    source, log, store = (str(tmp_path / n) for n in ("in", "log", "states"))
    for n, rows in enumerate([[raw(4, 7, 3), raw(3, 9, 0)], [raw(4, 7, 16, "4.01"), raw(3, 9, 0)]]):
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RAW).parquet(source)
        start_ingestion(stream, log, str(tmp_path / "c1")).awaitTermination()
        start_day_states(stream, store, str(tmp_path / "c2")).awaitTermination()
    bars = {(r.trade_date.day, str(r.close)) for r in revlog.read_log(spark, log).collect()}
    assert bars == {(3, "4.00000000"), (4, "4.01000000")} and revlog.read_log(spark, log).count() == 2
    batch = rawcache.day_states(spark.read.parquet(source))
    assert {(r.trade_date, r.state) for r in current_states(spark.read.parquet(store)).collect()} == {(r.trade_date, r.state) for r in batch.collect()}
