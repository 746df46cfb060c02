import hashlib
import json
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import identity, normalize
from tidemark.operators import rawcache, reconcile, revlog

UTC = timezone.utc
PLAIN = "symbol string, trade_date date, open decimal(28,8), high decimal(28,8), low decimal(28,8), close decimal(28,8), volume long, turnover decimal(38,4), data_time timestamp, available_time timestamp, ingest_time timestamp, source string, availability_policy_id string, historical_data_semantics string"


def ts(day, hour, minute=0, month=1, year=2024):
    return datetime(year, month, day, hour, minute, tzinfo=UTC)


def bar(close="4.00", ingest=None, day=date(2024, 1, 2), policy="daily_bar_eod_v1_15m", semantics="historical_latest", source="longbridge", symbol="510300.SH", volume=100):
    d = Decimal
    noon = datetime(day.year, day.month, day.day, tzinfo=UTC)
    return (symbol, day, d("3.95"), d("4.10"), d("3.90"), d(close), volume, d("400"), noon + timedelta(hours=7), noon + timedelta(hours=7, minutes=15), ingest or noon + timedelta(hours=8), source, policy, semantics)


def frame(spark, *bars):
    return spark.createDataFrame(list(bars), PLAIN)


# --- identity ---

def test_published_hash_vector(spark):
    r = identity.with_bar_ids(frame(spark, bar())).first()
    assert r.value_hash == "e3d1f3130b0d194ba60cb902da802e98e77ec9a8f1b8967ed7db1bf2bb87ab40"
    assert r.observation_id == "2267620012c0a80ef53ad1ed16250341143cb219676b88a275cd5320636a56d9"


def test_policy_changes_the_observation_but_not_the_value(spark):
    a, b = identity.with_bar_ids(frame(spark, bar(), bar(policy="v2_30m"))).collect()
    assert a.value_hash == b.value_hash and a.observation_id != b.observation_id


def test_hashes_do_not_depend_on_the_session_zone(spark):
    df = frame(spark, bar())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert identity.with_bar_ids(df).first().observation_id.startswith("2267620012c0")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_escapes_and_nulls(spark):
    text = "５１０３００．SH 🙂 \"q\""
    df = spark.createDataFrame([(text, None, 1)], "symbol string, b string, a int")
    values = {"symbol": F.col("symbol"), "b": F.col("b"), "a": F.col("a")}
    got = df.select(identity.sorted_json(values, ascii_only=True).alias("x"), identity.sorted_json(values).alias("y"), identity.stable_id(values | {"ingest_time": F.lit(1)}).alias("z")).first()
    content = {"symbol": text, "b": None, "a": 1}
    assert got.x == json.dumps(content, sort_keys=True, separators=(",", ":"))
    assert got.y == json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    runs = df.select(identity.sorted_json(values, ascii_only=True, plain=("a",)).alias("x")).first()
    assert runs.x == got.x
    assert got.z == hashlib.sha256(got.y.encode()).hexdigest()


def test_canonical_decimals(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("4.10000000", "100.00000000", "0.00000000", "-2.50000000", "0.00000001")], "d decimal(28,8)")
    assert [r[0] for r in df.select(identity.canonical_decimal("d")).collect()] == ["4.1", "100", "0", "-2.5", "0.00000001"]


def test_request_keys_and_file_hashes(spark, tmp_path):
    a = identity.request_key(" 510300.sh", date(2024, 1, 1), date(2024, 1, 2), "none")
    assert a == identity.request_key("510300.SH", date(2024, 1, 1), date(2024, 1, 2), "none") != identity.request_key("510300.SH", date(2024, 1, 1), date(2024, 1, 3), "none")
    (tmp_path / "r.yaml").write_bytes(b"a: 1\n")
    assert identity.file_hashes(spark, str(tmp_path / "r.yaml")).first().sha256 == hashlib.sha256(b"a: 1\n").hexdigest()


# --- point-in-time reads ---

def log_of(spark, *bars):
    return identity.with_bar_ids(frame(spark, *bars)).withColumn("revision_schema_version", F.lit(3).cast("short"))


def closes(log, as_of, mode, start=date(2019, 1, 1), end=date(2026, 12, 31)):
    return [str(r.close.normalize()) for r in revlog.bars_as_of(log, "510300.SH", start, end, source="longbridge", as_of=as_of, mode=mode).collect()]


def test_replay_sees_each_revision_when_it_was_stored(spark):
    log = log_of(spark, bar("4.00"), bar("4.01", ts(2, 12)), bar("9", source="other"))
    assert [closes(log, ts(2, h), revlog.SYSTEM_REPLAY) for h in (7, 10, 13)] == [[], ["4"], ["4.01"]]


def test_economic_sees_late_downloads_and_replay_does_not(spark):
    late = log_of(spark, bar(day=date(2019, 1, 2), ingest=ts(2, 8, year=2026)))
    at = ts(2, 8, year=2019)
    assert (closes(late, at, revlog.ECONOMIC), closes(late, at, revlog.SYSTEM_REPLAY), closes(late, ts(2, 9, year=2026), revlog.SYSTEM_REPLAY)) == (["4"], [], ["4"])


def test_ties_go_by_policy_then_hash(spark):
    log = log_of(spark, bar("4.00", policy="p_15m"), bar("4.01", policy="p_9m"))
    assert closes(log, ts(3, 0), revlog.ECONOMIC) == ["4.01"]


def test_arguments_are_checked(spark):
    log = log_of(spark, bar())
    for bad in ({"as_of": datetime(2024, 1, 3)}, {"mode": "latest"}, {"start": date(2025, 1, 1), "end": date(2024, 1, 1)}):
        with pytest.raises(ValueError):
            closes(**({"log": log, "as_of": ts(3, 0), "mode": revlog.ECONOMIC} | bad))
    assert closes(log.limit(0), ts(3, 0), revlog.ECONOMIC) == []


# --- the log on disk ---

def test_append_is_idempotent_and_prunes_months(spark, tmp_path):
    root = str(tmp_path / "log")
    first = frame(spark, bar(), bar(day=date(2024, 2, 5)), bar())
    assert revlog.append_bars(first, root) == {"submitted": 3, "inserted": 2}
    assert revlog.append_bars(first, root) == {"submitted": 3, "inserted": 0}
    assert revlog.append_bars(frame(spark, bar("4.01", ts(2, 12))), root) == {"submitted": 1, "inserted": 1}
    assert revlog.append_bars(first.limit(0), root) == {"submitted": 0, "inserted": 0}
    assert revlog.read_log(spark, root).count() == 3
    assert {len(revlog.month_folders(spark, root)), revlog.read_log(spark, root, date(2024, 2, 1), date(2024, 2, 28)).count()} == {2, 1}
    plan = revlog.read_log(spark, root, date(2024, 2, 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert [str(r.close.normalize()) for r in revlog.revision_history(revlog.read_log(spark, root), "510300.SH", date(2024, 1, 2), "longbridge").collect()] == ["4", "4.01"]


def test_conflicting_semantics_raise(spark, tmp_path):
    root = str(tmp_path / "log")
    revlog.append_bars(frame(spark, bar()), root)
    with pytest.raises(PySparkException, match="semantics conflict"):
        revlog.append_bars(frame(spark, bar(semantics="true_vintage")), root)


def test_invalid_and_provisional_bars_are_refused(spark, tmp_path):
    bad = frame(spark, bar("5.00"), bar(volume=-1), bar(symbol=" "), bar())
    assert [sorted(r.violated) for r in revlog.with_violations(bad).collect()] == [["high_below_body"], ["negative_volume"], ["empty_identifier"], []]
    with pytest.raises(ValueError, match="invalid bars"):
        revlog.append_bars(bad, str(tmp_path / "log"))
    with pytest.raises(ValueError, match="provisional"):
        revlog.require_finalized(frame(spark, bar(ingest=ts(2, 7, 3))))
    revlog.require_finalized(frame(spark, bar()))


def test_migration_of_older_schemas(spark, tmp_path):
    root = str(tmp_path / "log")
    old = frame(spark, bar(), bar(day=date(2024, 2, 5))).drop("availability_policy_id", "historical_data_semantics").withColumn("observation_id", F.lit("x")).withColumn("payload_hash", F.lit("y"))
    old.withColumn("year", F.year("trade_date")).withColumn("month", F.month("trade_date")).write.partitionBy("year", "month").parquet(root)
    assert list(revlog.schema_versions(spark, root).values()) == [[2], [2]]
    with pytest.raises(revlog.SchemaError):
        revlog.read_log(spark, root)
    assert revlog.migrate(spark, root) == 2 and revlog.migrate(spark, root) == 0
    rows = revlog.read_log(spark, root).collect()
    assert {r.availability_policy_id for r in rows} == {"legacy_inferred_daily_bar_900s"} and len(rows) == 2
    old.where("trade_date < '2024-02-01'").drop("observation_id", "payload_hash").withColumn("close", F.lit("4.05").cast("decimal(28,8)")).coalesce(1).write.mode("append").parquet(revlog.month_folders(spark, root)[0])
    assert list(revlog.schema_versions(spark, root).values()) == [[1, 3], [3]]  # one stray file
    with pytest.raises(revlog.SchemaError):
        revlog.read_log(spark, root, date(2024, 1, 1), date(2024, 1, 31))
    assert revlog.read_log(spark, root, date(2024, 2, 1)).count() == 1  # other months are not looked at
    assert revlog.migrate(spark, root) == 2 and revlog.read_log(spark, root).count() == 3
    assert revlog.schema_version([n for n, _ in revlog.BAR_FIELDS]) == 1
    with pytest.raises(revlog.SchemaError):
        revlog.schema_version(["symbol"])


# --- normalisation ---

RAW = "symbol string, open string, high string, low string, close string, volume long, turnover string, provider_timestamp timestamp, retrieved_at timestamp, provider string, sdk_version string, historical_data_semantics string"


def raw(day=2, retrieved=ts(3, 9), close="3.55", volume=100, symbol="510300.sh "):
    return (symbol, "3.5", " 3.6", "3.4E+0", close, volume, "1,355.00", datetime(2024, 1, day, tzinfo=UTC) - timedelta(hours=8), retrieved, "longbridge", "1", "historical_latest")


def test_bars_are_normalised_exactly(spark):
    r = normalize.normalize_bars(spark.createDataFrame([raw()], RAW)).first()
    assert (r.symbol, r.trade_date, r.close, r.turnover, r.availability_policy_id) == ("510300.SH", date(2024, 1, 2), Decimal("3.55"), Decimal("1355"), "daily_bar_eod_v1_15m")
    at = spark.createDataFrame([r]).select(F.unix_seconds("data_time"), F.unix_seconds("available_time")).first()
    assert tuple(at) == (int(ts(2, 7).timestamp()), int(ts(2, 7, 15).timestamp()))


@pytest.mark.parametrize("close", [None, "", "--", "bad", "NaN", "Infinity", "1.123456789"])
def test_strict_decimals_raise(spark, close):
    with pytest.raises(PySparkException, match="close is missing or invalid"):
        normalize.normalize_bars(spark.createDataFrame([raw(close=close)], RAW)).collect()


def test_small_functions(spark):
    one = lambda *cs: tuple(spark.range(1).select(*cs).first())
    lit = F.lit
    assert one(*[normalize.optional_date(lit(x)) for x in ("2024-01-02", "2024/01/02", "20240102", "2024-01-02 00:00", "--", "x", None)]) == (*[date(2024, 1, 2)] * 4, None, None, None)
    assert one(*[normalize.exchange_of(lit(x)) for x in ("510300.SH", "sz159915", "１５９９１５．SZ", "510300.XSHG", "159915.SHE", "510300")]) == ("SH", "SZ", "SZ", "SH", "SZ", "UNKNOWN")
    assert one(*[normalize.etf_symbol(lit(x)) for x in ("510300", "159915", "300", "900001")]) == ("510300.SH", "159915.SZ", None, None)
    assert one(*[normalize.canonical_symbol(lit(x)) for x in (" 510300.sh", "510300", "510300.HK")]) == ("510300.SH", None, None)
    assert one(*[normalize.instrument_type(lit(a), lit(b)) for a, b in (("510300.SH", ""), ("000300.SH", "CN Index"), ("600000.SH", ""))]) == ("ETF", "INDEX", "STOCK")
    assert one(normalize.lots_to_shares(lit("123")), normalize.lots_to_shares(lit(None).cast("string"))) == (12300, None)
    with pytest.raises(PySparkException, match="whole"):
        one(normalize.lots_to_shares(lit("1.005")))
    assert one(*[normalize.redundancy_band(lit(x).cast("double")) for x in (None, float("nan"), -0.95, 0.59, 0.6, 0.75, 0.9)]) == ("INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "LOW_MODERATE", "LOW_MODERATE", "MODERATE", "HIGH", "VERY_HIGH")
    assert one(*[normalize.structural(lit(a).cast("double"), lit(b).cast("double")) for a, b in ((0.9, 0.85), (0.9, None), (float("nan"), 0.9), (-0.95, -0.9))]) == (True, False, False, False)
    assert one(*[normalize.history_flag(lit(date(y, 1, 1)), lit(date(2026, 1, 1))) for y in (2024, 2022, 2019)]) == ("VERY_SHORT_HISTORY", "SHORT_HISTORY", "OK")
    assert one(*[normalize.correlation_distance(lit(float(x))) for x in (1, 0, -1, 1.0001)]) == (0.0, 0.5**0.5, 1.0, 0.0)
    assert one(*[normalize.relative_difference(lit(a), lit(b)) for a, b in ((0, 0), (100, 90), (None, 1))]) == (0.0, 0.1, None)
    assert one(normalize.tolerance_ratio(lit(0.0), 0), normalize.tolerance_ratio(lit(1.0), 0), normalize.tolerance_ratio(lit(1.0), 4)) == (0.0, float("inf"), 0.25)
    assert one(*[normalize.history_status(lit(date(2020, 1, d)), lit(date(2020, 1, 2))) for d in (1, 2)]) == ("BACKFILLED", "LIVE")
    assert one(normalize.redacted(lit("token=abc&x=1"))) == ("token=***&x=1",)
    assert normalize.policy_id("v2", 45) == "daily_bar_eod_v2_45s"
    seconds = [F.unix_seconds(normalize.provider_time(lit(x))) for x in ("1704153600", "2024-01-02T00:00:00", "2024-01-02T08:00:00+08:00")]
    assert set(one(*seconds)) == {int(ts(2, 0).timestamp())}
    with pytest.raises(PySparkException, match="unreadable provider time"):
        one(normalize.provider_time(lit("soon")))
    at = int(datetime(2024, 1, 2, 16, tzinfo=UTC).timestamp())
    assert one(normalize.local_day(F.timestamp_seconds(lit(at))), F.unix_seconds(normalize.session_open(lit(date(2024, 1, 2))))) == (date(2024, 1, 3), int(ts(2, 1, 30).timestamp()))


# --- raw cache ---

def test_days_are_finalized_by_retrieval_after_the_cut_off(spark):
    rows = spark.createDataFrame([raw(4, ts(4, 7, 3)), raw(5, ts(5, 7, 3)), raw(5, ts(5, 7, 15)), raw(5, ts(5, 8, 0)), raw(8, None)], RAW)
    assert {(r.trade_date.day, r.state, r.n_records) for r in rawcache.day_states(rows).collect()} == {(4, "provisional", 1), (5, "finalized", 3)}
    assert rawcache.finalized_records(rows).count() == 2
    early = spark.createDataFrame([(date(2024, 1, 4), ts(4, 4)), (date(2024, 1, 5), ts(5, 7, 30))], "trade_date date, cut_off timestamp")
    assert sorted(r.trade_date.day for r in rawcache.finalized_records(rows, cut_offs=early).collect()) == [4, 5]
    assert [r.trade_date.day for r in rawcache.finalized_records(rows, cut_offs=early, states=rawcache.day_states(rows)).collect()] == [5]
    only = spark.createDataFrame([(date(2024, 1, 4),)], "trade_date date")
    assert rawcache.day_states(rows, expected=only).count() == 1


def test_records_are_cached_once(spark):
    rows = spark.createDataFrame([raw(), raw(), raw(close="3.56")], RAW)
    cached = rawcache.upsert(None, rows)
    assert cached.count() == 2 and rawcache.upsert(cached, rows).count() == 2


def test_missing_ranges_run_in_trading_days(spark):
    days = [2, 3, 5, 8, 9, 10]
    expected = spark.createDataFrame([("a", date(2024, 1, d)) for d in days] + [("b", date(2024, 1, 2))], "symbol string, trade_date date")
    states = spark.createDataFrame([("a", date(2024, 1, 5), "finalized"), ("a", date(2024, 1, 9), "provisional"), ("b", date(2024, 1, 2), "finalized")], "symbol string, trade_date date, state string")
    assert sorted((r.symbol, r.first_day.day, r.last_day.day, r.n_days) for r in rawcache.missing_ranges(expected, states).collect()) == [("a", 2, 3, 2), ("a", 8, 10, 3)]
    assert rawcache.missing_days(expected, states).count() == 5
    assert rawcache.missing_ranges(expected.limit(0), states).count() == 0


def test_old_manifests_prove_nothing(spark):
    old = spark.createDataFrame([("a", "none", 2, date(2024, 1, 2), "finalized"), ("a", "none", 3, date(2024, 1, 3), "finalized"), ("a", "none", 2, date(2024, 1, 3), "verified")], "symbol string, adjust string, version int, trade_date date, state string")
    assert {(r.trade_date.day, r.state) for r in rawcache.upgraded_manifest(old).collect()} == {(2, "provisional"), (3, "finalized")}


# --- reconciliation ---

def test_reconciliation_statuses(spark):
    schema = "symbol string, trade_date date, open double, high double, low double, close double, volume long, turnover double"
    side = lambda *rows: spark.createDataFrame([("s", date(2024, 1, d), p, p, p, p, v, t) for d, p, v, t in rows], schema)
    ours = side((2, 4.0, 10000, 40000.0), (3, 4.0, 10000, 40000.0), (4, 4.0, 10000, 40000.0), (5, 4.0, 1, 1.0), (8, 4.0, None, 1.0), (9, 4.0, 0, 0.0))
    theirs = side((2, 4.004, 9900, 39800.0), (3, 4.008, 9700, 39000.0), (4, 4.02, 8000, 30000.0), (8, 4.0, 5, 1.0), (9, 4.0, 0, 0.0))
    got = {r.trade_date.day: r for r in reconcile.reconcile(ours, theirs, ["symbol", "trade_date"], price=0.005, volume=0.02, turnover=0.02, multiplier=2).collect()}
    assert {d: r.status for d, r in got.items()} == {2: "PASS", 3: "WARNING", 4: "FAIL", 5: "FAIL", 8: "FAIL", 9: "PASS"}
    assert got[5].price_abs_difference == float("inf")
