from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, revlog
from tidemark.plans import services
from tidemark.sources.connectors import RAW_BAR_SCHEMA, ProviderError, capability, fetch_bars
from tidemark.sources.sinks import write_report

UTC = timezone.utc


def raw_bar(day, hour, close="4.00"):
    stamp = datetime(2024, 1, day, tzinfo=UTC) - timedelta(hours=8)
    return {"symbol": "510300.SH", "open": "3.95", "high": "4.10", "low": "3.90", "close": close, "volume": 100, "turnover": "400", "provider_timestamp": stamp, "retrieved_at": datetime(2024, 1, day, hour, 16, tzinfo=UTC), "provider": "longbridge", "sdk_version": "1", "historical_data_semantics": "historical_latest", "provider_payload": "{}"}


class Provider:
    def __init__(self):
        self.asked = []

    def daily_bars(self, symbol, start, end):
        self.asked.append((symbol, start.day, end.day))
        return [raw_bar(d, 9, "4.05") for d in range(start.day, end.day + 1)]


def test_only_missing_days_are_fetched_and_ingested_once(spark, tmp_path):
    cached = spark.createDataFrame([raw_bar(2, 9), raw_bar(3, 6)], RAW_BAR_SCHEMA)
    expected = spark.createDataFrame([("510300.SH", date(2024, 1, d)) for d in (2, 3, 4)], "symbol string, trade_date date")
    provider, root = Provider(), str(tmp_path / "log")
    whole = services.incremental_bars(provider, cached, expected)
    assert provider.asked == [("510300.SH", 3, 4)]
    assert services.ingest_daily_bars(whole, root) == {"submitted": 3, "inserted": 3}
    assert services.ingest_daily_bars(whole, root) == {"submitted": 3, "inserted": 0}
    assert {(r.trade_date.day, str(r.close.normalize())) for r in revlog.read_log(spark, root).collect()} == {(2, "4"), (3, "4.05"), (4, "4.05")}


def test_ranges_are_fetched_on_the_executors(spark):
    missing = spark.createDataFrame([("510300.SH", date(2024, 1, 3), date(2024, 1, 4)), ("510300.SH", date(2024, 1, 8), date(2024, 1, 8))], "symbol string, first_day date, last_day date")

    class Remote:
        def daily_bars(self, symbol, start, end):
            from datetime import datetime, timezone

            return [{"symbol": symbol, "close": "4.05", "volume": 100, "provider_timestamp": datetime(2024, 1, d, tzinfo=timezone.utc)} for d in range(start.day, end.day + 1)]

    there = fetch_bars(spark, Remote(), missing, on_executors=True).collect()
    assert sorted(r.provider_timestamp.day for r in there) == [3, 4, 8] and {(r.symbol, r.close, r.volume) for r in there} == {("510300.SH", "4.05", 100)}


def test_shared_folders_are_asked_for_beyond_one_machine(spark):
    from types import SimpleNamespace as Some

    from tidemark.session import ensure_checkpoint_dir

    context = Some(getCheckpointDir=lambda: None, getConf=lambda: Some(get=lambda *_: None), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Some(sparkContext=context, conf=Some(get=lambda *_: None)))


def test_adjusted_bars_are_refused_before_anything_is_read():
    with pytest.raises(ValueError, match="unadjusted"):
        services.ingest_daily_bars(None, "nowhere", adjust="forward")


def test_diagnostic_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = date(2020, 1, 1)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (120, 3)), axis=0))
    rows = [(n, start + timedelta(days=i), float(prices[i, j])) for i in range(120) for j, n in enumerate("xyz")] + [("CASH", start, 1.0)]
    registry = spark.createDataFrame([("z", 1), ("y", 2), ("x", 3), ("CASH", 4), ("none", 5)], "asset string, ord int")
    tables = services.diagnostic(spark.createDataFrame(rows, "asset string, day date, level double"), registry, focus=[("x", "y"), ("x", "none")], windows=[10, 30])
    r = prices[1:] / prices[:-1] - 1
    rho = np.corrcoef(r.T)
    assert tables["effective_breadth_daily"].first().effective_n == pytest.approx(9 / (rho**2).sum())
    assert [(p.asset_1, p.asset_2) for p in tables["pairwise_correlations"].where("frequency = 'daily'").orderBy("asset_1", "asset_2").collect()] == [("y", "x"), ("z", "x"), ("z", "y")]
    assert {p.status for p in tables["rolling_pair_correlations"].collect()} == {"OK", "UNAVAILABLE"}
    assert tables["rolling_effective_breadth"].count() == 119 - 30 + 1
    assert tables["cluster_linkage"].count() == 2 and tables["eigenvalues_daily"].count() == 3
    assert {c.asset: c.flag for c in tables["coverage"].collect()}["none"] == "UNRESOLVED"
    write_report({"effective_breadth": tables["effective_breadth_daily"]}, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/effective_breadth.csv")).count() == 1
    with pytest.raises(ValueError, match="two assets"):
        services.diagnostic(spark.createDataFrame(rows, "asset string, day date, level double").where("asset = 'x'"), registry, focus=[], windows=[5])


def test_evidence_rules(spark):
    df = spark.createDataFrame([("https://a.b/c", ["x", "x"]), ("http://", ["q"]), (None, [])], "url string, scopes array<string>")
    got = [(r.a, r.b, r.c) for r in df.select(quality.web_address("url").alias("a"), quality.foreign_members("scopes", ["x"]).alias("b"), quality.repeated_members("scopes").alias("c")).collect()]
    assert got == [(True, [], True), (False, ["q"], False), (False, [], False)]


def test_capabilities():
    def denied():
        raise PermissionError

    def failed():
        raise ProviderError("x")

    assert [capability(lambda: [1]), capability(lambda: []), capability(failed), capability(denied), capability(denied, False)] == ["PASS", "FAIL", "FAIL", "NO_PERMISSION", "NO_CREDENTIAL"]


def test_published_breadth_identity(spark):
    """The participation ratio of a matrix is N^2 over its squared entries: [[1, .5], [.5, 1]] gives 1.6."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    x -= x.mean(axis=0)
    q, _ = np.linalg.qr(x)
    y = np.c_[q[:, 0], 0.5 * q[:, 0] + np.sqrt(0.75) * q[:, 1]]
    rows = [("ab"[j], date(2020, 1, 1) + timedelta(days=i), float(y[i, j])) for i in range(400) for j in range(2)]
    from tidemark.operators.breadth import effective_breadth

    r = spark.createDataFrame(rows, "asset string, day date, ret double")
    assert effective_breadth(r, 2).first().effective_n == pytest.approx(1.6, abs=1e-9)
    assert effective_breadth(r.where(F.col("asset") == "a"), 1).first().n_obs == 0
