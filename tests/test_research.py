import logging
from datetime import date, datetime, timedelta, timezone
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import breadth, cluster, observations, quality, resolve, returns
from tidemark.operators.revlog import ECONOMIC, SYSTEM_REPLAY
from tidemark.sources import connectors, registry, sinks

UTC = timezone.utc


def levels(spark, **series):
    return spark.createDataFrame([(a, d, v) for a, points in series.items() for d, v in points], "asset string, day date, level double")


def d(n, month=1):
    return date(2020, month, n)


# --- returns ---

def test_returns_fill_nothing_and_mask_nonpositive_levels(spark):
    got = returns.daily_returns(levels(spark, a=[(d(1), 100.0), (d(2), None), (d(3), 110.0), (d(4), 121.0)], b=[(d(1), 100.0), (d(2), 0.0), (d(3), 110.0), (d(4), 121.0)])).collect()
    assert {(r.asset, r.day.day, round(r.ret, 12)) for r in got} == {("a", 4, 0.1), ("b", 4, 0.1)}


def test_an_empty_week_voids_two_returns(spark):
    got = returns.weekly_returns(levels(spark, a=[(d(2), 100.0), (d(3), 105.0), (d(9), 110.0), (d(24), 121.0)])).collect()
    assert [(r.day.day, round(r.ret, 12)) for r in got] == [(9, round(110 / 105 - 1, 12))]


def test_level_audits_and_coverage(spark):
    x = levels(spark, a=[(d(1), 100.0), (d(2), -1.0), (d(20), 100.0), (d(21), 200.0)], b=[(date(2015, 1, 1), 1.0), (date(2021, 1, 1), 1.1)])
    assert {r.asset: (r.nonpositive, r.extreme_returns, r.long_gaps, r.quality) for r in returns.level_warnings(x).collect()} == {"a": (1, 1, 1, "PASS_WITH_WARNINGS"), "b": (0, 0, 1, "PASS_WITH_WARNINGS")}
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "asset string")
    assert {r.asset: (r.n_obs, r.flag) for r in returns.coverage(known, x).collect()} == {"a": (4, "VERY_SHORT_HISTORY"), "b": (2, "OK"), "c": (0, "UNRESOLVED")}
    returns.require_series(x)
    with pytest.raises(ValueError):
        returns.require_series(x.union(x.limit(1)))


# --- breadth ---

def series(spark, matrix, names="abcdef", start=date(2020, 1, 1)):
    rows = [(names[j], start + timedelta(days=i), None if np.isnan(v) else float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "asset string, day date, ret double")


def test_pairs_overlap_and_constant_series(spark):
    r = spark.createDataFrame([("A", d(1), 0.1), ("A", d(2), 0.2), ("A", d(3), 0.4), ("B", d(2), 0.3), ("B", d(3), 0.6), ("B", d(4), 0.8), ("C", d(2), 0.1), ("C", d(3), 0.1), ("D", d(3), 1.0)], "asset string, day date, ret double")
    got = {(x.asset_1, x.asset_2): x for x in breadth.pair_correlations(r, "daily").collect()}
    ab = got["A", "B"]
    assert (ab.start_date, ab.end_date, ab.n_obs, round(ab.rho, 12), ab.band) == (d(2), d(3), 2, 1.0, "VERY_HIGH")
    assert got["A", "C"].rho is None and got["A", "D"].rho is None and got["A", "D"].n_obs == 1
    order = spark.createDataFrame([("B", 1), ("A", 2)], "asset string, ord int")
    assert [(x.asset_1, x.asset_2) for x in breadth.pair_correlations(r, "daily", order).collect()] == [("B", "A")]


def test_common_window_and_effective_breadth_equal_the_spectrum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    x[5, 1] = np.nan
    r = series(spark, x)
    whole = x[~np.isnan(x).any(axis=1)]
    rho = np.corrcoef(whole.T)
    values = np.linalg.eigvalsh(rho)
    got = breadth.effective_breadth(r, 4).first()
    assert got.n_obs == 59 and got.effective_n == pytest.approx(values.sum() ** 2 / (values**2).sum(), abs=1e-10)
    common = breadth.common_window(r, 4)
    m = breadth.correlation_matrix(breadth.pair_correlations(common, "daily"), list("abcd"))
    assert np.allclose(m, rho) and sum(v for _, v, _ in breadth.spectrum(m)) == pytest.approx(4)
    assert breadth.effective_breadth(series(spark, np.c_[whole[:, :2], np.ones(59)]), 3).first().effective_n is None
    assert breadth.effective_breadth(r, 5).first().effective_n is None
    assert breadth.spectrum(np.array([[1, 0.5], [0.5, 1]]))[0][1] == pytest.approx(1.5)
    with pytest.raises(ValueError):
        breadth.spectrum(np.array([[1, np.nan], [np.nan, 1]]))


@pytest.mark.parametrize("window", [2, 5, 16])
def test_rolling_correlations_against_numpy(spark, window):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(37, 3)) + 0.2
    x[10:20, 2] = 0.1
    got = {(r.asset_1, r.asset_2, (r.day - date(2020, 1, 1)).days): r.rho for r in breadth.rolling_correlations(breadth.pairs(series(spark, x)), window).collect()}
    assert len(got) == 3 * (37 - window + 1)
    for a, b in combinations(range(3), 2):
        for end in range(window - 1, 37):
            part = x[end - window + 1 : end + 1]
            rho = got["abc"[a], "abc"[b], end]
            if np.ptp(part[:, b]) == 0:
                assert rho is None
            else:
                assert rho == pytest.approx(np.corrcoef(part[:, a], part[:, b])[0, 1], abs=1e-9)


def test_pairs_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(breadth, "BLOCK", 2)
    x = np.random.default_rng(3).normal(size=(25, 6))
    x[:9, 1] = np.nan
    x[10:, 4] = np.nan
    got = {(r.asset_1, r.asset_2): r for r in breadth.pair_correlations(series(spark, x).where("NOT isnan(ret)"), "daily").collect()}
    assert len(got) == 15
    for i, j in combinations(range(6), 2):
        both = np.flatnonzero(~np.isnan(x[:, i]) & ~np.isnan(x[:, j]))
        row = got["abcdef"[i], "abcdef"[j]]
        assert (row.n_obs, row.start_date, row.end_date) == (len(both), date(2020, 1, 1) + timedelta(int(both[0])), date(2020, 1, 1) + timedelta(int(both[-1])))
        assert row.rho is None if len(both) < 2 else row.rho == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-12)


def test_rolling_statistics_and_breadth(spark):
    x = np.random.default_rng(7).normal(size=(30, 3))
    r = series(spark, x)
    asked = spark.createDataFrame([("b", "a"), ("a", "z")], "asset_1 string, asset_2 string")
    got = {(s.asset_1, s.asset_2, s.window): s for s in breadth.rolling_statistics(r, asked, [10, 99]).collect()}
    rho = [np.corrcoef(x[i - 10 : i, 0], x[i - 10 : i, 1])[0, 1] for i in range(10, 31)]
    s = got["b", "a", 10]
    assert (s.status, s.n_windows) == ("OK", 21)
    assert [s.median, s.p10, s.p90, s.latest] == pytest.approx([np.median(rho), np.quantile(rho, 0.1), np.quantile(rho, 0.9), rho[-1]], abs=1e-9)
    assert got["b", "a", 99].status == "SKIPPED_SHORT_HISTORY" and got["a", "z", 10].status == "UNAVAILABLE"
    last = breadth.rolling_breadth(r, 3, 10).orderBy(F.desc("day")).first()
    m = np.corrcoef(x[20:].T)
    assert last.effective_n == pytest.approx(9 / (m**2).sum(), abs=1e-9)
    assert breadth.focus_pairs([("a", "b")], "g", ["a", "b", "g"]) == [("a", "b"), ("g", "a"), ("g", "b")]


def slow_linkage(distance):
    held, merges, n = {i: [i] for i in range(len(distance))}, [], len(distance)
    for step in range(n - 1):
        best = min((round(float(np.mean([distance[i, j] for i in held[a] for j in held[b]])), 14), a, b) for a, b in combinations(sorted(held), 2))
        merges.append((best[1], best[2], best[0], len(held[best[1]]) + len(held[best[2]])))
        held[n + step] = held.pop(best[1]) + held.pop(best[2])
    return merges


def test_average_linkage_against_brute_force():
    for seed in range(5):
        m = np.corrcoef(np.random.default_rng(seed).normal(size=(7, 20)))
        distance = cluster.distances(m)
        got, want = cluster.average_linkage(distance), slow_linkage(distance)
        assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert cluster.members([(0, 1, 0.1, 2), (2, 3, 0.2, 3)], ["x", "y", "z"]) == [["x", "y"], ["z", "x", "y"]]
    assert cluster.average_linkage(np.zeros((1, 1))) == []


# --- metadata ---

META = "symbol string, tracking_index string, iopv decimal(38,18), asset_class string, market_timezone string, availability_class string, effective_from date, effective_to date, available_time timestamp, ingest_time timestamp, snapshot_at timestamp, source string, provider_payload_hash string"


def t(hours):
    return datetime(2024, 1, 10, tzinfo=UTC) + timedelta(hours=hours)


def meta(source="spot", at=0, index="000300.SH", iopv="4.00", stored=None, kind="snapshot_only", ef=date(2024, 1, 1), et=None, h="aaa", snap=True):
    from decimal import Decimal

    return ("510300.SH", index, iopv and Decimal(iopv), "equity", "Asia/Shanghai", kind, ef, et, t(at), t(stored if stored is not None else at), t(at) if snap else None, source, h)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), META)


def known(spark, rows, as_of, **how):
    return sorted(r.provider_payload_hash for r in observations.eligible(table(spark, *rows), as_of=F.lit(t(as_of)), **({"mode": ECONOMIC} | how)).collect())


def test_eligibility(spark):
    rows = [meta(h="now"), meta(h="late", at=5), meta(h="stored-late", stored=9), meta(h="ended", et=date(2024, 1, 9)), meta(h="last-day", et=date(2024, 1, 10)), meta(h="future", ef=date(2024, 1, 11)), meta(h="no-snapshot", snap=False), meta(h="vintage", snap=False, kind="true_historical_vintage")]
    assert known(spark, rows, 1) == ["last-day", "now", "stored-late", "vintage"]
    assert known(spark, rows, 1, mode=SYSTEM_REPLAY) == ["last-day", "now", "vintage"]
    assert known(spark, rows, 10, research_cutoff=F.lit(t(6))) == ["last-day", "late", "now", "vintage"]
    assert "future" in known(spark, rows, 16)  # already the next day in the row's market zone


def test_latest_and_several_sources(spark):
    two = table(spark, meta(h="a"), meta(h="b", at=2), meta(h="c", ef=None, at=3))
    assert observations.metadata_as_of(two, as_of=F.lit(t(9)), mode=ECONOMIC).first().provider_payload_hash == "b"
    mixed = table(spark, meta(), meta(source="scale"))
    with pytest.raises(ValueError, match="several sources"):
        observations.metadata_as_of(mixed, as_of=F.lit(t(9)), mode=ECONOMIC)
    assert observations.metadata_as_of(mixed, as_of=F.lit(t(9)), mode=ECONOMIC, source="scale").count() == 1


def test_insert_once_keeps_the_first_observed(spark):
    rows = table(spark, meta(at=3, h="x"), meta(at=1, h="x"), meta(at=2, h="y"))
    first = observations.insert_once(None, rows, "provider_payload_hash")
    assert {(r.provider_payload_hash, r.ingest_time.hour) for r in first.collect()} == {("x", 1), ("y", 2)}
    assert observations.insert_once(first, rows, "provider_payload_hash").count() == 0


def test_calendar_and_index_reads(spark):
    days = spark.createDataFrame([("CN", d(2), t(0), t(0), "x", False), ("CN", d(2), t(1), t(5), "y", True)], "market string, trade_date date, available_time timestamp, ingest_time timestamp, source string, is_half_day boolean")
    read = lambda **how: observations.calendar_as_of(days, as_of=F.lit(t(2)), **how)
    assert read(mode=ECONOMIC).first().is_half_day and not read(mode=SYSTEM_REPLAY).first().is_half_day
    with pytest.raises(PySparkException, match="half-day"):
        read(mode=ECONOMIC, half_days="refuse").collect()
    idx = table(spark, meta(h="a"), meta(h="b", at=1)).withColumn("index_code", F.col("tracking_index"))
    assert observations.index_as_of(idx, as_of=F.lit(t(2)), day=F.lit(d(10)), mode=ECONOMIC).count() == 0
    assert observations.index_as_of(idx, as_of=F.lit(t(2)), day=F.lit(date(2024, 1, 10)), mode=ECONOMIC).first().provider_payload_hash == "b"


POLICY = [("iopv", "spot", 1, 3600, resolve.PRECEDENCE), ("iopv", "scale", 2, 3600, resolve.PRECEDENCE), ("tracking_index", "spot", 1, None, resolve.REQUIRE_AGREEMENT), ("tracking_index", "scale", 2, None, resolve.REQUIRE_AGREEMENT)]


def resolved(spark, rows, as_of):
    policy = spark.createDataFrame(POLICY, "field_name string, source string, precedence_rank int, max_age_seconds long, conflict_policy string")
    values = resolve.unpivot_known(table(spark, *rows), {"iopv": F.col("iopv"), "tracking_index": F.col("tracking_index")}, ["symbol", "source", *observations.METADATA_ORDER, "provider_payload_hash"])
    out = resolve.resolve(resolve.latest_per_source(values, ["symbol"]), policy, ["symbol"], as_of=F.lit(t(as_of)))
    return {r.field_name: r for r in out.collect()}


def test_resolver_decisions(spark):
    assert resolved(spark, [meta()], 0.5)["iopv"].status == "RESOLVED"
    stale = resolved(spark, [meta()], 2)["iopv"]
    assert (stale.status, stale.freshness, stale.value[:4]) == ("STALE", "EXPIRED", "4.00")
    conflict = resolved(spark, [meta(), meta(source="scale", index="000905.SH")], 0)["tracking_index"]
    assert (conflict.status, conflict.value, len(conflict.candidates)) == ("CONFLICT", None, 2)
    fallback = resolved(spark, [meta(iopv=None), meta(source="scale", iopv="4.10")], 0)["iopv"]
    assert (fallback.source, fallback.reason) == ("scale", "fallback to a later source")
    note = resolved(spark, [meta(), meta(source="scale", iopv="4.10")], 0)["iopv"]
    assert note.source == "spot" and note.reason.endswith("other sources disagree")
    assert resolved(spark, [meta(index=None, iopv="1")], 0)["tracking_index"].status == "UNKNOWN"
    assert resolved(spark, [meta(h="aaa"), meta(h="zzz")], 0)["iopv"].candidates[0].provider_payload_hash == "zzz"
    assert resolved(spark, [meta(), meta(iopv="4.01")], 0)["iopv"].status == "AMBIGUOUS"
    newer = resolved(spark, [meta(), meta(at=0.2, iopv=None)], 0.3)["iopv"]
    assert newer.status == "RESOLVED" and newer.value.startswith("4.00")
    assert resolved(spark, [], 0) == {}


# --- contracts ---

def test_contract_queries(spark):
    df = spark.createDataFrame([("a", 1, d(1), d(5)), ("a", 2, d(3), None), ("a", 3, d(9), d(10)), ("b", None, d(1), d(2)), ("b", 5, d(2), d(3))], "k string, v int, s date, e date")
    assert sorted((r.k, r.v) for r in quality.overlaps(df, ["k"], "s", "e", ["v"]).collect()) == [("a", 2), ("a", 3)]
    assert [(r.k, r.n) for r in quality.repeated(df.where("k = 'a'"), ["k"]).collect()] == [("a", 3)]
    assert [(r.k, r.rule) for r in quality.row_rules(df, ["k"], {"big": F.col("v") > 4, "odd": F.lit(None).cast("boolean")}).collect()] == [("b", "big")]
    target = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    assert {(r.value, r.n_matches) for r in quality.references(df, "v", target, "id").collect()} == {(1, 2), (3, 0), (5, 0)}
    counts = {r.k: (r.n_rows, r.n_big, r.labels, r.status) for r in quality.coverage_counts(df.withColumn("l", F.col("v").cast("string")), "k", "l", {"n_big": F.col("v") > 4}, "n_big").collect()}
    assert counts == {"a": (3, 0, "1;2;3", "PARTIAL"), "b": (2, 1, "5", "COVERED")}


# --- edges ---

def test_retry_and_chunks():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise connectors.ProviderError("busy", transient=True)
        return "ok"

    assert connectors.with_retry(flaky, base_seconds=1, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(connectors.ProviderError):
        connectors.with_retry(lambda: (_ for _ in ()).throw(connectors.ProviderError("no")), sleep=waits.append)
    assert waits == [1, 2]
    got = list(connectors.chunks(d(1), date(2020, 2, 10), 28))
    assert got == [(d(1), d(28)), (d(29), date(2020, 2, 10))]
    assert connectors.chunked(lambda a, b: [(a, b)], d(1), date(2020, 2, 10), 28) == got


def test_provider_answers(spark, tmp_path):
    ok = '{"success": true, "data": [{"tradeDate": "20240102", "indexCode": "H30184", "close": 4321.5}]}'
    assert tuple(connectors.index_levels(spark, ok, "H30184").first()) == (date(2024, 1, 2), 4321.5, "H30184")
    for bad, code in ((ok, "H30185"), ('{"success": true, "data": []}', "H30184")):
        with pytest.raises(connectors.ProviderError):
            connectors.index_levels(spark, bad, code)
    with pytest.raises(connectors.SchemaBreak):
        connectors.require_columns(spark.range(1), ["id", "name"])

    class Fake:
        def daily_bars(self, symbol, start, end):
            return [{"symbol": symbol, "close": "4", "volume": 1, "provider_timestamp": t(0), "retrieved_at": t(9)}]

    missing = spark.createDataFrame([("a", d(1), d(2)), ("b", d(1), d(1))], "symbol string, first_day date, last_day date")
    raw = connectors.fetch_bars(spark, Fake(), missing)
    assert raw.count() == 2
    sinks.write_json_lines(raw, str(tmp_path / "raw"))
    assert connectors.read_raw_cache(spark, str(tmp_path / "raw"), date(2024, 1, 10)).count() == 2
    assert connectors.read_raw_cache(spark, str(tmp_path / "raw"), end=date(2024, 1, 9)).count() == 0
    listing = spark.createDataFrame([("x",), ("y",), ("y",)], "symbol string")
    assert [connectors.probe(listing, listing, s) for s in "xyz"] == ["RESOLVED", "UNRESOLVED", "UNRESOLVED"]


def test_level_cache_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(d(2), 1.5, "i", "p", t(1), "1", "historical_latest"), (d(1), 1.0, "i", "p", t(1), "1", "historical_latest")], connectors.LEVEL_SCHEMA)
    sinks.write_level_cache(rows, str(tmp_path / "levels"))
    assert [r.level for r in connectors.read_level_cache(spark, str(tmp_path / "levels")).collect()] == [1.0, 1.5]
    with pytest.raises(connectors.ProviderError):
        connectors.read_level_cache(spark, str(tmp_path / "levels"), "other").collect()
    later = rows.union(spark.createDataFrame([(d(1), 9.0, "i", "p", t(2), "1", "historical_latest")], connectors.LEVEL_SCHEMA))
    assert {r.observation_date.day: r.level for r in connectors.last_per_day(later).collect()} == {1: 9.0, 2: 1.5}
    sinks.write_report({"t": spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")}, str(tmp_path / "r"), ("csv", "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r/t.csv")).first().b == "[1,2]"


def test_registries(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("known_sources: [a, b]\nfields:\n  nav: {source_precedence: [b, a], max_age_seconds: 5, conflict_policy: X}\n")
    content = registry.load(path)
    assert [(r.source, r.precedence_rank) for r in registry.resolution_policy(spark, content).orderBy("precedence_rank").collect()] == [("b", 1), ("a", 2)]
    content["fields"]["nav"]["source_precedence"] = ["a"]
    for bad in (lambda: registry.resolution_policy(spark, content), lambda: registry.load(path, sha256="0" * 64), lambda: registry.require({}, ["x"]), lambda: registry.find_one([{"a": 1}, {"a": 1}], a=1)):
        with pytest.raises(registry.ContractError):
            bad()
    path.write_text("x: {deep: [{Access_Token: abc}]}\n")
    with pytest.raises(registry.ContractError, match="x.deep.0.Access_Token"):
        registry.load(path)
    assert registry.merged({"a": 1, "m": {"x": 1, "y": 2}}, None, {"a": None, "m": {"y": 3}}) == {"a": None, "m": {"x": 1, "y": 3}}
    good = {"symbols": ["s"], "price_abs_tolerance": "0.005", "volume_relative_tolerance": "0.02", "turnover_relative_tolerance": "0.02", "warning_multiplier": "2"}
    assert registry.reconciliation_settings(good)["multiplier"] == 2
    with pytest.raises(registry.ContractError):
        registry.reconciliation_settings(good | {"warning_multiplier": "0.5"})
    record = logging.LogRecord("n", 1, "f", 1, "token=%s", ("abc",), None)
    registry.Redaction().filter(record)
    assert record.getMessage() == "token=***"


def test_index_registry(spark):
    row = {"index_code": "H30184", "source": "s", "source_note": "n", "known_at": "2025-01-02T09:00:00+08:00", "launch_date": "2020-01-02", "base_date": "UNKNOWN", "methodology_version": 2}
    got = registry.index_registry(spark, {"indexes": [row]}).first()
    assert (got.launch_date, got.base_date, got.methodology_version, got.availability_class) == (date(2020, 1, 2), None, "2", "snapshot_only")
    assert got.available_time == got.ingest_time == got.snapshot_at
    for bad in ({"indexes": [row | {"known_at": "2025-01-02T09:00:00"}]}, {"indexes": [row | {"source_note": ""}]}, {"indexes": {}}):
        with pytest.raises(registry.ContractError):
            registry.index_registry(spark, bad)
    assert registry.index_registry(spark, {}).count() == 0


def test_stores_take_each_key_once(spark, tmp_path):
    root, rows = str(tmp_path / "s"), table(spark, meta(at=3, h="x"), meta(at=1, h="x"), meta(at=2, h="y"))
    assert [observations.append_once(part, root, "provider_payload_hash") for part in (rows.limit(0), rows, rows)] == [0, 2, 0]
    assert spark.read.parquet(root).count() == 2


def test_calendar_observations_and_cut_offs(spark):
    days = lambda half: spark.createDataFrame([("CN", date(2024, 1, 2), half, "p", t(9))], "market string, trade_date date, is_half_day boolean, provider string, retrieved_at timestamp")
    row = observations.calendar_observations(days(None)).first()
    assert row.available_time == row.session_close and row.availability_policy_id == "historical_calendar_session_close_v1" and row.is_half_day is False
    with pytest.raises(PySparkException, match="unverified"):
        observations.calendar_observations(days(True)).collect()
    whole = observations.calendar_observations(days(False))
    assert [c for c in whole.select(*[F.coalesce(c, F.lit(True)).alias(n) for n, c in observations.calendar_rules().items()]).first()] == [False] * 3
    cut = observations.cut_offs(whole).select(F.unix_seconds("cut_off").alias("c")).first().c
    assert cut == whole.select(F.unix_seconds("session_close").alias("c")).first().c + 900


def test_payloads_and_invariants(spark):
    rows = table(spark, meta(h="x"), meta(h=""), meta(h="y", index=None))
    back = rows.select(*observations.decoded(observations.encoded(rows, ["tracking_index", "iopv", "effective_from"]), {"tracking_index": "string", "iopv": dict(rows.dtypes)["iopv"], "effective_from": "date", "more": "string"}, {"more": F.lit("d")}))
    assert sorted(map(str, back.drop("more").collect())) == sorted(map(str, rows.select("tracking_index", "iopv", "effective_from").collect())) and {r.more for r in back.collect()} == {"d"}
    index = rows.withColumn("index_code", F.col("tracking_index"))
    assert {r.rule for r in quality.row_rules(index, ["symbol"], observations.index_rules()).collect()} == {"empty_identifier"}


def test_columns_in_module_scope_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0


def test_provider_frames(spark):
    from tidemark.sources import frames

    at = F.lit(t(20))
    spot = spark.createDataFrame([("510300", "x", "--", "1000000", "2024-01-10", "t", "extra"), ("300", "y", "1", "1", "d", "t", "e")], "`代码` string, `名称` string, `IOPV实时估值` string, `最新份额` string, `数据日期` string, `更新时间` string, other string")
    a = frames.spot_observations(spot, at)
    r = a.first()
    assert (a.count(), r.symbol, r.iopv, int(r.shares), r.effective_from) == (1, "510300.SH", None, 1000000, date(2024, 1, 11))
    assert frames.spot_observations(spot.withColumn("other", F.lit("new")), at).first().provider_payload_hash == r.provider_payload_hash
    with pytest.raises(connectors.SchemaBreak):
        frames.spot_observations(spot.drop("名称"), at)
    scale = spark.createDataFrame([("159915", "n", "ETF", "2011-12-09", "5", "m", "1.5"), ("159001", "n", "LOF", "2011-12-09", "5", "m", "1.5")], "`基金代码` string, `基金简称` string, `基金类别` string, `上市日期` string, `基金份额` string, `基金管理人` string, `净值` string")
    b = frames.scale_observations(scale, at)
    assert [(x.symbol, x.list_date) for x in b.collect()] == [("159915.SZ", date(2011, 12, 9))]
    stored = frames.snapshot(None, a, b)
    assert stored.count() == 2 and {x.availability_class for x in stored.collect()} == {"forward_collected_pit"} and frames.snapshot(stored, a, b).count() == 0
    history = spark.createDataFrame([("2024-01-02", "1", "1.1", "1.2", "0.9", "123", "456.5")], "`日期` string, `开盘` string, `收盘` string, `最高` string, `最低` string, `成交量` string, `成交额` string")
    h = frames.history_bars(history, "510300.SH", at)
    assert h.first().volume == 12300 and h.select(F.unix_seconds("provider_timestamp")).first()[0] == int(datetime(2024, 1, 1, 16, tzinfo=UTC).timestamp())
