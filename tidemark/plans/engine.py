"""Queries over the engine's own operators, each with its SQL statement where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import iso, known_text, six_digits, token
from tidemark.functions.identity import canonical_decimal, observation_id, stable_id, value_hash
from tidemark.functions.normalize import canonical_symbol, exchange_of, first_known, instrument_type
from tidemark.operators import breadth, cluster, observations, quality, rawcache, reconcile, resolve, returns, revlog
from tidemark.plans.problems import BAR_FIELDS, _bar_copies, _BLANKS, _FUNDS, _sql_number, sql_day, sql_digits, sql_known, sql_token
from tidemark.sources.tables import table, with_symbol

AS_OF_SECONDS = 1_751_371_200  # 2025-07-01 12:00 UTC
TOLERANCES = {"price": 0.005, "volume": 0.02, "turnover": 0.02, "multiplier": 2.0}
SQL_AS_OF = "to_timestamp(1751371200)"
CUT_OFF_SECONDS = AS_OF_SECONDS - 60 * 86_400


def _instant(seconds: int = AS_OF_SECONDS):
    return F.timestamp_seconds(F.lit(seconds))


# --- bars ---

def _bars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "market_bars").withColumn("fund", six_digits("symbol")).withColumn("source", token("source")).where("fund IS NOT NULL")


def _known_bars(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    found = revlog.latest_revisions(_bars(spark, folder).drop("symbol"), as_of=_instant(), mode=mode, key=["fund", "trade_date", "source"], extra_order=["bar_seq"])
    return with_symbol(found.select("fund", iso("trade_date").alias("trade_date"), "source", "close", "volume", "bar_seq"), folder)


def bars_economic(spark, folder):
    """Every bar as it was available at an instant, whenever it was stored."""
    return _known_bars(spark, folder, revlog.ECONOMIC)


def bars_replay(spark, folder):
    """Every bar as this system held it at an instant."""
    return _known_bars(spark, folder, revlog.SYSTEM_REPLAY)


def bar_ids(spark, folder):
    """The content-addressed keys of every bar row, computed anew."""
    rows = table(spark, folder, "market_bars").select("*").drop("value_hash", "observation_id").withColumn("value_hash", value_hash())
    return rows.select("bar_seq", "value_hash", observation_id(F.col("value_hash")).alias("observation_id"))


def bar_violations(spark, folder):
    """How many bar rows break each invariant."""
    return quality.row_rules(table(spark, folder, "market_bars"), ["bar_seq"], revlog.violations()).groupBy("rule").agg(F.count("*").alias("n"))


def bar_log_months(spark, folder):
    """Rows submitted to each month of the log, revisions stored once, and ids that a merge refuses, as they come with two semantics."""
    rows = table(spark, folder, "market_bars")
    month = lambda df, name: df.groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(F.count("*").alias(name))
    conflicts = rows.groupBy("observation_id").agg(F.first("trade_date").alias("trade_date"), F.count_distinct("historical_data_semantics").alias("_n")).where("_n > 1")
    stored = revlog.merge_revisions(None, rows.join(conflicts.select("observation_id"), "observation_id", "left_anti"))
    months = month(rows, "submitted").join(month(stored, "stored"), ["year", "month"]).join(month(conflicts, "refused"), ["year", "month"], "left")
    return months.withColumn("refused", F.coalesce("refused", F.lit(0)))


def bar_revisions(spark, folder):
    """The revision history of every bar: how many contents, first and last stored."""
    rows = _bars(spark, folder).groupBy("fund", "trade_date", "source").agg(
        F.count("*").alias("n_rows"), F.count_distinct("value_hash").alias("n_contents"), F.min(F.unix_micros("ingest_time")).alias("first_us"), F.max(F.unix_micros("ingest_time")).alias("last_us"), F.max_by("close", F.struct("ingest_time", "bar_seq")).alias("last_close")
    )
    return with_symbol(rows, folder).withColumn("trade_date", iso("trade_date"))


def provisional_bars(spark, folder):
    """Bars stored before they became available, by source: a batch with any is refused."""
    return _bars(spark, folder).groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("ingest_time") < F.col("available_time")).alias("n_provisional"))


def calendar_days(spark, folder):
    """The latest known entry of each trading day, the first bar of a day standing for its calendar entry."""
    rows = _bars(spark, folder).select(F.lit("CN").alias("market"), "trade_date", "available_time", "ingest_time", F.concat("source", F.lpad(F.col("bar_seq").cast("string"), 20, "0")).alias("source"), "bar_seq", F.lit(False).alias("is_half_day"))
    return observations.calendar_as_of(rows, as_of=_instant(), mode=revlog.SYSTEM_REPLAY).select(iso("trade_date").alias("trade_date"), "bar_seq")


# --- raw bars ---

def _raw(spark, folder):
    return table(spark, folder, "supplemental_bars").withColumn("fund", six_digits("symbol"))


def raw_day_states(spark, folder):
    """Provisional and finalized days of the raw feed."""
    return with_symbol(rawcache.day_states(_raw(spark, folder), "fund"), folder).withColumn("trade_date", iso("trade_date"))


def raw_missing_ranges(spark, folder):
    """Runs of days with primary bars that the raw feed has not finalized."""
    expected = _bars(spark, folder).where("source = 'longbridge'").select("fund", "trade_date")
    found = rawcache.missing_ranges(expected, rawcache.day_states(_raw(spark, folder), "fund"), "fund")
    return with_symbol(found, folder).withColumn("first_day", iso("first_day")).withColumn("last_day", iso("last_day"))


def raw_records(spark, folder):
    """Cached records by identity, per provider version."""
    return rawcache.upsert(None, table(spark, folder, "supplemental_bars")).groupBy("sdk_version").agg(F.count("*").alias("n_records"))


def bars_reconciled(spark, folder):
    """The primary bars against the raw feed, in tolerances; infinite differences are null."""
    found = reconcile.reconcile(*_bar_copies(spark, folder), ["fund", "trade_date"], **TOLERANCES)
    shown = [F.when(F.col(c) < reconcile.INFINITE, F.round(c, 9)).alias(c) for c in ("price_abs_difference", "volume_relative_difference", "turnover_relative_difference")]
    return with_symbol(found.select("fund", iso("trade_date").alias("trade_date"), "status", *shown), folder)


# --- metadata ---

def _metadata(spark, folder):
    return table(spark, folder, "etf_metadata_obs").withColumn("fund", six_digits("symbol")).withColumn("source", token("source")).where("fund IS NOT NULL")


def _metadata_known(spark, folder, mode, cutoff=None):
    rows = observations.eligible(_metadata(spark, folder), as_of=_instant(), mode=mode, research_cutoff=None if cutoff is None else _instant(cutoff))
    latest = observations.latest_by(rows, ["fund", "source"], observations.METADATA_ORDER, ("provider_payload_hash", "meta_seq"))
    return with_symbol(latest.select("fund", "source", "meta_seq"), folder)


def metadata_economic(spark, folder):
    """Each source's latest observation of each fund that may be used at an instant."""
    return _metadata_known(spark, folder, revlog.ECONOMIC)


def metadata_replay(spark, folder):
    """The same as this system held it then."""
    return _metadata_known(spark, folder, revlog.SYSTEM_REPLAY)


def metadata_cutoff(spark, folder):
    """The same with only what was stored by a research cut-off."""
    return _metadata_known(spark, folder, revlog.ECONOMIC, CUT_OFF_SECONDS)


METADATA_CONTENT = ["symbol", "tracking_index", "asset_class", "management_fee", "fund_name", "fund_company", "shares", "effective_from", "effective_to", "source", "snapshot_at", "provider_payload_hash"]


def metadata_stored(spark, folder):
    """Observations submitted and stored: one with the content of an earlier one is not stored again."""
    rows = table(spark, folder, "etf_metadata_obs")
    keyed = rows.withColumn("observation_key", stable_id({c: F.col(c) for c in METADATA_CONTENT}))
    stored = observations.insert_once(None, keyed, "observation_key")
    count = lambda df, name: df.groupBy(token("source").alias("source")).agg(F.count("*").alias(name), F.min("meta_seq").alias(f"{name}_first"))
    return count(rows, "submitted").join(count(stored, "stored"), "source")


def metadata_sources(spark, folder):
    """Funds that several sources describe."""
    return with_symbol(observations.several_sources(_metadata(spark, folder).select("fund", "source"), "fund"), folder)


RESOLVED_FIELDS = ("tracking_index", "list_date", "fund_name", "fund_company", "management_fee", "nav", "iopv", "shares", "aum")


NUMBER_FIELDS = ("price_limit_pct", "management_fee", "nav", "iopv", "shares", "aum")
#: All fields of an observation that can be resolved, with their policy: the sources in order, and the greatest age.
SPOT, SCALE = "akshare:fund_etf_spot_em", "akshare:fund_etf_scale_szse"
WHOLE_POLICY = [
    (field, source, rank, age)
    for fields, age, order in (
        (("tracking_index", "list_date", "delist_date", "market_timezone", "asset_class"), None, (SPOT, SCALE)),
        (("trading_cycle", "settlement_cycle", "price_limit_pct", "contract_liquidation_rule", "fund_type", "management_fee", "fund_name", "fund_company"), 31_536_000, (SCALE, SPOT)),
        (("nav", "iopv"), 259_200, (SPOT, SCALE)), (("shares", "aum"), 2_678_400, (SCALE, SPOT)),
    )
    for field in fields for rank, source in enumerate(order, 1)
]
WHOLE_FIELDS = tuple(sorted({field for field, *_ in WHOLE_POLICY}))


def _resolved(spark, folder, names=RESOLVED_FIELDS, policy=None):
    rows = observations.eligible(_metadata(spark, folder), as_of=_instant(), mode=revlog.ECONOMIC)
    fields = {f: canonical_decimal(f) if f in NUMBER_FIELDS else F.coalesce(six_digits(f), known_text(f)) if f == "tracking_index" else known_text(F.col(f).cast("string")) for f in names}
    policy = table(spark, folder, "resolution_policy") if policy is None else policy
    policy = policy.withColumn("source", token("source")).withColumn("conflict_policy", F.when(F.col("max_age_seconds").isNull(), resolve.REQUIRE_AGREEMENT).otherwise(resolve.PRECEDENCE))
    values = resolve.unpivot_known(rows, fields, ["fund", "source", *observations.METADATA_ORDER, "provider_payload_hash"])
    return resolve.resolve(resolve.latest_per_source(values, ["fund"]), policy, ["fund"], as_of=_instant())


def metadata_resolved(spark, folder):
    """Every fund and field resolved over the sources at an instant."""
    return with_symbol(_resolved(spark, folder).select("fund", "field_name", "status", "value", "source", "freshness"), folder)


def metadata_resolved_whole(spark, folder):
    """Every fund and all 17 fields resolved by a policy of the engine's own."""
    policy = spark.createDataFrame(WHOLE_POLICY, "field_name string, source string, precedence_rank int, max_age_seconds long")
    return with_symbol(_resolved(spark, folder, WHOLE_FIELDS, policy).select("fund", "field_name", "status", "value", "source", "freshness"), folder)


def metadata_resolved_json(spark, folder):
    """The resolution of each fund as one JSON text."""
    return with_symbol(resolve.as_json(_resolved(spark, folder), ["fund"]), folder)


def unknown_sources(spark, folder):
    """Sources of candidates that the resolution policy does not know."""
    policy = table(spark, folder, "resolution_policy").withColumn("source", token("source"))
    return resolve.unknown_sources(table(spark, folder, "field_candidates").withColumn("source", token("source")), policy)


def metadata_overlaps(spark, folder):
    """Observations in effect before an earlier one of the same fund and source has ended, by source."""
    rows = _metadata(spark, folder).where("effective_from IS NOT NULL").select("fund", "source", "effective_from", "effective_to", "meta_seq")
    return quality.overlaps(rows, ["fund", "source"], "effective_from", "effective_to", ["meta_seq"]).groupBy("source").agg(F.count("*").alias("n"))


def instruments_normalized(spark, folder):
    """Instruments with exchange, kind and name from a chain of sources."""
    rows = table(spark, folder, "instruments")
    return rows.select(canonical_symbol("symbol").alias("symbol"), exchange_of("symbol").alias("exchange"), instrument_type("symbol", F.coalesce("instrument_type", F.lit(""))).alias("kind"), first_known("name", "symbol").alias("name"))


def fund_sets(spark, folder):
    """Funds by the feeds that know them: in either, in both, in one only."""
    a = _bars(spark, folder).select("fund").distinct()
    b = _metadata(spark, folder).select("fund").distinct()
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return quality.any_violation(count("either", a.union(b).distinct()), count("both", a.intersect(b)), count("bars_only", a.subtract(b)), count("metadata_only", b.subtract(a)))


def broken_references(spark, folder):
    """Fund codes in the bars that name no instrument, or several."""
    return quality.references(_bars(spark, folder), "fund", table(spark, folder, "instruments").withColumn("fund", six_digits("symbol")), "fund")


def event_bars(spark, folder):
    """Open, high, low, close, volume and turnover of each event type and day."""
    e = table(spark, folder, "events")
    first = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").cast("string").alias("trade_date")).agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.count("*").alias("volume"), F.sum(F.col("value").cast("decimal(18,4)")).alias("turnover")
    )


def event_payloads(spark, folder):
    """JSON payloads decoded with a schema; missing keys have a default."""
    props = F.from_json("props", "k long")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(props["k"], F.lit(0))).alias("k_sum"), F.count_distinct(props["k"]).alias("k_values"))


def part_coverage(spark, folder):
    """Conditional counts and joined labels of each brand."""
    return quality.coverage_counts(table(spark, folder, "part"), "p_brand", "p_type", {"n_large": F.col("p_size") > 40, "n_small": F.col("p_size") <= 5}, "n_large")


# --- research ---

def _order_levels(spark, folder):
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("level"))


def _line_levels(spark, folder):
    line = table(spark, folder, "lineitem")
    return line.groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("level"))


N_ORDER_ASSETS, N_LINE_ASSETS, WINDOW = 5, 6, 252


def _rounded(df, *columns):
    return df.select(*[F.round(c, 9).alias(c) if c in columns else (iso(c).alias(c) if t == "date" else F.col(c)) for c, t in df.dtypes])


def daily_returns(spark, folder):
    """Daily returns of each asset, nothing filled."""
    return _rounded(returns.daily_returns(_order_levels(spark, folder)), "ret")


def weekly_returns(spark, folder):
    """Weekly returns, dated by the last day of each week that has a level."""
    return _rounded(returns.weekly_returns(_order_levels(spark, folder)), "ret")


def level_warnings(spark, folder):
    """Audit counts of each level series."""
    return returns.level_warnings(_order_levels(spark, folder))


def series_coverage(spark, folder):
    """Coverage of every registered asset, one of which has no series."""
    levels = _order_levels(spark, folder)
    registry = levels.select("asset").distinct().unionByName(spark.createDataFrame([("0-NONE",)], "asset string"))
    return _rounded(returns.coverage(registry, levels))


def pair_correlations(spark, folder):
    """Daily and weekly correlations of all pairs of assets with their bands."""
    levels = _order_levels(spark, folder)
    both = breadth.pair_correlations(returns.daily_returns(levels), "daily").unionByName(breadth.pair_correlations(returns.weekly_returns(levels), "weekly"))
    return _rounded(both, "rho")


def common_days(spark, folder):
    """The days on which every asset has a return."""
    c = breadth.common_window(returns.daily_returns(_order_levels(spark, folder)), N_ORDER_ASSETS)
    return _rounded(c.groupBy("day").agg(F.sum("ret").alias("total")), "total")


def effective_breadth(spark, folder):
    """Effective number of independent assets over the common window."""
    return _rounded(breadth.effective_breadth(returns.daily_returns(_order_levels(spark, folder)), N_ORDER_ASSETS), "effective_n", "ratio")


LINE_ASSETS = ["AF", "AO", "NF", "NO", "RF", "RO", "ZZ"]  # all that the levels may have, and one without levels


def _line_pairs(spark):
    return spark.createDataFrame(breadth.focus_pairs([("RF", "AF")], "NO", LINE_ASSETS), "asset_1 string, asset_2 string")


def rolling_pairs(spark, folder):
    """Distribution of the rolling correlations of chosen pairs, with short and missing histories marked."""
    found = breadth.rolling_statistics(returns.daily_returns(_line_levels(spark, folder)), _line_pairs(spark), [WINDOW, 100_000])
    return _rounded(found, "median", "p10", "p90", "min", "max", "latest")


def rolling_breadth(spark, folder):
    """Effective number of assets over rolling windows of common rows."""
    return _rounded(breadth.rolling_breadth(returns.daily_returns(_line_levels(spark, folder)), N_LINE_ASSETS, WINDOW), "effective_n")


def redundant_pairs(spark, folder):
    """Pairs classed by full-sample and rolling correlation."""
    r = returns.daily_returns(_line_levels(spark, folder))
    found = breadth.redundancy(breadth.pair_correlations(r, "daily"), breadth.rolling_statistics(r, _line_pairs(spark), [WINDOW]), WINDOW)
    return _rounded(found.select("asset_1", "asset_2", "rho", "median", "band", "structural", "distinct_high"), "rho", "median")


def _order_matrix(spark, folder):
    rows = breadth.pair_correlations(returns.daily_returns(_order_levels(spark, folder)), "daily")
    assets = sorted({a for r in rows.select("asset_1", "asset_2").distinct().collect() for a in r})  # a short list of assets
    return assets, breadth.correlation_matrix(rows, assets)


def eigenvalues(spark, folder):
    """The spectrum of the correlation matrix."""
    return spark.createDataFrame(breadth.spectrum(_order_matrix(spark, folder)[1]), "rank int, eigenvalue double, share double")


def eigenvalue_powers(spark, folder):
    """The sums of the powers of the eigenvalues, which determine them."""
    values = [v for _, v, _ in breadth.spectrum(_order_matrix(spark, folder)[1])]
    return spark.createDataFrame([(k, round(sum(v**k for v in values), 6)) for k in range(1, len(values) + 1)], "power int, total double")


def asset_clusters(spark, folder):
    """Average-linkage merges of the assets by correlation distance, with the members of each."""
    assets, matrix = _order_matrix(spark, folder)
    merges = cluster.average_linkage(cluster.distances(matrix))
    rows = [(i + 1, a, b, round(d, 9), n, "|".join(m)) for i, ((a, b, d, n), m) in enumerate(zip(merges, cluster.members(merges, assets)))]
    return spark.createDataFrame(rows, "step int, left_id int, right_id int, distance double, size int, members string")


QUERIES = {
    f.__name__: f
    for f in (
        bars_economic, bars_replay, bar_ids, bar_violations, bar_log_months, bar_revisions, provisional_bars, calendar_days, raw_day_states, raw_missing_ranges, raw_records, bars_reconciled,
        metadata_economic, metadata_replay, metadata_cutoff, metadata_stored, metadata_sources, metadata_resolved, metadata_resolved_whole, metadata_resolved_json, unknown_sources, metadata_overlaps, instruments_normalized,
        fund_sets, broken_references, event_bars, event_payloads, part_coverage, daily_returns, weekly_returns, level_warnings, series_coverage, pair_correlations, common_days, effective_breadth,
        rolling_pairs, rolling_breadth, redundant_pairs, eigenvalues, eigenvalue_powers, asset_clusters,
    )
}


# --- the same in SQL -------------------------------------------------------------------------------------------------

_BARS = f"{_FUNDS}, bars AS (SELECT *, {sql_digits('symbol')} AS fund, {sql_token('source')} AS src FROM market_bars WHERE {sql_digits('symbol')} IS NOT NULL)"
_META = f"{_FUNDS}, meta AS (SELECT * REPLACE ({sql_token('source')} AS source), {sql_digits('symbol')} AS fund FROM etf_metadata_obs WHERE {sql_digits('symbol')} IS NOT NULL)"
_ISO = lambda c: f"strftime({c}, '%Y-%m-%d')"


def _sql_known_bars(replay: bool) -> str:
    return f"""
WITH {_BARS}, known AS (
  SELECT * FROM bars WHERE available_time <= {SQL_AS_OF} {f'AND ingest_time <= {SQL_AS_OF}' if replay else ''}
  QUALIFY row_number() OVER (PARTITION BY fund, trade_date, src ORDER BY ingest_time DESC, availability_policy_id DESC, value_hash DESC, bar_seq DESC) = 1
)
SELECT f.symbol, {_ISO('trade_date')} AS trade_date, src AS source, close, volume, bar_seq FROM known k JOIN funds f USING (fund)"""


_DEC = lambda c: rf"regexp_replace(regexp_replace(CAST({c} AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"
_TIME = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
_STR = lambda e: f"coalesce('\"' || {e} || '\"', 'null')"
# Symbols in wide digits hold non-ASCII characters: U+FF10 to U+FF19 and U+FF0E, which the JSON escapes.
_ASCII = "symbol"
for _i in range(10):
    _ASCII = f"replace({_ASCII}, chr({0xFF10 + _i}), '\\uff1{_i}')"
_ASCII = f"replace({_ASCII}, chr({0xFF0E}), '\\uff0e')"
_BAR_JSON = " || ".join([
    f"'{{\"close\":' || {_STR(_DEC('close'))}", f"',\"data_time\":' || {_STR(_TIME('data_time'))}", f"',\"high\":' || {_STR(_DEC('high'))}", f"',\"low\":' || {_STR(_DEC('low'))}", f"',\"open\":' || {_STR(_DEC('open'))}",
    f"',\"source\":' || {_STR('source')}", f"',\"symbol\":' || {_STR(_ASCII)}", f"',\"trade_date\":' || {_STR(_ISO('trade_date'))}", f"',\"turnover\":' || {_STR(_DEC('turnover'))}", "',\"volume\":' || coalesce(CAST(volume AS VARCHAR), 'null') || '}'",
])
_C = lambda e: f"coalesce({e}, '')"
_BAR_IDS = f"""
WITH hashed AS (SELECT *, sha256({_BAR_JSON}) AS vh FROM (SELECT * EXCLUDE (value_hash, observation_id) FROM market_bars))
SELECT bar_seq, vh AS value_hash, sha256({_C('symbol')} || '|' || {_C(_ISO('trade_date'))} || '|' || {_C('source')} || '|' || {_C(_TIME('ingest_time'))} || '|' || vh || '|' || {_C('availability_policy_id')} || '|' || {_C(_TIME('available_time'))}) AS observation_id
FROM hashed"""

_RULES = {
    "missing_value": " OR ".join(f"{n} IS NULL" for n, _ in revlog.BAR_FIELDS),
    "empty_identifier": "trim(symbol) = '' OR trim(source) = '' OR trim(availability_policy_id) = ''",
    "nonpositive_price": "least(open, high, low, close) <= 0",
    "low_above_body": "low > least(open, close)",
    "high_below_body": "high < greatest(open, close)",
    "high_below_low": "high < low",
    "negative_volume": "volume < 0 OR turnover < 0",
    "available_before_data": "available_time < data_time",
}

_CUT_OFF = "((trade_date + INTERVAL 15 HOUR + INTERVAL 15 MINUTE) AT TIME ZONE 'Asia/Shanghai')"
_STATES = f"""states AS (
  SELECT fund, trade_date, CASE WHEN bool_or(retrieved_at >= {_CUT_OFF}) THEN 'finalized' ELSE 'provisional' END AS state, count(*) AS n_records
  FROM (SELECT *, {sql_digits('symbol')} AS fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) AS trade_date FROM supplemental_bars) WHERE fund IS NOT NULL GROUP BY ALL)"""

_REL = lambda a, b: f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.0 WHEN {a} IS NULL OR {b} IS NULL THEN 'Infinity'::DOUBLE WHEN greatest(abs({a}), abs({b})) = 0 THEN 0.0 ELSE abs({a}::DOUBLE - {b}::DOUBLE) / greatest(abs({a}), abs({b}))::DOUBLE END"
_RECONCILED = f"""
WITH {_FUNDS},
l AS (
  SELECT {sql_digits('symbol')} AS fund, trade_date, {', '.join(f'CAST({f} AS DECIMAL(30,8)) AS {f}' for f in BAR_FIELDS)} FROM market_bars WHERE {sql_token('source')} = 'longbridge' AND {sql_digits('symbol')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {sql_digits('symbol')}, trade_date ORDER BY ingest_time DESC, bar_seq DESC) = 1
),
r AS (
  SELECT {sql_digits('symbol')} AS fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) AS trade_date, {', '.join(f'{_sql_number(f)} AS {f}' for f in ('open', 'high', 'low', 'close', 'turnover'))},
    CAST(volume * CASE WHEN lower(json_extract_string(provider_payload, '$.unit')) = 'lot' THEN 100 ELSE 1 END AS DECIMAL(30,8)) AS volume
  FROM supplemental_bars WHERE {sql_digits('symbol')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) ORDER BY retrieved_at DESC) = 1
),
d AS (
  SELECT coalesce(l.fund, r.fund) AS fund, coalesce(l.trade_date, r.trade_date) AS trade_date, l.fund IS NULL OR r.fund IS NULL AS one_sided,
    greatest(abs(l.open - r.open), abs(l.high - r.high), abs(l.low - r.low), abs(l.close - r.close))::DOUBLE AS p, {_REL('l.volume', 'r.volume')} AS v, {_REL('l.turnover', 'r.turnover')} AS t
  FROM l FULL JOIN r ON l.fund = r.fund AND l.trade_date = r.trade_date
),
w AS (SELECT *, CASE WHEN one_sided THEN 'Infinity'::DOUBLE ELSE greatest(p / 0.005, v / 0.02, t / 0.02) END AS worst FROM d)
SELECT symbol, {_ISO('trade_date')} AS trade_date, CASE WHEN worst <= 1 THEN 'PASS' WHEN worst <= 2 THEN 'WARNING' ELSE 'FAIL' END AS status,
  CASE WHEN NOT one_sided THEN round(p, 9) END AS price_abs_difference, CASE WHEN NOT one_sided AND v < 'Infinity'::DOUBLE THEN round(v, 9) END AS volume_relative_difference, CASE WHEN NOT one_sided AND t < 'Infinity'::DOUBLE THEN round(t, 9) END AS turnover_relative_difference
FROM w JOIN funds USING (fund)"""

_META_ORDER = "effective_from DESC NULLS LAST, snapshot_at DESC NULLS LAST, available_time DESC NULLS LAST, ingest_time DESC NULLS LAST, provider_payload_hash DESC NULLS LAST"


def _sql_eligible(replay: bool = False, cutoff: int | None = None) -> str:
    day = f"CAST({SQL_AS_OF} AT TIME ZONE coalesce(market_timezone, 'UTC') AS DATE)"
    return f"""eligible AS (SELECT * FROM meta WHERE (effective_from IS NULL OR effective_from <= {day}) AND (effective_to IS NULL OR effective_to >= {day}) AND available_time <= {SQL_AS_OF}
  AND (lower(availability_class) NOT IN ('snapshot_only', 'forward_collected_pit') OR coalesce(snapshot_at <= {SQL_AS_OF}, false)) {f'AND ingest_time <= {SQL_AS_OF}' if replay else ''} {f'AND ingest_time <= to_timestamp({cutoff})' if cutoff else ''})"""


def _sql_metadata(**how) -> str:
    return f"WITH {_META}, {_sql_eligible(**how)} SELECT f.symbol, source, meta_seq FROM eligible JOIN funds f USING (fund) QUALIFY row_number() OVER (PARTITION BY fund, source ORDER BY {_META_ORDER}, meta_seq DESC) = 1"


def _sql_values(fields) -> str:
    value = lambda f: f"CASE WHEN {f} IS NOT NULL THEN {_DEC(f)} END" if f in NUMBER_FIELDS else f"coalesce({sql_digits(f)}, {sql_known(f)})" if f == "tracking_index" else sql_known(f"CAST({f} AS VARCHAR)")
    return " UNION ALL ".join(f"SELECT fund, source, '{f}' AS field_name, {value(f)} AS value, effective_from, snapshot_at, available_time, ingest_time, provider_payload_hash FROM eligible" for f in fields)


def _sql_resolved(fields, policy: str) -> str:
    return f"""
WITH {_META}, {_sql_eligible()},
policy AS ({policy}),
vals AS ({_sql_values(fields)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY fund, source, field_name ORDER BY effective_from DESC NULLS LAST, snapshot_at DESC NULLS LAST, available_time DESC NULLS LAST, ingest_time DESC NULLS LAST) AS r FROM vals WHERE value IS NOT NULL),
latest AS (
  SELECT fund, source, field_name, arg_max(value, provider_payload_hash) AS value, count(DISTINCT value) > 1 AS ambiguous, max(coalesce(snapshot_at, available_time)) AS seen_at FROM ranked WHERE r = 1 GROUP BY ALL
),
judged AS (
  SELECT l.*, p.precedence_rank, p.max_age_seconds, CASE WHEN p.max_age_seconds IS NULL THEN 'NOT_APPLICABLE' WHEN epoch_us({SQL_AS_OF}) - epoch_us(l.seen_at) <= p.max_age_seconds * 1000000 THEN 'FRESH' ELSE 'EXPIRED' END AS freshness
  FROM latest l JOIN policy p ON p.field_name = l.field_name AND {sql_token('p.source')} = l.source
),
asked AS (SELECT fund, field_name, bool_or(p.max_age_seconds IS NULL) AS agree FROM (SELECT DISTINCT fund FROM latest) CROSS JOIN policy p GROUP BY ALL),
decided AS (
  SELECT a.fund, a.field_name, a.agree, count(j.fund) AS n, coalesce(bool_or(j.ambiguous), false) AS ambiguous, count(*) FILTER (WHERE j.freshness <> 'EXPIRED') AS n_fresh, count(DISTINCT j.value) AS n_values,
    count(DISTINCT j.value) FILTER (WHERE j.freshness <> 'EXPIRED') AS n_fresh_values,
    arg_min(j, j.precedence_rank) AS first_any, arg_min(j, j.precedence_rank) FILTER (WHERE j.freshness <> 'EXPIRED') AS first_fresh
  FROM asked a LEFT JOIN judged j USING (fund, field_name) GROUP BY ALL
),
marked AS (SELECT *, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN ambiguous THEN 'AMBIGUOUS' WHEN n_fresh = 0 THEN 'STALE' WHEN agree AND n_fresh_values > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS status FROM decided),
won AS (SELECT *, CASE WHEN status = 'RESOLVED' THEN first_fresh WHEN status = 'STALE' AND NOT (agree AND n_values > 1) THEN first_any END AS w FROM marked)
SELECT symbol, field_name, status, w.value AS value, w.source AS source, CASE WHEN status = 'STALE' THEN 'EXPIRED' ELSE w.freshness END AS freshness FROM won JOIN funds USING (fund)"""


_RESOLVED = _sql_resolved(RESOLVED_FIELDS, "SELECT * FROM resolution_policy")
_WHOLE_POLICY = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{source}', {rank}, {'NULL::BIGINT' if age is None else age})" for f, source, rank, age in WHOLE_POLICY) + ") v(field_name, source, precedence_rank, max_age_seconds)"
_REASON = """CASE WHEN status = 'UNKNOWN' THEN 'no known value from any source' WHEN status = 'CONFLICT' THEN 'fresh sources that must agree disagree'
  WHEN status = 'STALE' AND w IS NULL THEN 'all candidates are stale and disagree' WHEN status = 'STALE' THEN 'all candidates are stale; the first source''s value is kept'
  WHEN status = 'AMBIGUOUS' THEN 'a source''s latest rows disagree' WHEN w.precedence_rank = 1 THEN 'first source' ELSE 'fallback to a later source' END
  || CASE WHEN status = 'RESOLVED' AND n_values > 1 THEN '; other sources disagree' ELSE '' END"""
_RESOLVED_JSON = _RESOLVED[: _RESOLVED.rindex("SELECT symbol")] + f"""SELECT symbol, CAST(to_json(list(struct_pack(field_name := field_name, status := status, value := w.value, source := w.source, freshness := CASE WHEN status = 'STALE' THEN 'EXPIRED' ELSE w.freshness END, reason := {_REASON}) ORDER BY field_name)) AS VARCHAR) AS fields
FROM won JOIN funds USING (fund) GROUP BY symbol"""

_OVERLAPS = f"""
WITH {_META}, reached AS (
  SELECT source, effective_from, max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY fund, source ORDER BY effective_from, meta_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM meta WHERE effective_from IS NOT NULL
)
SELECT source, count(*) AS n FROM reached WHERE reach > effective_from GROUP BY source"""

_ORDER_LEVELS = "levels AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS level FROM orders GROUP BY ALL)"
_LINE_LEVELS = "levels AS (SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS level FROM lineitem GROUP BY ALL)"
_USABLE = "usable AS (SELECT asset, day, CASE WHEN level > 0 THEN level END AS level FROM levels)"
_DAILY = f"{_USABLE}, daily AS (SELECT * FROM (SELECT asset, day, level / lag(level) OVER (PARTITION BY asset ORDER BY day) - 1 AS ret FROM usable) WHERE ret IS NOT NULL)"
_WEEKLY = """weeks AS (SELECT asset, day + CAST((5 - isodow(day) + 7) % 7 AS INTEGER) AS week, max(day) AS day, arg_max(level, day) AS level FROM usable WHERE level IS NOT NULL GROUP BY ALL),
weekly AS (SELECT asset, day, ret FROM (SELECT asset, day, week - lag(week) OVER w AS gap, level / lag(level) OVER w - 1 AS ret FROM weeks WINDOW w AS (PARTITION BY asset ORDER BY week)) WHERE gap = 7 AND ret IS NOT NULL)"""
_BAND = "CASE WHEN rho IS NULL THEN 'INSUFFICIENT_DATA' WHEN rho < 0.60 THEN 'LOW_MODERATE' WHEN rho < 0.75 THEN 'MODERATE' WHEN rho < 0.90 THEN 'HIGH' ELSE 'VERY_HIGH' END"
_RHO = "CASE WHEN count(*) >= 2 AND stddev_pop(a.ret) * stddev_pop(b.ret) > 0 THEN covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)) END"


def _sql_pairs(source: str, frequency: str) -> str:
    return f"SELECT a.asset AS asset_1, b.asset AS asset_2, '{frequency}' AS frequency, {_ISO('min(a.day)')} AS start_date, {_ISO('max(a.day)')} AS end_date, count(*) AS n_obs, {_RHO} AS rho FROM {source} a JOIN {source} b ON a.day = b.day AND a.asset < b.asset GROUP BY ALL"


def _sql_common(n: int) -> str:
    return f"common AS (SELECT * FROM daily QUALIFY count(*) OVER (PARTITION BY day) = {n})"


def _sql_rolling(source: str, window: int) -> str:
    return f"""SELECT asset_1, asset_2, day, CASE WHEN sa * sb > 0 THEN cab / (sa * sb) END AS rho FROM (
    SELECT a.asset AS asset_1, b.asset AS asset_2, a.day, count(*) OVER w AS n, covar_pop(a.ret, b.ret) OVER w AS cab, stddev_pop(a.ret) OVER w AS sa, stddev_pop(b.ret) OVER w AS sb
    FROM {source} a JOIN {source} b ON a.day = b.day AND a.asset < b.asset WINDOW w AS (PARTITION BY a.asset, b.asset ORDER BY a.day ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) WHERE n = {window}"""


_LINE_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in breadth.focus_pairs([("RF", "AF")], "NO", LINE_ASSETS))
_STATS = "count(rho) AS n_windows, {iso_min} AS first_window_end, {iso_max} AS last_window_end, round(median(rho), 9) AS median, round(quantile_cont(rho, 0.1), 9) AS p10, round(quantile_cont(rho, 0.9), 9) AS p90, round(min(rho), 9) AS min, round(max(rho), 9) AS max, round(arg_max(rho, day), 9) AS latest".format(iso_min=_ISO("min(day)"), iso_max=_ISO("max(day)"))
_ROLLING_PAIRS = f"""
WITH {_LINE_LEVELS}, {_DAILY}, rolled AS ({_sql_rolling('daily', WINDOW)}),
stats AS (SELECT asset_1 AS low, asset_2 AS high, {WINDOW} AS "window", {_STATS} FROM rolled WHERE rho IS NOT NULL GROUP BY ALL),
asked AS (SELECT * FROM (VALUES {_LINE_PAIRS}) p(asset_1, asset_2), (VALUES ({WINDOW}), (100000)) w("window")),
have AS (SELECT DISTINCT asset FROM daily)
SELECT asset_1, asset_2, q."window", n_windows, first_window_end, last_window_end, median, p10, p90, min, max, latest,
  CASE WHEN asset_1 NOT IN (SELECT asset FROM have) OR asset_2 NOT IN (SELECT asset FROM have) THEN 'UNAVAILABLE' WHEN n_windows IS NULL THEN 'SKIPPED_SHORT_HISTORY' ELSE 'OK' END AS status
FROM asked q LEFT JOIN stats s ON s.low = least(asset_1, asset_2) AND s.high = greatest(asset_1, asset_2) AND s."window" = q."window" """

def _sql_matrix_powers(n: int) -> str:
    """Traces of the powers of the correlation matrix, which are the sums of the powers of its eigenvalues and determine them."""
    powers = ["m1 AS (SELECT asset_1 AS a, asset_2 AS b, rho AS v FROM p UNION ALL SELECT asset_2, asset_1, rho FROM p UNION ALL SELECT DISTINCT asset, asset, 1.0 FROM daily)"]
    powers += [f"m{k} AS (SELECT x.a, y.b, sum(x.v * y.v) AS v FROM m{k - 1} x JOIN m1 y ON x.b = y.a GROUP BY ALL)" for k in range(2, n + 1)]
    return f"WITH {_ORDER_LEVELS}, {_DAILY}, p AS ({_sql_pairs('daily', 'daily')}), " + ", ".join(powers) + " " + " UNION ALL ".join(f"SELECT {k} AS power, round(sum(v), 6) AS total FROM m{k} WHERE a = b" for k in range(1, n + 1))


def _sql_clusters(n: int) -> str:
    """Average linkage by its definition: the mean distance of all leaves of two clusters, the least pair merged, step by step."""
    parts = [
        "leaves AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS id FROM (SELECT DISTINCT asset FROM daily))",
        "dist AS (SELECT asset_1 AS a, asset_2 AS b, sqrt(0.5 * (1 - least(1, greatest(-1, rho)))) AS d FROM p UNION ALL SELECT asset_2, asset_1, sqrt(0.5 * (1 - least(1, greatest(-1, rho)))) FROM p)",
        "c0 AS (SELECT id AS cluster, asset, id AS place FROM leaves)",
    ]
    for k in range(1, n):
        parts += [
            f"s{k} AS (SELECT x.cluster AS left_id, y.cluster AS right_id, avg(d) AS distance FROM c{k - 1} x JOIN c{k - 1} y ON x.cluster < y.cluster JOIN dist ON dist.a = x.asset AND dist.b = y.asset GROUP BY ALL ORDER BY round(distance, 14), left_id, right_id LIMIT 1)",
            f"c{k} AS (SELECT CASE WHEN cluster IN (left_id, right_id) THEN {n + k - 1} ELSE cluster END AS cluster, asset, CASE WHEN cluster = right_id THEN place + {10 ** (k + 1)} ELSE place END AS place FROM c{k - 1}, s{k})",
        ]
    steps = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, CAST(left_id AS INTEGER) AS left_id, CAST(right_id AS INTEGER) AS right_id, round(distance, 9) AS distance, (SELECT CAST(count(*) AS INTEGER) FROM c{k} WHERE cluster = {n + k - 1}) AS size, (SELECT string_agg(asset, '|' ORDER BY place) FROM c{k} WHERE cluster = {n + k - 1}) AS members FROM s{k}" for k in range(1, n))
    return f"WITH {_ORDER_LEVELS}, {_DAILY}, p AS ({_sql_pairs('daily', 'daily')}), {', '.join(parts)} {steps}"


SQL = {
    "eigenvalue_powers": _sql_matrix_powers(N_ORDER_ASSETS),
    "asset_clusters": _sql_clusters(N_ORDER_ASSETS),
    "bars_economic": _sql_known_bars(False),
    "bars_replay": _sql_known_bars(True),
    "bar_ids": _BAR_IDS,
    "bar_violations": "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM market_bars WHERE {c}" for n, c in _RULES.items()) + ") GROUP BY rule",
    "bar_log_months": """WITH ids AS (SELECT observation_id, any_value(trade_date) AS trade_date, count(*) AS n, count(DISTINCT historical_data_semantics) AS k FROM market_bars GROUP BY observation_id)
SELECT CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month, CAST(sum(n) AS BIGINT) AS submitted, count(*) FILTER (WHERE k <= 1) AS stored, count(*) FILTER (WHERE k > 1) AS refused FROM ids GROUP BY 1, 2""",
    "bar_revisions": f"WITH {_BARS} SELECT f.symbol, {_ISO('trade_date')} AS trade_date, src AS source, count(*) AS n_rows, count(DISTINCT value_hash) AS n_contents, min(epoch_us(ingest_time)) AS first_us, max(epoch_us(ingest_time)) AS last_us, arg_max(close, (ingest_time, bar_seq)) AS last_close FROM bars b JOIN funds f USING (fund) GROUP BY f.symbol, trade_date, src",
    "provisional_bars": f"WITH {_BARS} SELECT src AS source, count(*) AS n_rows, count(*) FILTER (WHERE ingest_time < available_time) AS n_provisional FROM bars GROUP BY src",
    "calendar_days": f"WITH {_BARS} SELECT {_ISO('trade_date')} AS trade_date, bar_seq FROM bars WHERE available_time <= {SQL_AS_OF} AND ingest_time <= {SQL_AS_OF} QUALIFY row_number() OVER (PARTITION BY bars.trade_date ORDER BY available_time DESC, ingest_time DESC, src DESC, bar_seq DESC) = 1",
    "raw_day_states": f"WITH {_FUNDS}, {_STATES} SELECT symbol, {_ISO('trade_date')} AS trade_date, state, n_records FROM states JOIN funds USING (fund)",
    "raw_missing_ranges": f"""WITH {_BARS}, {_STATES}, expected AS (SELECT DISTINCT fund, trade_date FROM bars WHERE src = 'longbridge'),
days AS (SELECT e.fund, e.trade_date, coalesce(s.state = 'finalized', false) AS done FROM expected e LEFT JOIN states s USING (fund, trade_date)),
runs AS (SELECT *, sum(done::INT) OVER (PARTITION BY fund ORDER BY trade_date) AS run FROM days)
SELECT symbol, first_day, last_day, n_days FROM (SELECT fund, run, {_ISO('min(trade_date)')} AS first_day, {_ISO('max(trade_date)')} AS last_day, count(*) AS n_days FROM runs WHERE NOT done GROUP BY ALL) JOIN funds USING (fund)""",
    "raw_records": "SELECT sdk_version, count(*) AS n_records FROM (SELECT symbol, provider_timestamp, retrieved_at, open, high, low, close, volume, turnover, provider, min(sdk_version) AS sdk_version FROM supplemental_bars GROUP BY ALL) GROUP BY sdk_version",
    "bars_reconciled": _RECONCILED,
    "metadata_economic": _sql_metadata(),
    "metadata_replay": _sql_metadata(replay=True),
    "metadata_cutoff": _sql_metadata(cutoff=CUT_OFF_SECONDS),
    "metadata_stored": f"""WITH s AS (SELECT {sql_token('source')} AS src, {', '.join(METADATA_CONTENT)}, count(*) AS n, min(meta_seq) AS all_first, arg_min(meta_seq, (ingest_time, available_time, meta_seq)) AS first FROM etf_metadata_obs GROUP BY ALL)
SELECT src AS source, CAST(sum(n) AS BIGINT) AS submitted, min(all_first) AS submitted_first, count(*) AS stored, min(first) AS stored_first FROM s GROUP BY src""",
    "metadata_sources": f"WITH {_META} SELECT f.symbol, count(DISTINCT source) AS n_sources FROM meta JOIN funds f USING (fund) GROUP BY f.symbol HAVING count(DISTINCT source) > 1",
    "metadata_resolved": _RESOLVED,
    "metadata_resolved_whole": _sql_resolved(WHOLE_FIELDS, _WHOLE_POLICY),
    "metadata_resolved_json": _RESOLVED_JSON,
    "unknown_sources": f"SELECT DISTINCT {sql_token('source')} AS source FROM field_candidates WHERE {sql_token('source')} NOT IN (SELECT {sql_token('source')} FROM resolution_policy)",
    "metadata_overlaps": _OVERLAPS,
    "instruments_normalized": f"SELECT CASE WHEN regexp_full_match(upper(trim(symbol, {_BLANKS})), '[0-9]{{6}}\\.(SH|SZ)') THEN upper(trim(symbol, {_BLANKS})) END AS symbol, coalesce(nullif(CASE regexp_extract(upper(symbol), '(XSHG|XSHE|SHE|SH|SZ|SS)', 1) WHEN 'SH' THEN 'SH' WHEN 'SS' THEN 'SH' WHEN 'XSHG' THEN 'SH' WHEN 'SZ' THEN 'SZ' WHEN 'XSHE' THEN 'SZ' WHEN 'SHE' THEN 'SZ' END, ''), 'UNKNOWN') AS exchange, CASE WHEN lower(coalesce(instrument_type, '')) LIKE '%index%' THEN 'INDEX' WHEN substr(symbol, 1, 2) IN ('15', '16', '50', '51', '52', '56', '58') THEN 'ETF' ELSE 'STOCK' END AS kind, coalesce({sql_known('name')}, {sql_known('symbol')}) AS name FROM instruments",
    "fund_sets": f"""WITH a AS (SELECT DISTINCT {sql_digits('symbol')} AS fund FROM market_bars WHERE {sql_digits('symbol')} IS NOT NULL), b AS (SELECT DISTINCT {sql_digits('symbol')} AS fund FROM etf_metadata_obs WHERE {sql_digits('symbol')} IS NOT NULL)
SELECT 'either' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'bars_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'metadata_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "broken_references": f"WITH i AS (SELECT {sql_digits('symbol')} AS value, count(*) AS n FROM instruments GROUP BY 1) SELECT v.value, coalesce(i.n, 0) AS n_matches FROM (SELECT DISTINCT {sql_digits('symbol')} AS value FROM market_bars WHERE {sql_digits('symbol')} IS NOT NULL) v LEFT JOIN i USING (value) WHERE coalesce(i.n, 0) <> 1",
    "event_bars": f"SELECT event_type AS symbol, {_ISO('CAST(ts AS DATE)')} AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume, sum(CAST(value AS DECIMAL(18,4))) AS turnover FROM events GROUP BY event_type, CAST(ts AS DATE)",
    "event_payloads": "SELECT event_type, count(*) AS n, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_sum, count(DISTINCT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_values FROM events GROUP BY event_type",
    "part_coverage": "SELECT p_brand, count(*) AS n_rows, count(*) FILTER (WHERE p_size > 40) AS n_large, count(*) FILTER (WHERE p_size <= 5) AS n_small, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS labels, CASE WHEN count(*) FILTER (WHERE p_size > 40) > 0 THEN 'COVERED' ELSE 'PARTIAL' END AS status FROM part GROUP BY p_brand",
    "daily_returns": f"WITH {_ORDER_LEVELS}, {_DAILY} SELECT asset, {_ISO('day')} AS day, round(ret, 9) AS ret FROM daily",
    "weekly_returns": f"WITH {_ORDER_LEVELS}, {_DAILY}, {_WEEKLY} SELECT asset, {_ISO('day')} AS day, round(ret, 9) AS ret FROM weekly",
    "level_warnings": f"""WITH {_ORDER_LEVELS}, {_USABLE}, moves AS (SELECT l.asset, l.level, abs(u.level / lag(u.level) OVER w - 1) AS move, l.day - lag(l.day) OVER w AS gap FROM levels l JOIN usable u USING (asset, day) WINDOW w AS (PARTITION BY l.asset ORDER BY l.day)),
c AS (SELECT asset, count(*) FILTER (WHERE level <= 0) AS nonpositive, count(*) FILTER (WHERE move > 0.5) AS extreme_returns, count(*) FILTER (WHERE gap > 14) AS long_gaps FROM moves GROUP BY asset)
SELECT *, CASE WHEN nonpositive + extreme_returns + long_gaps > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS quality FROM c""",
    "series_coverage": f"""WITH {_ORDER_LEVELS}, r AS (SELECT DISTINCT asset FROM levels UNION SELECT '0-NONE'), c AS (SELECT asset, min(day) AS f, max(day) AS l, count(*) AS n FROM levels GROUP BY asset)
SELECT asset, {_ISO('f')} AS first_day, {_ISO('l')} AS last_day, coalesce(n, 0) AS n_obs, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN (l - f) / 365.25 < 3 THEN 'VERY_SHORT_HISTORY' WHEN (l - f) / 365.25 < 5 THEN 'SHORT_HISTORY' ELSE 'OK' END AS flag FROM r LEFT JOIN c USING (asset)""",
    "pair_correlations": f"WITH {_ORDER_LEVELS}, {_DAILY}, {_WEEKLY}, p AS ({_sql_pairs('daily', 'daily')} UNION ALL {_sql_pairs('weekly', 'weekly')}) SELECT * REPLACE (round(rho, 9) AS rho), {_BAND} AS band FROM p",
    "common_days": f"WITH {_ORDER_LEVELS}, {_DAILY}, {_sql_common(N_ORDER_ASSETS)} SELECT {_ISO('day')} AS day, round(sum(ret), 9) AS total FROM common GROUP BY common.day",
    "effective_breadth": f"""WITH {_ORDER_LEVELS}, {_DAILY}, {_sql_common(N_ORDER_ASSETS)}, p AS ({_sql_pairs('common', 'common')}), s AS (SELECT count(rho) AS k, sum(rho * rho) AS q, max(n_obs) AS n_obs FROM p), e AS (SELECT *, CASE WHEN k = {N_ORDER_ASSETS * (N_ORDER_ASSETS - 1) // 2} THEN {N_ORDER_ASSETS ** 2}.0 / ({N_ORDER_ASSETS} + 2 * q) END AS v FROM s)
SELECT CAST({N_ORDER_ASSETS} AS BIGINT) AS n_assets, coalesce(n_obs, 0) AS n_obs, round(v, 9) AS effective_n, round(v / {N_ORDER_ASSETS}, 9) AS ratio FROM e""",
    "rolling_pairs": _ROLLING_PAIRS,
    "rolling_breadth": f"WITH {_LINE_LEVELS}, {_DAILY}, {_sql_common(N_LINE_ASSETS)}, r AS ({_sql_rolling('common', WINDOW)}) SELECT {_ISO('day')} AS day, CASE WHEN count(rho) = 15 THEN round(36.0 / (6 + 2 * sum(rho * rho)), 9) END AS effective_n FROM r GROUP BY r.day",
    "redundant_pairs": f"""WITH {_LINE_LEVELS}, {_DAILY}, p AS ({_sql_pairs('daily', 'daily')}), asked AS (SELECT least(a, b) AS asset_1, greatest(a, b) AS asset_2 FROM (VALUES {_LINE_PAIRS}) v(a, b)), rolled AS ({_sql_rolling('daily', WINDOW)}),
m AS (SELECT asset_1, asset_2, median(rho) AS median FROM rolled JOIN asked USING (asset_1, asset_2) WHERE rho IS NOT NULL GROUP BY ALL)
SELECT asset_1, asset_2, round(rho, 9) AS rho, round(median, 9) AS median, {_BAND} AS band, coalesce(rho >= 0.9 AND median >= 0.85, false) AS structural, NOT coalesce(rho >= 0.9 AND median >= 0.85, false) AND coalesce(rho >= 0.75, false) AS distinct_high FROM p LEFT JOIN m USING (asset_1, asset_2)""",
}
