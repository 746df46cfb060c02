"""Queries that write and read back: the revision log, observation stores, caches. Each works in the session's shared folder."""

from __future__ import annotations

from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import iso, six_digits, token, utc_day
from tidemark.functions.identity import stable_id
from tidemark.operators import observations, rawcache, revlog
from tidemark.plans.engine import _CUT_OFF, _ISO, _RULES, METADATA_CONTENT, SQL_AS_OF, _instant, _line_levels, _LINE_LEVELS, _raw
from tidemark.plans.problems import _FUNDS, sql_day, sql_digits, sql_token
from tidemark.session import shared_path
from tidemark.sources.connectors import RAW_BAR_SCHEMA, read_level_cache, read_raw_cache
from tidemark.sources.sinks import write_json_lines, write_level_cache
from tidemark.sources.tables import table, with_symbol

SECOND_BATCH_SECONDS = 1_748_736_000  # 2025-06-01 00:00 UTC
FIRST_DAY, LAST_DAY = date(2025, 3, 10), date(2025, 10, 20)
V2_FROM, V3_FROM = date(2025, 4, 1), date(2025, 8, 1)
SEMANTICS = "historical_latest"


def _place(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid4().hex}")


def _valid_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that break no invariant and have the default semantics; the log refuses batches with others."""
    return revlog.with_violations(table(spark, folder, "market_bars")).where((F.size("violated") == 0) & (F.col("historical_data_semantics") == SEMANTICS)).drop("violated")


def _by_month(rows: DataFrame, **counts) -> DataFrame:
    return rows.groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(*[c.alias(n) for n, c in counts.items()])


def log_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The log after two batches and a repetition of the first: revisions by month between two dates, read from the folders of those months."""
    root, bars = _place(spark, "log"), _valid_bars(spark, folder)
    early = F.col("ingest_time") < F.timestamp_seconds(F.lit(SECOND_BATCH_SECONDS))
    done = [revlog.append_bars(part, root) for part in (bars.where(early), bars.where(~early), bars.where(early))]
    log = revlog.read_log(spark, root, FIRST_DAY, LAST_DAY).where(F.col("trade_date").between(FIRST_DAY, LAST_DAY))
    return _by_month(log, revisions=F.count("*"), contents=F.count_distinct("value_hash")).withColumn("again", F.lit(done[2]["inserted"]).cast("long"))


def log_migrated(spark: SparkSession, folder: str) -> DataFrame:
    """A log of three schema versions, by month, brought to the current one: its rows and availability policies by month."""
    root, bars = _place(spark, "old-log"), _valid_bars(spark, folder)
    v1 = bars.drop("revision_schema_version", "observation_id", "value_hash", "availability_policy_id", "historical_data_semantics", "bar_seq", "observed_at")
    v2 = bars.withColumn("payload_hash", F.col("value_hash")).drop("revision_schema_version", "value_hash", "availability_policy_id", "historical_data_semantics", "bar_seq", "observed_at")
    day = F.col("trade_date")
    for part in (v1.where(day < V2_FROM), v2.where((day >= V2_FROM) & (day < V3_FROM))):
        part.withColumn("year", F.year("trade_date")).withColumn("month", F.month("trade_date")).repartition("year", "month").write.mode("append").partitionBy("year", "month").parquet(root)
    rewritten = revlog.migrate(spark, root)
    revlog.append_bars(bars.where(day >= V3_FROM), root)
    return _by_month(revlog.read_log(spark, root), revisions=F.count("*"), policies=F.count_distinct("availability_policy_id")).withColumn("rewritten", F.lit(rewritten).cast("long"))


def _keyed_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "etf_metadata_obs")
    return rows.withColumn("observation_key", stable_id({c: F.col(c) for c in METADATA_CONTENT}))


def metadata_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata store after two deliveries, the second a full one: what each brought, and what the store holds of each source."""
    root, rows = _place(spark, "metadata"), _keyed_metadata(spark, folder)
    first = observations.append_once(rows.where(F.col("ingest_time") < F.timestamp_seconds(F.lit(SECOND_BATCH_SECONDS))), root, "observation_key")
    second = observations.append_once(rows, root, "observation_key")
    held = spark.read.parquet(root).groupBy(token("source").alias("source")).agg(F.count("*").alias("stored"))
    return held.select("source", "stored", F.lit(first).cast("long").alias("first_inserted"), F.lit(second).cast("long").alias("second_inserted"))


def metadata_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Observations encoded as JSON, one key left out, and decoded again: by source how many come back whole, the lacking key by its default."""
    columns = ["symbol", "tracking_index", "list_date", "management_fee", "fund_name", "effective_from", "shares", "provider_payload_hash"]
    rows = table(spark, folder, "etf_metadata_obs").select("source", *columns)
    types = dict(rows.select(*columns).dtypes) | {"trading_cycle": "string"}
    back = rows.select("source", F.struct(*columns).alias("was"), F.struct(*observations.decoded(observations.encoded(rows, columns), types, {"trading_cycle": F.lit("UNKNOWN")})).alias("now"))
    same = F.struct(*[F.col(f"now.{c}").alias(c) for c in columns]).eqNullSafe(F.col("was"))
    return back.groupBy(token("source").alias("source")).agg(F.count_if(same).alias("whole"), F.count_if(F.col("now.trading_cycle") == "UNKNOWN").alias("defaulted"))


def metadata_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Of each invariant how many observations keep it and how many break it."""
    rules = observations.metadata_rules()
    counts = table(spark, folder, "etf_metadata_obs").agg(*[F.count_if(c).alias(n) for n, c in rules.items()], F.count("*").alias("_all"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken"), (F.col("_all") - F.col(n)).alias("kept")) for n in rules])))


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    """A stored calendar: each source's trading days are those it has bars of, first retrieved with the first of them."""
    bars = table(spark, folder, "market_bars").where("trade_date IS NOT NULL AND ingest_time IS NOT NULL")
    days = bars.groupBy(F.lit("CN").alias("market"), "trade_date", token("source").alias("provider")).agg(F.min("ingest_time").alias("retrieved_at")).withColumn("is_half_day", F.lit(False))
    keyed = observations.calendar_observations(days)
    keyed = keyed.withColumn("calendar_key", stable_id({c: F.col(c).cast("string") for c in keyed.columns}))
    root = _place(spark, "calendar")
    early = F.col("trade_date") < V3_FROM
    for part in (keyed.where(early), keyed):  # the second delivery repeats the first
        observations.append_once(part, root, "calendar_key")
    return spark.read.parquet(root)


def calendar_observed(spark: SparkSession, folder: str) -> DataFrame:
    """The trading days between two dates as this system knew them at an instant, each with its session and policy."""
    known = observations.calendar_as_of(_calendar(spark, folder), as_of=_instant(), mode=revlog.SYSTEM_REPLAY, start=FIRST_DAY, end=LAST_DAY, half_days="refuse")
    return known.select(iso("trade_date").alias("trade_date"), "source", F.unix_seconds("session_open").alias("opens"), F.unix_seconds("session_close").alias("closes"), F.unix_micros("ingest_time").alias("ingested_us"), "availability_policy_id")


def raw_finalized(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records of finalized days that were retrieved after the close of their day in the stored calendar, by fund."""
    raw, calendar = _raw(spark, folder), _calendar(spark, folder)
    found = rawcache.finalized_records(raw, "fund", cut_offs=observations.cut_offs(calendar), states=rawcache.day_states(raw, "fund"))
    return with_symbol(found.groupBy("fund").agg(F.count("*").alias("n_records"), F.count_distinct("trade_date").alias("n_days")), folder)


def index_known(spark: SparkSession, folder: str) -> DataFrame:
    """Each index as described by the latest eligible row of a stored index table, appended in two deliveries."""
    rows = table(spark, folder, "etf_metadata_obs").select(
        six_digits("tracking_index").alias("index_code"), token("source").alias("source"), "availability_class", "effective_from", "effective_to", "available_time", "ingest_time", "snapshot_at", "meta_seq"
    ).where("index_code IS NOT NULL")
    root = _place(spark, "indices")
    for part in (rows.where(F.col("ingest_time") < F.timestamp_seconds(F.lit(SECOND_BATCH_SECONDS))), rows):
        observations.append_once(part, root, "meta_seq")
    found = observations.index_as_of(spark.read.parquet(root), as_of=_instant(), day=utc_day(_instant()), mode=revlog.ECONOMIC, ties=("meta_seq",))
    return found.select("index_code", "source", "meta_seq")


def level_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Levels written to the CSV cache and read back: days and total of each asset."""
    levels = _line_levels(spark, folder).select(
        F.col("day").alias("observation_date"), "level", F.col("asset").alias("symbol"), F.lit("bench").alias("provider"), F.lit("2025-07-01T00:00:00Z").alias("retrieved_at"), F.lit("1").alias("sdk_version"), F.lit(SEMANTICS).alias("historical_data_semantics")
    )
    root = _place(spark, "levels")
    write_level_cache(levels, root)
    return read_level_cache(spark, root).groupBy(F.col("symbol").alias("asset")).agg(F.count("*").alias("n_days"), F.sum(F.col("level").cast("decimal(18,2)")).alias("total"))


def raw_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bars written to the JSON cache and read back between two days: records and volume of each provider version."""
    root = _place(spark, "raw")
    names = [part.strip().split(" ")[0] for part in RAW_BAR_SCHEMA.split(",")]
    write_json_lines(table(spark, folder, "supplemental_bars").select(*names), root)
    back = read_raw_cache(spark, root, FIRST_DAY, LAST_DAY)
    return back.groupBy("sdk_version").agg(F.count("*").alias("n_records"), F.sum("volume").alias("volume"), F.count("open").alias("n_open"))


QUERIES = {f.__name__: f for f in (log_appended, log_migrated, metadata_appended, metadata_payloads, metadata_violations, calendar_observed, raw_finalized, index_known, level_cache, raw_cache)}

_VALID = f"valid AS (SELECT * FROM market_bars WHERE historical_data_semantics = '{SEMANTICS}' AND " + " AND ".join(f"NOT coalesce({c}, false)" for c in _RULES.values()) + ")"
_VALUES = "(symbol, trade_date, source, open, high, low, close, volume, turnover, data_time)"
_SECOND = f"to_timestamp({SECOND_BATCH_SECONDS})"
_CALENDAR = f"cal AS (SELECT trade_date, {sql_token('source')} AS source, min(ingest_time) AS ingest_time, (trade_date + INTERVAL 15 HOUR) AT TIME ZONE 'Asia/Shanghai' AS closes FROM market_bars WHERE trade_date IS NOT NULL AND ingest_time IS NOT NULL GROUP BY ALL)"
_KEY = ", ".join(c for c in METADATA_CONTENT)
_ELIGIBLE_DAY = f"CAST({SQL_AS_OF} AT TIME ZONE 'UTC' AS DATE)"

SQL = {
    "log_appended": f"""WITH {_VALID}
SELECT CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month, count(DISTINCT ({_VALUES}, ingest_time, availability_policy_id, available_time)) AS revisions, count(DISTINCT {_VALUES}) AS contents, 0::BIGINT AS again
FROM valid WHERE trade_date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' GROUP BY 1, 2""",
    "log_migrated": f"""WITH {_VALID}, named AS (
  SELECT *, CASE WHEN trade_date < DATE '{V3_FROM}' THEN 'legacy_inferred_daily_bar_' || CAST(greatest(0, (epoch_us(available_time) // 1000000) - (epoch_us(data_time) // 1000000)) AS BIGINT) || 's' ELSE availability_policy_id END AS policy FROM valid),
old AS (SELECT count(DISTINCT ({_VALUES}, ingest_time, policy, available_time)) AS n FROM named WHERE trade_date < DATE '{V3_FROM}')
SELECT CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month, count(DISTINCT ({_VALUES}, ingest_time, policy, available_time)) AS revisions, count(DISTINCT policy) AS policies, any_value(old.n) AS rewritten
FROM named, old GROUP BY 1, 2""",
    "metadata_appended": f"""WITH keyed AS (SELECT {sql_token('source')} AS src, ({_KEY}) AS k, ingest_time < {_SECOND} AS early FROM etf_metadata_obs),
n AS (SELECT count(DISTINCT k) FILTER (WHERE early) AS a, count(DISTINCT k) AS b FROM keyed)
SELECT src AS source, count(DISTINCT k) AS stored, any_value(n.a) AS first_inserted, any_value(n.b - n.a) AS second_inserted FROM keyed, n GROUP BY src""",
    "metadata_payloads": f"SELECT {sql_token('source')} AS source, count(*) AS whole, count(*) AS defaulted FROM etf_metadata_obs GROUP BY 1",
    "metadata_violations": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS broken, count(*) FILTER (WHERE ({c}) IS NOT TRUE) AS kept FROM etf_metadata_obs" for n, c in {
        "empty_identifier": "trim(coalesce(symbol, '')) = '' OR trim(coalesce(source, '')) = '' OR trim(coalesce(provider_payload_hash, '')) = ''",
        "missing_time": "available_time IS NULL OR ingest_time IS NULL", "delisted_before_listed": "delist_date < list_date", "ends_before_start": "effective_to < effective_from",
        "snapshot_missing": "lower(availability_class) IN ('snapshot_only', 'forward_collected_pit') AND snapshot_at IS NULL",
        "negative_number": "least(price_limit_pct, management_fee, nav, iopv, shares, aum) < 0",
    }.items()),
    "calendar_observed": f"""WITH {_CALENDAR}
SELECT {_ISO('trade_date')} AS trade_date, source, CAST(epoch_us(closes) // 1000000 - 19800 AS BIGINT) AS opens, CAST(epoch_us(closes) // 1000000 AS BIGINT) AS closes, epoch_us(ingest_time) AS ingested_us, 'historical_calendar_session_close_v1' AS availability_policy_id
FROM cal WHERE closes <= {SQL_AS_OF} AND ingest_time <= {SQL_AS_OF} AND trade_date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'
QUALIFY row_number() OVER (PARTITION BY cal.trade_date ORDER BY cal.closes DESC, ingest_time DESC, source DESC) = 1""",
    "raw_finalized": f"""WITH {_FUNDS}, r AS (SELECT {sql_digits('symbol')} AS fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) AS trade_date, retrieved_at FROM supplemental_bars)
SELECT symbol, count(*) AS n_records, count(DISTINCT trade_date) AS n_days FROM r JOIN funds USING (fund) WHERE retrieved_at >= {_CUT_OFF} AND trade_date IN (SELECT trade_date FROM market_bars WHERE ingest_time IS NOT NULL) GROUP BY symbol""",
    "index_known": f"""SELECT {sql_digits('tracking_index')} AS index_code, {sql_token('source')} AS source, meta_seq FROM etf_metadata_obs
WHERE {sql_digits('tracking_index')} IS NOT NULL AND (effective_from IS NULL OR effective_from <= {_ELIGIBLE_DAY}) AND (effective_to IS NULL OR effective_to >= {_ELIGIBLE_DAY}) AND available_time <= {SQL_AS_OF}
  AND (lower(availability_class) NOT IN ('snapshot_only', 'forward_collected_pit') OR coalesce(snapshot_at <= {SQL_AS_OF}, false))
QUALIFY row_number() OVER (PARTITION BY {sql_digits('tracking_index')} ORDER BY available_time DESC NULLS LAST, ingest_time DESC NULLS LAST, meta_seq DESC) = 1""",
    "level_cache": f"WITH {_LINE_LEVELS} SELECT asset, count(*) AS n_days, sum(CAST(level AS DECIMAL(18,2))) AS total FROM levels GROUP BY asset",
    "raw_cache": f"SELECT sdk_version, count(*) AS n_records, CAST(sum(volume) AS BIGINT) AS volume, count(open) AS n_open FROM supplemental_bars WHERE {sql_day('provider_timestamp')} BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}' GROUP BY sdk_version",
}
