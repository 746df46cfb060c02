"""The queries of the general large-scale problems 2 to 6, with their SQL statements for a second engine."""

from __future__ import annotations

from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import BLANKS, DIGITS, UNKNOWN_TEXTS, WIDE_DIGITS, iso, known_text, monday, number, six_digits, strip, token, utc_day
from tidemark.functions.normalize import local_day
from tidemark.operators.asof import attributes_as_of
from tidemark.operators.history import append_history, observed_versions, read_history, reconstruct, validity
from tidemark.operators.panes import pane_changes, window_corrections
from tidemark.operators.snapshot_diff import ordinals, snapshot_changes
from tidemark.operators.table_diff import field_differences, paired_leftovers
from tidemark.session import cut_lineage, drop_stored, shared_path
from tidemark.sources.tables import table, with_symbol
from tidemark.streaming.panes import read_windows, start_panes

CUT_OFF_DAYS = 21
CANONICAL_SOURCE = "longbridge"
SHARES_A_LOT = 100
SECOND_DELIVERY = "2025-06-01"


def _own(spark: SparkSession, folder: str, name: str) -> str:
    """A table of this session and data folder in the shared folder."""
    return shared_path(spark, f"{name}-{md5(folder.encode()).hexdigest()[:12]}")


def _deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "etf_spot_snapshot").withColumn("fund", six_digits("symbol")).withColumn("day", utc_day("snapshot_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Funds added, removed or changed in shares or iopv between the consecutive days of etf_spot_snapshot."""
    rows = _deliveries(spark, folder).select("fund", "day", "shares", "iopv", "ingest_time", "provider_payload_hash")
    changes = snapshot_changes(rows, key="fund", snapshot="day", values=["shares", "iopv"], latest_by=["ingest_time", "provider_payload_hash"], dictionary=_own(spark, folder, "fund-ordinals"))
    return with_symbol(changes, folder).select("symbol", iso("day").alias("snapshot_date"), "change_kind")


def p2_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """The funds' ordinals after a first and a second delivery of keys: those of the first are kept, the second's follow densely."""
    keys, at = _deliveries(spark, folder).where("fund IS NOT NULL"), _own(spark, folder, "ordinals-twice")
    drop_stored(spark, at)
    first = cut_lineage(ordinals(keys.where(F.col("day") < F.to_date(F.lit(SECOND_DELIVERY))), "fund", at))
    second = ordinals(keys, "fund", at)
    n = first.agg(F.count("*").alias("_n"))  # one row
    both = second.join(first.select("fund", F.col("ordinal").alias("_before")), "fund", "left").join(F.broadcast(n))
    kept = F.when(F.col("_before").isNotNull(), F.col("_before") == F.col("ordinal")).otherwise(F.col("ordinal") >= F.col("_n"))
    place = F.row_number().over(Window.orderBy("ordinal")) - 1 == F.col("ordinal")  # one row per fund of the registry
    return with_symbol(both.select("fund", F.col("_before").isNotNull().alias("in_first"), (kept & place).alias("kept")), folder)


def _bar_and_request_events(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "market_bars").select(
        F.lit("bar").alias("event_kind"), F.col("bar_seq").alias("event_id"), six_digits("symbol").alias("fund"),
        F.col("available_time").alias("known_by"), F.lit(None).cast("timestamp").alias("ingested_by"), F.col("trade_date").alias("on_day"),
    )
    replay = token("mode") == "system_replay"
    requests = table(spark, folder, "resolve_requests").select(
        F.lit("request").alias("event_kind"), F.col("request_id").alias("event_id"), six_digits("symbol").alias("fund"),
        F.when(F.col("as_of").isNotNull(), F.least("as_of", "research_data_cutoff")).alias("known_by"),
        F.when(replay, F.col("as_of")).alias("ingested_by"), utc_day("as_of").alias("on_day"),
    )
    return bars.unionByName(requests)


def _known_at_events(spark: SparkSession, folder: str, attributes: dict) -> DataFrame:
    observations = table(spark, folder, "etf_metadata_obs").withColumn("fund", six_digits("symbol"))
    return attributes_as_of(
        _bar_and_request_events(spark, folder), observations, entity="fund", event_keys=["event_kind", "event_id"],
        known_by=F.col("known_by"), ingested_by=F.col("ingested_by"), on_day=F.col("on_day"),
        available=F.col("available_time"), ingested=F.col("ingest_time"), effective_from=F.col("effective_from"),
        effective_to=F.col("effective_to"), sequence=F.col("meta_seq"), attributes=attributes,
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata observation known and in effect at each bar and each request.

    Each attribute's history is matched separately, and what it yields is the place of its observation in the stated order; the
    observation in force is the latest of the matches. Observations that know none of the attributes have a history too.
    """
    known = {"tracking_index": known_text("tracking_index"), "management_fee": F.col("management_fee"), "fund_company": known_text("fund_company")}
    text = lambda n: F.lpad(n.cast("string"), 20, "0")
    micros = lambda c: text(F.unix_micros(c) + F.lit(1 << 62))
    place = F.concat(text(F.coalesce(F.unix_date("effective_from") + F.lit(1 << 31), F.lit(0))), micros("available_time"), micros("ingest_time"), text(F.coalesce("meta_seq", F.lit(0))))
    attributes = {n: F.when(c.isNotNull(), place) for n, c in known.items()} | {"none": F.when(F.coalesce(*[c.cast("string") for c in known.values()]).isNull(), place)}
    found = _known_at_events(spark, folder, attributes)
    return found.select("event_kind", "event_id", F.substring(F.greatest(*attributes), -20, 20).cast("long").alias("meta_seq"))


EVENT_ATTRIBUTES = ("tracking_index", "management_fee", "fund_company")


def p3_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Three attributes, each as last known at the event's time whatever became known of the others."""
    return _known_at_events(spark, folder, {"tracking_index": six_digits("tracking_index"), "management_fee": F.col("management_fee"), "fund_company": known_text("fund_company")})


BAR_FIELDS = ["open", "high", "low", "close", "volume", "turnover"]
RESULT_FIELDS = ["price_abs_difference", "volume_relative_difference", "turnover_relative_difference"]


def _as_number(c: str):
    return F.col(c).cast("decimal(38,12)").alias(c)


def _bar_revisions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rows of the primary source, and of the supplemental copy in the same units and types."""
    bars = table(spark, folder, "market_bars").where(token("source") == CANONICAL_SOURCE)
    ours = bars.select(six_digits("symbol").alias("fund"), "trade_date", "ingest_time", "bar_seq", *map(_as_number, BAR_FIELDS))
    lots = F.lower(F.get_json_object("provider_payload", "$.unit")).eqNullSafe("lot")
    copy = table(spark, folder, "supplemental_bars").select(
        six_digits("symbol").alias("fund"), local_day("provider_timestamp").alias("trade_date"), "retrieved_at",
        *[number(f).alias(f) for f in ("open", "high", "low", "close", "turnover")],
        (F.col("volume") * F.when(lots, SHARES_A_LOT).otherwise(1)).cast("decimal(38,12)").alias("volume"),
    )
    return ours, copy


def _bar_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Per fund and day the last bar of either copy."""
    keys = ["fund", "trade_date"]
    last = lambda df, order: df.dropna(subset=keys).groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*BAR_FIELDS).alias("row")))["row"].alias("row")).select(*keys, "row.*")
    ours, copy = _bar_revisions(spark, folder)
    return last(ours, ["ingest_time", "bar_seq"]), last(copy, ["retrieved_at"])


def _result_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "reconciliation_results").select(
        token("copy_name").alias("copy"), six_digits("symbol").alias("fund"), "trade_date",
        *[F.when(~F.isnan(f), F.round(F.col(f), 8) + F.lit(0.0)).alias(f) for f in RESULT_FIELDS],
    ).dropna(subset=["fund", "trade_date"])
    return rows.where("copy = 'desk'").drop("copy"), rows.where("copy = 'archive'").drop("copy")


def _differences(left: DataFrame, right: DataFrame, fields: list[str], **how) -> DataFrame:
    keys = ["fund", "trade_date"]
    return field_differences(paired_leftovers(left, right, keys, fields, **how), keys, fields)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One-sided rows and unequal fields of the two copies of the bars and of the reconciliation results.

    A row that either copy repeats counts once: repetitions that stay single after pairing are no difference.
    """
    bars = _differences(*_bar_copies(spark, folder), BAR_FIELDS, repetitions=False)
    results = _differences(*_result_copies(spark, folder), RESULT_FIELDS, repetitions=False).distinct()
    found = bars.withColumn("dataset", F.lit("bars")).unionByName(results.withColumn("dataset", F.lit("results")))
    return with_symbol(found, folder).select("dataset", "symbol", iso("trade_date").alias("trade_date"), "field_name", "difference")


def p4_result_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The two copies of the results with every repetition counted: rows missing on a side and least-difference pairs."""
    found = _differences(*_result_copies(spark, folder), RESULT_FIELDS)
    return with_symbol(found, folder).select("symbol", iso("trade_date").alias("trade_date"), "field_name", "difference")


def p4_bar_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """All revisions of a bar in one copy against all in the other: per fund and day the left-over rows, pairs and unequal fields.

    A fund and day has several different rows on either side, so that which are paired is a choice; the unequal fields are the
    fewest that any pairing leaves.
    """
    keys = ["fund", "trade_date"]
    pairs = paired_leftovers(*(side.dropna(subset=keys) for side in _bar_revisions(spark, folder)), keys, BAR_FIELDS)
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    unequal = sum((~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))).cast("int") for f in BAR_FIELDS)
    counts = pairs.groupBy(*keys).agg(
        F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(paired).alias("n_pairs"), F.sum(F.when(paired, unequal).otherwise(0)).alias("n_unequal")
    )
    return with_symbol(counts, folder).withColumn("trade_date", iso("trade_date"))


def _weekly(rows: DataFrame) -> dict:
    """The records of the primary source and how their weekly volume is kept, for the batch and the stream."""
    bars = rows.where(token("source") == CANONICAL_SOURCE)
    bars = bars.select(six_digits("symbol").alias("fund"), "trade_date", "volume", "ingest_time", "bar_seq", F.coalesce("observed_at", "ingest_time").alias("arrival"))
    return {
        "records": bars, "keys": ["fund"], "item": ["trade_date"], "pane": monday("trade_date"), "arrived_on": utc_day("arrival"),
        "latest_by": [F.col("arrival"), F.col("ingest_time"), F.col("bar_seq")], "amount": F.col("volume"), "cut_off_days": CUT_OFF_DAYS,
    }


def _weekly_changes(spark: SparkSession, folder: str) -> DataFrame:
    return pane_changes(**_weekly(table(spark, folder, "market_bars")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The days on which late bars corrected a weekly volume, up to the cut-off."""
    found = window_corrections(_weekly_changes(spark, folder), keys=["fund"], from_day=7)
    return with_symbol(found, folder).select("symbol", iso("window_start").alias("week_start"), iso("observed_on").alias("observed_on"))


def p5_four_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Volumes of sliding four-week windows, as first emitted and after every correction."""
    found = window_corrections(_weekly_changes(spark, folder), keys=["fund"], size=4)
    return with_symbol(found, folder).select("symbol", iso("window_start").alias("window_start"), iso("observed_on").alias("observed_on"), F.col("total").cast("long").alias("total"))


STREAM_BATCHES = 3


def p5_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """The same as p5_found from a stream of micro-batches in random order, some rows of which are delivered twice."""
    root = shared_path(spark, f"stream-{uuid4().hex}")
    rows = table(spark, folder, "market_bars").select("source", "symbol", "trade_date", "volume", "ingest_time", "observed_at", "bar_seq")
    files = spark.sparkContext.defaultParallelism
    rows.repartition(files, F.xxhash64("bar_seq")).write.parquet(f"{root}/in")
    again = spark.read.parquet(f"{root}/in").where(token("source") == CANONICAL_SOURCE).where(F.col("observed_at") > F.col("ingest_time"))
    again.coalesce(max(1, files // STREAM_BATCHES)).write.mode("append").parquet(f"{root}/in")  # a repeated delivery
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-4 * files // (3 * STREAM_BATCHES))).parquet(f"{root}/in")
    query = start_panes(**_weekly(stream), store=f"{root}/store", checkpoint=f"{root}/checkpoint", from_day=7)
    query.awaitTermination()
    found = read_windows(spark, f"{root}/store", ["fund"])
    return with_symbol(found, folder).select("symbol", iso("window_start").alias("week_start"), iso("observed_on").alias("observed_on"))


def _fund_versions(observations: DataFrame) -> DataFrame:
    rows = observations.withColumn("fund", six_digits("symbol"))
    index = F.coalesce(six_digits("tracking_index"), known_text("tracking_index"))
    return observed_versions(
        rows, entity="fund", effective_from="effective_from", latest_by=["available_time", "ingest_time", "meta_seq"],
        attributes={"tracking_index": index, "management_fee": F.col("management_fee")}, effective_to=F.col("effective_to"),
    )


HISTORY = ["tracking_index", "management_fee"]
SECOND_APPEND = "2025-06-01"


def _periods(spark: SparkSession, root: str) -> DataFrame:
    return validity(reconstruct(read_history(spark, root, "fund"), entity="fund", attributes=HISTORY), entity="fund", attributes=HISTORY)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The validity periods of each fund's tracking index and management fee, reconstructed from the stored history."""
    root = _own(spark, folder, "fund-history")
    drop_stored(spark, root)
    append_history(spark, root, _fund_versions(table(spark, folder, "etf_metadata_obs")), entity="fund", attributes=HISTORY)
    found = with_symbol(_periods(spark, root), folder)
    return found.select("symbol", iso("valid_from").alias("valid_from"), F.coalesce(iso("valid_to"), F.lit("open")).alias("valid_to"))


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """The same periods with the attributes that held, from a history that was appended in two parts, the later stored first."""
    root, rows = _own(spark, folder, "fund-history-twice"), table(spark, folder, "etf_metadata_obs")
    drop_stored(spark, root)
    late = F.coalesce(F.col("ingest_time") >= F.to_timestamp(F.lit(SECOND_APPEND)), F.lit(False))
    for part in (rows.where(late), rows.where(~late)):
        append_history(spark, root, _fund_versions(part), entity="fund", attributes=HISTORY)
    found = with_symbol(_periods(spark, root), folder)
    return found.select("symbol", iso("valid_from").alias("valid_from"), F.coalesce(iso("valid_to"), F.lit("open")).alias("valid_to"), "tracking_index", F.col("management_fee").cast("decimal(38,18)").alias("management_fee"))


QUERIES = {f.__name__: f for f in (p2_found, p2_ordinals, p3_found, p3_attributes, p4_found, p4_result_copies, p4_bar_revisions, p5_found, p5_four_weeks, p5_streamed, p6_found, p6_history)}


# --- the same in SQL -------------------------------------------------------------------------------------------------

_BLANKS = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288)"
assert BLANKS == " \t\r\n 　"
_UNKNOWN = ", ".join(f"'{t}'" for t in UNKNOWN_TEXTS)


def sql_digits(c: str) -> str:
    return f"nullif(regexp_extract(translate({c}, '{WIDE_DIGITS}', '{DIGITS}'), '(^|[^0-9])([0-9]{{6}})([^0-9]|$)', 2), '')"


def sql_known(c: str) -> str:
    return f"CASE WHEN lower(trim({c}, {_BLANKS})) NOT IN ({_UNKNOWN}) THEN trim({c}, {_BLANKS}) END"


def sql_token(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


def sql_day(c: str) -> str:
    return f"CAST({c} AT TIME ZONE 'UTC' AS DATE)"


_FUNDS = f"funds AS (SELECT {sql_digits('symbol')} AS fund, min(symbol) AS symbol FROM instruments GROUP BY 1)"

_P2 = f"""
WITH {_FUNDS},
state AS (
  SELECT {sql_digits('symbol')} AS fund, {sql_day('snapshot_at')} AS day, shares, iopv FROM etf_spot_snapshot
  WHERE {sql_digits('symbol')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {sql_digits('symbol')}, {sql_day('snapshot_at')}
    ORDER BY ingest_time DESC, provider_payload_hash DESC, shares DESC NULLS LAST, iopv DESC NULLS LAST) = 1
),
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM state)),
paired AS (
  SELECT coalesce(n.fund, o.fund) AS fund, d.day, n.fund IS NULL AS gone, o.fund IS NULL AS fresh,
    n.shares IS DISTINCT FROM o.shares OR n.iopv IS DISTINCT FROM o.iopv AS moved
  FROM days d CROSS JOIN (SELECT DISTINCT fund FROM state) f
  LEFT JOIN state n ON n.fund = f.fund AND n.day = d.day
  LEFT JOIN state o ON o.fund = f.fund AND o.day = d.before
  WHERE d.before IS NOT NULL AND (n.fund IS NOT NULL OR o.fund IS NOT NULL)
)
SELECT symbol, strftime(day, '%Y-%m-%d') AS snapshot_date,
  CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'changed' END AS change_kind
FROM paired JOIN funds USING (fund) WHERE gone OR fresh OR moved
"""


def _p3_sql(columns: list[str], values: dict[str, str]) -> str:
    picks = ", ".join(f"arg_max({values[c]}, o.rank) FILTER (WHERE {values[c]} IS NOT NULL) AS {c}" for c in columns)
    return f"""
WITH events AS (
  SELECT 'bar' AS event_kind, bar_seq AS event_id, {sql_digits('symbol')} AS fund, available_time AS known_by,
    NULL::TIMESTAMPTZ AS ingested_by, trade_date AS on_day FROM market_bars
  UNION ALL
  SELECT 'request', request_id, {sql_digits('symbol')}, least(as_of, coalesce(research_data_cutoff, as_of)),
    CASE WHEN {sql_token('mode')} = 'system_replay' THEN as_of END, {sql_day('as_of')} FROM resolve_requests
),
observations AS (
  SELECT *, {sql_digits('symbol')} AS fund, row_number() OVER (ORDER BY effective_from NULLS FIRST, available_time, ingest_time, meta_seq) AS rank
  FROM etf_metadata_obs
),
known AS (
  SELECT e.event_kind, e.event_id, {picks}
  FROM events e JOIN observations o ON o.fund = e.fund AND o.available_time <= e.known_by
    AND (e.ingested_by IS NULL OR o.ingest_time <= e.ingested_by)
    AND (o.effective_from IS NULL OR o.effective_from <= e.on_day) AND (o.effective_to IS NULL OR o.effective_to > e.on_day)
  GROUP BY e.event_kind, e.event_id
)
SELECT * FROM known WHERE {' OR '.join(f'{c} IS NOT NULL' for c in columns)}
"""


def _sql_number(c: str) -> str:
    return f"TRY_CAST(replace({sql_known(c)}, ',', '') AS DECIMAL(30,8))"


def _p4_pairs(fields: list[str], dataset: str) -> str:
    sided = f"SELECT '{dataset}' AS dataset, fund, trade_date, 'row' AS field_name, CASE WHEN r.fund IS NULL THEN 'only_left' ELSE 'only_right' END AS difference FROM {dataset}_l l FULL JOIN {dataset}_r r USING (fund, trade_date) WHERE l.fund IS NULL OR r.fund IS NULL"
    each = [f"SELECT '{dataset}', fund, trade_date, '{f}', 'value' FROM {dataset}_l l JOIN {dataset}_r r USING (fund, trade_date) WHERE l.{f} IS DISTINCT FROM r.{f}" for f in fields]
    return " UNION ALL ".join([sided, *each])


_P4 = f"""
WITH {_FUNDS},
bars_l AS (
  SELECT {sql_digits('symbol')} AS fund, trade_date, {', '.join(f'CAST({f} AS DECIMAL(30,8)) AS {f}' for f in BAR_FIELDS)} FROM market_bars
  WHERE {sql_token('source')} = 'longbridge' AND {sql_digits('symbol')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {sql_digits('symbol')}, trade_date ORDER BY ingest_time DESC, bar_seq DESC) = 1
),
bars_r AS (
  SELECT {sql_digits('symbol')} AS fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) AS trade_date,
    {', '.join(f'{_sql_number(f)} AS {f}' for f in ('open', 'high', 'low', 'close', 'turnover'))},
    CAST(volume * CASE WHEN lower(json_extract_string(provider_payload, '$.unit')) = 'lot' THEN {SHARES_A_LOT} ELSE 1 END AS DECIMAL(30,8)) AS volume
  FROM supplemental_bars WHERE {sql_digits('symbol')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) ORDER BY retrieved_at DESC) = 1
),
results AS (
  SELECT DISTINCT {sql_token('copy_name')} AS copy, {sql_digits('symbol')} AS fund, trade_date,
    {', '.join(f'CASE WHEN NOT isnan({f}) THEN round({f}, 8) + 0.0 END AS {f}' for f in RESULT_FIELDS)} FROM reconciliation_results
  WHERE {sql_digits('symbol')} IS NOT NULL
),
results_l AS (SELECT * FROM results WHERE copy = 'desk'),
results_r AS (SELECT * FROM results WHERE copy = 'archive'),
found AS ({_p4_pairs(BAR_FIELDS, 'bars')} UNION ALL {_p4_pairs(RESULT_FIELDS, 'results')})
SELECT dataset, symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, field_name, difference FROM found JOIN funds USING (fund)
"""

# Neither copy of the results repeats a key with different values, so the least-cost pairing of a key's left-over rows is any pairing.
_P4_COPIES = f"""
WITH {_FUNDS},
results AS (
  SELECT {sql_token('copy_name')} AS copy, {sql_digits('symbol')} AS fund, trade_date,
    {', '.join(f'CASE WHEN NOT isnan({f}) THEN round({f}, 8) + 0.0 END AS {f}' for f in RESULT_FIELDS)} FROM reconciliation_results
  WHERE {sql_digits('symbol')} IS NOT NULL
),
desk AS (SELECT * EXCLUDE (copy) FROM results WHERE copy = 'desk'),
archive AS (SELECT * EXCLUDE (copy) FROM results WHERE copy = 'archive'),
l AS (SELECT *, count(*) AS n FROM (SELECT * FROM desk EXCEPT ALL SELECT * FROM archive) GROUP BY ALL),
r AS (SELECT *, count(*) AS n FROM (SELECT * FROM archive EXCEPT ALL SELECT * FROM desk) GROUP BY ALL),
paired AS (SELECT coalesce(l.fund, r.fund) AS fund, coalesce(l.trade_date, r.trade_date) AS trade_date, coalesce(l.n, 0) AS nl, coalesce(r.n, 0) AS nr, {', '.join(f'l.{f} IS DISTINCT FROM r.{f} AS d{i}' for i, f in enumerate(RESULT_FIELDS))} FROM l FULL JOIN r ON l.fund = r.fund AND l.trade_date = r.trade_date),
found AS (
  SELECT fund, trade_date, 'row' AS field_name, CASE WHEN nl > nr THEN 'only_left' ELSE 'only_right' END AS difference, unnest(range(abs(nl - nr))) AS k FROM paired
  {' '.join(f"UNION ALL SELECT fund, trade_date, '{f}', 'value', unnest(range(least(nl, nr))) FROM paired WHERE d{i}" for i, f in enumerate(RESULT_FIELDS))}
)
SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, field_name, difference FROM found JOIN funds USING (fund)
"""

_FIELD_LIST = ", ".join(BAR_FIELDS)
# Every way to give each row of the smaller side a row of the larger one of its own, and of these the cheapest.
_P4_REVISIONS = f"""
WITH RECURSIVE {_FUNDS},
ours AS (
  SELECT {sql_digits('symbol')} AS fund, trade_date, {', '.join(f'CAST({f} AS DECIMAL(30,8)) AS {f}' for f in BAR_FIELDS)} FROM market_bars
  WHERE {sql_token('source')} = 'longbridge' AND {sql_digits('symbol')} IS NOT NULL AND trade_date IS NOT NULL
),
theirs AS (
  SELECT {sql_digits('symbol')} AS fund, CAST(provider_timestamp AT TIME ZONE 'Asia/Shanghai' AS DATE) AS trade_date, {', '.join(f'{_sql_number(f)} AS {f}' for f in ('open', 'high', 'low', 'close'))},
    CAST(volume * CASE WHEN lower(json_extract_string(provider_payload, '$.unit')) = 'lot' THEN {SHARES_A_LOT} ELSE 1 END AS DECIMAL(30,8)) AS volume, {_sql_number('turnover')} AS turnover
  FROM supplemental_bars WHERE {sql_digits('symbol')} IS NOT NULL AND provider_timestamp IS NOT NULL
),
l AS (SELECT * FROM ours EXCEPT ALL SELECT * FROM theirs),
r AS (SELECT * FROM theirs EXCEPT ALL SELECT * FROM ours),
sizes AS (SELECT fund, trade_date, count(*) FILTER (WHERE side = 'l') AS nl, count(*) FILTER (WHERE side = 'r') AS nr FROM (SELECT fund, trade_date, 'l' AS side FROM l UNION ALL SELECT fund, trade_date, 'r' FROM r) GROUP BY ALL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY fund, trade_date, side ORDER BY {_FIELD_LIST}) AS i FROM (SELECT 'l' AS side, * FROM l UNION ALL SELECT 'r', * FROM r)
),
small AS (SELECT n.* FROM numbered n JOIN sizes s USING (fund, trade_date) WHERE least(nl, nr) > 0 AND n.side = CASE WHEN nl <= nr THEN 'l' ELSE 'r' END),
large AS (SELECT n.* FROM numbered n JOIN sizes s USING (fund, trade_date) WHERE least(nl, nr) > 0 AND n.side = CASE WHEN nl <= nr THEN 'r' ELSE 'l' END),
costs AS (SELECT a.fund, a.trade_date, a.i, b.i AS j, {' + '.join(f'CAST(a.{f} IS DISTINCT FROM b.{f} AS INTEGER)' for f in BAR_FIELDS)} AS cost FROM small a JOIN large b USING (fund, trade_date)),
ways AS (
  SELECT fund, trade_date, 1 AS i, [j] AS taken, cost FROM costs WHERE i = 1
  UNION ALL
  SELECT c.fund, c.trade_date, c.i, list_append(w.taken, c.j), w.cost + c.cost FROM ways w JOIN costs c ON c.fund = w.fund AND c.trade_date = w.trade_date AND c.i = w.i + 1 AND NOT list_contains(w.taken, c.j)
),
cheapest AS (SELECT fund, trade_date, arg_max(cost, (i, -cost)) AS cost FROM ways GROUP BY ALL)
SELECT symbol, strftime(trade_date, '%Y-%m-%d') AS trade_date, nl AS n_left, nr AS n_right, least(nl, nr) AS n_pairs, CAST(coalesce(cost, 0) AS BIGINT) AS n_unequal
FROM sizes LEFT JOIN cheapest USING (fund, trade_date) JOIN funds USING (fund)
"""

_P5_CHANGES = f"""
{_FUNDS},
rows AS (
  SELECT {sql_digits('symbol')} AS fund, trade_date, CAST(date_trunc('week', trade_date) AS DATE) AS week, coalesce(volume, 0) AS volume,
    coalesce(observed_at, ingest_time) AS arrival, {sql_day('coalesce(observed_at, ingest_time)')} AS arrived_on, ingest_time, bar_seq
  FROM market_bars WHERE {sql_token('source')} = 'longbridge' AND {sql_digits('symbol')} IS NOT NULL
),
kept AS (SELECT * FROM rows WHERE arrived_on < week + {CUT_OFF_DAYS}),
days AS (SELECT DISTINCT fund, week, arrived_on FROM kept),
totals AS (
  SELECT fund, week, observed_on, sum(volume) AS total FROM (
    SELECT d.fund, d.week, d.arrived_on AS observed_on, k.trade_date, arg_max(k.volume, (k.arrival, k.ingest_time, k.bar_seq)) AS volume
    FROM days d JOIN kept k ON k.fund = d.fund AND k.week = d.week AND k.arrived_on <= d.arrived_on GROUP BY ALL
  ) GROUP BY ALL
)"""

_P5 = f"""
WITH {_P5_CHANGES},
steps AS (SELECT *, lag(total, 1, 0) OVER (PARTITION BY fund, week ORDER BY observed_on) AS before FROM totals)
SELECT symbol, strftime(week, '%Y-%m-%d') AS week_start, strftime(observed_on, '%Y-%m-%d') AS observed_on
FROM steps JOIN funds USING (fund) WHERE total <> before AND observed_on >= week + 7
"""

_P5_FOUR = f"""
WITH {_P5_CHANGES},
steps AS (SELECT *, total - lag(total, 1, 0) OVER (PARTITION BY fund, week ORDER BY observed_on) AS change FROM totals),
moved AS (
  SELECT fund, CAST(week - 7 * k AS DATE) AS window_start, observed_on, sum(change) AS change FROM steps, (VALUES (0), (1), (2), (3)) v(k) WHERE change <> 0 GROUP BY ALL HAVING sum(change) <> 0
),
running AS (SELECT *, sum(change) OVER (PARTITION BY fund, window_start ORDER BY observed_on) AS total FROM moved)
SELECT symbol, strftime(window_start, '%Y-%m-%d') AS window_start, strftime(observed_on, '%Y-%m-%d') AS observed_on, CAST(total AS BIGINT) AS total
FROM running JOIN funds USING (fund)
"""

_P6_PERIODS = f"""
{_FUNDS},
rows AS (
  SELECT {sql_digits('symbol')} AS fund, effective_from, effective_to, coalesce({sql_digits('tracking_index')}, {sql_known('tracking_index')}) AS idx, management_fee AS fee,
    (available_time, ingest_time, meta_seq) AS ord FROM etf_metadata_obs WHERE effective_from IS NOT NULL AND {sql_digits('symbol')} IS NOT NULL
),
versions AS (
  SELECT fund, effective_from, arg_max(idx, ord) FILTER (WHERE idx IS NOT NULL) AS idx, arg_max(fee, ord) FILTER (WHERE fee IS NOT NULL) AS fee,
    arg_max(effective_to, ord) FILTER (WHERE effective_to IS NOT NULL) AS effective_to FROM rows GROUP BY ALL
),
filled AS (
  SELECT fund, effective_from, last_value(idx IGNORE NULLS) OVER w AS idx, last_value(fee IGNORE NULLS) OVER w AS fee,
    CASE WHEN effective_to < coalesce(lead(effective_from) OVER o, DATE '9999-12-31') THEN effective_to ELSE lead(effective_from) OVER o END AS ended
  FROM versions WINDOW w AS (PARTITION BY fund ORDER BY effective_from ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY fund ORDER BY effective_from)
),
marked AS (
  SELECT *, CASE WHEN lag(ended) OVER o = effective_from AND lag(idx) OVER o IS NOT DISTINCT FROM idx AND lag(fee) OVER o IS NOT DISTINCT FROM fee THEN 0 ELSE 1 END AS starts
  FROM filled WHERE ended IS NULL OR ended > effective_from WINDOW o AS (PARTITION BY fund ORDER BY effective_from)
),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY fund ORDER BY effective_from) AS run FROM marked),
periods AS (SELECT fund, run, min(effective_from) AS valid_from, CASE WHEN bool_or(ended IS NULL) THEN NULL ELSE max(ended) END AS valid_to, min(idx) AS idx, min(fee) AS fee FROM runs GROUP BY ALL)"""

_P6_COLUMNS = "symbol, strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), 'open') AS valid_to"

SQL = {
    "p2_found": _P2,
    "p2_ordinals": f"WITH {_FUNDS}, seen AS (SELECT {sql_digits('symbol')} AS fund, coalesce(bool_or({sql_day('snapshot_at')} < DATE '{SECOND_DELIVERY}'), false) AS in_first FROM etf_spot_snapshot GROUP BY 1) SELECT symbol, in_first, true AS kept FROM seen JOIN funds USING (fund)",
    "p3_found": _p3_sql(["meta_seq"], {"meta_seq": "o.meta_seq"}),
    "p3_attributes": _p3_sql(list(EVENT_ATTRIBUTES), {"tracking_index": sql_digits("o.tracking_index"), "management_fee": "CAST(o.management_fee AS VARCHAR)", "fund_company": sql_known("o.fund_company")}),
    "p4_found": _P4,
    "p4_result_copies": _P4_COPIES,
    "p4_bar_revisions": _P4_REVISIONS,
    "p5_found": _P5,
    "p5_four_weeks": _P5_FOUR,
    "p5_streamed": _P5,
    "p6_found": f"WITH {_P6_PERIODS} SELECT {_P6_COLUMNS} FROM periods JOIN funds USING (fund)",
    "p6_history": f"WITH {_P6_PERIODS} SELECT {_P6_COLUMNS}, idx AS tracking_index, fee AS management_fee FROM periods JOIN funds USING (fund)",
}
