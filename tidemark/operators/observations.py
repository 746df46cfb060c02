"""Observation stores of metadata, indices and calendars: insert once, and read as known at an instant."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import utc_day
from tidemark.functions.normalize import plus_seconds, session_close, session_open
from tidemark.operators.revlog import SYSTEM_REPLAY
from tidemark.session import cut_lineage, stored

#: Classes of observations that prove nothing before their own snapshot.
SNAPSHOT_CLASSES = ("snapshot_only", "forward_collected_pit")
METADATA_ORDER = ("effective_from", "snapshot_at", "available_time", "ingest_time")


def insert_once(existing: DataFrame | None, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not stored yet, one per key: the first observed, then by content."""
    order = [c for c in ("ingest_time", "available_time") if c in incoming.columns]
    first = incoming.groupBy(key).agg(F.min(F.struct(*order, *[c for c in incoming.columns if c not in (key, *order)])).alias("_r"))
    rows = first.select(key, "_r.*").select(*incoming.columns)
    return rows if existing is None else rows.join(existing.select(key), key, "left_anti")


def eligible(rows: DataFrame, *, as_of: Column, mode: str, research_cutoff: Column | None = None, day: Column | None = None) -> DataFrame:
    """The observations that may be used at ``as_of``.

    In effect on the day (both ends inclusive) in the row's own market zone, or on ``day`` if given; available; for snapshot
    classes taken by then; in replay stored by then; and stored by the research cut-off if there is one.
    """
    on = day if day is not None else F.coalesce(_zone_day(as_of), utc_day(as_of))
    fits = (
        (F.col("effective_from").isNull() | (F.col("effective_from") <= on))
        & (F.col("effective_to").isNull() | (F.col("effective_to") >= on))
        & (F.col("available_time") <= as_of)
        & (~F.lower("availability_class").isin(*SNAPSHOT_CLASSES) | F.coalesce(F.col("snapshot_at") <= as_of, F.lit(False)))
    )
    if mode == SYSTEM_REPLAY:
        fits &= F.col("ingest_time") <= as_of
    if research_cutoff is not None:
        fits &= research_cutoff.isNull() | (F.col("ingest_time") <= research_cutoff)
    return rows.where(fits)


def _zone_day(as_of: Column) -> Column:
    return utc_day(F.from_utc_timestamp(as_of, F.col("market_timezone")))


def latest_by(rows: DataFrame, key: list[str], order: tuple[str, ...], ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each key the row that is greatest by ``order``, nulls least, then by ``ties``."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in (*order, *ties)]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def several_sources(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one source describes; a read that names no source must not touch them."""
    return rows.groupBy(key).agg(F.min("source").alias("_a"), F.max("source").alias("_b"), F.count_distinct("source").alias("n_sources")).where("_a <> _b").drop("_a", "_b")


def metadata_as_of(rows: DataFrame, *, as_of: Column, mode: str, source: str | None = None, research_cutoff: Column | None = None, key: str = "symbol") -> DataFrame:
    """The latest eligible observation of each key (and source); without a source, several of them are an error."""
    known = eligible(rows, as_of=as_of, mode=mode, research_cutoff=research_cutoff)
    if source is not None:
        known = known.where(F.col("source") == source)
    elif not several_sources(known, key).limit(1).isEmpty():
        raise ValueError("several sources; name one")
    return latest_by(known, [key], METADATA_ORDER, ("provider_payload_hash",))


def index_as_of(rows: DataFrame, *, as_of: Column, day: Column, mode: str, research_cutoff: Column | None = None, codes: list[str] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The latest eligible description of each index (of ``codes``, if given); the effective period is judged on the caller's day."""
    asked = rows if codes is None else rows.where(F.col("index_code").isin(*codes))
    return latest_by(eligible(asked, as_of=as_of, mode=mode, research_cutoff=research_cutoff, day=day), ["index_code"], ("available_time", "ingest_time"), ties)


def calendar_as_of(rows: DataFrame, *, as_of: Column, mode: str, research_cutoff: Column | None = None, half_days: str = "keep", start: date | None = None, end: date | None = None) -> DataFrame:
    """Each market's latest known entry per day from ``start`` to ``end``. ``half_days`` may be ``keep`` or ``refuse``, which raises on one."""
    known = F.col("available_time") <= as_of
    if start is not None:
        known &= F.col("trade_date") >= F.lit(start)
    if end is not None:
        known &= F.col("trade_date") <= F.lit(end)
    if mode == SYSTEM_REPLAY:
        known &= F.col("ingest_time") <= as_of
    if research_cutoff is not None:
        known &= F.col("ingest_time") <= research_cutoff
    days = latest_by(rows.where(known), ["market", "trade_date"], ("available_time", "ingest_time"), ("source",))
    if half_days == "refuse":
        days = days.withColumn("is_half_day", F.when(F.col("is_half_day"), F.raise_error(F.lit("half-day session")).cast("boolean")).otherwise(F.col("is_half_day")))
    return days


# --- stores ---

def append_once(incoming: DataFrame, root: str, key: str) -> int:
    """Append the rows whose key is not stored at ``root`` yet; how many there were. One writer is assumed."""
    spark = incoming.sparkSession
    existing = spark.read.parquet(root) if stored(spark, root) else None
    fresh = cut_lineage(insert_once(existing, incoming, key))
    inserted = fresh.count()
    if inserted or existing is None:
        fresh.write.mode("append").parquet(root)
    return inserted


def calendar_observations(days: DataFrame, version: str = "v1") -> DataFrame:
    """Observations from a provider's trading days ``(market, trade_date, is_half_day, provider, retrieved_at)``.

    An open day is known from its session's close. Half days close at an unverified time, so one of them is an error.
    """
    verified = F.when(F.coalesce("is_half_day", F.lit(False)), F.raise_error(F.lit("half-day session times are unverified"))).otherwise(F.lit(False)).cast("boolean")
    return days.select(
        "market", "trade_date", F.lit(True).alias("is_open"), session_open("trade_date").alias("session_open"), session_close("trade_date").alias("session_close"), verified.alias("is_half_day"),
        session_close("trade_date").alias("available_time"), F.col("retrieved_at").alias("ingest_time"), F.col("provider").alias("source"),
        F.lit("historical_latest").alias("historical_data_semantics"), F.lit(f"historical_calendar_session_close_{version}").alias("availability_policy_id"),
    )


def cut_offs(calendar: DataFrame, delay_seconds: int = 900) -> DataFrame:
    """``(trade_date, cut_off)`` from each day's own close."""
    return calendar.where("is_open").select("trade_date", plus_seconds("session_close", delay_seconds).alias("cut_off"))


def encoded(rows: DataFrame, columns: list[str]) -> Column:
    """The columns as one JSON payload, nulls kept; times and dates as text, decimals exact."""
    plain = [F.col(c).cast("string").alias(c) if rows.schema[c].dataType.typeName() in ("decimal", "date") else F.col(c) for c in columns]
    return F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})


def decoded(payload: Column | str, types: dict[str, str], defaults: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a JSON payload by their types; a missing key or a null has its default, or is null."""
    content = F.from_json(payload, ", ".join(f"`{n}` {t}" for n, t in types.items()))
    return [F.coalesce(content[n], *([defaults[n]] if n in (defaults or {}) else [])).alias(n) for n in types]


def _reversed(first: str, last: str) -> Column:
    return F.coalesce(F.col(last) < F.col(first), F.lit(False))


def _blank(*columns: str) -> Column:
    return reduce(or_, [F.coalesce(F.trim(c), F.lit("")) == "" for c in columns])


def _unsnapped() -> Column:
    return F.coalesce(F.lower("availability_class").isin(*SNAPSHOT_CLASSES), F.lit(False)) & F.col("snapshot_at").isNull()


def metadata_rules() -> dict[str, Column]:
    """The invariants of a metadata observation, each as the condition of its violation."""
    numbers = [F.coalesce(F.col(c) < 0, F.lit(False)) for c in ("price_limit_pct", "management_fee", "nav", "iopv", "shares", "aum")]
    return {
        "empty_identifier": _blank("symbol", "source", "provider_payload_hash"), "missing_time": F.col("available_time").isNull() | F.col("ingest_time").isNull(),
        "delisted_before_listed": _reversed("list_date", "delist_date"), "ends_before_start": _reversed("effective_from", "effective_to"),
        "snapshot_missing": _unsnapped(), "negative_number": reduce(or_, numbers),
    }


def index_rules() -> dict[str, Column]:
    """The invariants of an index description."""
    return {
        "empty_identifier": _blank("index_code", "source"), "missing_time": F.col("available_time").isNull() | F.col("ingest_time").isNull(),
        "ends_before_start": _reversed("effective_from", "effective_to"), "snapshot_missing": _unsnapped(),
    }


def calendar_rules() -> dict[str, Column]:
    """The invariants of a calendar observation."""
    return {
        "empty_identifier": _blank("market", "source", "availability_policy_id"), "missing_time": F.col("available_time").isNull() | F.col("ingest_time").isNull(),
        "open_without_session": F.coalesce("is_open", F.lit(False)) & (F.col("session_open").isNull() | F.col("session_close").isNull()),
    }
