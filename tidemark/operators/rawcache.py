"""The raw cache of provider bars: record identity, provisional and finalized days, and what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identity import RAW_VALUE_FIELDS
from tidemark.functions.normalize import local_day, plus_seconds, session_close

PROVISIONAL, FINALIZED = "provisional", "finalized"


def payload_hash() -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(RAW_VALUE_FIELDS)]), {"ignoreNullFields": "false"}), 256)


def record_keys(raw: DataFrame) -> DataFrame:
    """The identity of a cached record: symbol, provider time, retrieval time and the hash of its values."""
    return raw.withColumn("payload_hash", payload_hash())


def upsert(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    rows = record_keys(incoming)
    rows = rows if existing is None else existing.unionByName(rows)
    return rows.dropDuplicates(["symbol", "provider_timestamp", "retrieved_at", "payload_hash"])


def day_states(raw: DataFrame, key: str = "symbol", delay_seconds: int = 900, expected: DataFrame | None = None) -> DataFrame:
    """``(key, trade_date, state, n_records)``: finalized once any record was retrieved at or after close plus delay.

    The state is a function of all records, so it is sticky and the same for batches and streams. Days outside
    ``expected (trade_date)``, if given, have no state.
    """
    day = local_day("provider_timestamp")
    rows = raw.withColumn("trade_date", day).dropna(subset=[key, "trade_date", "retrieved_at"])
    if expected is not None:
        rows = rows.join(F.broadcast(expected.select("trade_date").distinct()), "trade_date", "left_semi")  # bounded by the calendar
    final = F.col("retrieved_at") >= plus_seconds(session_close(F.col("trade_date")), delay_seconds)
    return rows.groupBy(key, "trade_date").agg(F.when(F.bool_or(final), FINALIZED).otherwise(PROVISIONAL).alias("state"), F.count("*").alias("n_records"))


def finalized_records(raw: DataFrame, key: str = "symbol", delay_seconds: int = 900, *, cut_offs: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The records of finalized days that were themselves retrieved at or after their day's cut-off.

    ``cut_offs (trade_date, cut_off)`` gives each day's own cut-off, and days without one have no record; without it every day
    closes at the regular time. ``states`` is the manifest of days; days that it does not call finalized have no record.
    """
    dated = raw.withColumn("trade_date", local_day("provider_timestamp"))
    if cut_offs is None:
        found = dated.where(F.col("retrieved_at") >= plus_seconds(session_close(F.col("trade_date")), delay_seconds))
    else:
        days = F.broadcast(cut_offs.groupBy("trade_date").agg(F.max("cut_off").alias("_cut_off")))  # bounded by the calendar
        found = dated.join(days, "trade_date").where(F.col("retrieved_at") >= F.col("_cut_off")).drop("_cut_off")
    return found if states is None else found.join(states.where(F.col("state") == FINALIZED).select(key, "trade_date"), [key, "trade_date"], "left_semi")


def missing_days(expected: DataFrame, states: DataFrame, key: str = "symbol") -> DataFrame:
    """``(key, trade_date)`` of expected days that are not finalized."""
    done = states.where(F.col("state") == FINALIZED).select(key, "trade_date")
    return expected.select(key, "trade_date").distinct().join(done, [key, "trade_date"], "left_anti")


def missing_ranges(expected: DataFrame, states: DataFrame, key: str = "symbol") -> DataFrame:
    """``(key, first_day, last_day, n_days)``: runs of missing days that no finalized expected day interrupts."""
    done = states.where(F.col("state") == FINALIZED).select(key, "trade_date", F.lit(True).alias("done"))
    days = expected.select(key, "trade_date").distinct().join(done, [key, "trade_date"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    run = F.sum(F.col("done").cast("int")).over(Window.partitionBy(key).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("_run", run).where(~F.col("done")).groupBy(key, "_run").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.count("*").alias("n_days")).drop("_run")


def upgraded_manifest(old: DataFrame) -> DataFrame:
    """A manifest ``(symbol, adjust, version, trade_date, state)`` of any version in the current one.

    Days that version 2 called verified were not checked against a cut-off and are provisional; version 1 kept ranges only.
    """
    state = F.when(F.col("version") >= 3, F.col("state")).otherwise(PROVISIONAL)
    rows = old.select("symbol", "adjust", "trade_date", state.alias("state"))
    return rows.groupBy("symbol", "adjust", "trade_date").agg(F.when(F.bool_or(F.col("state") == FINALIZED), FINALIZED).otherwise(PROVISIONAL).alias("state"))
