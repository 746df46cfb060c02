"""Continuous ingestion: the batch operators applied to micro-batches. They are idempotent, so a repeated batch does no harm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import normalize_bars
from tidemark.operators import rawcache, revlog


def _start(stream: DataFrame, step, checkpoint: str, available_now: bool):
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_ingestion(raw: DataFrame, log_root: str, checkpoint: str, *, version: str = "v1", delay_seconds: int = 900, available_now: bool = True):
    """Raw bars to the revision log: only records retrieved after their day's cut-off, normalised and appended once."""

    def step(batch: DataFrame, number: int) -> None:
        final = rawcache.finalized_records(batch, delay_seconds=delay_seconds).select(*batch.columns)
        revlog.append_bars(normalize_bars(final, version=version, delay_seconds=delay_seconds), log_root)

    return _start(raw, step, checkpoint, available_now)


def start_day_states(raw: DataFrame, store: str, checkpoint: str, *, key: str = "symbol", delay_seconds: int = 900, available_now: bool = True):
    """States of days per micro-batch; ``current_states`` takes the final one, as a finalized day stays so."""

    def step(batch: DataFrame, number: int) -> None:
        rawcache.day_states(batch, key, delay_seconds).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return _start(raw, step, checkpoint, available_now)


def current_states(states: DataFrame, key: str = "symbol") -> DataFrame:
    """``finalized`` sorts before ``provisional``, so the least state of a day is its current one."""
    return states.groupBy(key, "trade_date").agg(F.min("state").alias("state"), F.sum("n_records").alias("n_records"))
