"""Stream slicing on Structured Streaming: corrected totals per window as late records arrive, in any order.

A micro-batch is reduced to the daily items of its panes and added to a store of panes; then the windows that cover a pane of
the batch are recomposed from the store and emitted again. The store holds maxima, so batches may come in any order, overlap
or be repeated. The cut-off is a rule on a record's own times and no watermark: nothing depends on which records came first,
and nothing is dropped in silence. Records beyond the cut-off are counted for each batch and pane.

Layout of the store, all by batch, so that a repeated batch overwrites itself: ``daily/batch=`` daily items in order of
panes, ``touched/batch=`` windows that the batch recomposed, ``windows/batch=`` their totals, ``late/batch=`` cut-off records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panes import daily_items, in_time, item_changes, merged_items, window_corrections
from tidemark.session import folders


def start_panes(
    records: DataFrame, *, keys: list[str], item: list[str], pane: Column, arrived_on: Column, latest_by: list[Column], amount: Column, cut_off_days: int,
    store: str, checkpoint: str, size: int = 1, pane_days: int = 7, from_day: int = 0, available_now: bool = True,
):
    """Start a query that keeps the panes of a stream of records; the arguments are those of ``pane_changes`` and ``window_corrections``."""
    how = {"keys": keys, "item": item, "pane": pane, "arrived_on": arrived_on, "latest_by": latest_by, "amount": amount, "cut_off_days": cut_off_days}

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, lambda part: f"{store}/{part}/batch={number}"
        daily_items(batch, **how).sortWithinPartitions("pane").write.mode("overwrite").parquet(at("daily"))
        late = batch.select(pane.alias("pane"), arrived_on.alias("arrived_on")).where(~in_time(F.col("pane"), F.col("arrived_on"), cut_off_days))
        late.groupBy("pane").agg(F.count("*").alias("n_late")).write.mode("overwrite").parquet(at("late"))
        windows = spark.read.parquet(at("daily")).select(*keys, F.explode(F.array(*[F.date_sub("pane", i * pane_days) for i in range(size)])).alias("window_start")).distinct()
        windows.write.mode("overwrite").parquet(at("touched"))
        touched = spark.read.parquet(at("touched"))
        first, last = touched.agg(F.min("window_start"), F.max(F.date_add("window_start", (size - 1) * pane_days))).first()
        if first is None:  # no item was in time
            return
        near = read_daily(spark, store, [*keys, *item], F.col("pane").between(first, last)).join(touched.select(*keys).distinct(), keys, "left_semi")
        totals = window_corrections(item_changes(near, keys=keys, item=item), keys=keys, size=size, pane_days=pane_days, from_day=from_day)
        totals.join(touched, [*keys, "window_start"], "left_semi").write.mode("overwrite").parquet(at("windows"))

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_daily(spark: SparkSession, store: str, whole: list[str], panes: Column | None = None) -> DataFrame:
    """The daily items of all batches; ``panes`` prunes by the statistics of files and row groups."""
    rows = spark.read.parquet(f"{store}/daily").drop("batch")
    return merged_items(rows if panes is None else rows.where(panes), whole)


def read_windows(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """``(keys, window_start, observed_on, total)`` as last emitted for each window; empty where nothing came in time."""
    if not folders(spark, f"{store}/windows/batch=*"):
        return spark.createDataFrame([], ", ".join([*(f"`{k}` string" for k in keys), "window_start date, observed_on date, total long"]))
    last = spark.read.parquet(f"{store}/touched").groupBy(*keys, "window_start").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{store}/windows").join(last, [*keys, "window_start", "batch"]).drop("batch")


def read_late(spark: SparkSession, store: str) -> DataFrame:
    """``(pane, n_late)``: records that came after their pane's cut-off, a repeated delivery counted again."""
    return spark.read.parquet(f"{store}/late").groupBy("pane").agg(F.sum("n_late").alias("n_late"))
