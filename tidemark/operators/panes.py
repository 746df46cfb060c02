"""Per-period totals by event time, corrected as late records arrive.

Stream slicing: the time axis is cut at window boundaries into panes that do not overlap. Every record belongs to one pane;
a late record changes that pane alone, and only the windows that cover it are recomposed and emitted again. A window of
``size`` panes that slides by one pane covers its panes; a tumbling window is the case ``size`` = 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_time(pane: Column, arrived_on: Column, cut_off_days: int) -> Column:
    """Whether a record arrives before the cut-off, counted from the pane's first day."""
    return arrived_on < F.date_add(pane, cut_off_days)


def daily_items(records: DataFrame, *, keys: list[str], item: list[str], pane: Column, arrived_on: Column, latest_by: list[Column], amount: Column, cut_off_days: int) -> DataFrame:
    """``(keys, item, pane, arrived_on, held)``: of each item and arrival day the last arrived record's order and amount.

    A maximum, so it does not matter in which order, in how many parts or how often the records come.
    """
    whole = [*keys, *item]
    held = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(latest_by)], F.coalesce(amount, F.lit(0)).alias("amount"))
    rows = records.select(*whole, pane.alias("pane"), arrived_on.alias("arrived_on"), held.alias("held")).dropna(subset=[*whole, "pane", "arrived_on"])
    return merged_items(rows.where(in_time(F.col("pane"), F.col("arrived_on"), cut_off_days)), whole)


def merged_items(daily: DataFrame, whole: list[str]) -> DataFrame:
    return daily.groupBy(*whole, "pane", "arrived_on").agg(F.max("held").alias("held"))


def item_changes(daily: DataFrame, *, keys: list[str], item: list[str]) -> DataFrame:
    """``(keys, pane, arrived_on, change)`` from the daily items."""
    before = F.lag("held.amount", 1, 0).over(Window.partitionBy(*keys, *item, "pane").orderBy("arrived_on"))
    return (
        daily.withColumn("change", F.col("held.amount") - before)
        .where("change <> 0")
        .groupBy(*keys, "pane", "arrived_on")
        .agg(F.sum("change").alias("change"))
        .where("change <> 0")
    )


def pane_changes(
    records: DataFrame, *, keys: list[str], item: list[str], pane: Column, arrived_on: Column, latest_by: list[Column], amount: Column, cut_off_days: int
) -> DataFrame:
    """``(keys, pane, arrived_on, change)``: by how much each arrival day changes the total of a pane.

    An item (``item`` within ``keys``) counts with the ``amount`` of its last arrived record by ``latest_by``, null as 0.
    Records that arrive ``cut_off_days`` or more after the pane's first day are cut off. Records with a null key, item,
    pane or arrival are ignored. The records of one item and arrival day are reduced on the map side.
    """
    daily = daily_items(records, keys=keys, item=item, pane=pane, arrived_on=arrived_on, latest_by=latest_by, amount=amount, cut_off_days=cut_off_days)
    return item_changes(daily, keys=keys, item=item)


def window_corrections(changes: DataFrame, *, keys: list[str], size: int = 1, pane_days: int = 7, from_day: int = 0) -> DataFrame:
    """``(keys, window_start, observed_on, total)``: each window whenever a pane that it covers has changed.

    ``observed_on`` is the day at whose end the total differs from that of the day before; days earlier than ``from_day``
    days after the window's start are left out (their changes still count in the totals). The changes of a key, which the
    calendar bounds, come together once; only there is each pane laid under the windows that cover it.
    """
    if size > 1:
        covered = F.explode(F.array(*[F.date_sub("pane", i * pane_days) for i in range(size)]))
        moved = changes.repartition(*keys).select(*keys, covered.alias("window_start"), F.col("arrived_on").alias("observed_on"), "change")
        moved = moved.groupBy(*keys, "window_start", "observed_on").agg(F.sum("change").alias("change")).where("change <> 0")
    else:
        moved = changes.select(*keys, F.col("pane").alias("window_start"), F.col("arrived_on").alias("observed_on"), "change")
    running = F.sum("change").over(Window.partitionBy(*keys, "window_start").orderBy("observed_on"))
    return moved.withColumn("total", running).where(F.col("observed_on") >= F.date_add("window_start", from_day)).drop("change")
