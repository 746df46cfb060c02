"""Level series in long form ``(asset, day, level)``: validation, daily and weekly returns, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import history_flag

EXTREME_RETURN, LONG_GAP_DAYS = 0.50, 14


def _by_day():
    return Window.partitionBy("asset").orderBy("day")


def usable(levels: DataFrame) -> DataFrame:
    """Levels of zero or less are unknown, but their rows stay, so that no return spans them."""
    return levels.withColumn("level", F.when(F.col("level") > 0, F.col("level")))


def require_series(levels: DataFrame) -> None:
    """One row per asset and day, no missing days or levels; anything else raises."""
    bad = levels.groupBy("asset", "day").agg(F.count("*").alias("n"), F.count("level").alias("known")).where("n > 1 OR known < n OR day IS NULL").limit(3).collect()
    if bad:
        raise ValueError(f"repeated or missing levels: {bad}")


def daily_returns(levels: DataFrame) -> DataFrame:
    """``(asset, day, ret)``: the change against the row before; none where either level is unknown."""
    before = F.lag("level").over(_by_day())
    return usable(levels).select("asset", "day", (F.try_divide(F.col("level"), before) - 1).alias("ret")).where("ret IS NOT NULL")


def friday(day: Column | str) -> Column:
    """The Friday that ends the week (Saturday to Friday) of a day."""
    return F.next_day(F.date_sub(F.col(day) if isinstance(day, str) else day, 1), "Fri")


def weekly_returns(levels: DataFrame) -> DataFrame:
    """``(asset, day, ret)`` from each week's last known level, dated by its actual day.

    A week without a known level voids the return into it and the one out of it.
    """
    last = usable(levels).where("level IS NOT NULL").groupBy("asset", friday("day").alias("week")).agg(F.max("day").alias("day"), F.max_by("level", "day").alias("level"))
    weeks = Window.partitionBy("asset").orderBy("week")
    joined = last.select("asset", "day", "week", F.lag("week").over(weeks).alias("week0"), "level", F.lag("level").over(weeks).alias("level0"))
    return joined.where(F.date_diff("week", "week0") == 7).select("asset", "day", (F.try_divide("level", "level0") - 1).alias("ret"))


def level_warnings(levels: DataFrame) -> DataFrame:
    """``(asset, nonpositive, extreme_returns, long_gaps, quality)``: audit counts per series; nothing is dropped for them."""
    known = F.when(F.col("level") > 0, F.col("level"))
    rows = levels.select("asset", "level", F.abs(F.try_divide(known, F.lag(known).over(_by_day())) - 1).alias("move"), F.date_diff("day", F.lag("day").over(_by_day())).alias("gap"))
    counts = rows.groupBy("asset").agg(F.count_if(F.col("level") <= 0).alias("nonpositive"), F.count_if(F.col("move") > EXTREME_RETURN).alias("extreme_returns"), F.count_if(F.col("gap") > LONG_GAP_DAYS).alias("long_gaps"))
    return counts.withColumn("quality", F.when(F.col("nonpositive") + F.col("extreme_returns") + F.col("long_gaps") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def coverage(registry: DataFrame, levels: DataFrame) -> DataFrame:
    """``(asset, first_day, last_day, n_obs, flag)`` for every registered asset; UNRESOLVED without a series."""
    each = levels.groupBy("asset").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_obs"))
    joined = registry.select("asset").distinct().join(each, "asset", "left")
    return joined.select("asset", "first_day", "last_day", F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"), F.coalesce(history_flag("first_day", "last_day"), F.lit("UNRESOLVED")).alias("flag"))
