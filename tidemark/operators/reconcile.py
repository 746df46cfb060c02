"""Reconciliation of two feeds of bars: differences in tolerances, and a status per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import relative_difference, tolerance_ratio

INFINITE = float("inf")
PRICES = ("open", "high", "low", "close")


def reconcile(primary: DataFrame, supplemental: DataFrame, key: list[str], *, price: float, volume: float, turnover: float, multiplier: float) -> DataFrame:
    """``(key, status, three differences)``: PASS within the tolerances, WARNING within their multiple, else FAIL.

    A key on one side only fails with infinite differences, and so does a value that only one side knows; a value that
    neither knows differs by 0. Each side must have one row per key.
    """
    columns = [*PRICES, "volume", "turnover"]
    a = primary.select(*key, F.struct(*columns).alias("a"))
    b = supplemental.select(*key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    one_sided = F.col("a").isNull() | F.col("b").isNull()

    def guarded(diff, names):
        lacking = [F.col(f"a.{n}").isNull() != F.col(f"b.{n}").isNull() for n in names]
        any_lacking = lacking[0]
        for c in lacking[1:]:
            any_lacking |= c
        return F.when(one_sided | any_lacking, INFINITE).otherwise(F.coalesce(diff, F.lit(0.0)))

    price_difference = F.greatest(*[F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) for p in PRICES]).cast("double")
    out = both.select(
        *key,
        guarded(price_difference, PRICES).alias("price_abs_difference"),
        guarded(relative_difference("a.volume", "b.volume"), ["volume"]).alias("volume_relative_difference"),
        guarded(relative_difference("a.turnover", "b.turnover"), ["turnover"]).alias("turnover_relative_difference"),
    )
    worst = F.greatest(tolerance_ratio(F.col("price_abs_difference"), price), tolerance_ratio(F.col("volume_relative_difference"), volume), tolerance_ratio(F.col("turnover_relative_difference"), turnover))
    return out.withColumn("status", F.when(worst <= 1, "PASS").when(worst <= multiplier, "WARNING").otherwise("FAIL"))
