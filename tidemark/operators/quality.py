"""Contracts of registry tables as queries that return violations; an empty result means that the contract holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_rules(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule whose condition of violation is true for a row; null counts as not violated."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def references(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """``(value, n_matches)`` of references that do not match exactly one row of the target."""
    found = target.groupBy(F.col(target_column).alias("value")).agg(F.count("*").alias("n_matches"))
    asked = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return asked.join(found, "value", "left").select("value", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches")).where("n_matches <> 1")


def overlaps(df: DataFrame, key: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Rows whose period begins before the end of any earlier one of the key; ends are exclusive, a null end is open."""
    before = Window.partitionBy(*key).orderBy(start, *ties).rowsBetween(Window.unboundedPreceding, -1)
    far = F.to_date(F.lit("9999-12-31"))
    reach = F.max(F.coalesce(F.col(end), far)).over(before)
    return df.where(F.col(start).isNotNull()).withColumn("_reach", reach).where(F.col("_reach") > F.col(start)).drop("_reach")


def layered(*layers: Column) -> Column:
    """The value of the first layer that has one, for defaults of root, group and item."""
    return F.coalesce(*layers)


def coverage_counts(df: DataFrame, group: str, label: str, flags: dict[str, Column], wanted: str) -> DataFrame:
    """Per group the number of rows, of each flag, the sorted labels joined by ``;`` and a status.

    The status is COVERED if any row has the flag ``wanted``, PARTIAL if there are other rows.
    """
    counts = [F.count_if(c).alias(n) for n, c in flags.items()]
    out = df.groupBy(group).agg(F.count("*").alias("n_rows"), *counts, F.array_join(F.array_sort(F.collect_set(label)), ";").alias("labels"))
    return out.withColumn("status", F.when(F.col(wanted) > 0, "COVERED").otherwise("PARTIAL"))


def any_violation(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def web_address(c: str) -> Column:
    """Whether a text is an HTTP(S) address with a host; null is not."""
    return F.coalesce(F.col(c).rlike(r"^https?://[^/\s?#]+"), F.lit(False))


def foreign_members(c: str, allowed: list[str]) -> Column:
    """The members of an array that are not allowed."""
    return F.array_except(c, F.array(*[F.lit(a) for a in allowed]))


def repeated_members(c: str) -> Column:
    """Whether an array has a member twice."""
    return F.size(F.array_distinct(c)) < F.size(c)
