"""The best representative of each group of duplicate records, field by field.

Records are unpivoted to long rows, one per field. Every row votes for its normalised value with its source's trust times the
decay of its recency; the votes of a value are summed, the winner is the value with the most votes (``max_by``), and the
winners are pivoted back to one record.

Trust and decay are either given as numbers (``trust_votes``), or set by the places of a strict order (``placed_votes``): trust
and decay then fall so steeply that all lesser votes together never reach a greater one. Groupings combine on the map side
and places are limited before the shuffle, so that a group with a third of all rows sends few rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clean import known_text, number, six_digits

PLACES = 512  # 0.25 to the power of 511 is the least normal number
VOTE_UNIT = 1_000_000  # votes are whole millionths, so that their sums do not depend on the order of rows


def unpivot(records: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Long rows ``(ids, field_name, value)``, the values as text."""
    rows = records.select(*ids, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("_x"))
    return rows.select(*ids, "_x.field_name", "_x.value")


def normalised(value: Column | str, field: Column | str = "field_name") -> Column:
    """One text for all notations of a value; null where unknown.

    Indices are their six digits, numbers their shortest decimal form, other texts are compared without case, repeated
    blanks and the abbreviation of "management".
    """
    text, field = known_text(value), F.col(field) if isinstance(field, str) else field
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", " "), r"\bmgmt\b", "management")
    shortest = F.regexp_replace(F.regexp_replace(number(value).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(field == "tracking_index", F.coalesce(six_digits(text), plain)).otherwise(F.coalesce(shortest, plain))


def trust_votes(trust: Column, age_seconds: Column, half_life_seconds: Column) -> Column:
    """Trust times recency decay in millionths: half the weight for every half-life; no decay without a half-life."""
    decay = F.coalesce(F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)) / half_life_seconds), F.lit(1.0))
    return F.round(trust * decay * VOTE_UNIT).cast("long")


def placed_votes(ballots: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ``_vote``: a quarter of the vote of the next greater ``order`` in the group, 1 for the greatest.

    A vote exceeds the sum of all lesser ones threefold, so sums keep the strict order, in floating point too. Places beyond
    ``PLACES`` have votes below the least number, that is 0, and are left out.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return ballots.withColumn("_place", place).where(F.col("_place") <= PLACES).withColumn("_vote", F.pow(F.lit(0.25), F.col("_place") - 1)).drop("_place")


def survivors(rows: DataFrame, *, group: list[str], candidate: str, value: Column, order: Column, keep: list[str], vote: Column | None = None) -> DataFrame:
    """``(group, keep)``: for each group of at least two different candidates the surviving one.

    A row counts if its (normalised) ``value`` is known and its ``vote`` is not null, or, where no vote is given, its
    ``order``, whose places then set the votes. Votes of a value are summed over its different candidates; ties between
    values, and the choice among the rows of the winning value, go by ``order``. Rows with a null in a group column are
    ignored; a repeated row counts once; a group without a row that counts has no result.
    """
    known = rows.dropna(subset=[*group, candidate]).select(*group, F.col(candidate).alias("_id"), (vote if vote is not None else F.lit(0)).alias("_vote"), value.alias("_value"), order.alias("_order"), F.struct(*keep).alias("_keep"))
    several = known.groupBy(*group).agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low <> _high").select(*group)
    counts = F.col("_value").isNotNull() & F.col("_vote").isNotNull() & F.col("_order").isNotNull()
    ballots = known.where(counts).groupBy(*group, "_id", "_value").agg(F.max("_vote").alias("_vote"), F.max(F.struct("_order", "_keep")).alias("_best"))
    if vote is None:
        ballots = placed_votes(ballots, group, "_best")
    tally = ballots.groupBy(*group, "_value").agg(F.sum("_vote").alias("_votes"), F.max("_best").alias("_best"))
    won = tally.groupBy(*group).agg(F.max_by("_best", F.struct("_votes", "_best", "_value")).alias("_best"))
    return won.join(several, group, "left_semi").select(*group, "_best._keep.*")


def pivot_back(winners: DataFrame, ids: list[str], fields: list[str], value: str = "value") -> DataFrame:
    """One record per group from the winning long rows."""
    return winners.groupBy(*ids).agg(*[F.max(F.when(F.col("field_name") == f, F.col(value))).alias(f) for f in fields])
