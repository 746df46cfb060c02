"""The history of changing entity attributes, stored as checkpoints and patches.

An entity's observations are folded to one row per effective date, which states some of its attributes. Of each calendar
period the first such version is stored as a checkpoint, which also carries what was last known of all other attributes; every
other version is a patch with the attributes that it states. A version is reconstructed by folding the patches forward from
the nearest checkpoint, so no reader goes further back than one period.

The store grows by generations. An append folds new observations into the stored versions of their entities and writes only
the rows that differ from what is stored; of a version's rows the one of the latest generation holds. A stated value keeps the
order of its observation, so observations may be appended in any order. Versions of an entity are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import folders, stored

END = "effective_to"


def observed_versions(rows: DataFrame, *, entity: str, effective_from: str, latest_by: list[str], attributes: dict[str, Column], effective_to: Column) -> DataFrame:
    """``(entity, effective_from, stated)``: at each effective date the last known value ``v`` of each attribute and its order ``o``.

    Combines on the map side: an entity with a third of all rows leaves one row per effective date and task. Rows without
    entity or effective date are ignored; an attribute that is unknown in all rows of a date is null.
    """
    order = F.struct(*latest_by)
    last = lambda value, name: F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))).alias(name)
    known = rows.where(F.col(entity).isNotNull() & F.col(effective_from).isNotNull())
    names = [*attributes, END]
    found = known.groupBy(entity, F.col(effective_from).alias("effective_from")).agg(*[last(c, n) for n, c in (attributes | {END: effective_to}).items()])
    return found.select(entity, "effective_from", F.struct(*names).alias("stated"))


def store(versions: DataFrame, *, entity: str, attributes: list[str], period: str = "quarter") -> DataFrame:
    """Checkpoint-delta form ``(entity, period, effective_from, is_checkpoint, stated, carried)`` of all versions of an entity.

    ``carried`` is set on checkpoints: of every attribute that the version does not state what was last known before it.
    """
    by_time = Window.partitionBy(entity).orderBy("effective_from")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    v = versions.withColumn("period", F.trunc("effective_from", period))
    first = F.coalesce(F.lag("period").over(by_time) != F.col("period"), F.lit(True))
    v = v.select(entity, "period", "effective_from", first.alias("is_checkpoint"), "stated", *[F.last(f"stated.{a}.v", True).over(earlier).alias(f"was_{a}") for a in attributes])
    carried = F.struct(*[F.when(F.col(f"stated.{a}").isNull(), F.col(f"was_{a}")).alias(a) for a in attributes])
    return v.select(entity, "period", "effective_from", "is_checkpoint", "stated", F.when(F.col("is_checkpoint"), carried).alias("carried"))


def read_history(spark: SparkSession, root: str, entity: str) -> DataFrame | None:
    """The stored rows that hold, or None where nothing is stored."""
    parts = [p for p in folders(spark, f"{root}/generation=*") if stored(spark, p)]
    if len(parts) < 2:
        return spark.read.parquet(parts[0]) if parts else None
    rows = spark.read.option("basePath", root).parquet(*parts)
    content = [c for c in rows.columns if c not in (entity, "effective_from", "generation")]
    held = rows.groupBy(entity, "effective_from").agg(F.max_by(F.struct(*content), "generation").alias("r"))
    return held.select(entity, "effective_from", "r.*")


def append_history(spark: SparkSession, root: str, versions: DataFrame, *, entity: str, attributes: list[str], period: str = "quarter") -> None:
    """Fold ``versions`` into the store at ``root``. Appending the same versions again writes no rows. One writer is assumed."""
    held = read_history(spark, root, entity)
    number = 0
    if held is not None:
        number = 1 + max(int(p.rsplit("=", 1)[1]) for p in folders(spark, f"{root}/generation=*") if stored(spark, p))
        ours = held.join(versions.select(entity).distinct(), entity, "left_semi")
        both = ours.select(entity, "effective_from", "stated").unionByName(versions)
        merged = both.groupBy(entity, "effective_from").agg(F.struct(*[F.max(f"stated.{a}").alias(a) for a in [*attributes, END]]).alias("stated"))
        new = store(merged, entity=entity, attributes=attributes, period=period)
        content = ["period", "is_checkpoint", "stated", "carried"]
        old = ours.select(F.col(entity).alias("_e"), F.col("effective_from").alias("_f"), F.struct(*content).alias("_old"))
        versions = new.join(old, (F.col(entity) == F.col("_e")) & (F.col("effective_from") == F.col("_f")), "left").where(~F.struct(*content).eqNullSafe(F.col("_old"))).drop("_e", "_f", "_old")
    else:
        versions = store(versions, entity=entity, attributes=attributes, period=period)
    versions.write.mode("overwrite").parquet(f"{root}/generation={number}")


def reconstruct(rows: DataFrame, *, entity: str, attributes: list[str]) -> DataFrame:
    """``(entity, effective_from, effective_to, attributes)`` with every version's full attributes."""
    fold = Window.partitionBy(entity, "period").orderBy("effective_from")
    value = lambda a: F.last(F.coalesce(f"stated.{a}.v", f"carried.{a}"), True).over(fold).alias(a)
    return rows.repartition(entity).select(entity, "effective_from", F.col(f"stated.{END}.v").alias(END), *[value(a) for a in attributes])


def validity(versions: DataFrame, *, entity: str, attributes: list[str]) -> DataFrame:
    """``(entity, attributes, valid_from, valid_to)``: validity periods, the end exclusive and null if open.

    A version ends at the earlier of its ``effective_to`` and the next version's start. Versions that touch and hold equal
    attributes (null equals null) are one period. A version whose ``effective_to`` is not after its start is never in
    force and has no row, but still ends its predecessor.
    """
    by_time = Window.partitionBy(entity).orderBy("effective_from")
    ended = versions.withColumn("_end", F.least("effective_to", F.lead("effective_from").over(by_time))).where("_end IS NULL OR _end > effective_from")
    value = F.struct(*attributes)
    joins = F.lag("_end").over(by_time).eqNullSafe(F.col("effective_from")) & F.lag(value).over(by_time).eqNullSafe(value)
    runs = ended.withColumn("_first", ~joins).withColumn("_run", F.sum(F.col("_first").cast("int")).over(by_time))
    return runs.groupBy(entity, "_run").agg(
        *[F.min_by(a, "effective_from").alias(a) for a in attributes],
        F.min("effective_from").alias("valid_from"), F.max_by("_end", "effective_from").alias("valid_to"),
    ).drop("_run")
