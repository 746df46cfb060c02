"""Field-level resolution of metadata from several sources: precedence, freshness and conflicts.

All entities and fields are resolved at once. Wide observations are unpivoted, reduced to each source's latest known value by
map-side-combined groupings, judged against the policy, and decided by one expression per (entity, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import freshness
from tidemark.operators.observations import METADATA_ORDER
from tidemark.session import bounded_broadcast

REQUIRE_AGREEMENT, PRECEDENCE = "REQUIRE_AGREEMENT", "PRECEDENCE_WITH_AUDIT"


def unpivot_known(rows: DataFrame, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    """``(keep, field_name, value)`` of all known values, as text. A newer unknown value never hides an older known one."""
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), c.cast("string").alias("value")) for f, c in fields.items()]))
    return rows.select(*keep, x.alias("_x")).select(*keep, "_x.field_name", "_x.value").where("value IS NOT NULL")


def latest_per_source(values: DataFrame, key: list[str]) -> DataFrame:
    """Each source's latest value of each field; ``ambiguous`` where its latest rows disagree.

    Latest is the greatest (effective from, snapshot, available, ingested), nulls least. The payload hash only chooses the
    representative among rows that agree.
    """
    group = [*key, "field_name", "source"]
    order = F.struct(*[F.coalesce(F.col(c).cast("timestamp"), F.timestamp_seconds(F.lit(-62_135_596_800))).alias(f"o{i}") for i, c in enumerate(METADATA_ORDER)])
    # One row per distinct value and source is left after the first grouping.
    by_value = values.groupBy(*group, "value").agg(F.max(F.struct(order.alias("o"), "provider_payload_hash", "snapshot_at", "available_time")).alias("r"))
    best = by_value.groupBy(*group).agg(F.max("r.o").alias("_o"), F.max_by(F.struct("value", "r"), F.col("r")).alias("b"), F.collect_list(F.col("r.o")).alias("_all"))
    ties = F.size(F.filter("_all", lambda o: o == F.col("_o")))
    return best.select(*group, F.col("b.value").alias("value"), F.col("b.r.provider_payload_hash").alias("provider_payload_hash"), F.coalesce("b.r.snapshot_at", "b.r.available_time").alias("seen_at"), (ties > 1).alias("ambiguous"))


def resolve(latest: DataFrame, policy: DataFrame, key: list[str], *, as_of: Column) -> DataFrame:
    """``(key, field_name, status, value, source, freshness, reason, candidates)`` by the policy.

    ``policy`` has (field_name, source, precedence_rank, max_age_seconds, conflict_policy) and is small; sources outside it are
    not candidates. Every field of the policy has a row for every key, UNKNOWN without a candidate. AMBIGUOUS marks a source
    whose latest rows disagree, which no winner can be drawn from.
    """
    policy = bounded_broadcast(policy)
    judged = latest.join(policy, ["field_name", "source"]).withColumn("freshness", freshness(as_of, F.col("seen_at"), F.col("max_age_seconds")))
    candidate = F.struct("precedence_rank", "source", "value", "freshness", "provider_payload_hash", "ambiguous")
    groups = judged.groupBy(*key, "field_name").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))  # at most one per source of the policy
    fields = policy.groupBy("field_name").agg(F.max("conflict_policy").alias("conflict_policy"))
    names = F.array(*[F.struct(F.lit(r.field_name).alias("field_name"), F.lit(r.conflict_policy).alias("conflict_policy")) for r in fields.orderBy("field_name").collect()])  # the policy's fields
    asked = latest.select(*key).distinct().select(*key, F.explode(names).alias("_f")).select(*key, "_f.*")
    joined = asked.join(groups, [*key, "field_name"], "left")
    fresh = F.filter("candidates", lambda c: c["freshness"] != "EXPIRED")
    agree = F.col("conflict_policy") == REQUIRE_AGREEMENT
    values = lambda cs: F.size(F.array_distinct(F.transform(cs, lambda c: c["value"])))
    d = joined.withColumn("fresh", fresh)
    nothing, stale = F.coalesce(F.size("candidates"), F.lit(0)) < 1, F.size("fresh") == 0
    status = (
        F.when(nothing, "UNKNOWN").when(F.exists("candidates", lambda c: c["ambiguous"]), "AMBIGUOUS").when(stale, "STALE")
        .when(agree & (values(F.col("fresh")) > 1), "CONFLICT").otherwise("RESOLVED")
    )
    d = d.withColumn("status", status).withColumn("_win", F.when(F.col("status") == "RESOLVED", F.get("fresh", F.lit(0))).when((F.col("status") == "STALE") & ~(agree & (values(F.col("candidates")) > 1)), F.get("candidates", F.lit(0))))
    reason = (
        F.when(F.col("status") == "UNKNOWN", "no known value from any source")
        .when(F.col("status") == "CONFLICT", "fresh sources that must agree disagree")
        .when((F.col("status") == "STALE") & F.col("_win").isNull(), "all candidates are stale and disagree")
        .when(F.col("status") == "STALE", "all candidates are stale; the first source's value is kept")
        .when(F.col("status") == "AMBIGUOUS", "a source's latest rows disagree")
        .when(F.col("_win.precedence_rank") == 1, "first source").otherwise("fallback to a later source")
    )
    noted = F.concat(reason, F.when((F.col("status") == "RESOLVED") & (values(F.col("candidates")) > 1), "; other sources disagree").otherwise(""))
    shown = F.when(F.col("status").isin("STALE"), "EXPIRED").otherwise(F.col("_win.freshness"))
    return d.select(*key, "field_name", "status", F.col("_win.value").alias("value"), F.col("_win.source").alias("source"), shown.alias("freshness"), noted.alias("reason"), "candidates")


def unknown_sources(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Sources in the rows that the policy does not order; resolution must not pass them over in silence."""
    return rows.select("source").distinct().join(bounded_broadcast(policy.select("source").distinct()), "source", "left_anti")


def as_json(resolved: DataFrame, key: list[str]) -> DataFrame:
    """One JSON text per key with all its resolved fields, nulls kept."""
    fields = F.array_sort(F.collect_list(F.struct("field_name", "status", "value", "source", "freshness", "reason")))
    return resolved.groupBy(*key).agg(F.to_json(fields, {"ignoreNullFields": "false"}).alias("fields"))
