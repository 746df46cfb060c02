"""The bitemporal revision log of daily bars: append, migrate, and point-in-time reads in two modes.

``economic`` asks what had become available by an instant, whenever it was stored; ``system_replay`` asks what this system
held then. The log is Parquet in ``year``/``month`` folders; reads prune folders by the asked dates, appends rewrite only the
months they touch. A single writer is assumed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime
from functools import reduce

import pandas as pd
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import with_bar_ids
from tidemark.session import cut_lineage, folders

ECONOMIC, SYSTEM_REPLAY = "economic", "system_replay"
SCHEMA_VERSION = 3

_UTC = T.TimestampType()
BAR_FIELDS = [
    ("symbol", T.StringType()), ("trade_date", T.DateType()), *[(n, T.DecimalType(28, 8)) for n in ("open", "high", "low", "close")],
    ("volume", T.LongType()), ("turnover", T.DecimalType(38, 4)), ("data_time", _UTC), ("available_time", _UTC), ("ingest_time", _UTC),
    ("source", T.StringType()), ("availability_policy_id", T.StringType()), ("historical_data_semantics", T.StringType()),
]
BAR_SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in BAR_FIELDS])
LOG_SCHEMA = T.StructType([T.StructField("revision_schema_version", T.ShortType(), False), T.StructField("observation_id", T.StringType(), False), T.StructField("value_hash", T.StringType(), False), *BAR_SCHEMA.fields])
CLUSTER_BY = ["symbol", "source", "trade_date", "ingest_time", "availability_policy_id", "value_hash"]
KEY = ["symbol", "trade_date", "source"]


class SchemaError(ValueError):
    """A log whose files are of more than one schema version, or of none that is known."""


class ConflictError(ValueError):
    """Rows that claim one identity and disagree in content."""


# --- schema versions ---

def schema_version(columns: list[str]) -> int:
    """The version of a file by its columns: 3 current, 2 with ids but without value hash, 1 without ids."""
    have = set(columns) - {"year", "month"}
    if have >= {f.name for f in LOG_SCHEMA.fields}:
        return 3
    plain = {n for n, _ in BAR_FIELDS} - {"availability_policy_id", "historical_data_semantics"}
    if have >= plain | {"observation_id", "payload_hash"}:
        return 2
    if have >= plain:
        return 1
    raise SchemaError(f"unknown columns {sorted(have)}")


def month_folders(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> list[str]:
    """The ``year=/month=`` folders of a log, of the months ``12 * year + month`` asked for; none where there is no log yet."""
    found = folders(spark, f"{root}/year=*/month=*")
    number = lambda f: 12 * int(f.split("year=")[1].split("/")[0]) + int(f.rsplit("month=", 1)[1])
    return [f for f in found if (first is None or number(f) >= first) and (last is None or number(f) <= last)]


def schema_versions(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> dict[str, list[int]]:
    """The versions of the files of every month folder, from the footers of all files, read by the executors.

    A folder of 0 versions is empty; one of several is mixed. Columns that are no known version raise.
    """
    files = [p for f in month_folders(spark, root, first, last) for p in folders(spark, f"{f}/*.parquet")]
    if not files:
        return {}

    def footers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part.path:
                system, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                rows.append((path, ",".join(pq.read_schema(at, filesystem=system).names)))
            yield pd.DataFrame(rows, columns=["path", "names"])

    slices = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    read = spark.createDataFrame([(f,) for f in files], "path string").repartition(slices).mapInPandas(footers, "path string, names string")
    seen = read.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "names").distinct().collect()  # a few kinds a month
    found: dict[str, set[int]] = {}
    for row in seen:
        found.setdefault(row.folder, set()).add(schema_version(row.names.split(",")))
    return {f: sorted(v) for f, v in sorted(found.items())}


def require_current(spark: SparkSession, root: str, first: int | None = None, last: int | None = None) -> None:
    old = {f: v for f, v in schema_versions(spark, root, first, last).items() if v != [SCHEMA_VERSION]}
    if old:
        raise SchemaError(f"migrate first: {old}")


# --- reads ---

def read_log(spark: SparkSession, root: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """The log, months outside ``start`` to ``end`` pruned; empty where there is none."""
    if not month_folders(spark, root):
        return spark.createDataFrame([], LOG_SCHEMA)
    require_current(spark, root, start and start.year * 12 + start.month, end and end.year * 12 + end.month)
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in LOG_SCHEMA.fields], T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
    log, month = spark.read.schema(schema).parquet(root), F.col("year") * 12 + F.col("month")
    if start:
        log = log.where(F.col("year") >= start.year).where(month >= start.year * 12 + start.month)
    if end:
        log = log.where(F.col("year") <= end.year).where(month <= end.year * 12 + end.month)
    return log.drop("year", "month")


def latest_revisions(revisions: DataFrame, *, as_of: Column, mode: str, key: list[str] = KEY, extra_order: list[str] = ()) -> DataFrame:
    """Of each key the newest revision known at ``as_of`` (a literal, or a column for an instant per row).

    Newest is the greatest (ingest time, policy id, value hash); rows with a null time are not known at any instant. The rank
    is limited before the shuffle, so a hot key sends one row per task.
    """
    if mode not in (ECONOMIC, SYSTEM_REPLAY):
        raise ValueError(f"mode must be {ECONOMIC} or {SYSTEM_REPLAY}")
    known = F.col("available_time") <= as_of
    if mode == SYSTEM_REPLAY:
        known &= F.col("ingest_time") <= as_of
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in ("ingest_time", "availability_policy_id", "value_hash", *extra_order)])
    return revisions.where(known).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def bars_as_of(log: DataFrame, symbol: str, start: date, end: date, *, source: str, as_of: datetime, mode: str) -> DataFrame:
    """The bars of one symbol and source between two dates as known at an instant, by trade date."""
    if as_of.tzinfo is None:
        raise ValueError("as_of must have a time zone")
    if end < start:
        raise ValueError("end precedes start")
    asked = log.where((F.col("symbol") == symbol) & (F.col("source") == source) & F.col("trade_date").between(start, end))
    return latest_revisions(asked, as_of=F.lit(as_of), mode=mode).select(*[n for n, _ in BAR_FIELDS]).orderBy("trade_date")


def revision_history(log: DataFrame, symbol: str, day: date, source: str) -> DataFrame:
    return log.where((F.col("symbol") == symbol) & (F.col("trade_date") == day) & (F.col("source") == source)).orderBy("ingest_time", "availability_policy_id", "value_hash")


# --- validation ---

def violations() -> dict[str, Column]:
    """The invariants of a bar, each as the condition of its violation. An unknown value violates its own rule only."""
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return {
        "missing_value": reduce(lambda a, b: a | b, [F.col(n).isNull() for n, _ in BAR_FIELDS]),
        "empty_identifier": F.coalesce((F.trim("symbol") == "") | (F.trim("source") == "") | (F.trim("availability_policy_id") == ""), F.lit(False)),
        "nonpositive_price": F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(False)),
        "low_above_body": F.coalesce(F.col("low") > low, F.lit(False)),
        "high_below_body": F.coalesce(F.col("high") < high, F.lit(False)),
        "high_below_low": F.coalesce(F.col("high") < F.col("low"), F.lit(False)),
        "negative_volume": F.coalesce((F.col("volume") < 0) | (F.col("turnover") < 0), F.lit(False)),
        "available_before_data": F.coalesce(F.col("available_time") < F.col("data_time"), F.lit(False)),
    }


def with_violations(bars: DataFrame) -> DataFrame:
    """The bars with ``violated``, the names of the invariants that each breaks."""
    marks = F.array(*[F.when(c, n) for n, c in violations().items()])
    return bars.withColumn("violated", F.filter(marks, lambda m: m.isNotNull()))


def require_valid(bars: DataFrame) -> None:
    bad = with_violations(bars).where("size(violated) > 0").select("symbol", "trade_date", "violated").limit(3).collect()
    if bad:
        raise ValueError(f"invalid bars: {bad}")


def require_finalized(bars: DataFrame) -> None:
    """Bars stored before they became available are provisional; a batch with any is refused."""
    if not bars.where("ingest_time < available_time").limit(1).isEmpty():
        raise ValueError("provisional bars: ingested before available")


# --- writes ---

def merge_revisions(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Union keyed by observation id, existing rows first; one id with two semantics is a conflict and raises."""
    names = [f.name for f in LOG_SCHEMA.fields]
    rows = incoming.select(*names, F.lit(1).alias("_new"))
    if existing is not None:
        rows = existing.select(*names, F.lit(0).alias("_new")).unionByName(rows)
    merged = rows.groupBy("observation_id").agg(F.min(F.struct("_new", *[n for n in names if n != "observation_id"])).alias("r"), F.min("historical_data_semantics").alias("_a"), F.max("historical_data_semantics").alias("_b"))
    same = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("semantics conflict for "), F.col("observation_id"))).cast(merged.schema["r"].dataType))
    return merged.select("observation_id", same.alias("r")).select(*[("observation_id" if n == "observation_id" else f"r.{n}") for n in names], "r._new")


def _write_months(rows: DataFrame, root: str) -> None:
    dated = rows.select(*[f.name for f in LOG_SCHEMA.fields], F.year("trade_date").alias("year"), F.month("trade_date").alias("month"))
    # AQE's rebalance splits a large month over several files and puts small ones together.
    dated.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", *CLUSTER_BY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(root)


def append_bars(bars: DataFrame, root: str) -> dict[str, int]:
    """Append bars once: ``submitted`` counts the input, ``inserted`` the revisions that were new.

    Appending the same bars again changes nothing. Only the touched months are read and rewritten; the merged rows are
    written to the shared checkpoint folder first, as a job must not overwrite what it still reads.
    """
    spark = bars.sparkSession
    require_valid(bars)
    incoming = cut_lineage(with_bar_ids(bars).withColumn("revision_schema_version", F.lit(SCHEMA_VERSION).cast("short")))
    submitted = incoming.count()
    if not submitted:
        return {"submitted": 0, "inserted": 0}
    existing = None
    if month_folders(spark, root):
        months = incoming.select(F.year("trade_date").alias("_y"), F.month("trade_date").alias("_m")).distinct()  # bounded by the calendar
        first, last = incoming.agg(F.min("trade_date"), F.max("trade_date")).first()
        log = read_log(spark, root, first, last)
        existing = log.join(F.broadcast(months), (F.year("trade_date") == F.col("_y")) & (F.month("trade_date") == F.col("_m")), "left_semi")
    merged = cut_lineage(merge_revisions(existing, incoming))
    inserted = merged.where("_new = 1").count()
    if inserted:
        _write_months(merged, root)
    return {"submitted": submitted, "inserted": inserted}


def migrated(rows: DataFrame) -> DataFrame:
    """Rows of an older version in the current schema: the availability policy is inferred from the delay, hashes are taken anew."""
    delay = F.greatest(F.lit(0), F.unix_seconds("available_time") - F.unix_seconds("data_time"))
    bars = rows.withColumn("availability_policy_id", F.concat(F.lit("legacy_inferred_daily_bar_"), delay.cast("string"), F.lit("s"))).withColumn("historical_data_semantics", F.lit("historical_latest"))
    typed = bars.select(*[F.col(n).cast(t).alias(n) for n, t in BAR_FIELDS])
    return with_bar_ids(typed).withColumn("revision_schema_version", F.lit(SCHEMA_VERSION).cast("short")).select(*[f.name for f in LOG_SCHEMA.fields])


def migrate(spark: SparkSession, root: str) -> int:
    """Rewrite every month that has files of an older version; the number of rows that were rewritten."""
    old = {f: v for f, v in schema_versions(spark, root).items() if v != [SCHEMA_VERSION]}
    if not old:
        return 0
    files = [(p, f) for f in old for p in folders(spark, f"{f}/*.parquet")]
    parts = []
    for f, versions in old.items():
        for p in [p for p, own in files if own == f] if len(versions) > 1 else [f]:
            rows = spark.read.parquet(p)
            current = schema_version(rows.columns) == SCHEMA_VERSION
            parts.append(rows.select(*[c.name for c in LOG_SCHEMA.fields]) if current else migrated(rows))
    rows = cut_lineage(merge_revisions(None, reduce(DataFrame.unionByName, parts)))
    _write_months(rows, root)
    return rows.count()
