"""The engine's composite operations: incremental fetch, ingestion, metadata snapshots and the diagnostic of a universe."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normalize import correlation_distance, normalize_bars
from tidemark.operators import breadth, cluster, rawcache, returns, revlog
from tidemark.session import cut_lineage
from tidemark.sources import frames
from tidemark.sources.connectors import BarProvider, fetch_bars

UNADJUSTED = "none"


def incremental_bars(provider: BarProvider, cached: DataFrame, expected: DataFrame, *, delay_seconds: int = 900, **retry: Any) -> DataFrame:
    """Fetch the runs of expected days ``(symbol, trade_date)`` that the cache has not finalized; the cache with what came back."""
    missing = rawcache.missing_ranges(expected, rawcache.day_states(cached, delay_seconds=delay_seconds))
    return rawcache.upsert(rawcache.record_keys(cached), fetch_bars(expected.sparkSession, provider, missing, **retry))


def ingest_daily_bars(raw: DataFrame, log_root: str, *, adjust: str = UNADJUSTED, version: str = "v1", delay_seconds: int = 900) -> dict[str, int]:
    """Finalized raw bars to the revision log. Only unadjusted ones: adjusted prices change whenever the factor does."""
    if adjust != UNADJUSTED:
        raise ValueError("only unadjusted bars are canonical")
    final = rawcache.finalized_records(raw, delay_seconds=delay_seconds)
    bars = cut_lineage(normalize_bars(final, version=version, delay_seconds=delay_seconds))
    revlog.require_finalized(bars)
    return revlog.append_bars(bars, log_root)


def snapshot_metadata(existing: DataFrame | None, spot: DataFrame, scale: DataFrame, snapshot_at: Column) -> DataFrame:
    """The observations of a spot and a scale frame that are not stored yet."""
    return frames.snapshot(existing, frames.spot_observations(spot, snapshot_at), frames.scale_observations(scale, snapshot_at))


def diagnostic(levels: DataFrame, registry: DataFrame, *, focus: list[tuple[str, str]], windows: list[int], without: tuple[str, ...] = ("CASH",)) -> dict[str, DataFrame]:
    """All tables of a universe diagnostic from levels ``(asset, day, level)`` and a registry ``(asset, ord)``.

    Assets in ``without`` are covered but take no part in correlations. The registry is a short list of assets; matrices of its
    size are handled on the driver.
    """
    spark: SparkSession = levels.sparkSession
    risky = levels.where(~F.col("asset").isin(*without))
    daily, weekly = cut_lineage(returns.daily_returns(risky)), cut_lineage(returns.weekly_returns(risky))
    assets = [r.asset for r in registry.where(~F.col("asset").isin(*without)).join(daily.select("asset").distinct(), "asset", "left_semi").orderBy("ord").collect()]
    if len(assets) < 2:
        raise ValueError("at least two assets with returns are needed")
    out = {"coverage": returns.coverage(registry, levels), "data_quality": returns.level_warnings(levels)}
    out["pairwise_correlations"] = breadth.pair_correlations(daily, "daily", registry).unionByName(breadth.pair_correlations(weekly, "weekly", registry))
    asked = spark.createDataFrame(focus, "asset_1 string, asset_2 string")
    out["rolling_pair_correlations"] = breadth.rolling_statistics(daily, asked, windows)
    out["redundancy"] = breadth.redundancy(breadth.pair_correlations(daily, "daily", registry), out["rolling_pair_correlations"], windows[-1])
    out["rolling_effective_breadth"] = breadth.rolling_breadth(daily, len(assets), windows[-1])
    for name, r in (("daily", daily), ("weekly", weekly)):
        out[f"effective_breadth_{name}"] = breadth.effective_breadth(r, len(assets))
        pairs = breadth.pair_correlations(breadth.common_window(r, len(assets)), name, registry)
        matrix = breadth.correlation_matrix(pairs, assets)
        out[f"common_window_correlation_{name}"] = pairs.withColumn("distance", correlation_distance("rho"))
        whole = breadth.spectrum(matrix) if not (matrix != matrix).any() else []
        out[f"eigenvalues_{name}"] = spark.createDataFrame(whole, "rank int, eigenvalue double, share double")
        if name == "daily":
            merges = cluster.average_linkage(cluster.distances(matrix)) if whole else []
            rows = [(a, b, d, n, "|".join(m)) for (a, b, d, n), m in zip(merges, cluster.members(merges, assets))]
            out["cluster_linkage"] = spark.createDataFrame(rows, "left_id int, right_id int, distance double, size int, members string")
    return out
