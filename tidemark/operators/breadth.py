"""Correlation structure of return series ``(asset, day, ret)``: pairs, common windows, rolling values, effective breadth.

Effective breadth is the participation ratio of the correlation matrix, (sum of eigenvalues)^2 / (sum of their squares). The
eigenvalues sum to N and their squares to the squared entries, so it is N^2 / sum of rho^2, and no eigen-solver is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import redundancy_band, structural
from tidemark.session import bounded_broadcast, cut_lineage

BLOCK = 64  # assets of a block
MOST_IN_MATRIX = 2_000  # assets of a matrix on the driver: 32 MB


def ordered(returns: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Adds ``ord``: the asset's place in a registry ``(asset, ord)``, by name without one."""
    if order is None:
        order = returns.select("asset").distinct().withColumn("ord", F.row_number().over(Window.orderBy("asset")))  # one row per asset
    return returns.join(order.select("asset", "ord"), "asset")


def pairs(returns: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``(asset_1, asset_2, day, a, b)``: the days that both assets of each unordered pair have, pairs in registry order."""
    r = ordered(returns, order).where("ret IS NOT NULL")
    left = r.select("day", F.col("asset").alias("asset_1"), F.col("ord").alias("o1"), F.col("ret").alias("a"))
    right = r.select("day", F.col("asset").alias("asset_2"), F.col("ord").alias("o2"), F.col("ret").alias("b"))
    return left.join(right, "day").where("o1 < o2").select("asset_1", "asset_2", "day", "a", "b")


def asked_pairs(returns: DataFrame, asked: DataFrame) -> DataFrame:
    """``pairs`` of the asked ``(asset_1, asset_2)`` alone, each once whichever way round it is asked: no other pair is ever formed."""
    low, high = F.least("asset_1", "asset_2"), F.greatest("asset_1", "asset_2")
    wanted = bounded_broadcast(asked.where("asset_1 <> asset_2").select(low.alias("asset_1"), high.alias("asset_2")).distinct())
    r = returns.where("ret IS NOT NULL")
    left = r.select(F.col("asset").alias("asset_1"), "day", F.col("ret").alias("a")).join(wanted, "asset_1")
    return left.join(r.select(F.col("asset").alias("asset_2"), "day", F.col("ret").alias("b")), ["asset_2", "day"]).select("asset_1", "asset_2", "day", "a", "b")


def pair_correlations(returns: DataFrame, frequency: str, order: DataFrame | None = None) -> DataFrame:
    """``(asset_1, asset_2, frequency, start_date, end_date, n_obs, rho, band)`` of all pairs with a common day, in registry order.

    Pairs of fewer than two days, and pairs with a constant side, have no rho. No pair of values is ever a row: the assets are cut
    into blocks of ``BLOCK``, the returns of two blocks meet in one task (at most twice ``BLOCK`` values a day), and their moments
    over the common days are matrix products. A return goes to as many tasks as there are blocks.
    """
    r = ordered(returns, order).where("ret IS NOT NULL AND day IS NOT NULL").select("asset", "ord", "day", "ret", F.expr(f"ord div {BLOCK}").alias("_own"))
    blocks = r.select("_own").distinct().agg(F.sort_array(F.collect_set("_own")).alias("_blocks"))  # one row
    met = r.join(F.broadcast(blocks)).withColumn("_other", F.explode("_blocks")).withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
    shape = "asset_1 string, asset_2 string, start_date date, end_date date, n_obs long, rho double"
    out = met.select("asset", "ord", "day", "ret", "_own", "_low", "_high").groupBy("_low", "_high").applyInPandas(_block_correlations, shape)
    return out.withColumn("frequency", F.lit(frequency)).withColumn("band", redundancy_band("rho")).select("asset_1", "asset_2", "start_date", "end_date", "n_obs", "rho", "frequency", "band")


def _block_correlations(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of two blocks of assets, or of one block with itself."""
    days, day = np.unique(group["day"].to_numpy(), return_inverse=True)
    sides = []
    for block in (group["_low"].iloc[0], group["_high"].iloc[0]):
        own = (group["_own"] == block).to_numpy()
        names = group.loc[own, ["ord", "asset"]].drop_duplicates().sort_values("ord")
        place = np.searchsorted(names["ord"].to_numpy(), group.loc[own, "ord"].to_numpy())
        x = np.full((len(days), len(names)), np.nan)
        x[day[own], place] = group.loc[own, "ret"].to_numpy()
        has = ~np.isnan(x)
        x = np.where(has, x - np.nanmean(x, axis=0), 0.0)  # moments about the mean lose no digits
        sides.append((names, x, has))
    (left, x, in_x), (right, y, in_y) = sides
    n = in_x.T.astype(float) @ in_y
    every = np.maximum(n, 1)
    a, b, ab = x.T @ in_y / every, in_x.T @ y / every, x.T @ y / every
    aa, bb = (x * x).T @ in_y / every, in_x.T @ (y * y) / every
    spread_a, spread_b = (np.where(v - m * m > 1e-13 * v, v - m * m, np.nan) for v, m in ((aa, a), (bb, b)))
    rho = np.where(n >= 2, (ab - a * b) / np.sqrt(spread_a * spread_b), np.nan)
    i, j = np.nonzero((n > 0) & (left["ord"].to_numpy()[:, None] < right["ord"].to_numpy()))
    first, last = np.zeros(n.shape, dtype=int), np.zeros(n.shape, dtype=int)
    for k in range(len(left)):
        common = in_x[:, k, None] & in_y
        first[k], last[k] = common.argmax(axis=0), len(days) - 1 - common[::-1].argmax(axis=0)
    value = pd.Series(rho[i, j], dtype=object)
    return pd.DataFrame({
        "asset_1": left["asset"].to_numpy()[i], "asset_2": right["asset"].to_numpy()[j], "start_date": days[first[i, j]], "end_date": days[last[i, j]],
        "n_obs": n[i, j].astype(int), "rho": value.where(value.notna(), None),
    })


def common_window(returns: DataFrame, n_assets: int) -> DataFrame:
    """The returns of the days on which all ``n_assets`` assets have one; without a join."""
    n = F.count("ret").over(Window.partitionBy("day"))
    return returns.where("ret IS NOT NULL").withColumn("_n", n).where(F.col("_n") == n_assets).drop("_n")


def effective_breadth(returns: DataFrame, n_assets: int) -> DataFrame:
    """One row ``(n_assets, n_obs, effective_n, ratio)`` over the common window.

    Null where a pair has no correlation, as with a constant series: a missing term must not pass for zero.
    """
    common = common_window(returns, n_assets)
    rho = pair_correlations(common, "common").agg(F.count("rho").alias("n_pairs"), F.sum(F.col("rho") * F.col("rho")).alias("squares"), F.max("n_obs").alias("n_obs"))
    n = F.lit(float(n_assets))
    whole = F.col("n_pairs") == n_assets * (n_assets - 1) // 2
    value = F.when(whole, n * n / (n + 2 * F.coalesce("squares", F.lit(0.0))))
    return rho.select(F.lit(n_assets).cast("long").alias("n_assets"), F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"), value.alias("effective_n"), (value / n).alias("ratio"))


def correlation_matrix(pair_rows: DataFrame, assets: list[str]) -> np.ndarray:
    """The matrix on the driver, for at most ``MOST_IN_MATRIX`` assets; missing pairs are NaN."""
    if len(assets) > MOST_IN_MATRIX:
        raise ValueError(f"{len(assets)} assets are too many for a matrix on the driver")
    place, m = {a: i for i, a in enumerate(assets)}, np.full((len(assets), len(assets)), np.nan)
    np.fill_diagonal(m, 1.0)
    for r in pair_rows.select("asset_1", "asset_2", "rho").where(F.col("asset_1").isin(assets) & F.col("asset_2").isin(assets)).collect():
        i, j = place[r.asset_1], place[r.asset_2]
        m[i, j] = m[j, i] = np.nan if r.rho is None else r.rho
    return m


def spectrum(matrix: np.ndarray) -> list[tuple[int, float, float]]:
    """``(rank, eigenvalue, share)`` in descending order; rounding noise below 1e-12 is zero."""
    if not np.allclose(matrix, matrix.T, atol=1e-10):
        raise ValueError("the matrix must be symmetric and complete")
    values = np.linalg.eigvalsh(matrix)[::-1]
    values = np.where(np.abs(values) < 1e-12, 0.0, values)
    return [(i + 1, float(v), float(v / values.sum())) for i, v in enumerate(values)]


_MOMENTS = {"a": ("a",), "b": ("b",), "ab": ("a", "b"), "aa": ("a", "a"), "bb": ("b", "b")}


def rolling_correlations(pair_rows: DataFrame, window: int) -> DataFrame:
    """``(asset_1, asset_2, day, rho)`` over the last ``window`` rows of each pair of ``pairs`` or ``asked_pairs``; full windows only.

    The cost of a row does not grow with the window: rows are cut into blocks of ``window``, and a window's moments are the
    running sum of its block so far plus the running sum, from the other end, of the rest of the block before. Nothing is
    subtracted, so long series lose no digits. A side that is constant in the window has no correlation.
    """
    pair = ["asset_1", "asset_2"]
    by_day = Window.partitionBy(*pair).orderBy("day")
    rows = pair_rows.withColumn("_i", F.row_number().over(by_day) - 1).withColumn("_block", F.expr(f"_i div {window}"))
    rows = rows.select(*pair, "day", "_i", "_block", *[(F.col(m[0]) * F.col(m[1]) if len(m) > 1 else F.col(m[0])).alias(f"m_{n}") for n, m in _MOMENTS.items()])
    ahead = Window.partitionBy(*pair, "_block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*pair, "_block").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(f"m_{n}").over(back).alias(f"s_{n}") for n in _MOMENTS])
    rows = rows.select(*pair, "day", "_i", *[F.sum(f"m_{n}").over(ahead).alias(f"p_{n}") for n in _MOMENTS], *[f"s_{n}" for n in _MOMENTS])
    whole = F.col("_i") % window == window - 1
    total = [F.when(whole, F.col(f"p_{n}")).otherwise(F.col(f"p_{n}") + F.lag(f"s_{n}", window - 1).over(by_day)).alias(n) for n in _MOMENTS]
    t = rows.select(*pair, "day", "_i", *total).where(F.col("_i") >= window - 1)
    w = F.lit(float(window))
    spread = lambda n: w * F.col(n + n) - F.col(n) * F.col(n)
    moves = lambda n: F.when(spread(n) > w * F.col(n + n) * 1e-13, spread(n))
    rho = F.try_divide(w * F.col("ab") - F.col("a") * F.col("b"), F.sqrt(moves("a")) * F.sqrt(moves("b")))
    return t.select(*pair, "day", F.when(~F.isnan(rho), rho).alias("rho"))


def rolling_statistics(returns: DataFrame, asked: DataFrame, windows: list[int]) -> DataFrame:
    """Distribution of rolling correlations of the asked pairs ``(asset_1, asset_2)``, in either orientation.

    Status is UNAVAILABLE if an asset has no returns, SKIPPED_SHORT_HISTORY without a full window, else OK.
    """
    have = returns.select("asset").distinct()
    known = asked.join(have.select(F.col("asset").alias("asset_1"), F.lit(True).alias("h1")), "asset_1", "left").join(have.select(F.col("asset").alias("asset_2"), F.lit(True).alias("h2")), "asset_2", "left")
    every = known.crossJoin(asked.sparkSession.createDataFrame([(w,) for w in windows], "window int"))  # a literal list of windows
    parts, rows = None, cut_lineage(asked_pairs(returns, asked))  # once for all windows
    for w in windows:
        r = rolling_correlations(rows, w).where("rho IS NOT NULL")
        s = r.groupBy(F.least("asset_1", "asset_2").alias("low"), F.greatest("asset_1", "asset_2").alias("high")).agg(
            F.count("*").alias("n_windows"), F.min("day").alias("first_window_end"), F.max("day").alias("last_window_end"), F.median("rho").alias("median"),
            F.percentile("rho", F.lit(0.1)).alias("p10"), F.percentile("rho", F.lit(0.9)).alias("p90"), F.min("rho").alias("min"), F.max("rho").alias("max"), F.max_by("rho", "day").alias("latest"),
        ).withColumn("window", F.lit(w))
        parts = s if parts is None else parts.unionByName(s)
    joined = every.withColumn("low", F.least("asset_1", "asset_2")).withColumn("high", F.greatest("asset_1", "asset_2")).join(parts, ["low", "high", "window"], "left")
    status = F.when(F.col("h1").isNull() | F.col("h2").isNull(), "UNAVAILABLE").when(F.col("n_windows").isNull(), "SKIPPED_SHORT_HISTORY").otherwise("OK")
    return joined.withColumn("status", status).drop("low", "high", "h1", "h2")


def rolling_breadth(returns: DataFrame, n_assets: int, window: int) -> DataFrame:
    """``(day, effective_n)`` over the last ``window`` rows of the common window: one pass over the pairs."""
    r = rolling_correlations(pairs(common_window(returns, n_assets)), window)
    n = float(n_assets)
    whole = F.count("rho") == n_assets * (n_assets - 1) // 2
    return r.groupBy("day").agg(F.when(whole, F.lit(n * n) / (F.lit(n) + 2 * F.sum(F.col("rho") * F.col("rho")))).alias("effective_n"))


def redundancy(pair_rows: DataFrame, rolling: DataFrame, window: int) -> DataFrame:
    """Pairs with their rolling median: ``structural`` if both are high, ``distinct_high`` if only the full-sample value is."""
    low, high = F.least("asset_1", "asset_2"), F.greatest("asset_1", "asset_2")
    medians = rolling.where((F.col("window") == window) & (F.col("status") == "OK")).select(low.alias("low"), high.alias("high"), "median")
    both = pair_rows.withColumn("low", low).withColumn("high", high).join(medians, ["low", "high"], "left").drop("low", "high")
    both = both.withColumn("structural", structural("rho", "median"))
    return both.withColumn("distinct_high", ~F.col("structural") & F.coalesce(F.col("rho") >= 0.75, F.lit(False)))


def focus_pairs(fixed: list[tuple[str, str]], hub: str, assets: list[str]) -> list[tuple[str, str]]:
    """The fixed pairs and the hub with every other asset, in list order and without repetition in either orientation."""
    out, seen = [], set()
    for pair in [*fixed, *((hub, a) for a in assets if a != hub)]:
        if frozenset(pair) not in seen:
            seen.add(frozenset(pair))
            out.append(pair)
    return out
