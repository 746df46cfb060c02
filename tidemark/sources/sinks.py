"""Sinks for results: atomic JSON, CSV level caches and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, nulls kept. The committer moves finished files into place, so readers see no half of one."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_level_cache(levels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The CSV cache of benchmark levels, by symbol and day."""
    levels.sortWithinPartitions("symbol", "observation_date").write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], root: str, formats: tuple[str, ...] = ("csv",)) -> None:
    """Each table of a report in each format, times and dates as ISO text, nested values as JSON."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        for kind in formats:
            (df if kind in ("json", "parquet") else flat).write.mode("overwrite").format(kind).options(header="true").save(f"{root}/{name}.{kind}")
