"""Registries from YAML: read on the driver, checked there, and given to Spark as small tables."""

from __future__ import annotations

import hashlib
import logging
import re
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Keys that must not stand in a configuration file, and what logs must not show.
SECRET_KEYS = ("app_key", "app_secret", "access_token", "token", "password", "secret")
_SECRET_TEXT = re.compile(r"(?i)((?:" + "|".join(SECRET_KEYS) + r")\s*[=:]\s*)[^\s,;&]+")


class ContractError(ValueError):
    """A registry that breaks its contract."""


def load(path: str | Path, sha256: str | None = None) -> dict[str, Any]:
    """The mapping of a YAML file; with ``sha256`` the file must have that hash; secrets in it are an error."""
    import yaml

    raw = Path(path).read_bytes()
    if sha256 is not None and hashlib.sha256(raw).hexdigest() != sha256:
        raise ContractError(f"{path} is not the pinned version")
    content = yaml.safe_load(raw) or {}
    if not isinstance(content, dict):
        raise ContractError(f"{path} is not a mapping")
    if found := forbidden_keys(content, SECRET_KEYS):
        raise ContractError(f"{path} holds secrets: {found}")
    return content


def forbidden_keys(value: Any, names: tuple[str, ...], at: str = "") -> list[str]:
    """The paths of keys, at any depth, that are in ``names``."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in ([f"{at}{k}"] if str(k).lower() in names else []) + forbidden_keys(v, names, f"{at}{k}.")]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in forbidden_keys(v, names, f"{at}{i}.")]
    return []


def require(content: dict[str, Any], keys: list[str]) -> dict[str, Any]:
    if lacking := sorted(set(keys) - content.keys()):
        raise ContractError(f"missing keys {lacking}")
    return content


def merged(*layers: dict[str, Any] | None) -> dict[str, Any]:
    """Later layers override earlier ones, with an explicit null too; nested mappings are merged."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def find_one(rows: list[dict[str, Any]], **equal: Any) -> dict[str, Any]:
    found = [r for r in rows if all(r.get(k) == v for k, v in equal.items())]
    if len(found) != 1:
        raise ContractError(f"{len(found)} rows match {equal}; one is needed")
    return found[0]


def resolution_policy(spark: SparkSession, content: dict[str, Any]) -> DataFrame:
    """``(field_name, source, precedence_rank, max_age_seconds, conflict_policy)``; every field must order every known source."""
    known, rows = set(content["known_sources"]), []
    for field, p in content["fields"].items():
        order = p["source_precedence"]
        if set(order) != known or len(order) != len(known):
            raise ContractError(f"{field} must order every known source once")
        age = p.get("max_age_seconds")
        if age is not None and age < 0:
            raise ContractError(f"{field} has a negative age")
        rows += [(field, s, i, age, p["conflict_policy"]) for i, s in enumerate(order, 1)]
    return spark.createDataFrame(rows, "field_name string, source string, precedence_rank int, max_age_seconds long, conflict_policy string")


def reconciliation_settings(content: dict[str, Any]) -> dict[str, float]:
    require(content, ["symbols", "price_abs_tolerance", "volume_relative_tolerance", "turnover_relative_tolerance", "warning_multiplier"])
    out = {"price": float(content["price_abs_tolerance"]), "volume": float(content["volume_relative_tolerance"]), "turnover": float(content["turnover_relative_tolerance"]), "multiplier": float(content["warning_multiplier"])}
    if not content["symbols"] or min(out.values()) < 0 or out["multiplier"] < 1:
        raise ContractError("symbols, tolerances of 0 or more and a multiplier of 1 or more are needed")
    return out


INDEX_SHAPE = "index_code string, base_date date, launch_date date, methodology_version string, is_total_return boolean, source string, availability_class string, effective_from date, effective_to date, available_time timestamp, ingest_time timestamp, snapshot_at timestamp, source_note string"


def index_registry(spark: SparkSession, content: dict[str, Any]) -> DataFrame:
    """Descriptions of indices; the instant at which one was known is its available, ingest and snapshot time. UNKNOWN is null."""
    rows = content.get("indexes", [])
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ContractError("indexes must be a list of mappings")
    known = lambda v: None if v in (None, "", "UNKNOWN") else v
    day = lambda v: None if known(v) is None else date.fromisoformat(str(v))
    out = []
    for i, r in enumerate(rows):
        if lacking := [k for k in ("index_code", "source", "source_note", "known_at") if not r.get(k)]:
            raise ContractError(f"indexes[{i}] lacks {lacking}")
        at = datetime.fromisoformat(str(r["known_at"]))
        if at.tzinfo is None:
            raise ContractError(f"indexes[{i}].known_at must have a time zone")
        version = known(r.get("methodology_version"))
        out.append((
            str(r["index_code"]), day(r.get("base_date")), day(r.get("launch_date")), None if version is None else str(version), r.get("is_total_return"), str(r["source"]),
            str(r.get("availability_class", "snapshot_only")), day(r.get("effective_from")), day(r.get("effective_to")), at, at, at, str(r["source_note"]),
        ))
    return spark.createDataFrame(out, INDEX_SHAPE)


class Redaction(logging.Filter):
    """Keeps credentials out of log records."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = _SECRET_TEXT.sub(r"\1***", record.getMessage()), ()
        return True
