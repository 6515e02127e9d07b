"""Configuration as TOML, and what the driver says of its tables. Nothing here touches executors."""

from __future__ import annotations

import shutil
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def merged(base: dict, over: dict) -> dict:
    """Both, tables merged at any depth; values of `over` win."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, defaults: dict) -> tuple[dict, str]:
    """SRC-23: (configuration, error): the defaults with the file's values; a missing or broken file gives the defaults and
    says why."""
    try:
        with open(path, "rb") as f:
            return merged(defaults, tomllib.load(f)), ""
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return dict(defaults), f"{type(e).__name__}: {e}"


def _value(v: Any) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_value, v)) + "]"
    shown = "".join(c if c >= " " and c not in '"\\' and c != "\x7f" else f"\\u{ord(c):04x}" if c not in '"\\' else "\\" + c for c in str(v))
    return f'"{shown}"'


def _key(k: str) -> str:
    return k if k and all(c.isascii() and (c.isalnum() or c in "-_") for c in k) else _value(k)


def to_toml(conf: dict, prefix: tuple[str, ...] = ()) -> str:
    """SRC-24: TOML text that loads to the same configuration; null values are left out."""
    plain = [f"{_key(k)} = {_value(v)}" for k, v in conf.items() if v is not None and not isinstance(v, dict)]
    head = [f"[{'.'.join(map(_key, prefix))}]"] if prefix and (plain or not conf) else []
    blocks = ["\n".join(head + plain)] if head or plain else []
    blocks += [to_toml(v, (*prefix, k)) for k, v in conf.items() if isinstance(v, dict)]
    return "\n\n".join(b.strip("\n") for b in blocks if b) + ("" if prefix else "\n")


#: The engine's tables by schema version; a later version only adds columns, which older files read as null.
SCHEMAS = {
    1: {
        "tasks": "task_id string, kind string, target string, goal string, scope string, idempotency_key string, parent_id string, discovery_path string, policy_json string, resources_json string, budget_json string, state string, attempts long, throttles long, transitions long, bytes_done long, seconds_done double, leased_at double, lease_expires double, worker_id string, created_at double, updated_at double",
        "task_evidence": "id long, task_id string, at double, stage string, signal string, decision string, reason string, facts_json string",
        "raw_artifacts": "sha256 string, url string, size long, mime string, status int, headers_json string, fetched_at double, source string, session_id string, parent_task string, discovery_path string, path string, note string",
        "pages": "url_hash string, url string, fetched_at double, status int, content_hash string, simhash long, duplicate_of string, size long, source_sha256 string",
        "extracted": "url_hash string, data_json string, parser string, version int, extracted_at double",
        "cooldowns": "domain string, until_epoch double, tier int, throttle_count int",
        "deadletter": "at double, label string, error string, statements_json string, replayed int",
    },
    2: {"pages": "batch_no int"},
}


def schema(name: str, version: int = max(SCHEMAS)) -> str:
    """SRC-12: a table's columns as of a version."""
    parts = [SCHEMAS[v][name] for v in sorted(SCHEMAS) if v <= version and name in SCHEMAS[v]]
    if not parts:
        raise KeyError(name)
    return ", ".join(parts)


def open_table(spark: SparkSession, path: str, name: str, version: int = max(SCHEMAS)):
    """SRC-12: files of any earlier version, read with the columns of `version`."""
    return spark.read.schema(schema(name, version)).parquet(path)


def available(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """SRC-11, SUP-09: the engine's tables and whether the folder has them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {s.getPath().getName().split(".")[0] for s in fs.listStatus(path)} if fs.exists(path) else set()
    return [(n, n in there) for n in SCHEMAS[1]]


def health(spark: SparkSession, folder: str, least_free: float = 0.1) -> dict[str, list[str]]:
    """SUP-29, SUP-30: problems (missing tables) and warnings (a local folder's disk nearly full)."""
    problems = [f"no table {n}" for n, ok in available(spark, folder) if not ok]
    warnings = []
    local = folder.removeprefix("file://")
    if Path(local).exists():
        use = shutil.disk_usage(local)
        if use.free < least_free * use.total:
            warnings.append("disk nearly full")
    return {"problems": problems, "warnings": warnings}
