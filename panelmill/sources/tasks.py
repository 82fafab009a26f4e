"""Task configuration: which datasets, terms, horizons and split lengths exist.

The YAML is small and read on the driver; the task table is a DataFrame of one
row per (dataset, term).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

TERMS = ("short", "medium", "long")
TASK_SCHEMA = ("dataset_id string, dataset string, freq string, term string, prediction_length bigint, "
               "test_length bigint, val_length bigint")


def load_config(text: str) -> dict[str, Any]:
    """Datasets of a YAML text: nested mappings with integer or plain text values."""
    try:
        import yaml
    except ImportError:
        return _plain_mapping(text).get("datasets", {}) or {}
    return (yaml.safe_load(text) or {}).get("datasets", {}) or {}


def _plain_mapping(text: str) -> dict[str, Any]:
    """Indented `key: value` lines, which is all a task file uses."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if value:
            stack[-1][1][key] = int(value) if value.lstrip("-").isdigit() else value.strip("'\"")
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def split_dataset_id(dataset_id: str) -> tuple[str, str]:
    parts = dataset_id.split("/")
    if len(parts) != 2:
        raise ValueError(f"dataset id {dataset_id!r} is not of the form name/freq")
    return parts[0], parts[1]


def available_terms(config: dict[str, Any], dataset_id: str) -> list[str]:
    """Terms of a dataset that have a horizon."""
    entry = config.get(dataset_id) or {}
    return [t for t in TERMS if (entry.get(t) or {}).get("prediction_length") is not None]


def find_dataset(config: dict[str, Any], name: str) -> tuple[str, dict[str, Any]]:
    """By full id, else the first entry with this bare name."""
    if name in config:
        return name, config[name]
    for dataset_id, entry in config.items():
        if split_dataset_id(dataset_id)[0] == name:
            return dataset_id, entry
    raise ValueError(f"dataset {name!r} is not configured")


def task_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """One row per dataset and term with a horizon."""
    rows = []
    for dataset_id, entry in config.items():
        dataset, freq = split_dataset_id(dataset_id)
        for term in available_terms(config, dataset_id):
            rows.append((dataset_id, dataset, freq, term, entry[term]["prediction_length"],
                         entry.get("test_length"), entry.get("val_length")))
    return spark.createDataFrame(rows, TASK_SCHEMA)
