"""Where the tables of each layer lie."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from weir.schemas import CONTRACT_NAMES

#: Environment variable that names the base folder; an argument wins over it.
BASE_VARIABLE = "WEIR_BASE_PATH"
#: The base folder where nothing names one, on a single machine only.
DEFAULT_BASE = "/tmp/weir"
LAYERS = ("bronze", "silver", "gold", "quarantine", "observability")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def base_path(given: str | None = None, spark: SparkSession | None = None) -> str:
    """The folder given, else the one in the environment, else a local one; on a cluster, whose machines
    share no local folder, one must be named."""
    named = given or os.environ.get(BASE_VARIABLE)
    if not named and spark is not None and not is_local(spark):
        raise ValueError(f"name the base folder of the tables, as argument or in {BASE_VARIABLE}")
    return (named or DEFAULT_BASE).rstrip("/")


def layer_paths(layer: str, base: str | None = None) -> dict[str, str]:
    """Table -> path for each of LAYERS; ValueError for others."""
    root = base_path(base)
    tables = {
        **{name: [t for t in CONTRACT_NAMES if t.startswith(name + "_")] for name in LAYERS[:3]},
        "quarantine": ["quarantine_bronze", "quarantine_silver", "quarantine_gold"],
        "observability": ["metrics", "rule_results"],
    }
    if layer not in tables:
        raise ValueError(f"no such layer: {layer}")
    return {t: f"{root}/{t}" for t in tables[layer]}
