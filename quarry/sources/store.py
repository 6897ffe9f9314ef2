"""Derived tables that queries share: built once an application, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_built: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset, a folder in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if "://" not in at and not at.startswith("file:"):
        at = "file://" + at
    return ("file://" + at[5:]) if at.startswith("file:/") and not at.startswith("file://") else at


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, written the first time that it is asked for."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _built:
        path = work_dir(spark, name)
        out = build().write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])
