"""Written intermediates: cut lineage in iterative plans so that lost executors cost one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one only where unset)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="meshwright-graph-"))
            atexit.register(lambda: shutil.rmtree(_own[0], ignore_errors=True))
        base = f"file://{_own[0]}"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
