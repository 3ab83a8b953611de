"""Scratch tables of multi-step jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that setting is missing and Spark runs in this
    process, as in tests.  A cluster without the setting is an error: its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shotloom-"))
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: cuts its lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
