"""What the corpus operators share: shared-folder tables, row keys, text helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}

ROW = ("__llm_file", "__llm_row")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that setting is missing and Spark runs in this
    process, as in tests.  A cluster without the setting is an error: its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _fallback.setdefault(app, tempfile.mkdtemp(prefix="shotloom-"))
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(df: DataFrame) -> DataFrame:
    """``df`` if its rows have a place in a file, or else a written copy of it, whose rows have one.

    A place in a file stays the same when a lost executor's work is done again; a number that the plan gives does not."""
    try:
        df.select(df.metadataColumn("_metadata")["file_path"])
    except AnalysisException:
        return materialize(df)
    return df


def with_row_key(df: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of a located frame, and the content locator of each row: its file and its place there."""
    place = df.metadataColumn("_metadata")
    return df.select(*(c.alias(n) for n, c in columns.items()), place["file_path"].alias(ROW[0]), place["row_index"].alias(ROW[1]))


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row of a located frame as one struct, ``whole``, beside its locator: no column can clash with another."""
    return with_row_key(df, whole=F.struct(*(F.col(f"`{c}`") for c in df.columns)))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of written tables where a key of ``right`` (a row each) meets ``size`` rows of ``left``.

    Keys with a thousandth of all rows or more (10,000 at least, so a thousand keys at most) are broadcast, so their rows
    stay where they are; the other rows are shuffled by key, none of which is large."""
    edge = max(10_000, total // 1000)
    hot, cool = right.where(F.col(size) > edge), right.where(F.col(size) <= edge)
    near = left.join(F.broadcast(hot), keys)  # a thousand rows at most
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(cool, keys))


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (dots written as __) for the actions inside."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: the package's own folder, or SHOTLOOM_TOKENIZERS."""
    root = os.environ.get("SHOTLOOM_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
