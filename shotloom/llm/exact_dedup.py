"""Exact deduplication as a stateful stream.

A stream of digests (one slim row per document) updates a keyed state that lives in RocksDB on disk and never
expires.  Per digest it retains the stable identifier of the document that stays, the content locator (file and row)
of that document and the number of copies.  The stream advances by micro-batches of a few waves of tasks, each of which
looks its digests up in the state that the earlier ones left; with a lasting ``state_path`` a later call looks up what
earlier calls left.  Rows of one digest are combined before they are shuffled, so a digest that a third of all
documents share costs one row per task.  Every digest hit is then checked on the full bytes: only texts whose digest
was hit are read again, and copies are combined before they are shuffled; should two different texts ever share a digest, they are regrouped by their bytes.

Defined results: a null text counts as empty; of equal texts the largest doc_id stays (a null doc_id is the smallest;
rows that repeat a doc_id and text, or tie as nulls: the one at the greatest locator); a text of any length is hashed
and compared whole; an empty table gives an empty table; columns other than the id and the text are not read, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, join_hot, located, materialize, settings, shared_dir, utf8, whole_rows, with_row_key

KEY = ["digest", "n_bytes"]
WAVES = 2  # of tasks whose files make a micro-batch, where no number of files is given
MASK_BITS = 24  # places of the table of hit digests that every task gets (2 MB): beyond as many hits it lets all texts pass


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_row_key(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """(doc_id, locator, digest, n_bytes) of each document's text with A-Z lower-cased."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            norm = [utf8(t).lower() for t in b.pop("text")]
            yield b.assign(digest=[digest(x) for x in norm], n_bytes=[len(x) for x in norm])

    return _normal(located(docs), id_col, text_col).mapInPandas(run, f"doc_id long, {ROW[0]} string, {ROW[1]} long, digest string, n_bytes long")


def stream_state(slim: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the slim tables below ``path``/slim that the state has not seen through it; return each digest's last state.

    Updates are appended per micro-batch (a replayed batch overwrites itself); both values only grow, so the
    last state of a digest is the maximum of its updates."""
    spark = slim.sparkSession
    files = files_per_batch or WAVES * spark.sparkContext.defaultParallelism
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="200",
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",  # no megabytes set aside per partition
    ):
        state = (
            spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/slim/*")
            .groupBy(*KEY)
            .agg(F.max(F.struct("doc_id", *ROW)).alias("keep"), F.count("*").alias("group_size"))
        )
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/updates/batch={k}"))
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    try:
        updates = spark.read.schema(state.schema).option("basePath", f"{path}/updates").parquet(f"{path}/updates/*")
    except Exception:  # an empty source runs no micro-batch
        if slim.limit(1).count():
            raise
        updates = spark.createDataFrame([], state.schema)
    return updates.groupBy(*KEY).agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def _place(digest: str) -> int:
    return int(hashlib.md5(digest.encode()).hexdigest()[:8], 16) >> (32 - MASK_BITS)


def _mask(hits: DataFrame) -> np.ndarray:
    """2^MASK_BITS bits: those at the places of the hit digests are set."""
    place = F.shiftright(F.conv(F.substring(F.md5("digest"), 1, 8), 16, 10).cast("long"), 32 - MASK_BITS)
    parts = hits.select(place.alias("p")).distinct().groupBy(F.shiftright("p", 12).alias("page")).agg(F.collect_list(F.col("p").bitwiseAND(4095)).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = []
            for at in b["at"]:
                one = np.zeros(4096, np.uint8)
                one[np.asarray(at, np.int64)] = 1
                bits.append(np.packbits(one).tobytes())
            yield pd.DataFrame({"page": b["page"], "bits": bits})

    out = np.zeros((1 << (MASK_BITS - 12), 512), np.uint8)
    for r in parts.mapInPandas(run, "page long, bits binary").toLocalIterator():  # 4096 pages of 512 bytes at most
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _texts(docs: DataFrame, mask: np.ndarray, id_col: str, text_col: str, digest: Callable[[bytes], str]) -> DataFrame:
    """As digests(), for texts whose digest may have been hit, with the normalised bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)  # 2 MB, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for b in batches:
            norm = [utf8(t).lower() for t in b.pop("text")]
            key = [digest(x) for x in norm]
            place = np.array([_place(k) for k in key], np.int64)
            out = b.assign(digest=key, n_bytes=[len(x) for x in norm], norm=norm)
            yield out[(bits[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)]

    return _normal(located(docs), id_col, text_col).mapInPandas(run, f"doc_id long, {ROW[0]} string, {ROW[1]} long, digest string, n_bytes long, norm binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], str] = sha256_hex, files_per_batch: int | None = None, state_path: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per document of ``docs``: doc_id, locator, digest, keep_id, group_size, kept.

    With a ``state_path`` in the shared folder the state outlives the call: documents that a later call brings hit those
    of the earlier ones, which it names as ``earlier`` so that their bytes can be compared.  Each load is given once."""
    spark = docs.sparkSession
    docs = located(docs)
    path = state_path or shared_dir(spark)
    slim = materialize(digests(docs, id_col, text_col, digest), f"{path}/slim/load-{uuid.uuid4().hex}")
    state = materialize(stream_state(slim, path, files_per_batch))

    hit = state.where("group_size > 1").select(*KEY)
    mask = _mask(hit)
    hits = _texts(docs, mask, id_col, text_col, digest)
    if earlier is not None:
        hits = hits.unionAll(_texts(earlier, mask, id_col, text_col, digest))
    ends = hits.groupBy(*KEY).agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))  # copies are combined before the shuffle
    clash = materialize(ends.where(F.col("lo") != F.col("hi")).select(*KEY))

    plain = join_hot(slim, state, KEY, "group_size", slim.count())
    if clash.take(1):  # different texts under one digest: group these by their bytes
        rows = materialize(hits.join(clash, KEY, "left_semi"))
        exact = rows.groupBy(*KEY, "norm").agg(F.max(F.struct("doc_id", *ROW)).alias("keep"), F.count("*").alias("group_size"))
        mine = rows.join(slim.select(*ROW), list(ROW), "left_semi") if earlier is not None else rows
        plain = plain.join(clash, KEY, "left_anti").unionByName(mine.join(exact, [*KEY, "norm"]).select(plain.columns))
    here = F.struct("doc_id", *ROW)
    return plain.select("doc_id", *ROW, "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", here.eqNullSafe(F.col("keep")).alias("kept"))


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all its columns stay, whatever their names.

    The rows that go are fewer than those that stay, so it is these that are joined."""
    docs = located(docs)
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(*ROW)
    return whole_rows(docs).join(gone, list(ROW), "left_anti").select("whole.*")
