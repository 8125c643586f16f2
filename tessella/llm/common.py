"""What the operators of this subpackage share: inputs, scratch tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker; bounds its memory when every text is long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`, read by Spark only (the folder may be in any store)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # what was shuffled for it is not needed once it is written
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes tables that `stage` wrote and that no later step reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for f in t.inputFiles()[:1]:
            folder = sc._jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def crc32_text(column: Column) -> Column:
    """crc32 of the decimal text of an integer column."""
    return F.crc32(column.cast("string").cast("binary"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a text column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def groups(batches, keys: list[str]):
    """From batches sorted by `keys`: (record batch of whole groups, starts of its groups), a bounded number of rows at a time.

    One group is held at a time when it spans batches, so callers cut hot groups before.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = longs(batch.column(k))
            change[1:] |= v[1:] != v[:-1]
            if held and longs(held[-1].column(k)[-1:])[0] != v[0]:
                change[0] = True
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1])
        whole = _joined([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
        if whole is not None:
            yield whole, _starts(whole, keys)
    whole = _joined(held)
    if whole is not None:
        yield whole, _starts(whole, keys)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return None
    if len(batches) == 1:
        return batches[0]
    t = pa.Table.from_batches(batches).combine_chunks()
    return t.to_batches(max_chunksize=t.num_rows)[0]


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        v = longs(batch.column(k))
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def slices(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges (i, j) of a batch with at most `limit` bytes of text each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
