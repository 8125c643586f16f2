"""Operator 1, quality classifier: zstandard dictionaries of good and bad text, and a calibrated size difference."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, buffers, crc32_text, documents, longs, stage, table, unstage
from .learn import Isotonic, labelled_sample

SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
BLOCKS = pa.schema([("y", pa.int32()), ("key", pa.int64()), ("block", pa.binary())])
DIFFERENCES = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("d", pa.float64())])
#: Bytes compressed at once, so that a dictionary counts as much at the end of a text as at its start.
BLOCK = 2048
#: Bytes added to a text's length, so that a few bytes of difference say little of a short text.
SHORT = 32


class CompressionModel:
    """Two dictionaries and an isotonic calibration; picklable, its compressors are made where it is used."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.good, self.bad, self.level, self.calibration = good, bad, level, Isotonic().fit(*[np.zeros(0)] * 3)

    def _sizes(self):
        out = []
        for raw in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            params = zstandard.ZstdCompressionParameters.from_level(self.level, write_content_size=False, write_dict_id=False, write_checksum=False)
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return out

    def differences(self, texts) -> np.ndarray:
        """For each UTF-8 text the difference of its compressed sizes, bad less good, over all its blocks, for each byte of it.

        Text that repeats itself compresses to little with either dictionary, so its difference is small beside its length.
        """
        good, bad = self._sizes()
        out = np.zeros(len(texts))
        for n, t in enumerate(texts):
            for k in range(0, len(t), BLOCK):
                block = t[k : k + BLOCK]
                out[n] += len(bad(block)) - len(good(block))
            out[n] /= len(t) + SHORT
        return out

    def score(self, texts) -> np.ndarray:
        return self.calibration.predict(self.differences(texts))


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for a trained one: raw content
        return b"".join(blocks)[-size:] or b" " * 16


def _views(column: pa.Array) -> list[memoryview]:
    offsets, data = buffers(column)
    view = memoryview(data)
    return [view[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int = 3000, blocks: int = 4000, size: int = 1 << 16) -> CompressionModel:
    """Fits on at most `limit` labelled texts of each label, whole: dictionaries of `size` bytes on one half of them, from at
    most `blocks` blocks a label (chosen by hash among all blocks of all these texts), and the calibration on the other half.

    Blocks come to the driver, and of the other half one number a text. Null texts are empty; labels that are null or neither
    0 nor 1 and null ids teach nothing; of a repeated id one text stands for all.
    """
    sample = stage(labelled_sample(docs, labels, label, learn, limit).repartition(F.col("doc_id")), "quality-sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))

    def cut(batches):
        for batch in batches:
            for doc_id, y, t in zip(longs(batch.column("doc_id")).tolist(), longs(batch.column("y")), _views(batch.column("text")), strict=True):
                parts = [bytes(t[k : k + BLOCK]) for k in range(0, len(t), BLOCK)]
                keys = [zlib.crc32(b"%d:%d" % (doc_id, k)) for k in range(len(parts))]
                yield batch_of(BLOCKS, np.full(len(parts), y), keys, parts)

    cutting = sample.filter(half == 0).select("doc_id", "y", "text").mapInArrow(cut, "y int, key long, block binary")
    chosen = {y: [bytes(r.block) for r in cutting.filter(F.col("y") == y).orderBy("key", "block").limit(blocks).collect()] for y in (1, 0)}
    model = CompressionModel(_dictionary(chosen[1], size), _dictionary(chosen[0], size))

    def measured(batches):
        for batch in batches:
            yield batch_of(DIFFERENCES, batch.column("doc_id"), batch.column("y"), batch.column("weight"), model.differences(_views(batch.column("text"))))

    rest = sample.filter(half == 1).select("doc_id", "y", "weight", "text").mapInArrow(measured, "doc_id long, y int, weight double, d double").collect()
    unstage(sample)
    rest.sort(key=tuple)
    y = np.array([r.y for r in rest], float)
    if len(set(y)) == 2:
        model.calibration.fit(np.array([r.d for r in rest]), y, np.array([r.weight for r in rest]))
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score) of every row's whole text; null is the empty text, repeated rows and null ids are scored like any other.

    The score is the calibrated size difference and nothing else. Without labels of both kinds every score is 0.5.
    """

    def rows(batches):
        for batch in batches:
            yield batch_of(SCORED, batch.column("doc_id"), model.score(_views(batch.column("text"))))

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = train(docs, labels, "quality", F.pmod(crc32_text(F.col("doc_id")), F.lit(3)) != 1)
    held = F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
