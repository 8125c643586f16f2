"""Matrix Market coordinate files."""

from __future__ import annotations

import contextlib
import gzip
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 2**63 - 1


@dataclass(frozen=True)
class MatrixMarketHeader:
    rows: int
    columns: int
    entries: int
    field: str
    symmetry: str
    lines: int
    """Lines up to and with the size line."""


#: Bytes that lines before the entries may have: they must lie in the first part of the file that Spark deals out.
HEADER_BYTES = 1 << 20


def _lines(path: str):
    """Lines of a plain or gzip-compressed file, as far as they are asked for; files of remote stores are read by Spark."""
    if "://" in path and not path.startswith("file://"):
        yield from (r.value for r in SparkSession.active().read.text(path).toLocalIterator())
        return
    path = path.removeprefix("file://")
    with gzip.open(path, "rt") if path.endswith(".gz") else open(path) as f:
        yield from f


def read_matrix_market_header(path: str | Path) -> MatrixMarketHeader:
    """Reads the header of a plain or gzip-compressed file, and nothing after it."""
    with contextlib.closing(_lines(str(path))) as f:
        words = next(f, "").lower().split()
        if len(words) != 5 or words[:3] != ["%%matrixmarket", "matrix", "coordinate"]:
            raise ValueError("not a Matrix Market coordinate file")
        kind, symmetry = words[3:]
        if kind not in ("real", "integer", "pattern"):
            raise ValueError(f"unsupported field {kind!r}")
        if symmetry not in ("general", "symmetric", "skew-symmetric", "hermitian"):
            raise ValueError(f"unsupported symmetry {symmetry!r}")
        if symmetry == "skew-symmetric" and kind == "pattern":
            raise ValueError("a pattern file cannot be skew-symmetric")
        lines = length = 1
        for line in f:
            lines, length = lines + 1, length + len(line.encode())
            if length > HEADER_BYTES:
                raise ValueError(f"the header has over {HEADER_BYTES} bytes")
            if not line.strip() or line.startswith("%"):
                continue
            size = line.split()
            if len(size) != 3 or not all(re.fullmatch("[0-9]+", s) for s in size):
                raise ValueError("malformed size line")
            rows, columns, entries = map(int, size)
            if max(rows, columns, entries) > MOST:
                raise ValueError("a dimension exceeds 64-bit integers")
            if symmetry != "general" and rows != columns:
                raise ValueError("a symmetric matrix is square")
            return MatrixMarketHeader(rows, columns, entries, kind, symmetry, lines)
    raise ValueError("the size line is missing")


def entries(spark: SparkSession, path: str | Path, head: MatrixMarketHeader, canonical: bool) -> DataFrame:
    """(i, j, x), zero-based and checked: counts, syntax and bounds raise; `canonical` skips mirroring and summing.

    Spark numbers lines within a partition, and the first split of the file, of HEADER_BYTES at least, is the first partition's first.
    """
    if canonical and head.symmetry != "general":
        raise ValueError("a trusted file must be general")
    lines = spark.read.text(str(path)).withColumn("n", F.monotonically_increasing_id())
    body = lines.filter((F.col("n") >= head.lines) & (F.trim("value") != "") & ~F.col("value").startswith("%"))
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    width = 2 if head.field == "pattern" else 3
    number = r"[+-]?[0-9]+" if head.field == "integer" else None
    value = F.lit(1.0) if width == 2 else F.element_at("w", 3).try_cast("double")
    if number:
        value = F.when(F.element_at("w", 3).rlike(f"^{number}$"), value)
    parsed = body.select(words.alias("w")).select(
        F.size("w").alias("width"),
        F.when(F.element_at("w", 1).rlike("^[+]?[0-9]+$"), F.element_at("w", 1).try_cast("long")).alias("r"),
        F.when(F.try_element_at("w", F.lit(2)).rlike("^[+]?[0-9]+$"), F.try_element_at("w", F.lit(2)).try_cast("long")).alias("c"),
        F.when(F.size("w") == width, value).alias("x"),
    )
    inside = F.col("r").between(1, head.rows) & F.col("c").between(1, head.columns)
    wrong = [(F.col("width") != width, "fields"), (F.col("r").isNull() | F.col("c").isNull() | F.col("x").isNull(), "a number"), (~inside, "a coordinate")]
    if head.symmetry == "skew-symmetric":
        wrong.append(((F.col("r") == F.col("c")) & (F.col("x") != 0), "the diagonal"))
    check = parsed.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(w, F.lit(False))).alias(f"w{k}") for k, (w, _) in enumerate(wrong))).first()
    for k, (_, what) in enumerate(wrong):
        if check[f"w{k}"]:
            raise ValueError(f"malformed Matrix Market file: {what} in {check[f'w{k}']} lines")
    if check["n"] != head.entries:
        raise ValueError(f"the file has {check['n']} entries; its header says {head.entries}")
    out = parsed.select((F.col("r") - 1).alias("i"), (F.col("c") - 1).alias("j"), "x")
    if canonical:
        return out
    if head.symmetry != "general":
        mirror = -F.col("x") if head.symmetry == "skew-symmetric" else F.col("x")
        both = F.array(F.struct("i", "j", "x"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), mirror.alias("x")))
        out = out.select(F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("e")).select("e.*")
    return out.groupBy("i", "j").agg(F.sum("x").alias("x")).filter("x <> 0 or isnan(x)")
