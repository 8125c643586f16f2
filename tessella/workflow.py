"""Single-cell style preprocessing of a count matrix (cells x genes)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators.array import Matrix
from .sources.session import Session


@dataclass(frozen=True)
class Preprocessed:
    normalized: Matrix
    cells: np.ndarray
    genes: np.ndarray
    mean: np.ndarray
    variance: np.ndarray


def normalize(counts: Matrix, min_genes: int = 1, min_cells: int = 3, target: float = 10_000.0) -> tuple[Matrix, np.ndarray, np.ndarray]:
    """Drops cells with few detected genes, genes detected in few cells, and empty cells; scales cells to `target`; log1p.

    Returns the lazy sparse result and the positions that stay. Only axis totals come to the host.
    """
    cells = np.flatnonzero((counts > 0).sum(axis=1) >= min_genes)
    kept = counts[cells, :]
    genes = np.flatnonzero((kept > 0).sum(axis=0) >= min_cells)
    kept = kept[:, genes]
    totals = kept.sum(axis=1)
    full = np.flatnonzero(totals > 0)
    if len(full) < len(totals):
        kept, cells, totals = kept[full, :], cells[full], totals[full]
    scale = kept.session.from_numpy((target / totals)[:, None]) if len(totals) else None
    return (np.log1p(kept * scale) if scale is not None else kept), cells, genes


def preprocess(counts: Matrix, **options) -> Preprocessed:
    """normalize, then each gene's mean and sample variance."""
    out, cells, genes = normalize(counts, **options)
    return Preprocessed(out, cells, genes, out.mean(axis=0), out.var(axis=0, ddof=1))


def normalize_frame(counts: Matrix, min_genes: int = 1, min_cells: int = 3, target: float = 10_000.0) -> DataFrame:
    """The rows (i, j, x) of `normalize`'s result with nothing collected: for more cells or genes than a host holds.

    Totals are aggregates, selections are joins, and what stays is numbered anew by sorted parts and their sizes.
    """
    df = counts.to_frame()
    detected = F.sum(((F.col("x") > 0) & ~F.isnan("x")).cast("long")).alias("n")
    kept = df.join(df.groupBy("i").agg(detected).filter(F.col("n") >= min_genes).select("i"), "i", "left_semi")
    genes = kept.groupBy("j").agg(detected).filter(F.col("n") >= min_cells).select("j")
    kept = kept.join(genes, "j", "left_semi")
    cells = kept.groupBy("i").agg(F.sum("x").alias("total")).filter(F.col("total") > 0)
    session = counts.session
    cells = numbered(session, cells, "i", "row").select("i", "row", "total")
    genes = numbered(session, genes, "j", "column").select("j", "column")
    scaled = kept.join(cells, "i").join(genes, "j")
    return scaled.select(F.col("row").alias("i"), F.col("column").alias("j"), F.log1p(F.col("x") * (F.lit(target) / F.col("total"))).alias("x"))


def numbered(session: Session, df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` with the rank of its distinct `key` from 0 on as `name`: sorted parts are numbered each, their sizes come to the driver."""
    df = session.stored(df.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sizes = dict(df.groupBy("part").count().collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start = F.create_map(*(F.lit(v).cast("long") for pair in before.items() for v in pair)) if before else F.lit(None)
    first = F.element_at(start, F.col("part").cast("long")) if before else F.lit(0).cast("long")
    return df.withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + first)
