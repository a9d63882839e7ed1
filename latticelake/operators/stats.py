"""Statistics of atoms per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def atom_stats(index: DataFrame, n: str = "n_atoms") -> DataFrame:
    """One row: frames, total, least, most, mean, median and population deviation; all but the counts null when empty."""
    return index.agg(
        F.count("*").alias("n_frames"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_atoms"), F.min(n).alias("min_atoms"), F.max(n).alias("max_atoms"),
        F.avg(n).alias("mean_atoms"), F.median(n).alias("median_atoms"), F.stddev_pop(n).alias("std_atoms"),
    )


def volume(lattice):
    """|det| of a flat 3x3 array column; NaN where it is null or not of nine values."""
    m = [F.element_at(lattice, k) for k in range(1, 10)]
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    return F.when(F.size(lattice) == 9, F.abs(det.cast("double"))).otherwise(F.lit(float("nan")))


def density_weight(n, v):
    """n squared over the volume where that is finite and positive, else n."""
    return F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), n.cast("double") * n / v).otherwise(n.cast("double"))
