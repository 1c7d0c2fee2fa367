"""Device-memory samples: peaks, verdicts, headroom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the verdicts: times the mean, idle MB, spare GiB.
TIMES_MEAN, IDLE_MB, SPARE_GIB = 1.5, 500.0, 2.0


def samples_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """gpu_idx and used_mb of `index, MB` lines; lines that are none are left out."""
    part = F.split(F.col(column), ",")
    return lines.select(F.trim(F.get(part, F.lit(0))).try_cast("int").alias("gpu_idx"), F.trim(F.get(part, F.lit(1))).try_cast("double").alias("used_mb")).where("gpu_idx is not null and used_mb is not null")


def peaks(samples: DataFrame, key: str = "gpu_idx", value: str = "used_mb") -> DataFrame:
    """Peak of each key; partial maxima before the shuffle."""
    return samples.groupBy(key).agg(F.max(value).alias("peak"))


def mean_peak(peak: DataFrame, world: int, key: str = "gpu_idx") -> DataFrame:
    """One row: mean over the assigned keys 0 to world - 1, of which missing ones count 0."""
    return peak.where(F.col(key).between(0, world - 1)).agg((F.coalesce(F.sum("peak"), F.lit(0.0)) / world).alias("mean"))


def verdicts(peak: DataFrame, world: int, key: str = "gpu_idx") -> DataFrame:
    """peak with assigned, mean and verdict: high (assigned, over 1.5 times the mean), unexpected (not assigned, over 500 MB) or ok.

    The mean is one row, joined by broadcast."""
    rows = peak.withColumn("assigned", F.col(key).between(0, world - 1)).crossJoin(F.broadcast(mean_peak(peak, world, key)))
    high = F.col("assigned") & (F.col("mean") > 0) & (F.col("peak") > TIMES_MEAN * F.col("mean"))
    return rows.withColumn("verdict", F.when(high, F.lit("high")).when(~F.col("assigned") & (F.col("peak") > IDLE_MB), F.lit("unexpected")).otherwise(F.lit("ok")))


def any_issue(judged: DataFrame) -> DataFrame:
    return judged.agg(F.coalesce(F.bool_or(F.col("verdict") != "ok"), F.lit(False)).alias("issue"))


def headroom(spare_gib: Column) -> Column:
    """safe above 2 GiB, tight above 0, else oom."""
    return F.when(spare_gib > SPARE_GIB, F.lit("safe")).when(spare_gib > 0, F.lit("tight")).otherwise(F.lit("oom"))


def all_safe(judged: DataFrame, verdict: str = "verdict", by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Whether every workload is safe, in one row (true for none), or in one for each group, in one pass.

    groups: rows of `by` that are answered too where no workload has them."""
    if groups is not None:
        judged = judged.select(*by, verdict).unionByName(groups.select(*by, F.lit(None).cast("string").alias(verdict)))
    return judged.groupBy(*by).agg(F.coalesce(F.bool_and(F.col(verdict) == "safe"), F.lit(True)).alias("safe"))


def gib(size: Column) -> Column:
    """GiB of bytes."""
    return size / float(1 << 30)


def totals(rows: DataFrame, value: Column, chosen: Column, *by: str) -> DataFrame:
    """Sum of a value, and of it where chosen, with the share of the latter."""
    out = rows.groupBy(*by).agg(F.sum(value).alias("total"), F.sum(F.when(chosen, value)).alias("chosen"))
    return out.withColumn("chosen", F.coalesce("chosen", F.lit(0) * F.col("total"))).withColumn("share", F.try_divide("chosen", "total"))
