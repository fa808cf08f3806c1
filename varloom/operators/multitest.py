"""Multiple-testing correction on tables of any size, without a one-task sort.

P-values are counted first, so that ties, however many, are one row. The distinct values are
range-sorted; ranks are summed within a partition and shifted by the sums of
the partitions before, and the step-up minimum runs within a partition, bounded by the
smallest value of the partitions behind. Only one row per partition meets in one task; the
corrected values are joined back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators.pipe import Pipe
from varloom.session import cut

METHODS = ("bonferroni", "fdr_bh", "fdr_by")
EULER = 0.5772156649015329


def harmonic(n: int) -> float:
    """Sum of 1/i up to n."""
    return math.fsum(1 / i for i in range(1, n + 1)) if n < 10_000 else math.log(n) + EULER + 1 / (2 * n) - 1 / (12 * n * n)


def corrected_p(p: str, method: str = "fdr_bh", name: str = "p_corrected", nan_as_one: bool = False) -> Pipe:
    """Adds corrected p-values, clipped to 1. Null (and NaN) p-values stay null and do not count, or NaN counts as 1 if nan_as_one."""
    if method not in METHODS:
        raise ValueError(f"method is {method}")

    def run(df: DataFrame) -> DataFrame:
        value = F.when(F.isnan(p), F.lit(1.0) if nan_as_one else F.lit(None)).otherwise(F.col(p).cast("double"))
        d = df.withColumn("_p", value)
        if method == "bonferroni":
            n = d.where("_p is not null").count()
            return d.withColumn(name, F.least(F.col("_p") * n, F.lit(1.0))).drop("_p")
        counts = d.where("_p is not null").groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        known = cut(counts.repartitionByRange(F.col("_p")).withColumn("_part", F.spark_partition_id()))
        sizes = known.groupBy("_part").agg(F.sum("_n").alias("_m"))
        total = sum(r["_m"] for r in sizes.collect())  # one row per partition
        c = harmonic(total) if method == "fdr_by" else 1.0
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o")))  # one row per partition
        w = Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # tied values have the largest rank of theirs
        ranked = known.join(offsets, "_part").withColumn("_rank", F.sum("_n").over(w) + F.col("_o"))
        raw = ranked.withColumn("_raw", F.col("_p") * total * c / F.col("_rank"))
        tails = raw.groupBy("_part").agg(F.min("_raw").alias("_min"))
        after = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        bound = F.broadcast(tails.select("_part", F.coalesce(F.min("_min").over(after), F.lit(float("inf"))).alias("_bound")))
        back = Window.partitionBy("_part").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        steps = raw.withColumn("_step", F.min("_raw").over(back)).join(bound, "_part")
        steps = steps.select("_p", F.least(F.col("_step"), F.col("_bound"), F.lit(1.0)).alias("_c"))
        done = d.where("_p is not null").join(steps, "_p").withColumn(name, F.col("_c"))
        rest = d.where("_p is null").withColumn(name, F.lit(None).cast("double"))
        keep = [*df.columns, name]
        return done.select(*keep).unionByName(rest.select(*keep))

    return run


def reject_column(p: str, alpha: float = 0.05, method: str = "bonferroni", name: str = "reject_null") -> Pipe:
    """Adds whether the corrected p-value is at most alpha."""

    def run(df: DataFrame) -> DataFrame:
        return df.transform(corrected_p(p, method, "_c")).withColumn(name, F.coalesce(F.col("_c") <= alpha, F.lit(False))).drop("_c")

    return run


def corrected_table(p: str, alpha: float = 0.05, method: str = "fdr_bh", apply_filter: bool = True, name: str = "p_corrected", order: Sequence[str] = ()) -> Pipe:
    """Corrected p-values, the rows that pass (or a mark), sorted by p."""

    def run(df: DataFrame) -> DataFrame:
        d = df.transform(corrected_p(p, method, name))
        passed = F.coalesce(F.col(name) <= alpha, F.lit(False))
        d = d.where(passed) if apply_filter else d.withColumn("reject_null", passed)
        return d.orderBy(F.col(p).asc_nulls_last(), *order)

    return run
