"""Sorting and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varloom.operators.pipe import Pipe


def sort_rows(by: Sequence[str], descending: bool | Sequence[bool] = False) -> Pipe:
    """Sort by several keys, each in its own direction; nulls last."""
    flags = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    if len(flags) != len(by):
        raise ValueError("one direction for each key, or one for all")
    return lambda df: df.orderBy(*(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in zip(by, flags, strict=True)))


def unique_rows(by: Sequence[str], keep: str = "any", order_by: Sequence[str] | None = None) -> Pipe:
    """One row per key. keep: any, first or last (by order_by), none (keys that occur more than once go altogether).

    first/last are folded in the tasks before the shuffle (min/max of a struct), so a key
    with many rows stays cheap; ties beyond order_by are settled by the remaining columns.
    Null keys form a key of their own.
    """
    if keep not in ("any", "first", "last", "none"):
        raise ValueError(f"keep is {keep}")
    if keep != "any" and not order_by:
        raise ValueError("first, last and none need order_by")

    def run(df: DataFrame) -> DataFrame:
        if keep == "any":
            return df.dropDuplicates(list(by))
        rest = [c for c in df.columns if c not in by]
        order = [c for c in order_by if c in rest] + [c for c in rest if c not in order_by]
        if keep == "none":
            one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_r"))
            return one.where("_n = 1").select(*(F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns))
        pick = F.min if keep == "first" else F.max
        one = df.groupBy(*by).agg(pick(F.struct(*order)).alias("_r"))
        return one.select(*(F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in df.columns))

    return run


def top_rows(n: int, by: str, descending: bool = False) -> Pipe:
    """The n first rows by a column, without a full sort; nulls last."""
    return lambda df: df.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()).limit(n)


def row_number_within(by: Sequence[str], order: Sequence[str], name: str = "n") -> Pipe:
    """Number of the row within its group, from 0."""
    return lambda df: df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
