"""Composable table transforms: a pipe is a function DataFrame -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pipe = Callable[[DataFrame], DataFrame]


def identity(df: DataFrame) -> DataFrame:
    """The default of every optional pipe."""
    return df


def composite(pipes: Sequence[Pipe]) -> Pipe:
    """Applies pipes from left to right; one lazy plan."""
    return lambda df: functools.reduce(lambda d, p: d.transform(p), pipes, df)


def require(df: DataFrame, *columns: str) -> None:
    """Raises KeyError for missing columns, as Spark passes some of them over in silence."""
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def observed(name: str, *metrics) -> Pipe:
    """Counts rows (and other metrics) of what flows by, without a pass of its own."""
    return lambda df: df.observe(name, F.count(F.lit(1)).alias("rows"), *metrics)
