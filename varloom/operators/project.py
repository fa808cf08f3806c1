"""Projections and schema changes. All are narrow: no shuffle, pushed into the scan where they prune."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators.pipe import Pipe, require


def select_columns(*columns: str) -> Pipe:
    """The listed columns in that order."""

    def run(df: DataFrame) -> DataFrame:
        require(df, *columns)
        return df.select(*(F.col(f"`{c}`") for c in columns))

    return run


def drop_columns(*columns: str) -> Pipe:
    """All but the listed columns; a missing one raises KeyError."""

    def run(df: DataFrame) -> DataFrame:
        require(df, *columns)
        return df.drop(*columns)

    return run


def rename_column(old: str, new: str) -> Pipe:
    """One column under a new name; a missing one raises KeyError."""

    def run(df: DataFrame) -> DataFrame:
        require(df, old)
        return df.withColumnRenamed(old, new)

    return run


def rename_by_position(position: int, new: str) -> Pipe:
    """The column at a position under a new name."""
    return lambda df: df.toDF(*(new if i == position % len(df.columns) else c for i, c in enumerate(df.columns)))


def move_to_front(column: str) -> Pipe:
    """That column first, the others in alphabetical order."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        return df.select(column, *sorted(c for c in df.columns if c != column))

    return run


def cast_column(column: str, kind: str, new_name: str | None = None) -> Pipe:
    """Cast under the same or a new name. What does not convert raises (ANSI)."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        return df.withColumn(new_name or column, F.col(column).cast(kind))

    return run


def _cast_all(source: type, kind: str) -> Pipe:
    return lambda df: df.select(*(F.col(f"`{f.name}`").cast(kind).alias(f.name) if isinstance(f.dataType, source) else F.col(f"`{f.name}`") for f in df.schema))


def floats_to_float32() -> Pipe:
    """Every double column as float."""
    return _cast_all(T.DoubleType, "float")


def ints_to_int32() -> Pipe:
    """Every bigint column as int; overflow raises."""
    return _cast_all(T.LongType, "int")


def set_constant(column: str, value) -> Pipe:
    """Adds or replaces a column by a constant."""
    return lambda df: df.withColumn(column, F.lit(value))


def with_expressions(**columns: Column | str) -> Pipe:
    """Adds or replaces columns by Columns or SQL text; all are computed from the rows as they came in."""
    return lambda df: df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def scale_column(column: str, factor: float) -> Pipe:
    """A column times a constant, in place."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        return df.withColumn(column, F.col(column) * F.lit(factor))

    return run


def column_specifiers(wanted: dict[str, str | None]) -> Pipe:
    """Canonical name -> name in this table; unnamed and absent ones (None) are left out. Only the named columns stay."""

    def run(df: DataFrame) -> DataFrame:
        named = {k: v for k, v in wanted.items() if v is not None}
        require(df, *named.values())
        return df.select(*(F.col(f"`{v}`").alias(k) for k, v in named.items()))

    return run


def add_missing(columns: Sequence[str], kind: str = "double") -> Pipe:
    """Null columns for the names that are not there yet."""
    return lambda df: df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})
