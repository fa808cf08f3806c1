"""Row filters. Predicates are plain Columns, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators.pipe import Pipe, require
from varloom.session import broadcast_if_small

#: Values up to which a list is a predicate; longer lists are joined.
LIST_LIMIT = 1000


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def by_values(column: str, values: Sequence) -> Pipe:
    """Rows whose value is in the list; nulls are not."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        if len(values) <= LIST_LIMIT:
            return df.where(F.col(column).isin(list(values)))
        wanted = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], T.StructType([T.StructField(column, df.schema[column].dataType)]))
        return df.join(broadcast_if_small(wanted, len(values)), column, "left_semi")

    return run


def at_least(column: str, least: float) -> Pipe:
    """column >= least; null and NaN do not pass."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        c = F.col(column)
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            return df.where((c >= least) & ~F.isnan(c))
        return df.where(c >= least)

    return run


def info_score(least: float, column: str = "INFO") -> Pipe:
    """Imputation quality of at least `least`."""
    return at_least(column, least)


def any_at_least(least: float, exclude: Sequence[str] = ()) -> Pipe:
    """Rows where any column outside `exclude` is at least `least`."""

    def run(df: DataFrame) -> DataFrame:
        tests = [F.coalesce((F.col(c).cast("double") >= least) & ~F.isnan(F.col(c).cast("double")), F.lit(False)) for c in df.columns if c not in exclude]
        return df.where(reduce(or_, tests)) if tests else df.where(F.lit(False))

    return run


def drop_nulls(*subset: str) -> Pipe:
    """Rows without null in the subset, or in any column; NaN is no null."""
    return lambda df: df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in subset or df.columns]))


def drop_nan(*columns: str) -> Pipe:
    """Rows with neither NaN nor null in the columns."""
    return lambda df: df.where(reduce(lambda a, b: a & b, [present(F.col(c)) for c in columns]))


def head(n: int) -> Pipe:
    """Any n rows; after a sort, the first n."""
    return lambda df: df.limit(n)


@dataclass(frozen=True)
class Interval:
    """start..end on one chromosome; `closed` says whether end belongs to it."""

    chrom: int
    start: int
    end: int
    closed: bool = False

    def holds(self, chrom: Column, pos: Column) -> Column:
        upper = pos <= self.end if self.closed else pos < self.end
        return (chrom == self.chrom) & (pos >= self.start) & upper


#: The extended MHC region by genome build.
MHC = {"19": Interval(6, 25_000_000, 34_000_000), "38": Interval(6, 25_726_063, 33_400_644)}


def exclude_interval(interval: Interval, chrom: str = "CHR", pos: str = "POS") -> Pipe:
    """Rows outside the interval; rows with unknown place are left out."""
    return lambda df: df.where(~interval.holds(F.col(chrom), F.col(pos)))


def exclude_mhc(build: str | None, chrom: str = "CHR", pos: str = "POS", closed: bool = False) -> Pipe:
    """Rows outside the extended MHC; build None leaves the table as it is."""
    if build is None:
        return lambda df: df
    region = MHC[build]
    return exclude_interval(Interval(region.chrom, region.start, region.end, closed), chrom, pos)


def within(interval: Interval, chrom: str = "CHR", pos: str = "POS") -> Pipe:
    """Rows inside the interval."""
    return lambda df: df.where(interval.holds(F.col(chrom), F.col(pos)))


def frequency_filter(column: str, least: float, validate: bool = True) -> Pipe:
    """min(f, 1 - f) >= least; null and NaN do not pass. validate: a frequency outside 0..1 raises when the plan runs; without it the filter reaches the scan."""

    def run(df: DataFrame) -> DataFrame:
        f = F.col(column)
        ok = (F.least(f, 1 - f) >= least) & ~F.isnan(f)
        if validate:
            outside = ~F.isnan(f) & ((f < 0) | (f > 1))
            ok = F.when(outside, F.raise_error(F.lit(f"{column} is not within 0..1")).cast("boolean")).otherwise(ok)
        return df.where(ok)

    return run


def drop_degenerate_z(z: str = "Z", beta: str = "BETA", se: str = "SE") -> Pipe:
    """Rows with a finite Z, or, in a table without Z, with finite BETA and SE and SE > 0."""

    def finite(c: Column) -> Column:
        return present(c) & (F.abs(c) < float("inf"))

    def run(df: DataFrame) -> DataFrame:
        if z in df.columns:
            return df.where(finite(F.col(z)))
        return df.where(finite(F.col(beta)) & finite(F.col(se)) & (F.col(se) > 0))

    return run


def status_digits(column: str = "STATUS", drop: dict[int, str] | None = None) -> Pipe:
    """Drops rows whose status code has one of the given digits at a place (1-based); by default 8 at the 6th and 7 or 8 at the 7th. A null code does not pass."""
    drop = drop or {6: "8", 7: "78"}

    def run(df: DataFrame) -> DataFrame:
        bad = [F.instr(F.lit(digits), F.substring(F.col(column).cast("string"), place, 1)) > 0 for place, digits in drop.items()]
        return df.where(~reduce(or_, bad))

    return run


def snvs_only(ea: str = "EA", nea: str = "NEA") -> Pipe:
    """Single-base alleles only."""
    return lambda df: df.where((F.length(ea) == 1) & (F.length(nea) == 1))
