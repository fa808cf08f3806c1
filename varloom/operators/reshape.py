"""Long to wide, wide to long, transpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.pipe import Pipe

#: Most columns a pivot or transpose may make; they are a schema, held by the driver.
MOST_COLUMNS = 20_000


def pivot(on: str, index: Sequence[str], values: Sequence[str], domain: Sequence | None = None, validate: bool = True) -> Pipe:
    """One row per index, one column per value of `on` (and per value column, if several: value_on).

    The domain is read from the data if not given. validate: a repeated (index, on) raises.
    """

    def run(df: DataFrame) -> DataFrame:
        found = list(domain) if domain is not None else sorted(r[0] for r in df.select(on).where(F.col(on).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect())
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"{on} has more than {MOST_COLUMNS} values")

        def single(v: str):
            one = F.first(v, ignorenulls=True)
            return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("repeated key in pivot")).cast(df.schema[v].dataType)).otherwise(one) if validate else one

        grouped = df.groupBy(*index).pivot(on, found)
        if len(values) == 1:
            return grouped.agg(single(values[0]))
        wide = grouped.agg(*(single(v).alias(v) for v in values))
        names = {f"{x}_{v}": f"{v}_{x}" for x in found for v in values}
        return wide.withColumnsRenamed(names)

    return run


def unpivot(index: Sequence[str], on: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> Pipe:
    """A row per (index, column); `on` None: all other columns."""
    return lambda df: df.unpivot(list(index), list(on) if on is not None else [c for c in df.columns if c not in index], variable, value)


def transpose(label: str) -> Pipe:
    """Rows become columns, named by the values of `label`; the old column names become the column "index". For small tables: the rows become a schema."""

    def run(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != label]
        long = df.select(F.col(label).cast("string").alias("_l"), *rest).unpivot(["_l"], rest, "index", "_v")
        return long.transform(pivot("_l", ["index"], ["_v"]))

    return run


def indicator_matrix(rows: str, columns: str, domain: Sequence | None = None) -> Pipe:
    """0/1 matrix of (row, column) membership: one row per distinct row value."""

    def run(df: DataFrame) -> DataFrame:
        pairs = df.select(rows, columns).distinct().withColumn("_one", F.lit(1))
        wide = pairs.transform(pivot(columns, [rows], ["_one"], domain))
        return wide.fillna(0, [c for c in wide.columns if c != rows])

    return run
