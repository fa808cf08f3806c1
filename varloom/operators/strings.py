"""Strings, arrays and number formats."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.pipe import Pipe, require


def lowercase(column: str, new_name: str) -> Pipe:
    return lambda df: df.withColumn(new_name, F.lower(column))


def replace_pattern(column: str, new_name: str, pattern: str, by: str) -> Pipe:
    r"""Every match of a regular expression; `by` is taken literally but for \1-style groups."""
    java = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
    return lambda df: df.withColumn(new_name, F.regexp_replace(column, pattern, java))


def replace_first(column: str, new_name: str, pattern: str, by: str) -> Pipe:
    """The first match only."""
    return lambda df: df.withColumn(new_name, F.regexp_replace(column, f"(?s)^(.*?){pattern}", "$1" + by.replace("$", r"\$")))


def extract_pattern(column: str, new_name: str, pattern: str, kind: str = "string") -> Pipe:
    """First group of the first match as a type; no match gives null."""
    found = F.regexp_extract(column, pattern, 1)
    return lambda df: df.withColumn(new_name, F.when(found != "", found).cast(kind))


def remove_prefix(column: str, prefix: str) -> Pipe:
    return lambda df: df.withColumn(column, F.regexp_replace(column, "^" + re.escape(prefix), ""))


def concatenate(columns: Sequence[str], sep: str, new_name: str, ignore_nulls: bool = True) -> Pipe:
    """Columns joined by a separator. Nulls are passed over, or make the result null."""
    texts = [F.col(c).cast("string") for c in columns]
    if ignore_nulls:
        return lambda df: df.withColumn(new_name, F.concat_ws(sep, *texts))
    between = [x for c in texts for x in (F.lit(sep), c)][1:]
    return lambda df: df.withColumn(new_name, F.concat(*between))


def split_to_list(column: str, sep: str, new_name: str) -> Pipe:
    """Split at a literal separator into a list."""
    return lambda df: df.withColumn(new_name, F.split(column, re.escape(sep), -1))


def split_to_columns(column: str, sep: str, names: Sequence[str]) -> Pipe:
    """Split into that many columns; missing parts are null, surplus parts stay out, the column itself stays."""
    parts = F.split(column, re.escape(sep), -1)
    return lambda df: df.withColumns({n: F.get(parts, F.lit(i)) for i, n in enumerate(names)})


def unnest(column: str) -> Pipe:
    """A row per list element; a null or empty list gives one row with null."""

    def run(df: DataFrame) -> DataFrame:
        require(df, column)
        return df.select(*(F.explode_outer(c).alias(c) if c == column else F.col(c) for c in df.columns))

    return run


def replace_values(column: str, new_name: str, mapping: Mapping, default: Column | None = None, strict: bool = True) -> Pipe:
    """Maps values; NaN is a legal key. Without default an unmapped value raises (strict) or stays (not strict)."""
    c = F.col(column)
    out = None
    for k, v in mapping.items():
        test = c.isNull() if k is None else c == F.lit(k)
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    rest = default if default is not None else F.raise_error(F.concat(F.lit("no replacement for "), F.coalesce(c.cast("string"), F.lit("null")))) if strict else c
    return lambda df: df.withColumn(new_name, out.otherwise(rest) if out is not None else rest)


def format_numbers(column: str, spec: str) -> Pipe:
    """Numbers in a Python format, other values as they are; the result is text.

    Arrow batches: the JVM's formatter rounds ties of the shortest decimal, not of the binary value.
    """

    @F.pandas_udf("string")
    def formatted(x: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else format(v, spec) for v in x], dtype=object)

    def run(df: DataFrame) -> DataFrame:
        text = F.col(column).cast("string")
        number = text.try_cast("double")
        return df.withColumn(column, F.when(number.isNotNull(), formatted(number)).otherwise(text))

    return run


def clean_list(column: str) -> Pipe:
    """Drops null and empty elements; a list without elements becomes null."""
    kept = F.filter(column, lambda x: x.isNotNull() & (F.trim(x.cast("string")) != "") & (F.lower(x.cast("string")) != "nan"))
    return lambda df: df.withColumn(column, F.when(F.size(kept) > 0, kept))


def title_case(column: str, new_name: str) -> Pipe:
    return lambda df: df.withColumn(new_name, F.initcap(column))
