"""Summary statistics from a raw table to an analysis-ready one, as one ordered plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import filters, project, rows
from varloom.operators.harmonize import is_ambiguous_snv
from varloom.operators.pipe import Pipe
from varloom.session import broadcast_if_small

SEX_CHROMOSOMES = (23, 24)
ERROR_STATUS = "9999999"


@dataclass(frozen=True)
class Steps:
    """What to keep, in this order: members (CHR, POS) of a variant list, no insertions and deletions, no strand-ambiguous single bases, no MHC of a build, no sex chromosomes, no status digits that tell of a failed harmonisation."""

    members: DataFrame | None = None
    drop_indels: bool = False
    drop_palindromic: bool = False
    exclude_mhc: str | None = None
    exclude_sex: bool = False
    status: dict[int, str] | None = None


def only_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose (CHR, POS) the list has."""
    return df.join(broadcast_if_small(members.select("CHR", "POS").distinct()), ["CHR", "POS"], "left_semi")


def transform(steps: Steps) -> Pipe:
    """The steps in order. A frequency outside 0..1 and a status that marks an error raise when the plan runs; columns that are not there are not checked."""

    def run(df: DataFrame) -> DataFrame:
        d = df
        if "EAF" in d.columns:
            outside = F.col("EAF").isNotNull() & ~F.isnan("EAF") & ((F.col("EAF") < 0) | (F.col("EAF") > 1))
            d = d.withColumn("EAF", F.when(outside, F.raise_error(F.lit("EAF is not within 0..1")).cast("double")).otherwise(F.col("EAF")))
        if steps.members is not None:
            d = only_members(d, steps.members)
        if steps.drop_indels:
            d = d.transform(filters.snvs_only())
        if steps.drop_palindromic:
            d = d.where(~is_ambiguous_snv())
        if steps.exclude_mhc:
            d = d.transform(filters.exclude_mhc(steps.exclude_mhc))
        if steps.exclude_sex:
            d = d.where(~F.col("CHR").isin(*SEX_CHROMOSOMES))
        if steps.status is not None:
            d = d.transform(filters.status_digits(drop=steps.status))
        if "STATUS" in d.columns:
            failed = F.col("STATUS").cast("string") == ERROR_STATUS
            d = d.withColumn("STATUS", F.when(failed, F.raise_error(F.lit("a row's status marks an error")).cast(d.schema["STATUS"].dataType)).otherwise(F.col("STATUS")))
        return d

    return run


def create(names: dict[str, str | None], steps: Steps = Steps()) -> Pipe:
    """Named columns under their canonical names, then the steps."""
    return lambda df: df.transform(project.column_specifiers(names)).transform(transform(steps))


def for_correlation(df: DataFrame, members: DataFrame | None = None, drop_indels: bool = True, drop_palindromic: bool = True, exclude_mhc: str | None = "19") -> DataFrame:
    """Rows for cross-trait regression: the filters, then no row of any rsID that still occurs twice. Rows without an rsID count as one such rsID."""
    d = df.transform(transform(Steps(None, drop_indels, drop_palindromic, exclude_mhc)))
    if members is not None:
        d = only_members(d, members)
    return d.transform(rows.unique_rows(["rsID"], "none", ["CHR", "POS"]))
