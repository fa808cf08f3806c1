"""Scalar statistics on columns: all whole-stage-codegen expressions, no Python."""

from __future__ import annotations


from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.normal import norm_ppf_sql, norm_two_sided_sql, with_quantile, with_two_sided
from varloom.operators.pipe import Pipe, require

NAN = float("nan")


def max_with_constant(column: str, value: float, new_name: str) -> Pipe:
    """Row-wise maximum of a column and a constant; of null, the constant."""
    return lambda df: df.withColumn(new_name, F.greatest(F.col(column), F.lit(value)))


def row_average(exclude: Sequence[str], name: str = "Average") -> Pipe:
    """Mean of all other columns of a row, over those that are not null; null if all are."""

    def run(df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{c}`").cast("double") for c in df.columns if c not in exclude]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
        count = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
        return df.withColumn(name, F.when(count > 0, total / F.greatest(count, F.lit(1))))

    return run


def shifted_log(base: float, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), pseudocount: float = 1.0) -> Pipe:
    """log_base(x + pseudocount) on the listed columns, or on all but the excluded."""

    def run(df: DataFrame) -> DataFrame:
        chosen = list(columns) if columns is not None else [c for c in df.columns if c not in exclude]
        return df.withColumns({c: F.log(float(base), F.col(c) + pseudocount) for c in chosen})

    return run


def winsorize(most: float, exclude: Sequence[str] = ()) -> Pipe:
    """Values above `most` become `most`; null stays null."""
    return lambda df: df.withColumns({c: F.when(F.col(c) > most, F.lit(most)).otherwise(F.col(c)) for c in df.columns if c not in exclude})


def beta_from_odds_ratio(if_needed: bool = False) -> Pipe:
    """BETA = ln(OR); null for OR <= 0. A table with BETA raises ValueError, or stays as it is if if_needed."""

    def run(df: DataFrame) -> DataFrame:
        if "BETA" in df.columns:
            if if_needed:
                return df
            raise ValueError("the table has BETA already")
        require(df, "OR")
        return df.withColumn("BETA", F.when(F.col("OR") > 0, F.log("OR")))

    return run


def p_from_mlog10p(if_needed: bool = False) -> Pipe:
    """P = 10 ** -MLOG10P."""

    def run(df: DataFrame) -> DataFrame:
        if "P" in df.columns:
            if if_needed:
                return df
            raise ValueError("the table has P already")
        return df.withColumn("P", F.pow(F.lit(10.0), -F.col("MLOG10P")))

    return run


def mlog10p_if_needed(least: float = 1e-250) -> Pipe:
    """MLOG10P = -log10(max(P, least)); null P gives null."""

    def run(df: DataFrame) -> DataFrame:
        if "MLOG10P" in df.columns:
            return df
        return df.withColumn("MLOG10P", F.when(F.col("P").isNotNull(), -F.log10(F.greatest(F.col("P"), F.lit(least)))))

    return run


def p_from_beta_se_sql(beta: str, se: str) -> str:
    return f"(CASE WHEN {se} <> 0 THEN {norm_two_sided_sql(f'({beta} / (CASE WHEN {se} <> 0 THEN {se} END))')} END)"


def p_from_beta_se_if_needed(p: str = "P", beta: str = "BETA", se: str = "SE") -> Pipe:
    """P = P(|Z| > |BETA / SE|); null at SE = 0."""
    return lambda df: df if p in df.columns else with_two_sided(df, f"({beta} / (CASE WHEN {se} <> 0 THEN {se} END))", p)


def se_from_p_sql(beta: str, p: str) -> str:
    z = norm_ppf_sql(f"({p} / 2.0e0)")
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN abs({beta} / {z}) END)"


def se_from_p(if_needed: bool = False) -> Pipe:
    """SE = |BETA / quantile(P / 2)|: the lower tail stays finite for tiny P. Null at P = 0 and P = 1."""

    def run(df: DataFrame) -> DataFrame:
        if "SE" in df.columns:
            if if_needed:
                return df
            raise ValueError("the table has SE already")
        d = with_quantile(df, "(CASE WHEN P > 0 AND P < 1 THEN P / 2.0e0 END)", "_z")
        return d.withColumn("SE", F.abs(F.col("BETA") / F.col("_z"))).drop("_z")

    return run


def attenuation_ratio(mean_chi: str, intercept: str, name: str = "ratio") -> Pipe:
    """(intercept - 1) / (mean chi2 - 1) if mean chi2 >= 1.02 and intercept >= 1, else NaN."""
    m, i = F.col(mean_chi), F.col(intercept)
    return lambda df: df.withColumn(name, F.when((m >= 1.02) & (i >= 1), (i - 1) / F.when(m >= 1.02, m - 1)).otherwise(F.lit(NAN)))


def liability_factor(population_prevalence: float, sample_prevalence: float | None = None) -> float:
    """Observed-scale heritability times this is liability-scale heritability: (K(1-K))^2 / (phi(T)^2 P(1-P))."""
    k, p = population_prevalence, sample_prevalence if sample_prevalence is not None else 0.5
    n = NormalDist()
    return (k * (1 - k)) ** 2 / (n.pdf(n.inv_cdf(1 - k)) ** 2 * p * (1 - p))


def liability_heritability(observed: str, liability: str, population_prevalence: float | None, sample_prevalence: float | None = None) -> Pipe:
    """Heritability on the liability scale; without a prevalence (quantitative trait) a copy."""
    factor = 1.0 if population_prevalence is None else liability_factor(population_prevalence, sample_prevalence)
    return lambda df: df.withColumn(liability, F.col(observed) * F.lit(factor))


@dataclass(frozen=True)
class Cohort:
    """A case-control cohort and its effective sample size."""

    name: str
    cases: int
    controls: int

    @property
    def effective_n(self) -> float:
        return 4 * self.cases * self.controls / (self.cases + self.controls)


def effective_n_from_cohorts(cohorts: Sequence[Cohort], column: str, name: str = "N", missing: str = "?") -> Pipe:
    """Sum of effective sizes of the cohorts whose character is not `missing`, rounded half away from zero."""
    parts = [F.when(F.substring(F.col(column), i + 1, 1) != missing, F.lit(c.effective_n)).otherwise(0.0) for i, c in enumerate(cohorts)]
    return lambda df: df.withColumn(name, F.round(sum(parts, F.lit(0.0))).cast("bigint"))


def effect_interval(beta: str = "b", se: str = "se", width: float = 1.95) -> Pipe:
    """lower and upper bound of an effect for a forest plot."""
    return lambda df: df.withColumns({"lower": F.col(beta) - width * F.col(se), "upper": F.col(beta) + width * F.col(se)})


def z_scores(beta: str = "BETA", se: str = "SE", name: str = "Z") -> Pipe:
    """Z = BETA / SE; null where SE is not above 0."""
    return lambda df: df.withColumn(name, F.when(F.col(se) > 0, F.col(beta) / F.when(F.col(se) > 0, F.col(se))))


def total_effective_n(pairs: Sequence[tuple[int, int]]) -> int:
    """Sum of whole effective sizes of (cases, controls)."""
    return sum(int(4 / (1 / a + 1 / b)) for a, b in pairs)



