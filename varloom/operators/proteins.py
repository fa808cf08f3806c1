"""Many tables of one shape (proteins) on one variant index: slim aligned form, heritability and cross-trait correlation of all of them in one plan.

Aligned rows are kept long and sparse, (protein, row_id, BETA, SE, N): a variant that a
protein lacks has no row, which the regressions read as weight 0, like NaN in a dense column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import regress
from varloom.operators.joins import allele_key
from varloom.operators.rows import unique_rows
from varloom.session import broadcast_if_small

ALL, CIS_EXCLUDED = "all", "cis_excluded"


def slim(index: DataFrame, proteins: DataFrame, protein: str = "protein") -> DataFrame:
    """(protein, row_id, BETA, SE, N as float) of regenie-like rows (protein, CHROM, GENPOS, ALLELE0, ALLELE1, BETA, SE, N) on the index (row_id, CHR, POS, EA, NEA).

    BETA is turned to the index's EA; of repeated variants the first by BETA, SE stays; a missing BETA or SE is NaN.
    """
    p = proteins.select(
        protein, F.col("CHROM").cast("int").alias("CHR"), F.col("GENPOS").cast("int").alias("POS"), allele_key("ALLELE1", "ALLELE0").alias("_key"),
        F.col("ALLELE1").alias("_ea"), F.col("BETA").cast("double").alias("BETA"), F.col("SE").cast("double").alias("SE"), F.col("N").cast("float").alias("N"),
    ).transform(unique_rows([protein, "CHR", "POS", "_key"], "first", ["BETA", "SE", "_ea"]))
    i = index.select("row_id", F.col("CHR").cast("int").alias("CHR"), F.col("POS").cast("int").alias("POS"), allele_key("EA", "NEA").alias("_key"), "EA")
    nan = F.lit(float("nan"))
    beta = F.coalesce(F.when(F.col("EA") == F.col("_ea"), F.col("BETA")).otherwise(-F.col("BETA")), nan)
    return p.join(broadcast_if_small(i), ["CHR", "POS", "_key"]).select(protein, "row_id", beta.cast("float").alias("BETA"), F.coalesce("SE", nan).cast("float").alias("SE"), "N")


def check_chromosomes(index: DataFrame, proteins: DataFrame, protein: str = "protein") -> None:
    """Raises ValueError for proteins without any row on a chromosome of the index: a missing file, not missing variants."""
    wanted = {r[0] for r in index.select(F.col("CHR").cast("int")).distinct().collect()}
    got = proteins.groupBy(protein).agg(F.collect_set(F.col("CHROM").cast("int")).alias("c"))
    lacking = got.where(~F.forall(F.array(*(F.lit(c) for c in sorted(wanted))), lambda c: F.array_contains("c", c))).limit(5).collect() if wanted else []
    if lacking:
        raise ValueError("no rows on some chromosome for " + ", ".join(str(r[protein]) for r in lacking))


def constant_n(df: DataFrame, protein: str = "protein") -> DataFrame:
    """(protein, n): the one finite sample size of each; none or several raise when the plan runs."""
    finite = F.when(~F.isnan("N") & (F.abs("N") < float("inf")), F.col("N"))
    g = df.groupBy(protein).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    wrong = F.raise_error(F.concat(F.lit("distinct sample sizes, or none, in "), F.col(protein).cast("string"))).cast("double")
    return g.select(protein, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("double")).otherwise(wrong).alias("n"))


def _in_sets(df: DataFrame, coordinates: DataFrame, protein: str, window: int) -> DataFrame:
    """Each row once in the set of all variants and, unless it lies within `window` bases of the protein's gene, once in that without them. A protein without coordinates has the first set only."""
    c = broadcast_if_small(coordinates.select(protein, F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")))
    d = df.join(c, protein, "left")
    cis = (F.col("CHR") == F.col("_c")) & F.col("POS").between(F.col("_s") - window, F.col("_e") + window)
    sets: Column = F.when(F.coalesce(~cis, F.lit(False)), F.array(F.lit(ALL), F.lit(CIS_EXCLUDED))).otherwise(F.array(F.lit(ALL)))
    return d.withColumn("variant_set", F.explode(sets)).drop("_c", "_s", "_e")


def heritability(aligned: DataFrame, context: DataFrame, coordinates: DataFrame, m: float, sample_sizes: DataFrame | None = None, n_blocks: int = 200, window: int = 1_000_000, protein: str = "protein") -> DataFrame:
    """LD-score heritability of every protein over all variants and without its cis region: (protein, variant_set, h2, h2_se, intercept, intercept_se, lambda_gc, mean_chi2, n_kept).

    context: (row_id, CHR, POS, ld, ordinal) as made by regress.ldsc_context. sample_sizes: (protein, n), else the constant N of the aligned rows.
    All proteins are groups of one regression, so there is one pass however many there are.
    """
    n = broadcast_if_small(constant_n(aligned, protein) if sample_sizes is None else sample_sizes.select(protein, F.col("n").cast("double").alias("n")))
    z = F.col("BETA").cast("double") / F.when(F.col("SE") > 0, F.col("SE").cast("double"))
    total = context.count()
    d = aligned.drop("N").join(broadcast_if_small(context.select("row_id", "CHR", "POS", "ld", "ordinal"), total), "row_id").join(n, protein)
    d = _in_sets(d.withColumn("chi2", z * z), coordinates, protein, window)
    return regress.heritability(d, [protein, "variant_set"], total, m, n_blocks)


def correlation(aligned: DataFrame, context: DataFrame, coordinates: DataFrame, m: float, sample_sizes: DataFrame | None = None, n_blocks: int = 200, window: int = 1_000_000, protein: str = "protein") -> DataFrame:
    """Cross-trait regression of every protein with one trait: (protein, variant_set, gcov, h2_t, h2_p, rg, rg_se, z, p, n_snps).

    context: (row_id, CHR, POS, ld, ordinal, z_t, n_t), the trait's z on the index's EA; rows without z_t take no part.
    """
    n = broadcast_if_small(constant_n(aligned, protein) if sample_sizes is None else sample_sizes.select(protein, F.col("n").cast("double").alias("n")))
    total = context.count()
    z = F.col("BETA").cast("double") / F.when(F.col("SE") > 0, F.col("SE").cast("double"))
    d = aligned.drop("N").join(broadcast_if_small(context.select("row_id", "CHR", "POS", "ld", "ordinal", "z_t", "n_t"), total), "row_id").join(n.withColumnRenamed("n", "n_p"), protein)
    return regress.genetic_correlation(_in_sets(d.withColumn("z_p", z), coordinates, protein, window), [protein, "variant_set"], total, m, n_blocks)
