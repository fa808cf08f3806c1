"""Tables that downstream tools and figures start from: exports, selections around fine-mapping, causal estimates from instruments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.normal import with_two_sided
from varloom.operators.filters import present
from varloom.operators.rows import unique_rows


def snp_locations(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(rsID, CHR, POS, extra) of variants with an rsID, one row per rsID (the first by place), sorted by place: the location file of a gene analysis."""
    d = df.where("rsID is not null").select("rsID", "CHR", "POS", *extra)
    return d.transform(unique_rows(["rsID"], "first", ["CHR", "POS", *extra])).orderBy("CHR", "POS", "rsID")


def write_space_separated(df: DataFrame, path: str) -> None:
    """Headerless space-separated text."""
    df.write.mode("overwrite").option("sep", " ").option("header", False).csv(path)


def z_table(df: DataFrame, n: float | None = None) -> DataFrame:
    """(RSID, CHR, POS, A1, A2, N, Z) for bivariate mixture models: finite rows with SE > 0."""
    size = F.lit(float(n)) if n is not None else F.col("N").cast("double")
    d = df.where(present(F.col("BETA")) & present(F.col("SE")) & (F.col("SE") > 0))
    return d.select(F.col("rsID").alias("RSID"), "CHR", "POS", F.col("EA").alias("A1"), F.col("NEA").alias("A2"), size.alias("N"), (F.col("BETA") / F.col("SE")).alias("Z"))


def enrichment_points(df: DataFrame, name: str = "Name", p: str = "Coefficient_P_value") -> DataFrame:
    """Names in title case with -log10 p, in order of p, numbered from 0: the points of an enrichment figure. A report of a few hundred rows."""
    d = df.select(F.initcap(F.regexp_replace(name, "_", " ")).alias("name"), F.col(p).alias("p"), F.when(F.col(p) > 0, -F.log10(p)).alias("mlog10p"))
    from pyspark.sql.window import Window

    return d.withColumn("n", F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), "name")) - 1)


def top_bars(df: DataFrame, n: int = 20, p: str = "P", label: str = "FULL_NAME", alpha: float = 0.05) -> DataFrame:
    """The n smallest p-values with -log10 p and whether they pass Bonferroni over all rows."""
    total = max(df.count(), 1)
    return df.orderBy(F.col(p).asc_nulls_last(), label).limit(n).select(label, p, F.when(F.col(p) > 0, -F.log10(p)).alias("mlog10p"), (F.col(p) <= alpha / total).alias("passes"))


def align_to_matrix(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of df that label a row of an LD matrix (CHR, POS, EA, NEA -> ordinal), in the matrix's order."""
    return df.join(labels.select("CHR", "POS", "EA", "NEA", "ordinal"), ["CHR", "POS", "EA", "NEA"]).orderBy("ordinal")


def submatrix(matrix: np.ndarray, ordinals: Sequence[int]) -> np.ndarray:
    """Rows and columns of a locus's matrix."""
    return matrix[np.ix_(ordinals, ordinals)]


def nearest_correlation(matrix: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Positive semidefinite correlation matrix: eigenvalues clipped, diagonal set to 1 again."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    if values.min() >= tolerance:
        return matrix
    fixed = (vectors * np.maximum(values, tolerance)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(fixed))
    return fixed * np.outer(scale, scale)


def consistent_variants(df: DataFrame, diagnostics: DataFrame, log_lr: float = 2.0, z: float = 2.0) -> DataFrame:
    """Rows without those whose alleles look switched: logLR above and |z| above their limits."""
    bad = diagnostics.where((F.col("logLR") > log_lr) & (F.abs("z") > z)).select("ordinal")
    return df.join(bad, "ordinal", "left_anti")


def credible_sets(df: DataFrame, members: DataFrame, effects: DataFrame) -> DataFrame:
    """Rows of credible sets (set, ordinal) with alpha and mu of the set's effect and pip."""
    return members.join(effects, ["set", "ordinal"]).join(df, "ordinal").orderBy("set", F.col("alpha").desc(), "ordinal")


def steiger_kept(df: DataFrame, most_p: float) -> DataFrame:
    """Instruments that point from exposure to outcome with a p-value of at most most_p."""
    return df.where(F.col("steiger_dir") & (F.col("steiger_pval") <= most_p))


def inverse_variance_estimate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Causal estimate from harmonised instruments (beta_exposure, beta_outcome, se_outcome): b, se, p, n, multiplicative random effects."""
    w = 1 / (F.col("se_outcome") * F.col("se_outcome"))
    x, y = F.col("beta_exposure"), F.col("beta_outcome")
    d = df.where(F.col("se_outcome") > 0)
    g = d.groupBy(*by).agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.count(F.lit(1)).alias("n"))
    b = F.col("xy") / F.when(F.col("xx") > 0, F.col("xx"))
    q = F.greatest((F.col("yy") - b * F.col("xy")) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(1.0))
    out = g.select(*by, b.alias("b"), F.sqrt(q / F.when(F.col("xx") > 0, F.col("xx"))).alias("se"), "n")
    return with_two_sided(out, "(b / se)", "p")


def overlap_matrix(pairs: DataFrame, names: Sequence[str], value: str = "gcov_int", unit_diagonal: bool = True) -> np.ndarray:
    """Symmetric matrix of a pair table (p1, p2, value) of a few traits, scaled to correlations."""
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for r in pairs.select("p1", "p2", value).collect():
        if r["p1"] in at and r["p2"] in at:
            m[at[r["p1"]], at[r["p2"]]] = m[at[r["p2"]], at[r["p1"]]] = r[value]
    d = np.sqrt(np.diag(m))
    m = m / np.outer(d, d)
    if unit_diagonal:
        np.fill_diagonal(m, 1.0)
    return m


def gene_results(genes: DataFrame, thesaurus: DataFrame, max_p: float | None = 0.01) -> DataFrame:
    """(gene_id, chrom, pos, p, name) of gene results (GENE, CHR, START, STOP, P): midpoints, names of the thesaurus (gene_id, name), else the id; p below max_p, None for all.

    Of a gene's several names the smallest counts.
    """
    g = genes.select(F.col("GENE").cast("string").alias("gene_id"), F.col("CHR").cast("string").alias("chrom"), ((F.col("START").cast("double") + F.col("STOP").cast("double")) / 2).alias("pos"), F.col("P").cast("double").alias("p"))
    g = g.where(F.col("p") < max_p) if max_p is not None else g
    names = thesaurus.select(F.col("gene_id").cast("string").alias("gene_id"), "name").groupBy("gene_id").agg(F.min("name").alias("name"))
    return g.join(names, "gene_id", "left").withColumn("name", F.coalesce("name", "gene_id"))


def gene_p_values(table: DataFrame, locations: DataFrame, gene: str, p: str, by: str = "gene_id", max_p: float | None = 0.1) -> DataFrame:
    """(gene_id, name, chrom, pos, p) of a (gene, p) table placed by gene locations (gene_id, name, chrom, start, end); genes without a place are left out.

    by: gene_id or name, what the table names its genes by; of a repeated one the location that is first by place counts.
    """
    if by not in ("gene_id", "name"):
        raise ValueError(f"by is {by}")
    t = table.select(F.col(gene).cast("string").alias("_gene"), F.col(p).cast("double").alias("p"))
    t = t.where(F.col("p") < max_p) if max_p is not None else t
    middle = (F.col("start").cast("double") + F.col("end").cast("double")) / 2
    l = locations.select(F.col(by).cast("string").alias("_gene"), F.struct(F.col("chrom").cast("string").alias("chrom"), middle.alias("pos"), F.col("gene_id").cast("string").alias("gene_id"), F.col("name").cast("string").alias("name")).alias("l"))
    return t.join(l.groupBy("_gene").agg(F.min("l").alias("l")), "_gene").select("l.gene_id", "l.name", "l.chrom", "l.pos", "p")
