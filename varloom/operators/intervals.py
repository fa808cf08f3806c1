"""Range joins by (chromosome, position bin): equi-joins, never nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BIN = 1_000_000


def points_in_ranges(points: DataFrame, ranges: DataFrame, window: int = 0, closed: bool = True, bin_size: int = BIN) -> DataFrame:
    """Points (CHR, POS, ...) with every range (chrom, start, end, ...) that holds them, widened by `window` on both sides.

    A range is repeated in each bin it touches, so bin_size should be about a range's length. Clashing
    names of other columns must be renamed by the caller.
    """
    lo, hi = F.col("start") - window, F.col("end") + window
    bins = F.explode(F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size))).alias("_bin")
    r = ranges.where("start <= end").select("*", bins)
    p = points.withColumn("_pbin", F.floor(F.col("POS") / bin_size))
    upper = F.col("POS") <= hi if closed else F.col("POS") < hi
    return p.join(r, (F.col("CHR") == F.col("chrom")) & (F.col("_pbin") == F.col("_bin")) & (F.col("POS") >= lo) & upper).drop("_bin", "_pbin")


def best_range(points: DataFrame, ranges: DataFrame, key: list[str], bin_size: int = BIN) -> DataFrame:
    """For every point the range that holds it farthest from its edges; ties go to the smaller start."""
    inside = points_in_ranges(points, ranges, bin_size=bin_size)
    depth = F.least(F.col("POS") - F.col("start"), F.col("end") - F.col("POS"))
    w = Window.partitionBy(*key).orderBy(depth.desc(), "start", "end")
    return inside.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cis_mask(variants: DataFrame, gene: tuple[int, int, int], window: int = 1_000_000, name: str = "cis") -> DataFrame:
    """Marks variants within `window` bases of a gene (chrom, start, end)."""
    c, s, e = gene
    return variants.withColumn(name, (F.col("CHR") == c) & F.col("POS").between(s - window, e + window))


def annotate_genes(variants: DataFrame, genes: DataFrame, window: int = 0) -> DataFrame:
    """(gene, variants within the gene or its window, as a count and extremes): the SNP-to-gene annotation."""
    hit = points_in_ranges(variants, genes, window)
    return hit.groupBy("gene").agg(F.count(F.lit(1)).alias("n_variants"), F.min("POS").alias("first_pos"), F.max("POS").alias("last_pos"))


def overlapping(genes: DataFrame, chrom: int, start: int, end: int) -> DataFrame:
    """Genes that overlap a region (closed)."""
    return genes.where((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") <= end))


def gene_coordinates(df: DataFrame, chrom: str = "Gene CHROM", start: str = "Gene start", end: str = "Gene end") -> DataFrame:
    """Text coordinates as integers: X is 23; what is neither a number nor X is left out."""
    c, s, e = (F.col(f"`{x}`") for x in (chrom, start, end))
    code = F.when(c == "X", 23).when(c.rlike("^[0-9]+$"), c.cast("int"))
    digits = s.rlike("^[0-9]+$") & e.rlike("^[0-9]+$")
    return df.withColumns({"chrom": code, "start": F.when(digits, s).cast("int"), "end": F.when(digits, e).cast("int")}).where("chrom is not null and start is not null and end is not null")


def lead_variants(df: DataFrame, threshold: float = 5e-8, window: int = 500_000, p: str = "P") -> DataFrame:
    """One lead variant per locus: significant variants no farther than `window` from the next one form a locus; its smallest p leads, ties by position.

    Only significant variants are sorted, by chromosome.
    """
    sig = df.where(F.col(p) <= threshold)
    by = Window.partitionBy("CHR").orderBy("POS")
    gap = F.col("POS") - F.lag("POS").over(by)
    marked = sig.withColumn("_new", F.when(gap.isNull() | (gap > window), 1).otherwise(0))
    loci = marked.withColumn("_locus", F.sum("_new").over(by.rangeBetween(Window.unboundedPreceding, 0)))
    others = [c for c in df.columns if c not in (p, "POS", "CHR")]
    lead = loci.groupBy("CHR", "_locus").agg(F.min(F.struct(p, "POS", *others)).alias("l"), F.count(F.lit(1)).alias("locus_variants"))
    return lead.select(*(F.col("CHR") if c == "CHR" else F.col(f"l.{c}") for c in df.columns), "locus_variants")


def manhattan_positions(df: DataFrame, chrom: str = "CHR", pos: str = "POS", p: str = "P") -> DataFrame:
    """Adds x (position on the joined chromosomes) and mlog10p for a Manhattan plot. One row per chromosome is windowed."""
    longest = df.groupBy(chrom).agg(F.max(pos).alias("_len"))
    w = Window.orderBy(chrom).rowsBetween(Window.unboundedPreceding, -1)
    offset = longest.select(F.col(chrom), F.coalesce(F.sum("_len").over(w), F.lit(0)).alias("_off"))
    return df.join(offset, chrom).withColumns({"x": F.col(pos) + F.col("_off"), "mlog10p": F.when(F.col(p) > 0, -F.log10(F.col(p)))}).drop("_off")
