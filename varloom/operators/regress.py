"""Regressions from additive sums: block jackknife, LD-score heritability and correlation, munging, subtraction.

The unit of work is five weighted sums per (group, block): sum wl^2, wl, w, wly, wy. They
are folded in the tasks before the shuffle; leave-one-out values are totals less a block,
and the 2 x 2 systems are solved in closed form by Column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.normal import with_quantile, with_two_sided
from varloom.operators.harmonize import is_ambiguous_snv, matches, matches_flipped
from varloom.operators.scalar import liability_factor

SUMS = ("a", "b", "d", "e", "f")
#: Fixed value: median of the chi-squared distribution with one degree of freedom.
CHI2_MEDIAN = 0.4549364231195724
NAN = float("nan")


def block_bounds(n: int, n_blocks: int) -> list[tuple[int, int]]:
    """Contiguous half-open blocks of n rows: cuts at floor(linspace(1, n, n_blocks + 1)); fewer rows than blocks raise ValueError."""
    if n < n_blocks:
        raise ValueError(f"{n} rows make no {n_blocks} blocks")
    cuts = [1 + (p * (n - 1)) // n_blocks for p in range(n_blocks + 1)]
    return [(cuts[p] - 1, cuts[p + 1] - 1 if p < n_blocks - 1 else n) for p in range(n_blocks)]


def block_of(ordinal: Column, n: int, n_blocks: int) -> Column:
    """Block of a 0-based ordinal under block_bounds, by integer arithmetic."""
    if n <= 1:
        return F.lit(0)
    p = F.floor(((ordinal.cast("bigint") + 1) * n_blocks + (n - 2)) / F.lit(n - 1)) - 1
    return F.least(p, F.lit(n_blocks - 1)).cast("int")


def even_block_of(ordinal: Column, n: int, n_blocks: int) -> Column:
    """Blocks of n // n_blocks rows; the last takes the remainder."""
    return F.least(F.floor(ordinal / F.lit(max(n // n_blocks, 1))), F.lit(n_blocks - 1)).cast("int")


def block_sums(df: DataFrame, by: Sequence[str], w: Column, x: Column, y: Column) -> DataFrame:
    """Five sums per (by, block) of the regression of y on [x, 1] with weight w; rows without weight count 0."""
    return df.groupBy(*by, "block").agg(F.sum(w * x * x).alias("a"), F.sum(w * x).alias("b"), F.sum(w).alias("d"), F.sum(w * x * y).alias("e"), F.sum(w * y).alias("f"))


def slope(s: dict[str, Column]) -> Column:
    det = s["a"] * s["d"] - s["b"] * s["b"]
    return (s["d"] * s["e"] - s["b"] * s["f"]) / F.when(det != 0, det)


def intercept(s: dict[str, Column]) -> Column:
    det = s["a"] * s["d"] - s["b"] * s["b"]
    return (s["a"] * s["f"] - s["b"] * s["e"]) / F.when(det != 0, det)


def leave_one_out(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, block, slope, intercept, slope_loo, intercept_loo) from block sums."""
    total = sums.groupBy(*by).agg(*(F.sum(c).alias(f"t{c}") for c in SUMS)) if by else sums.agg(*(F.sum(c).alias(f"t{c}") for c in SUMS)).withColumn("_k", F.lit(1))
    j = sums.join(total, list(by)) if by else sums.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")  # one row
    t = {c: F.col(f"t{c}") for c in SUMS}
    loo = {c: F.col(f"t{c}") - F.col(c) for c in SUMS}
    return j.select(*by, "block", slope(t).alias("slope"), intercept(t).alias("intercept"), slope(loo).alias("slope_loo"), intercept(loo).alias("intercept_loo"))


def _kept(chi: Column, n: Column) -> Column:
    finite = chi.isNotNull() & ~F.isnan(chi) & (chi < float("inf"))
    return finite & (chi <= F.greatest(n * 0.001, F.lit(80.0)))


def _aggregate_h2(df: DataFrame, by: Sequence[str], chi: str, n: str, m: float, kept: Column) -> DataFrame:
    """Per group: tot = clip(m (mean chi2 - 1) / mean(l n), 0, 1), nbar, kept rows."""
    g = df.where(kept).groupBy(*by).agg(F.avg(chi).alias("_mc"), F.avg(F.col("ld") * F.col(n)).alias("_mln"), F.avg(n).alias("nbar"), F.count(F.lit(1)).alias("n_kept"), F.median(chi).alias("_median"))
    tot = F.least(F.greatest(m * (F.col("_mc") - 1) / F.col("_mln"), F.lit(0.0)), F.lit(1.0))
    return g.select(*by, tot.alias("tot"), "nbar", "n_kept", F.col("_mc").alias("mean_chi2"), (F.col("_median") / CHI2_MEDIAN).alias("lambda_gc"))


def _het(tot: Column, n: Column, m: float) -> Column:
    c = tot * n / m
    one = 1 + c * F.greatest(F.col("ld"), F.lit(1.0))
    return 1 / (2 * one * one)


def heritability(df: DataFrame, by: Sequence[str], n_snps: int, m: float, n_blocks: int = 200, exclude: Column | None = None) -> DataFrame:
    """LD-score heritability per group of (by, ordinal, ld, chi2, n): h2, h2_se, intercept, intercept_se, lambda_gc, mean_chi2, n_kept.

    `ordinal` numbers the shared variants 0..n_snps-1. Excluded and filtered variants get
    weight 0, so all groups share the blocks.
    """
    kept = _kept(F.col("chi2"), F.col("n")) & (~exclude if exclude is not None else F.lit(True))
    d = df.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    agg = _aggregate_h2(d, by, "chi2", "n", m, F.col("_kept"))
    j = d.where("_kept").join(agg.select(*by, "tot"), list(by)).withColumn("block", block_of(F.col("ordinal"), n_snps, n_blocks))
    w = _het(F.col("tot"), F.col("n"), m) / F.greatest(F.col("ld"), F.lit(1.0))
    loo = leave_one_out(block_sums(j, by, w, F.col("ld"), F.col("chi2")), by)
    nb = n_blocks
    g = loo.groupBy(*by).agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.count(F.lit(1)).alias("_k"),
        F.var_samp(nb * F.col("slope") - (nb - 1) * F.col("slope_loo")).alias("_v"), F.var_samp(nb * F.col("intercept") - (nb - 1) * F.col("intercept_loo")).alias("_vi"),
    )
    g = g.join(agg, list(by))
    scale = m / F.col("nbar")
    return g.select(*by, (F.col("slope") * scale).alias("h2"), (F.sqrt("_v") * scale / math.sqrt(nb)).alias("h2_se"), "intercept", (F.sqrt("_vi") / math.sqrt(nb)).alias("intercept_se"), "lambda_gc", "mean_chi2", "n_kept")


def genetic_correlation(df: DataFrame, by: Sequence[str], n_snps: int, m: float, n_blocks: int = 200) -> DataFrame:
    """Cross-trait LD-score regression per group of (by, ordinal, ld, z_t, n_t, z_p, n_p): gcov, h2_t, h2_p, rg, rg_se, z, p.

    rg is NaN where a heritability is not above 0. Weight of the covariance: oc (sqrt(het_t) + sqrt(het_p))^2.
    """
    d = df.withColumns({"ct": F.col("z_t") * F.col("z_t"), "cp": F.col("z_p") * F.col("z_p")})
    d = d.withColumn("_kept", F.coalesce(_kept(F.col("ct"), F.col("n_t")) & _kept(F.col("cp"), F.col("n_p")), F.lit(False))).where("_kept")
    g = d.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in ("ct", "cp", "n_t", "n_p")), F.avg(F.col("ld") * F.col("n_t")).alias("lnt"), F.avg(F.col("ld") * F.col("n_p")).alias("lnp"), F.count(F.lit(1)).alias("n_snps"))

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    g = g.select(*by, clip(m * (F.col("mct") - 1) / F.col("lnt")).alias("tot_t"), clip(m * (F.col("mcp") - 1) / F.col("lnp")).alias("tot_p"), F.col("mn_t").alias("nt"), F.col("mn_p").alias("np"), "n_snps")
    j = d.join(g, list(by)).withColumn("block", block_of(F.col("ordinal"), n_snps, n_blocks))
    oc = 1 / F.greatest(F.col("ld"), F.lit(1.0))
    ht, hp = _het(F.col("tot_t"), F.col("n_t"), m), _het(F.col("tot_p"), F.col("n_p"), m)
    wc = oc * (F.sqrt(ht) + F.sqrt(hp)) * (F.sqrt(ht) + F.sqrt(hp))
    parts = []
    for kind, w, y in (("t", ht * oc, F.col("ct")), ("p", hp * oc, F.col("cp")), ("c", wc, F.col("z_t") * F.col("z_p"))):
        x = F.col("ld")
        parts += [F.sum(w * x * x).alias(f"a{kind}"), F.sum(w * x).alias(f"b{kind}"), F.sum(w).alias(f"d{kind}"), F.sum(w * x * y).alias(f"e{kind}"), F.sum(w * y).alias(f"f{kind}")]
    sums = j.groupBy(*by, "block").agg(*parts)  # three regressions, one shuffle
    names = [f"{c}{k}" for k in "tpc" for c in SUMS]
    total = sums.groupBy(*by).agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    x = sums.join(total, list(by)).join(g, list(by))

    def of(kind: str, loo: bool) -> Column:
        return slope({c: (F.col(f"t_{c}{kind}") - F.col(f"{c}{kind}")) if loo else F.col(f"t_{c}{kind}") for c in SUMS})

    def ratio(loo: bool) -> Column:
        h_t, h_p = of("t", loo) / F.col("nt") * m, of("p", loo) / F.col("np") * m
        ok = (h_t > 0) & (h_p > 0)
        return F.when(ok, of("c", loo) / F.sqrt(F.col("nt") * F.col("np")) * m / F.sqrt(F.when(ok, h_t * h_p))).otherwise(F.lit(NAN))

    x = x.select(*by, "n_snps", (of("c", False) / F.sqrt(F.col("nt") * F.col("np")) * m).alias("gcov"), (of("t", False) / F.col("nt") * m).alias("h2_t"), (of("p", False) / F.col("np") * m).alias("h2_p"), ratio(False).alias("rg"), ratio(True).alias("_loo"))
    out = x.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("gcov", "h2_t", "h2_p", "rg", "n_snps")), (F.sqrt(F.var_pop("_loo") * F.lit(float(n_blocks - 1)))).alias("rg_se"))
    z = F.when(F.col("rg_se") > 0, F.col("rg") / F.when(F.col("rg_se") > 0, F.col("rg_se")))
    tested = with_two_sided(out.withColumn("z", z), "(CASE WHEN NOT isnan(z) THEN z END)", "p")
    return tested.withColumn("p", F.when(F.isnan("z"), F.lit(NAN)).otherwise(F.col("p")))


def exact_heritability(df: DataFrame, m: float, n_blocks: int = 200, exclude: Column | None = None) -> DataFrame:
    """Heritability of one trait (ordinal, ld, chi2, n) whose blocks are cut over the variants it keeps, not over the shared ones: the reference for the shared-block form, one more sort."""
    from varloom.operators.joins import with_row_id

    kept = df.where(_kept(F.col("chi2"), F.col("n")) & (~exclude if exclude is not None else F.lit(True)))
    d = with_row_id(kept.withColumnRenamed("ordinal", "_was"), [], within="_was", name="ordinal")
    return heritability(d.withColumn("_g", F.lit(1)), ["_g"], d.count(), m, n_blocks).drop("_g")


def exact_correlation(df: DataFrame, m: float, n_blocks: int = 200, exclude: Column | None = None) -> DataFrame:
    """Correlation of one pair (ordinal, ld, z_t, n_t, z_p, n_p) whose blocks are cut over the variants it keeps."""
    from varloom.operators.joins import with_row_id

    kept = df.where(_kept(F.col("z_t") * F.col("z_t"), F.col("n_t")) & _kept(F.col("z_p") * F.col("z_p"), F.col("n_p")) & (~exclude if exclude is not None else F.lit(True)))
    d = with_row_id(kept.withColumnRenamed("ordinal", "_was"), [], within="_was", name="ordinal")
    return genetic_correlation(d.withColumn("_g", F.lit(1)), ["_g"], d.count(), m, n_blocks).drop("_g")


def partitioned(df: DataFrame, by: Sequence[str], annotations: Sequence[str], n_snps: int, m: float, n_blocks: int = 200) -> DataFrame:
    """LD-score regression on several annotations per group of (by, ordinal, ld, chi2, n, annotations): (by, annotation, coefficient, coefficient_se, z, p).

    chi2 = intercept + n * sum of coefficient * annotation's LD score. Weights are those of `heritability` by the total
    score ld; standard errors by the block jackknife; p is one-sided (coefficient above 0). The sums of
    the normal equations are folded in the tasks; a group then has a row per block, which one task solves.
    A group whose equations are singular gives NaN.
    """
    kept = F.coalesce(_kept(F.col("chi2"), F.col("n")), F.lit(False))
    d = df.where(kept)
    agg = _aggregate_h2(d, by, "chi2", "n", m, F.lit(True))
    j = d.join(agg.select(*by, "tot", "nbar"), list(by)).withColumn("block", block_of(F.col("ordinal"), n_snps, n_blocks))
    w = _het(F.col("tot"), F.col("n"), m) / F.greatest(F.col("ld"), F.lit(1.0))
    x = [*(F.col(a) * F.col("n") / F.col("nbar") for a in annotations), F.lit(1.0)]
    k = len(x)
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    sums = [F.sum(w * x[a] * x[b]).alias(f"x{a}_{b}") for a, b in cells] + [F.sum(w * x[a] * F.col("chi2")).alias(f"y{a}") for a in range(k)]
    per_block = j.groupBy(*by, "block").agg(*sums, F.first("nbar").alias("nbar"))
    keys = list(by)

    def solve(f):
        import numpy as np
        import pandas as pd

        left, right = np.zeros((len(f), k, k)), f[[f"y{a}" for a in range(k)]].to_numpy(float)
        for a, b in cells:
            left[:, a, b] = left[:, b, a] = f[f"x{a}_{b}"].to_numpy(float)

        def solution(a, y):
            try:
                return np.linalg.solve(a, y)
            except np.linalg.LinAlgError:
                return np.full(k, np.nan)

        full = solution(left.sum(0), right.sum(0))
        without = np.array([solution(left.sum(0) - a, right.sum(0) - y) for a, y in zip(left, right, strict=True)])
        nb = len(f)
        pseudo = nb * full - (nb - 1) * without
        se = pseudo.std(axis=0, ddof=1) / math.sqrt(nb) if nb > 1 else np.full(k, np.nan)
        c, e = full[:-1] / f["nbar"].iloc[0], se[:-1] / f["nbar"].iloc[0]
        z = np.divide(c, e, out=np.full(k - 1, np.nan), where=e > 0)
        p = [0.5 * math.erfc(v / math.sqrt(2)) if v == v else NAN for v in z]
        return pd.DataFrame({**{b: [f[b].iloc[0]] * (k - 1) for b in keys}, "annotation": list(annotations), "coefficient": c, "coefficient_se": e, "z": z, "p": p})

    types = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in keys)
    return per_block.groupBy(*keys).applyInPandas(solve, f"{types}, annotation string, coefficient double, coefficient_se double, z double, p double")


def ldsc_context(index: DataFrame, ld: DataFrame, drop_ambiguous: bool = True, exclude_mhc: bool = True) -> DataFrame:
    """Variants of the index with LD scores, without ambiguous and MHC ones (closed interval), numbered by (CHR, POS, row_id) as `ordinal`."""
    from varloom.operators.filters import MHC, Interval
    from varloom.operators.joins import with_row_id

    j = index.join(ld.select(F.col("SNP").alias("rsID"), F.col("L2").alias("ld")), "rsID")
    if drop_ambiguous:
        j = j.where(~F.col("is_strand_ambiguous"))
    if exclude_mhc:
        r = MHC["38"]
        j = j.where(~Interval(r.chrom, r.start, r.end, closed=True).holds(F.col("CHR"), F.col("POS")))
    return with_row_id(j, ["POS", "row_id"], name="ordinal")


def munge(df: DataFrame, ref: DataFrame, n: float | None = None, info_filter: float = 0.9, maf_filter: float = 0.01) -> DataFrame:
    """Summary statistics (SNP, A1, A2, effect, P, [N, MAF, INFO]) as (SNP, A1, A2, Z, N) on the reference's A1.

    Order: N override, MAF folded, alleles other than A, C, G, T null, inner join, missing P or
    effect dropped, odds ratios (rounded median 1) raise, flip, allele match, Z, INFO and MAF filters.
    """
    d = df.withColumn("N", F.lit(float(n))) if n is not None else df
    if "MAF" in d.columns:
        d = d.withColumn("MAF", F.least(F.col("MAF"), 1 - F.col("MAF")))
    for c in ("A1", "A2"):
        d = d.withColumn(c, F.when(F.upper(c).isin("A", "C", "G", "T"), F.upper(c)))
    j = d.join(ref.select("SNP", F.col("A1").alias("r1"), F.col("A2").alias("r2")), "SNP")
    j = j.where(F.col("P").isNotNull() & ~F.isnan("P") & F.col("effect").isNotNull() & ~F.isnan("effect"))
    centre = j.agg(F.median("effect")).first()[0]
    if centre is not None and round(centre) == 1:
        raise ValueError("effects look like odds ratios; give their logarithms")
    same, turned = matches("A1", "A2", "r1", "r2"), matches_flipped("A1", "A2", "r1", "r2")
    effect = F.when(same, F.col("effect")).otherwise(-F.col("effect"))
    kept = j.where((same | turned) & (F.col("P") > 0) & (F.col("P") <= 1)).withColumn("_sign", F.signum(effect))
    out = with_quantile(kept, "(P / 2.0e0)", "_q").withColumn("Z", -F.col("_sign") * F.col("_q"))
    if "INFO" in d.columns:
        out = out.where(F.col("INFO") >= info_filter)
    if "MAF" in d.columns:
        out = out.where(F.col("MAF") >= maf_filter)
    return out.where(F.col("N").isNotNull() & ~F.isnan("N")).select("SNP", F.col("r1").alias("A1"), F.col("r2").alias("A2"), "Z", "N")


def filter_reference(ref: DataFrame, maf_filter: float, exclude_ambiguous: bool = False) -> DataFrame:
    """Reference variants with MAF at or above the limit, without A/T and C/G ones if wanted."""
    d = ref.where(F.col("MAF") >= maf_filter)
    return d.where(~is_ambiguous_snv("A1", "A2")) if exclude_ambiguous else d


def standardise(df: DataFrame, ref: DataFrame, info_filter: float = 0.6) -> DataFrame:
    """(SNP, A1, A2, MAF, beta, se) with beta = Z / sqrt(N var), var = 2 f (1 - f) of the table's MAF, else the reference's.

    Z of P below 1e-307 is sign * sqrt(-2 ln P).
    """
    own = "MAF" in df.columns
    d = df.withColumnRenamed("MAF", "own_maf") if own else df.withColumn("own_maf", F.lit(None).cast("double"))
    j = d.join(ref.select("SNP", F.col("A1").alias("r1"), F.col("A2").alias("r2"), "MAF"), "SNP")
    same, turned = matches("A1", "A2", "r1", "r2"), matches_flipped("A1", "A2", "r1", "r2")
    j = j.where(same | turned)
    if "INFO" in df.columns:
        j = j.where(F.col("INFO") >= info_filter)
    sign = F.when(same, F.signum("effect")).otherwise(-F.signum("effect"))
    f = F.coalesce("own_maf", "MAF")
    j = j.withColumns({"_sign": sign, "_var": 2 * f * (1 - f)}).where((F.col("_var") > 0) & (F.col("_sign") != 0) & (F.col("P") > 0) & (F.col("P") < 1))
    j = with_quantile(j, "(P / 2.0e0)", "_q")
    j = j.withColumn("_z", F.col("_sign") * F.when(F.col("P") < 1e-307, F.sqrt(-2 * F.log("P"))).otherwise(-F.col("_q")))
    beta = F.col("_z") / F.sqrt(F.col("N") * F.col("_var"))
    return j.select("SNP", F.col("r1").alias("A1"), F.col("r2").alias("A2"), "MAF", beta.alias("beta"), F.abs(beta / F.col("_z")).alias("se"))


def subtraction(df: DataFrame, s: Sequence[Sequence[float]], v: Sequence[Sequence[float]], i: Sequence[Sequence[float]]) -> DataFrame:
    """Effects on a factor and on what it leaves of trait 1: df (beta1, beta2, se1, se2, var_snp) -> beta_f, se_f, beta_r, se_r, neff_f, neff_r.

    s: 2 x 2 genetic covariance; v: 3 x 3 sampling covariance of (s11, s12, s22); i: 2 x 2 intercepts.
    b = sqrt(s22), a_f = s12 / b, a_r = sqrt(s11 - a_f^2); beta_f = beta2 / b, beta_r = (beta1 - a_f / b beta2) / a_r.
    Standard errors by the delta method over (beta1, beta2) and (s11, s12, s22).
    """
    s11, s12, s22 = s[0][0], s[0][1], s[1][1]
    if s22 <= 0 or s11 - s12 * s12 / s22 <= 0:
        raise ValueError("the genetic covariance is not positive definite")
    b = math.sqrt(s22)
    r = s11 - s12 * s12 / s22
    ar, q = math.sqrt(r), s12 / s22
    b1, b2, x = F.col("beta1"), F.col("beta2"), F.col("var_snp")
    beta_f, beta_r = b2 / b, (b1 - q * b2) / ar
    # covariance of the two estimates: standard errors scaled by the intercepts
    floor = [[max(i[0][0], 1.0), i[0][1]], [i[1][0], max(i[1][1], 1.0)]]
    v11 = F.col("se1") * F.col("se1") * floor[0][0]
    v22 = F.col("se2") * F.col("se2") * floor[1][1]
    v12 = F.col("se1") * F.col("se2") * floor[0][1]
    # partial derivatives
    gf = (F.lit(0.0), F.lit(1 / b), F.lit(0.0), F.lit(0.0), -b2 / (2 * b * s22))
    numerator = b1 - q * b2
    dr = {"s11": 1.0, "s12": -2 * q, "s22": q * q}
    gr = (
        F.lit(1 / ar), F.lit(-q / ar), -numerator / (2 * ar * r) * dr["s11"],
        -b2 / (s22 * ar) - numerator / (2 * ar * r) * dr["s12"], b2 * q / (s22 * ar) - numerator / (2 * ar * r) * dr["s22"],
    )

    def variance(g: tuple[Column, ...]) -> Column:
        snp = g[0] * g[0] * v11 + 2 * g[0] * g[1] * v12 + g[1] * g[1] * v22
        for a in range(3):
            for c in range(3):
                snp = snp + g[2 + a] * g[2 + c] * float(v[a][c])
        return snp

    out = df.withColumns({"beta_f": beta_f, "se_f": F.sqrt(variance(gf)), "beta_r": beta_r, "se_r": F.sqrt(variance(gr))})
    return out.withColumns({"neff_f": 1 / (x * F.col("se_f") * F.col("se_f")), "neff_r": 1 / (x * F.col("se_r") * F.col("se_r"))})


def liability_conversion(sample_prevalence: float | None, population_prevalence: float | None) -> float:
    """Factor to the liability scale; 1 for a quantitative trait."""
    return 1.0 if population_prevalence is None or sample_prevalence is None else liability_factor(population_prevalence, sample_prevalence)


def multi_trait(df: DataFrame, traits: Sequence[str], n_snps: int, m: float, n_blocks: int = 200) -> tuple[list[list[float]], list[list[float]], list[list[float]]]:
    """(S, V, I) of k traits from (ordinal, ld, z.<trait>, n.<trait>): genetic covariance, its sampling covariance, intercepts.

    All k (k + 1) / 2 regressions are sums of one aggregation over blocks; k and the blocks are few, so the driver solves them.
    """
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(traits) for b in traits[i:]]
    d = df
    means = {}
    aggs = []
    for t in traits:
        chi = F.col(f"`z.{t}`") * F.col(f"`z.{t}`")
        aggs += [F.avg(chi).alias(f"c_{t}"), F.avg(F.col("ld") * F.col(f"`n.{t}`")).alias(f"l_{t}"), F.avg(f"`n.{t}`").alias(f"n_{t}")]
    row = d.agg(*aggs).first()
    for t in traits:
        means[t] = (min(max(m * (row[f"c_{t}"] - 1) / row[f"l_{t}"], 0.0), 1.0), row[f"n_{t}"])
    d = d.withColumn("block", block_of(F.col("ordinal"), n_snps, n_blocks))
    sums = []
    x, oc = F.col("ld"), 1 / F.greatest(F.col("ld"), F.lit(1.0))
    for k, (a, b) in enumerate(pairs):
        ha, hb = (_het(F.lit(means[t][0]), F.col(f"`n.{t}`"), m) for t in (a, b))
        w = ha * oc if a == b else oc * (F.sqrt(ha) + F.sqrt(hb)) * (F.sqrt(ha) + F.sqrt(hb))
        y = F.col(f"`z.{a}`") * F.col(f"`z.{b}`")
        sums += [F.sum(w * x * x).alias(f"a{k}"), F.sum(w * x).alias(f"b{k}"), F.sum(w).alias(f"d{k}"), F.sum(w * x * y).alias(f"e{k}"), F.sum(w * y).alias(f"f{k}")]
    got = d.groupBy("block").agg(*sums).toPandas()  # n_blocks rows

    def solve(s):
        det = s["a"] * s["d"] - s["b"] ** 2
        return (s["d"] * s["e"] - s["b"] * s["f"]) / det, (s["a"] * s["f"] - s["b"] * s["e"]) / det

    size = len(traits)
    big_s, big_i, pseudo, scale = np.zeros((size, size)), np.zeros((size, size)), [], []
    for k, (a, b) in enumerate(pairs):
        part = {c: got[f"{c}{k}"].to_numpy() for c in SUMS}
        full, icpt = solve({c: v.sum() for c, v in part.items()})
        loo, _ = solve({c: v.sum() - v for c, v in part.items()})
        nbar = math.sqrt(means[a][1] * means[b][1])
        i, j = traits.index(a), traits.index(b)
        big_s[i, j] = big_s[j, i] = full / nbar * m
        big_i[i, j] = big_i[j, i] = icpt
        pseudo.append(n_blocks * full - (n_blocks - 1) * loo)
        scale.append(nbar * math.sqrt(n_blocks) / m)
    big_v = np.cov(np.array(pseudo)) / np.outer(scale, scale) if len(pairs) > 1 else np.array([[np.var(pseudo[0], ddof=1) / scale[0] ** 2]])
    return big_s.tolist(), big_v.tolist(), big_i.tolist()
