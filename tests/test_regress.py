"""Regression kernels against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import causality as lcv
from varloom.operators import regress as reg


def test_blocks(spark):
    for n, nb in ((1000, 50), (997, 200), (20, 20), (21, 20)):
        b = reg.block_bounds(n, nb)
        assert b[0][0] == 0 and b[-1][1] == n and all(x[1] == y[0] for x, y in zip(b, b[1:], strict=False))
        assert b[1][0] == int(np.floor(np.linspace(1, n, nb + 1)[1])) - 1
        got = [r["k"] for r in spark.range(n).select(reg.block_of(F.col("id"), n, nb).alias("k")).collect()]
        assert got == [next(i for i, (s, e) in enumerate(b) if s <= k < e) for k in range(n)]
    with pytest.raises(ValueError):
        reg.block_bounds(5, 6)


def wls(w, x, y):
    a, b, d, e, f = (w * x * x).sum(), (w * x).sum(), w.sum(), (w * x * y).sum(), (w * y).sum()
    det = a * d - b * b
    return (d * e - b * f) / det, (a * f - b * e) / det


def data(n=2000, seed=1):
    rng = np.random.default_rng(seed)
    ld = rng.uniform(0.5, 60, n)
    z1 = rng.normal(size=n) * np.sqrt(1 + 0.02 * ld)
    z2 = 0.4 * z1 + rng.normal(size=n) * np.sqrt(1 + 0.02 * ld)
    return ld, z1, z2


def test_heritability(spark):
    ld, z1, _ = data()
    chi, n, m, nb = z1**2, 1e4, 1e5, 20
    chi[5], chi[9] = 200.0, np.nan
    d = spark.createDataFrame([("p", i, float(a), float(b), n) for i, (a, b) in enumerate(zip(ld, chi, strict=True))], "protein string, ordinal int, ld double, chi2 double, n double")
    got = reg.heritability(d, ["protein"], len(ld), m, nb).first()
    keep = np.isfinite(chi) & (chi <= max(0.001 * n, 80))
    tot = min(max(m * (chi[keep].mean() - 1) / (ld[keep] * n).mean(), 0), 1)
    w = np.where(keep, 1 / (2 * (1 + tot * n / m * np.maximum(ld, 1)) ** 2) / np.maximum(ld, 1), 0)
    y = np.where(keep, chi, 0)
    slope, icpt = wls(w, ld, y)
    loo = np.array([wls(np.r_[w[:s], w[e:]], np.r_[ld[:s], ld[e:]], np.r_[y[:s], y[e:]])[0] for s, e in reg.block_bounds(len(ld), nb)])
    pseudo = nb * slope - (nb - 1) * loo
    assert got["h2"] == pytest.approx(slope / n * m, rel=1e-9)
    assert got["intercept"] == pytest.approx(icpt, rel=1e-9)
    assert got["h2_se"] == pytest.approx(math.sqrt(pseudo.var(ddof=1)) / (n * math.sqrt(nb) / m), rel=1e-9)
    assert got["n_kept"] == keep.sum() and got["lambda_gc"] == pytest.approx(np.median(chi[keep]) / reg.CHI2_MEDIAN, rel=1e-2)


def test_genetic_correlation(spark):
    ld, z1, z2 = data()
    n, m, nb = 1e4, 1e5, 20
    d = spark.createDataFrame([("p", i, float(a), float(b), n, float(c), n) for i, (a, b, c) in enumerate(zip(ld, z1, z2, strict=True))], "p string, ordinal int, ld double, z_t double, n_t double, z_p double, n_p double")
    got = reg.genetic_correlation(d, ["p"], len(ld), m, nb).first()
    h, oc = [], 1 / np.maximum(ld, 1)
    for z in (z1, z2):
        tot = min(max(m * ((z**2).mean() - 1) / (ld * n).mean(), 0), 1)
        h.append(1 / (2 * (1 + tot * n / m * np.maximum(ld, 1)) ** 2))
    parts = [(h[0] * oc, z1**2), (h[1] * oc, z2**2), (oc * (np.sqrt(h[0]) + np.sqrt(h[1])) ** 2, z1 * z2)]

    def rg(keep):
        a, b, c = (wls(w[keep], ld[keep], y[keep])[0] / n * m for w, y in parts)
        return c / math.sqrt(a * b)

    every = np.ones(len(ld), bool)
    loo = []
    for s, e in reg.block_bounds(len(ld), nb):
        k = every.copy()
        k[s:e] = False
        loo.append(rg(k))
    se = math.sqrt((nb - 1) / nb * ((np.array(loo) - np.mean(loo)) ** 2).sum())
    assert got["rg"] == pytest.approx(rg(every), rel=1e-9) and got["rg_se"] == pytest.approx(se, rel=1e-9)
    assert got["p"] == pytest.approx(math.erfc(abs(got["rg"] / se) / math.sqrt(2)), rel=1e-9)


def test_multi_trait_agrees_with_pair(spark):
    ld, z1, z2 = data()
    n, m, nb = 1e4, 1e5, 20
    d = spark.createDataFrame([(i, float(a), float(b), n, float(c), n) for i, (a, b, c) in enumerate(zip(ld, z1, z2, strict=True))], "ordinal int, ld double, `z.a` double, `n.a` double, `z.b` double, `n.b` double")
    s, v, i = reg.multi_trait(d, ["a", "b"], len(ld), m, nb)
    one = reg.genetic_correlation(d.select(F.lit("p").alias("p"), "ordinal", "ld", F.col("`z.a`").alias("z_t"), F.col("`n.a`").alias("n_t"), F.col("`z.b`").alias("z_p"), F.col("`n.b`").alias("n_p")), ["p"], len(ld), m, nb).first()
    assert s[0][1] == pytest.approx(one["gcov"], rel=1e-9) and s[0][0] == pytest.approx(one["h2_t"], rel=1e-9) and s[1][1] == pytest.approx(one["h2_p"], rel=1e-9)
    assert len(v) == 3 and v[0][1] == pytest.approx(v[1][0])


def test_subtraction_delta_method(spark):
    s, i = [[0.4, 0.1], [0.1, 0.3]], [[1.05, 0.2], [0.2, 1.1]]
    v = [[1e-3, 2e-4, 1e-4], [2e-4, 8e-4, 1e-4], [1e-4, 1e-4, 9e-4]]
    x = (0.03, -0.02, 0.01, 0.02, 0.4)
    got = reg.subtraction(spark.createDataFrame([x], "beta1 double, beta2 double, se1 double, se2 double, var_snp double"), s, v, i).first()

    def effects(p):
        b1, b2, s11, s12, s22 = p
        b = math.sqrt(s22)
        af = s12 / b
        return np.array([b2 / b, (b1 - af / b * b2) / math.sqrt(s11 - af**2)])

    p = np.array([x[0], x[1], 0.4, 0.1, 0.3])
    jac = np.array([(effects(p + e) - effects(p - e)) / 2e-6 for e in np.eye(5) * 1e-6]).T
    cov = np.zeros((5, 5))
    cov[:2, :2] = [[x[2] ** 2 * 1.05, x[2] * x[3] * 0.2], [x[2] * x[3] * 0.2, x[3] ** 2 * 1.1]]
    cov[2:, 2:] = v
    want = np.sqrt(np.diag(jac @ cov @ jac.T))
    assert (got["beta_f"], got["beta_r"]) == pytest.approx(tuple(effects(p)))
    assert (got["se_f"], got["se_r"]) == pytest.approx(tuple(want), rel=1e-5)
    assert got["neff_f"] == pytest.approx(1 / (0.4 * want[0] ** 2), rel=1e-5)
    with pytest.raises(ValueError):
        reg.subtraction(spark.createDataFrame([x], "beta1 double, beta2 double, se1 double, se2 double, var_snp double"), [[0.1, 0.3], [0.3, 0.3]], v, i)


def test_munge_and_standardise(spark):
    schema = "SNP string, A1 string, A2 string, effect double, P double, N double, MAF double, INFO double"
    d = spark.createDataFrame([("r1", "a", "g", 0.1, 0.05, 100.0, 0.9, 1.0), ("r2", "G", "A", 0.1, 0.05, math.nan, 0.3, 1.0), ("r3", "A", "G", None, 0.05, 100.0, 0.3, 1.0), ("r4", "A", "C", 0.1, 0.05, 100.0, 0.3, 1.0), ("r5", "G", "A", 0.1, 0.05, 100.0, 0.3, 0.5), ("r6", "G", "A", 0.2, 0.05, 100.0, 0.3, 1.0), ("r7", "AT", "A", 0.2, 0.05, 100.0, 0.3, 1.0)], schema)
    ref = spark.createDataFrame([(f"r{i}", "A", "G", 0.2) for i in range(1, 8)], "SNP string, A1 string, A2 string, MAF double")
    m = {r["SNP"]: r for r in reg.munge(d, ref).collect()}
    assert set(m) == {"r1", "r6"} and m["r1"]["Z"] == pytest.approx(1.959964, rel=1e-6) and m["r6"]["Z"] == pytest.approx(-1.959964, rel=1e-6)
    assert {r["N"] for r in reg.munge(d, ref, n=50.0).collect()} == {50.0}
    with pytest.raises(ValueError):
        reg.munge(d.withColumn("effect", F.lit(1.02)), ref)
    s = {r["SNP"]: r for r in reg.standardise(d.drop("INFO"), ref).collect()}
    assert s["r6"]["beta"] == pytest.approx(-1.959964 / math.sqrt(100 * 2 * 0.3 * 0.7), rel=1e-6) and s["r6"]["se"] == pytest.approx(1 / math.sqrt(100 * 0.42), rel=1e-9)
    assert reg.filter_reference(ref, 0.3).count() == 0


def naive_moments(ld, a, b, t):
    w = 1 / np.maximum(1, ld)

    def trait(z):
        c = z**2
        k = c <= t * c.mean()
        i = wls(w[k], ld[k], c[k])[1]
        return (w * ld * (c - i)).sum() / (w * ld * ld).sum(), i

    (h1, i1), (h2, i2) = trait(a), trait(b)
    k = (a**2 < t * (a**2).mean()) & (b**2 < t * (b**2).mean())
    ic = wls(w[k], ld[k], (a * b)[k])[1]
    rho = (w * ld * (a * b - ic)).sum() / (w * ld * ld).sum() / math.sqrt(h1 * h2)
    mean = lambda x: (w * x).sum() / w.sum()
    s1, s2 = math.sqrt(mean(a**2) - i1), math.sqrt(mean(b**2) - i2)
    x, y = a / s1, b / s2
    k1 = mean(y * x**3 - 3 * x * y * i1 / s1**2 - 3 * (x**2 - i1 / s1**2) * ic / (s1 * s2))
    k2 = mean(x * y**3 - 3 * x * y * i2 / s2**2 - 3 * (y**2 - i2 / s2**2) * ic / (s1 * s2))
    return rho, k1, k2


def test_causality(spark):
    ld, a, b = data(1050, 5)
    d = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(ld, a, b, strict=True))], "ordinal int, ld double, z1 double, z2 double")
    got = lcv.jackknife(d, len(ld), 10, threshold=4.0)
    assert tuple(got.loc[0, ["rho", "kappa1", "kappa2"]]) == pytest.approx(naive_moments(ld, a, b, 4.0), rel=1e-8)
    out = np.r_[0:105 * 9]
    assert tuple(got.loc[10, ["rho", "kappa1", "kappa2"]]) == pytest.approx(naive_moments(ld[out], a[out], b[out], 4.0), rel=1e-8)
    p = lcv.posterior(got)
    assert -1 <= p["gcp_mean"] <= 1 and 0 <= p["p_gcp_zero"] <= 1
    assert lcv.t_cdf(-2.0, 10) == pytest.approx(0.0366940173853702, rel=1e-9) and lcv.t_pdf(0.0, 5) == pytest.approx(0.3796066898224944, rel=1e-9)


def test_causality_undefined(spark):
    d = spark.createDataFrame([(i, 1.0 + i % 7, 0.1 * (i % 3), 0.1) for i in range(60)], "ordinal int, ld double, z1 double, z2 double")
    got = lcv.jackknife(d, 60, 5)
    assert got["rho"].isna().any()
    with pytest.raises(ValueError):
        lcv.posterior(got)
