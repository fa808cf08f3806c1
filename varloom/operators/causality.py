"""Latent causal variable model: jackknife moments from distributed sums, posterior on the driver.

Moments of every leave-one-block-out set are needed, and which variants enter the intercept
depends on that set's mean chi-squared. Three passes give additive sums: block means; per
left-out block the sums of the intercept regressions; everything else is polynomial in the
z-scores and comes from sums per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.regress import even_block_of

POWERS = ("w", "wll", "w11", "w22", "w12", "w1112", "w1222", "wl", "wl11", "wl22", "wl12")


def block_moments(df: DataFrame, n_snps: int, n_blocks: int) -> pd.DataFrame:
    """Sums per block of weighted products of (ld, z1, z2), weight 1 / max(1, ld)."""
    w, l, a, b = 1 / F.greatest(F.col("ld"), F.lit(1.0)), F.col("ld"), F.col("z1"), F.col("z2")
    terms = {"w": w, "wll": w * l * l, "w11": w * a * a, "w22": w * b * b, "w12": w * a * b, "w1112": w * a * a * a * b, "w1222": w * a * b * b * b, "wl": w * l, "wl11": w * l * a * a, "wl22": w * l * b * b, "wl12": w * l * a * b}
    d = df.withColumn("block", even_block_of(F.col("ordinal"), n_snps, n_blocks))
    return d.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("s11"), F.sum(b * b).alias("s22"), *(F.sum(v).alias(k) for k, v in terms.items())).toPandas().sort_values("block").reset_index(drop=True)


def intercept_sums(df: DataFrame, n_snps: int, n_blocks: int, limits: np.ndarray) -> dict[str, np.ndarray]:
    """Five regression sums per subset (row of limits: left-out block or -1, chi2 limit of trait 1 and 2) for traits 1, 2 and cross."""
    carried = df.sparkSession.sparkContext.broadcast(limits)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = carried.value
        total = np.zeros((len(rows), 3, 5))
        for f in frames:
            ld, a, b, block = (f[c].to_numpy(np.float64) for c in ("ld", "z1", "z2", "block"))
            w = 1 / np.maximum(ld, 1)
            for k, (out, t1, t2) in enumerate(rows):
                inside = block != out
                for q, (keep, y) in enumerate(((a * a <= t1, a * a), (b * b <= t2, b * b), ((a * a < t1) & (b * b < t2), a * b))):
                    ww = np.where(inside & keep, w, 0.0)
                    total[k, q] += (ww @ (ld * ld), ww @ ld, ww.sum(), ww @ (ld * y), ww @ y)
        k, q, s = np.indices(total.shape)
        yield pd.DataFrame({"k": k.ravel(), "q": q.ravel(), "s": s.ravel(), "v": total.ravel()})

    d = df.select("ld", "z1", "z2", even_block_of(F.col("ordinal"), n_snps, n_blocks).alias("block"))
    got = d.mapInPandas(part, "k int, q int, s int, v double").groupBy("k", "q", "s").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((len(limits), 3, 5))
    out[got["k"], got["q"], got["s"]] = got["v"]
    return out


def _moments(t: dict[str, float], sums: np.ndarray) -> tuple[float, float, float]:
    """(rho, kappa1, kappa2) of a subset from its totals and intercept sums; NaN where a heritability or a scale is not above 0."""
    undefined = (math.nan, math.nan, math.nan)
    if not len(sums) or any(s[0] * s[2] - s[1] ** 2 <= 0 for s in sums) or t["wll"] <= 0:
        return undefined

    def icpt(s):
        return (s[0] * s[4] - s[1] * s[3]) / (s[0] * s[2] - s[1] ** 2)

    i1, i2, ic = (icpt(s) for s in sums)
    h1, h2, hc = ((t[f"wl{k}"] - i * t["wl"]) / t["wll"] for k, i in (("11", i1), ("22", i2), ("12", ic)))
    if h1 <= 0 or h2 <= 0 or t["w11"] / t["w"] <= i1 or t["w22"] / t["w"] <= i2:
        return undefined
    rho = hc / math.sqrt(h1 * h2)
    s1, s2 = math.sqrt(t["w11"] / t["w"] - i1), math.sqrt(t["w22"] / t["w"] - i2)
    e = {k: t[k] / t["w"] for k in ("w11", "w22", "w12", "w1112", "w1222")}
    cross, joint = e["w12"] / (s1 * s2), ic / (s1 * s2)
    k1 = e["w1112"] / (s1**3 * s2) - 3 * cross * i1 / s1**2 - 3 * (e["w11"] - i1) / s1**2 * joint
    k2 = e["w1222"] / (s1 * s2**3) - 3 * cross * i2 / s2**2 - 3 * (e["w22"] - i2) / s2**2 * joint
    return rho, k1, k2


def jackknife(df: DataFrame, n_snps: int, n_blocks: int = 100, threshold: float = 30.0) -> pd.DataFrame:
    """rho, kappa1, kappa2 for the whole set (left_out -1) and every set without one block. df: (ordinal, ld, z1, z2)."""
    blocks = block_moments(df, n_snps, n_blocks)
    keys = ["n", "s11", "s22", *POWERS]
    total = blocks[keys].sum()
    sets = [(-1, total)] + [(int(b), total - blocks.loc[i, keys]) for i, b in enumerate(blocks["block"])]
    limits = np.array([(b, threshold * t["s11"] / t["n"], threshold * t["s22"] / t["n"]) for b, t in sets])
    sums = intercept_sums(df, n_snps, n_blocks, limits)
    return pd.DataFrame([(b, *_moments(t, sums[k])) for k, (b, t) in enumerate(sets)], columns=["left_out", "rho", "kappa1", "kappa2"])


def t_pdf(x: float, df: float) -> float:
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


def t_cdf(x: float, df: float) -> float:
    """By the continued fraction of the incomplete beta function."""
    v = df / (df + x * x)
    tail = 0.5 * _betainc(df / 2, 0.5, v)
    return tail if x <= 0 else 1 - tail


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(1, 800):
        k = i // 2
        step = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front / f


def posterior(estimates: pd.DataFrame) -> dict[str, float]:
    """Posterior of the causality proportion on a grid of 201 values, from leave-one-out estimates."""
    e = estimates[estimates["left_out"] >= 0]
    if e[["rho", "kappa1", "kappa2"]].isna().any().any():
        raise ValueError("a leave-one-out estimate is undefined: a heritability is not above 0")
    rho = e["rho"].to_numpy()
    k1, k2 = (e[c].to_numpy() - 3 * rho for c in ("kappa1", "kappa2"))
    nb = len(e)
    grid = np.arange(-100, 101) / 100.0
    weights, at = np.zeros(len(grid)), {}
    for j, x in enumerate(grid):
        f = np.abs(rho) ** -x
        ratio = (k1 / f - f * k2) / np.maximum(1 / np.abs(rho), np.sqrt(k1**2 / f**2 + k2**2 * f**2))
        stat = ratio.mean() / ratio.std(ddof=1) / math.sqrt(nb + 1)
        weights[j] = t_pdf(stat, nb - 2)
        at[round(float(x), 2)] = stat
    sign = math.copysign(1, rho.mean())
    mean = float((grid * weights).sum() / weights.sum())
    return {
        "rho": float(rho.mean()), "rho_se": float(rho.std(ddof=1) * math.sqrt(nb + 1)), "gcp_mean": mean,
        "gcp_sd": float(math.sqrt(((grid - mean) ** 2 * weights).sum() / weights.sum())), "z_gcp_zero": sign * at[0.0],
        "p_gcp_zero": 2 * t_cdf(-abs(at[0.0]), nb - 1), "p_full_forward": t_cdf(sign * at[1.0], nb - 2), "p_full_backward": t_cdf(-sign * at[-1.0], nb - 2),
    }
