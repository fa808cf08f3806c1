"""Normal distribution as SQL text and as Columns, without leaving the JVM.

The functions return SQL expressions that Spark and DuckDB both run. erfc is
t * exp(-x^2 + P(t)) with t = 2 / (2 + x); P is a polynomial fitted at import time to the
exact function, so no table of coefficients is kept. The quantile is Wichura's AS 241.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQRT2 = math.sqrt(2.0)


def _log_scaled_erfc(x: float) -> float:
    """ln(erfc(x) * exp(x^2)) for x >= 0."""
    if x < 5:
        return math.log(math.erfc(x)) + x * x
    f = x
    for k in range(200, 0, -1):  # continued fraction
        f = x + (k / 2) / f
    return -math.log(f * math.sqrt(math.pi))


@functools.cache
def _polynomial(degree: int = 26) -> tuple[float, ...]:
    """P(t) in powers of 2t - 1, fitted on t in (0, 1]."""
    n = 400
    y = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    t = (y + 1) / 2
    p = [_log_scaled_erfc(2 / v - 2) - math.log(v) for v in t]
    fit = np.polynomial.chebyshev.Chebyshev.fit(y, p, degree, domain=[-1, 1])
    return tuple(np.polynomial.chebyshev.cheb2poly(fit.coef))


def erfc_sql(x: str) -> str:
    """Complementary error function; relative error about 1e-12 in either tail."""
    t = f"(2.0e0 / (2.0e0 + abs({x})))"
    y = f"(2.0e0 * {t} - 1.0e0)"
    p = _double(_polynomial()[-1])
    for c in reversed(_polynomial()[:-1]):
        p = f"({p} * {y} + {_double(c)})"
    upper = f"({t} * exp(-({x}) * ({x}) + {p}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {upper} ELSE 2.0e0 - {upper} END)"


def _double(c: float) -> str:
    r = repr(float(c))
    return r if "e" in r else r + "e0"


def norm_sf_sql(z: str) -> str:
    """P(Z > z)."""
    return f"(0.5e0 * {erfc_sql(f'(({z}) / {SQRT2!r}e0)')})"


def norm_two_sided_sql(z: str) -> str:
    """P(|Z| > |z|)."""
    return f"({erfc_sql(f'(abs({z}) / {SQRT2!r}e0)')})"


def norm_pdf_sql(z: str) -> str:
    return f"(exp(-0.5e0 * ({z}) * ({z})) / {math.sqrt(2 * math.pi)!r}e0)"


# AS 241 (PPND16), numerators and denominators from the constant term up.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(parts: tuple, r: str) -> str:
    def poly(c: tuple) -> str:
        out = _double(c[-1])
        for v in reversed(c[:-1]):
            out = f"({out} * {r} + {_double(v)})"
        return out

    return f"({poly(parts[0])} / {poly(parts[1])})"


def norm_ppf_sql(p: str) -> str:
    """Quantile for 0 < p < 1; null outside."""
    q = f"(({p}) - 0.5e0)"
    near = f"(0.180625e0 - {q} * {q})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1.0e0 - ({p}) END))"
    tail = f"(CASE WHEN {r} <= 5 THEN {_ratio(_MIDDLE, f'({r} - 1.6e0)')} ELSE {_ratio(_TAIL, f'({r} - 5.0e0)')} END)"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(_CENTRE, near)} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def norm_sf(column: str) -> Column:
    """P(Z > z) of a column named by SQL text."""
    return F.expr(norm_sf_sql(column))


def norm_pdf(column: str) -> Column:
    return F.expr(norm_pdf_sql(column))


def with_two_sided(df: DataFrame, z: str, name: str) -> DataFrame:
    """Adds P(|Z| > |z|) of an SQL expression.

    In stages, so that the terms a polynomial uses often are computed once and the generated code stays small.
    """
    horner = _double(_polynomial()[-1])
    for c in reversed(_polynomial()[:-1]):
        horner = f"({horner} * _e_y + {_double(c)})"
    staged = df.withColumn("_e_x", F.expr(f"abs({z}) / {SQRT2!r}e0")).withColumn("_e_t", F.expr("2.0e0 / (2.0e0 + _e_x)")).withColumn("_e_y", F.expr("2.0e0 * _e_t - 1.0e0"))
    return staged.withColumn(name, F.expr(f"_e_t * exp({horner} - _e_x * _e_x)")).drop("_e_x", "_e_t", "_e_y")


def with_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds the normal quantile of an SQL expression, null outside 0 < p < 1; in stages."""
    staged = df.withColumn("_q_p", F.expr(p)).withColumn("_q_q", F.expr("_q_p - 0.5e0"))
    staged = staged.withColumn("_q_r", F.expr("CASE WHEN _q_p > 0 AND _q_p < 1 THEN sqrt(-ln(CASE WHEN _q_q < 0 THEN _q_p ELSE 1.0e0 - _q_p END)) END"))
    staged = staged.withColumns({"_q_n": F.expr("0.180625e0 - _q_q * _q_q"), "_q_m": F.expr("_q_r - 1.6e0"), "_q_f": F.expr("_q_r - 5.0e0")})
    tail = f"(CASE WHEN _q_r <= 5 THEN {_ratio(_MIDDLE, '_q_m')} ELSE {_ratio(_TAIL, '_q_f')} END)"
    staged = staged.withColumns({"_q_c": F.expr(f"_q_q * {_ratio(_CENTRE, '_q_n')}"), "_q_t": F.expr(tail)})
    value = "CASE WHEN _q_r IS NULL THEN NULL WHEN abs(_q_q) <= 0.425e0 THEN _q_c WHEN _q_q < 0 THEN -_q_t ELSE _q_t END"
    return staged.withColumn(name, F.expr(value)).drop("_q_p", "_q_q", "_q_r", "_q_n", "_q_m", "_q_f", "_q_c", "_q_t")
