"""Special functions as Column expressions, and the same expressions as SQL text.

Neither Spark SQL nor the oracle has an error function, so the normal distribution is written
out as rational approximations. ``*_sql`` return text that both engines accept, and the Column
forms are made from that text, so the two cannot drift apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's rational approximations of erf and erfc (1969), fixed values.
ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
TAIL_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
TAIL_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
# Coefficients of M. J. Wichura's algorithm AS 241 (PPND16, 1988), fixed values.
PPF_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
PPF_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
PPF_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
PPF_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
PPF_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
PPF_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _poly(x: str, coefficients) -> str:
    """c0 + c1 x + c2 x^2 + ... by Horner's rule."""
    out = _num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {_num(c)})"
    return out


def phi_sql(z: str) -> str:
    """The standard normal distribution function of a SQL expression."""
    y = f"(abs({z}) / {_num(2**0.5)})"
    sq = f"({y} * {y})"
    near = f"({y} * {_poly(sq, (ERF_P[3], ERF_P[2], ERF_P[1], ERF_P[0], ERF_P[4]))} / {_poly(sq, (ERF_Q[3], ERF_Q[2], ERF_Q[1], ERF_Q[0], 1.0))})"
    middle = f"(exp(-{sq}) * {_poly(y, (*reversed(ERFC_P[:8]), ERFC_P[8]))} / {_poly(y, (*reversed(ERFC_Q), 1.0))})"
    inverse = f"(1.0 / greatest({sq}, {_num(1.0)}))"
    rational = f"({inverse} * {_poly(inverse, (*reversed(TAIL_P[:5]), TAIL_P[5]))} / {_poly(inverse, (*reversed(TAIL_Q), 1.0))})"
    far = f"(exp(-{sq}) * ({_num(0.5641895835477563)} - {rational}) / greatest({y}, {_num(1.0)}))"
    upper = f"(CASE WHEN {y} <= 0.46875 THEN 1.0 - {near} WHEN {y} <= 4.0 THEN {middle} ELSE {far} END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) > 0 THEN 1.0 - 0.5 * {upper} ELSE 0.5 * {upper} END)"


def density_sql(z: str) -> str:
    return f"(exp(-0.5 * ({z}) * ({z})) * {_num(0.3989422804014327)})"


def phi_inverse_sql(p: str) -> str:
    """The standard normal quantile of a SQL expression in (0, 1); null elsewhere."""
    q = f"(({p}) - 0.5)"
    r0 = f"({_num(0.180625)} - {q} * {q})"
    centre = f"({q} * {_poly(r0, PPF_A)} / {_poly(r0, PPF_B)})"
    r = f"sqrt(-ln(least(({p}), 1.0 - ({p}))))"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {_poly(f'({r} - 1.6)', PPF_C)} / {_poly(f'({r} - 1.6)', PPF_D)} ELSE {_poly(f'({r} - 5.0)', PPF_E)} / {_poly(f'({r} - 5.0)', PPF_F)} END)"
    return f"(CASE WHEN ({p}) <= 0.0 OR ({p}) >= 1.0 THEN NULL WHEN abs({q}) <= 0.425 THEN {centre} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def t_cdf_sql(t: str, dof: int) -> str:
    """Student's t distribution function for a whole number of degrees of freedom: the finite
    trigonometric series (Abramowitz and Stegun 26.7.3-4), which is exact."""
    if dof < 1:
        raise ValueError("degrees of freedom must be positive")
    theta = f"atan(({t}) / {_num(dof**0.5)})"
    c2, term, terms = f"power(cos({theta}), 2)", 1.0, []
    if dof % 2:
        for i in range((dof - 1) // 2):
            terms.append(f"{_num(term)} * power({c2}, {i})")
            term *= (2 * i + 2) / (2 * i + 3)
        series = " + ".join(terms)
        area = f"({theta}" + (f" + sin({theta}) * cos({theta}) * ({series})" if terms else "") + f") * {_num(2 / 3.141592653589793)}"
    else:
        for i in range(dof // 2):
            terms.append(f"{_num(term)} * power({c2}, {i})")
            term *= (2 * i + 1) / (2 * i + 2)
        area = f"sin({theta}) * ({' + '.join(terms)})"
    return f"(0.5 + 0.5 * ({area}))"


def phi(column: str) -> Column:
    return F.expr(phi_sql(column))


def phi_inverse(column: str) -> Column:
    return F.expr(phi_inverse_sql(column))


def density(column: str) -> Column:
    return F.expr(density_sql(column))


def t_cdf(column: str, dof: int) -> Column:
    return F.expr(t_cdf_sql(column, dof))


def gamma_p(a, x):
    """The regularised lower incomplete gamma function of arrays or numbers: series below a + 1,
    else Lentz's continued fraction. Not a number where a is not positive or x is negative."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    with np.errstate(invalid="ignore"):
        fine = (a > 0) & (x >= 0)
    out[fine & (x == 0)] = 0.0
    shapes, which = np.unique(a, return_inverse=True)
    log_gamma = np.array([math.lgamma(v) if v > 0 else np.nan for v in shapes])[which].reshape(a.shape)
    small, large = fine & (x > 0) & (x < a + 1), fine & (x >= a + 1) & np.isfinite(x)
    out[fine & np.isinf(x)] = 1.0
    front = lambda at: np.exp(a[at] * np.log(x[at]) - x[at] - log_gamma[at])
    if small.any():
        n, v = a[small].copy(), x[small]
        term = 1.0 / n
        total = term.copy()
        while (term > total * 1e-16).any():
            n += 1
            term *= v / n
            total += term
        out[small] = np.minimum(1.0, front(small) * total)
    if large.any():
        b, k = x[large] + 1 - a[large], a[large]
        c, d = np.full(b.shape, 1e300), 1.0 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - k)
            b += 2
            d, c = an * d + b, b + an / c
            d = 1.0 / np.where(np.abs(d) > 1e-300, d, 1e-300)
            c = np.where(np.abs(c) > 1e-300, c, 1e-300)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[large] = np.maximum(0.0, 1.0 - front(large) * h)
    return out if out.shape else float(out)


def gamma_quantile(a, p):
    """The x at which ``gamma_p(a, x)`` is p, for arrays or numbers: bisection of logarithms,
    from the leading term of the series, which lies below, to a doubled bound above."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    with np.errstate(invalid="ignore"):
        fine = (a > 0) & (p >= 0) & (p < 1)
    k, q = a[fine], p[fine]
    shapes, which = np.unique(k, return_inverse=True)
    log_gamma = np.array([math.lgamma(v + 1) for v in shapes])[which].reshape(k.shape)
    low = np.exp(np.maximum((np.log(np.maximum(q, 1e-300)) + log_gamma) / k, -690.0))
    high = np.maximum(k + 10 * np.sqrt(k) + 10, low)
    while (short := gamma_p(k, high) < q).any():
        high = np.where(short, high * 2, high)
    for _ in range(80):
        mid = np.sqrt(low * high)
        under = gamma_p(k, mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    out = np.full(a.shape, np.nan)
    out[fine] = np.where(q > 0, np.sqrt(low * high), 0.0)
    return out if out.shape else float(out)


def _positive(shape: Column, scale: Column) -> Column:
    return (shape > 0) & (scale > 0)


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    """The gamma distribution function; missing where an argument is missing or not positive."""

    @F.pandas_udf("double")
    def law(x: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series(gamma_p(shape.to_numpy(float), x.clip(lower=0.0).to_numpy(float)))

    fine = x.isNotNull() & _positive(shape, scale)
    return F.when(fine, law(F.when(fine, x / scale), F.when(fine, shape)))


def gamma_ppf(p: Column, shape: Column, scale: Column) -> Column:
    """The gamma quantile function for 0 <= p < 1; missing where an argument is missing or out of range."""

    @F.pandas_udf("double")
    def law(p: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series(gamma_quantile(shape.to_numpy(float), p.to_numpy(float)))

    fine = (p >= 0) & (p < 1) & _positive(shape, scale)
    return F.when(fine, law(F.when(fine, p), F.when(fine, shape)) * scale)


def gamma_to_normal(x: Column, shape: Column, scale: Column) -> Column:
    """The standard normal score of a gamma value; probabilities are kept 1e-6 from 0 and 1.
    Missing where an argument is missing, or a parameter not positive."""

    @F.pandas_udf("double")
    def score(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
        p = gamma_p(shape.to_numpy(float), (x.clip(lower=0.0) / scale.where(scale > 0)).to_numpy(float)).clip(1e-6, 1 - 1e-6)
        # |z| squared over 2 follows a gamma law of shape 1/2.
        return pd.Series(np.sign(p - 0.5) * np.sqrt(2 * gamma_quantile(0.5, np.abs(2 * p - 1))))

    return score(x, shape, scale)


def normal_to_gamma(z: Column, shape: Column, scale: Column) -> Column:
    """The gamma value of a standard normal score, with probabilities and missing values as above."""

    @F.pandas_udf("double")
    def value(z: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
        v = z.to_numpy(float)
        p = ((1 + np.sign(v) * gamma_p(0.5, v * v / 2)) / 2).clip(1e-6, 1 - 1e-6)
        return pd.Series(gamma_quantile(shape.to_numpy(float), p)) * scale.where(scale > 0)

    return value(z, shape, scale)
