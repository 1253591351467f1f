"""Link functions, ordinal transforms, log-likelihood and log-prior terms, md5 uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from tidegrid.functions.missing import as_col

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def inv_logit(x: Column | str) -> Column:
    return F.lit(1.0) / (F.exp(-as_col(x)) + 1.0)


def log1p_exp(x: Column | str) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    x = as_col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sum_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_gamma(z: Column | str) -> Column:
    """ln Gamma(z), z > 0: argument shifted up by 8, then the Stirling series (error < 1e-11)."""
    z = as_col(z)
    shift = F.lit(0.0)
    for pair in range(4):
        shift = shift + F.log((z + 2.0 * pair) * (z + (2.0 * pair + 1)))
    w = z + 8.0
    i2 = F.lit(1.0) / (w * w)
    series = ((((i2 / 1188.0 - 1 / 1680.0) * i2 + 1 / 1260.0) * i2 - 1 / 360.0) * i2 + 1 / 12.0) / w
    return (w - 0.5) * F.log(w) - w + HALF_LOG_2PI + series - shift


# --- ordinal scale -----------------------------------------------------------------------


def ordinal_expected(x: Column, cuts: Column, weights: list[float]) -> Column:
    """Expected count of an ordered-logit outcome with K = len(weights) levels.

    Written as ``w_K - sum_k (w_{k+1} - w_k) * P(level <= k)``, the summation by parts of
    ``sum_k w_k P(level = k)``: one inverse logit per cutpoint and no differences of
    probabilities.
    """
    out = F.lit(float(weights[-1]))
    for k in range(len(weights) - 1):
        step = float(weights[k + 1] - weights[k])
        out = out - inv_logit(F.element_at(cuts, k + 1) - x) * step
    return out


def ordinal_probabilities(x: Column, cuts: Column, levels: int) -> list[Column]:
    """P(level = k) for k = 1..levels."""
    below = [inv_logit(F.element_at(cuts, k) - x) for k in range(1, levels)]
    return [below[0]] + [below[k] - below[k - 1] for k in range(1, levels - 1)] + [1.0 - below[-1]]


def ordinal_draw(u: Column, x: Column, cuts: Column, levels: int) -> Column:
    """Inverse-CDF draw of an ordered-logit level (1-based) from a uniform."""
    out = F.lit(1)
    for k in range(1, levels):
        out = out + (u > inv_logit(F.element_at(cuts, k) - x)).cast("int")
    return out


# --- log-likelihoods ---------------------------------------------------------------------


def loglik_bernoulli(y: Column, eta: Column) -> Column:
    return -log1p_exp(F.when(y == 1, -eta).otherwise(eta))


def loglik_ordinal(level: Column, eta: Column, cuts: Column, levels: int) -> Column:
    """ln P(level) as a log-difference of two logistic CDFs (stable in both tails)."""
    first = -log1p_exp(eta - F.element_at(cuts, 1))
    last = -log1p_exp(F.element_at(cuts, levels - 1) - eta)
    hi = F.try_element_at(cuts, level) - eta
    lo = F.try_element_at(cuts, level - 1) - eta
    # s(hi) - s(lo) = s(hi) * s(-lo) * (1 - e^(lo - hi))
    mid = -log1p_exp(-hi) - log1p_exp(lo) + F.log(-F.expm1(lo - hi))
    return F.when(level == 1, first).when(level == levels, last).otherwise(mid)


def loglik_negbin(y: Column, eta: Column, phi: Column) -> Column:
    """NB2 with log mean ``eta`` and dispersion ``phi``."""
    log_mu_phi = log_sum_exp(eta, F.log(phi))
    return (
        log_gamma(y + phi) - log_gamma(phi) - log_gamma(y + 1.0)
        + y * (eta - log_mu_phi)
        + phi * (F.log(phi) - log_mu_phi)
    )


def loglik_zinb(y: Column, count_loglik: Column, theta: Column) -> Column:
    """Zero-inflated count: ``theta`` is the logit of the extra-zero probability.

    ``count_loglik`` is the count part's own log-likelihood; give it as a column of an earlier
    projection, since it is used more than once here.
    """
    count_part = count_loglik - log1p_exp(theta)
    return F.when(y == 0, log_sum_exp(-log1p_exp(-theta), count_part)).otherwise(count_part)


# --- log-densities of the priors ---------------------------------------------------------


def logpdf_normal(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return z * z * -0.5 - (HALF_LOG_2PI + math.log(sd))


def logpdf_gamma(x: Column, shape: float, rate: float) -> Column:
    const = shape * math.log(rate) - math.lgamma(shape)
    return F.log(x) * (shape - 1) - x * rate + const


def logpdf_inv_gamma(x: Column, shape: float, scale: float) -> Column:
    const = shape * math.log(scale) - math.lgamma(shape)
    return F.log(x) * -(shape + 1) - F.lit(scale) / x + const


def sum_logpdf_std_normal(values: Column) -> Column:
    """Sum of standard-normal log densities over an array."""
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)
    return squares * -0.5 - F.size(values) * HALF_LOG_2PI


def logpdf_induced_dirichlet(cuts: Column, levels: int) -> Column:
    """Flat Dirichlet on the level probabilities implied by the cutpoints, anchored at 0.

    The flat Dirichlet density is Gamma(K); the log Jacobian determinant is
    ``ln K + sum_k ln(s_k (1 - s_k))`` with ``s_k = inv_logit(-c_k)``.
    """
    const = math.lgamma(levels) + math.log(levels)
    terms = F.aggregate(cuts, F.lit(0.0), lambda acc, c: acc - log1p_exp(c) - log1p_exp(-c))
    return terms + const


# --- reproducible uniforms ---------------------------------------------------------------


def md5_uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 over the parts joined by '|'.

    A pure function of its inputs: a recomputed task, a different partitioning or a different
    engine gives the same number.
    """
    cols = [as_col(p) if isinstance(p, (Column, str)) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    head = F.substring(F.md5(text), 1, 8)
    return F.conv(head, 16, 10).cast("long") / F.lit(4294967296.0)
