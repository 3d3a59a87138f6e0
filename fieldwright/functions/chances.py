"""Distributions: normal, gamma and copula pieces as expressions and numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polynomial approximation of the normal distribution (Abramowitz and Stegun 26.2.17).
AS_P, AS_B, AS_C = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.3989422804014327


def phi(x: Column) -> Column:
    """Standard normal distribution function, to about 7.5e-8."""
    t = 1 / (1 + AS_P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(AS_B):
        poly = (poly + b) * t
    tail = AS_C * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def phi_sql(x: str) -> str:
    t = f"(1.0e0 / (1.0e0 + {AS_P}e0 * abs({x})))"
    poly = "0.0e0"
    for b in reversed(AS_B):
        poly = f"(({poly} + ({b}e0)) * {t})"
    tail = f"({AS_C}e0 * exp(-({x}) * ({x}) / 2.0e0) * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0e0 - {tail} ELSE {tail} END)"


def gamma_shape(mean: Column, sd: Column) -> Column:
    return F.when((mean > 0) & (sd > 0), mean * mean / (sd * sd))


def gamma_scale(mean: Column, sd: Column) -> Column:
    return F.when((mean > 0) & (sd > 0), sd * sd / mean)


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_cdf(x: np.ndarray, shape) -> np.ndarray:
    """Regularised lower incomplete gamma, element by element: a series below shape + 1, a
    continued fraction above."""
    shape = np.asarray(shape, float)
    x, log_gamma, shape = np.broadcast_arrays(np.asarray(x, float), _log_gamma(shape), shape)
    return _gamma_cdf(x, shape, log_gamma)


def _gamma_cdf(x: np.ndarray, shape: np.ndarray, log_gamma: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape)
    low, high = (x > 0) & (x < shape + 1), x >= shape + 1
    if low.any():
        v, k = x[low], shape[low]
        term = total = 1 / k
        step = k
        for _ in range(1000):
            step = step + 1
            term = term * v / step
            total = total + term
            if (term < total * 1e-15).all():
                break
        out[low] = total * np.exp(k * np.log(v) - v - log_gamma[low])
    if high.any():
        v, k = x[high], shape[high]
        b, c = v + 1 - k, np.full(v.shape, 1e300)
        d = 1 / b
        h = d
        for i in range(1, 1000):
            a = -i * (i - k)
            b = b + 2
            d = 1 / (a * d + b)
            c = b + a / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-14).all():
                break
        out[high] = 1 - np.exp(k * np.log(v) - v - log_gamma[high]) * h
    return out


def gamma_ppf(p: np.ndarray, shape, scale) -> np.ndarray:
    """Gamma quantiles, element by element, by Newton steps on the distribution function; a step
    that leaves what is known to hold the quantile halves that instead."""
    shape = np.asarray(shape, float)
    p, log_gamma, shape, scale = np.broadcast_arrays(np.asarray(p, float), _log_gamma(shape), shape, np.asarray(scale, float))
    goal, k, lg = p.ravel(), shape.ravel(), log_gamma.ravel()
    with np.errstate(all="ignore"):
        # start: the normal quantile (Abramowitz and Stegun 26.2.23) of the cube root, or the density near 0
        t = np.sqrt(-2 * np.log(np.minimum(goal, 1 - goal)))
        z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
        z = np.where(goal < 0.5, -z, z)
        x = k * (1 - 1 / (9 * k) + z / (3 * np.sqrt(k))) ** 3
        near = np.exp((np.log(goal) + np.log(k) + lg) / k)
        x = np.where((x > 0.1 * k) & np.isfinite(x), x, near)
        x = np.where(goal <= 0, 0.0, np.where((x > 0) & np.isfinite(x), x, np.where(np.isfinite(k), k, np.nan)))
        low, high = np.zeros(x.shape), np.full(x.shape, np.inf)
        todo = np.flatnonzero((goal > 0) & np.isfinite(x))
        for _ in range(200):
            if not len(todo):
                break
            at, own = x[todo], k[todo]
            over = _gamma_cdf(at, own, lg[todo]) - goal[todo]
            lo, hi = np.where(over < 0, at, low[todo]), np.where(over >= 0, at, high[todo])
            low[todo], high[todo] = lo, hi
            step = over / np.exp((own - 1) * np.log(at) - at - lg[todo])
            step = step / np.maximum(1 - 0.5 * step * ((own - 1) / at - 1), 0.5)
            new = at - step
            mid = np.where(np.isfinite(hi), (lo + hi) / 2, 2 * at + 1)
            done = (np.abs(over) <= 3e-16) | (np.abs(step) <= 1e-13 * at) | (np.isfinite(hi) & (hi - lo <= 1e-15 * hi))
            x[todo] = np.where(done, at, np.where((new > lo) & (new < hi), new, mid))
            todo = todo[~done]
    return scale * x.reshape(p.shape)


def positive_semidefinite(matrix: np.ndarray) -> np.ndarray:
    """Nearest correlation-like matrix: negative eigenvalues clipped, diagonal back to one."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    clipped = (vectors * np.maximum(values, 1e-10)) @ vectors.T
    scale = np.sqrt(np.diag(clipped))
    return clipped / np.outer(scale, scale)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def equal_correlation(rho: float, k: int) -> tuple[float, float]:
    """(own, shared): own * e + shared * m has about variance 1 and correlation ``rho`` between any two of
    k, as ``positive_semidefinite`` leaves it, where e are independent normals.  From 0 on m is one
    more normal, below 0 the mean of all k."""
    if rho >= 0:
        rho = min(rho, 1.0)
        return math.sqrt(1 - rho), math.sqrt(rho)
    both, each = max(1 + (k - 1) * rho, 1e-10), 1 - rho  # eigenvalues: of the mean, of what differs from it
    size = math.sqrt(each + (both - each) / k)
    return math.sqrt(each) / size, (math.sqrt(both) - math.sqrt(each)) / size


def copula_draws(shapes, scales, correlation: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n joint gamma draws whose dependence is a Gaussian copula; rows are draws."""
    root = np.linalg.cholesky(positive_semidefinite(correlation))
    u = normal_cdf(np.random.default_rng(seed).standard_normal((n, len(shapes))) @ root.T)
    return np.column_stack([gamma_ppf(u[:, k], shapes[k], scales[k]) for k in range(len(shapes))])
