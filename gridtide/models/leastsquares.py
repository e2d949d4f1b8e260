"""Least squares from sums: the data is reduced to cross products, only those are solved in Python."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_sums(xs: Sequence[str], y: str) -> dict[str, str]:
    """The products whose sums make up the normal equations, named a_i_j, b_i, yy and n.

    Regressors and products are SQL text: there are many, and each is a plain product.
    """
    out = {f"a_{i}_{j}": f"({xs[i]}) * ({xs[j]})" for i in range(len(xs)) for j in range(i + 1)}
    out.update({f"b_{i}": f"({x}) * ({y})" for i, x in enumerate(xs)})
    out.update({"yy": f"({y}) * ({y})", "n": "1D"})
    return out


def complete(xs: Sequence[str], y: str) -> str:
    return " AND ".join(f"({c}) IS NOT NULL" for c in [y, *xs])


def normal_equations(df: DataFrame, xs: Sequence[str], y: str, by: Sequence[str]) -> DataFrame:
    """One row of sums per group, over the rows that have all values; sums combine before the shuffle."""
    products = cross_sums(xs, y)
    return df.filter(complete(xs, y)).groupBy(*by).agg(*(F.expr(f"sum({c})").alias(n) for n, c in products.items()))


def packed(k: int) -> list[Column]:
    """The summed columns as one lower triangle, one right side, yy and n."""
    triangle = ", ".join(f"a_{i}_{j}" for i in range(k) for j in range(i + 1))
    side = ", ".join(f"b_{i}" for i in range(k))
    return [F.expr(f"array({triangle}) AS xtx"), F.expr(f"array({side}) AS xty"), F.col("yy"), F.col("n")]


def unpack(xtx: np.ndarray, k: int) -> np.ndarray:
    full = np.zeros((k, k))
    full[np.tril_indices(k)] = xtx
    return full + np.tril(full, -1).T


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the inverse of the matrix, after scaling it to a unit diagonal."""
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
    return inverse @ b, inverse


def criteria(sse: float, n: float, k: int) -> tuple[float, float]:
    """AIC and BIC of a Gaussian regression up to a constant."""
    fit = n * np.log(max(sse, 1e-300) / n)
    return fit + 2 * k, fit + k * np.log(n)


FIT_TYPE = "coef array<double>, used array<int>, n double, sse double, aic double, bic double, t_first double"


def fit_subsets(subsets: Sequence[Sequence[int]], first: int = 0):
    """A function over summed rows: per row the subset of regressors with the lowest AIC.

    `coef` has a zero for each regressor left out. `t_first` is the t value of regressor `first`. A row
    with a `size` only takes subsets of so many regressors.
    """
    @F.pandas_udf(FIT_TYPE)
    def fit(xtx: pd.Series, xty: pd.Series, yy: pd.Series, n: pd.Series, size: pd.Series) -> pd.DataFrame:
        found = []
        for a_, b_, yy_, n_, size_ in zip(xtx, xty, yy, n, size):
            b_ = np.asarray(b_, float)
            a_ = unpack(np.asarray(a_, float), len(b_))
            best = None
            for subset in subsets:
                at = list(subset)
                if n_ <= len(at) or (size_ and len(at) != size_):
                    continue
                beta, inverse = solve(a_[np.ix_(at, at)], b_[at])
                sse = max(float(yy_ - beta @ b_[at]), 0.0)
                aic, bic = criteria(sse, n_, len(at))
                if best is None or aic < best[4] - 1e-9:
                    coef = np.zeros(len(b_))
                    coef[at] = beta
                    spread = np.sqrt(sse / (n_ - len(at)) * inverse[at.index(first), at.index(first)]) if first in at else 0.0
                    t = float(coef[first] / spread) if spread > 0 else None
                    best = (coef.tolist(), at, float(n_), sse, aic, bic, t)
            found.append(best or (None, None, float(n_), None, None, None, None))
        return pd.DataFrame(found, columns=["coef", "used", "n", "sse", "aic", "bic", "t_first"])

    return fit


def fit_summed(sums: DataFrame, k: int, keep: Sequence[str], subsets: Sequence[Sequence[int]] | None = None,
               first: int = 0, size: Column | None = None) -> DataFrame:
    """Solve summed rows; one fit per row. `size` fixes the number of regressors of a row's subset."""
    fit = fit_subsets(subsets or [list(range(k))], first)
    ready = sums.select(*keep, *packed(k), (F.lit(0) if size is None else size).alias("_size"))
    return ready.withColumn("_fit", fit("xtx", "xty", "yy", "n", "_size")).select(*keep, "_fit.*")


def predict(coef: str, xs: Sequence[str]) -> Column:
    return F.expr(" + ".join(f"{coef}[{i}] * ({x})" for i, x in enumerate(xs)))


NESTED_TYPE = "lags int, n double, t_before double"


def shifted_products(first: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """All sums of products of two lags of a series, from those with lag 0 and what its ends add and take per shift.

    The sum for lags (i, j) is that for (i - 1, j - 1) and `edges[i - 1, j - 1]`.
    """
    k = len(first)
    out = np.zeros((k, k))
    out[0], out[:, 0] = first, first
    for i in range(1, k):
        out[i, i:] = out[i - 1, i - 1: k - 1] + edges[i - 1, i - 1:]
        out[i:, i] = out[i, i:]
    return out


def nested_fit(a: np.ndarray, b: np.ndarray, yy: float, n: float, fixed: int, only: bool) -> tuple[int, float | None] | None:
    """The number of lags with the lowest AIC, the regressors being a constant, a level and lags, and the t value of the level.

    One factorisation gives the errors of all numbers of lags: each regressor takes the square of its place in the turned right
    side from the error. `only`: all lags are taken. Singular sums are solved number by number.
    """
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    unit, right = a / np.outer(scale, scale), b / scale
    try:
        factor = np.linalg.cholesky(unit)
        if np.diag(factor).min() < 1e-6:
            raise np.linalg.LinAlgError
        errors = yy - np.cumsum(np.linalg.solve(factor, right) ** 2)
    except np.linalg.LinAlgError:
        errors = np.array([yy - solve(a[:m, :m], b[:m])[0] @ b[:m] for m in range(1, len(b) + 1)])
    best = None
    for m in range(len(b) if only else fixed, len(b) + 1):
        if n <= m:
            continue
        aic = criteria(max(float(errors[m - 1]), 0.0), n, m)[0]
        if best is None or aic < best[0] - 1e-9:
            best = (aic, m)
    if best is None:
        return None
    m = best[1]
    beta, inverse = solve(a[:m, :m], b[:m])
    spread = np.sqrt(max(float(yy - beta @ b[:m]), 0.0) / (n - m) * inverse[1, 1])
    return m - fixed, float(beta[1] / spread) if spread > 0 else None
