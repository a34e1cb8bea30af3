"""Distributed linear algebra on narrow matrices: Gram sums on the cluster, the small solve on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, X'X) over rows without a null (others are left out, as NaN rows are in a sample covariance): one partial matrix per partition, then a sum of K x K values."""
    k = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(k), np.zeros((k, k))
        for p in batches:
            x = p.to_numpy(dtype=float)
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"i": range(k * k + k + 1), "v": np.concatenate([[n], s, g.ravel()])})

    rows = df.select(*columns).dropna().mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in rows])
    return int(v[0]), v[1 : k + 1], v[k + 1 :].reshape(k, k)


def covariance(df: DataFrame, columns: list[str], weights: np.ndarray | None = None, noise: np.ndarray | None = None) -> np.ndarray:
    """Sample covariance of the weighted columns, plus the weighted noise squared on its diagonal."""
    n, s, g = gram(df, columns)
    w = np.ones(len(columns)) if weights is None else np.asarray(weights, float)
    c = (g - np.outer(s, s) / n) / max(1, n - 1) * np.outer(w, w)
    return c + np.diag((np.asarray(noise) * w) ** 2) if noise is not None else c


def principal_components(df: DataFrame, columns: list[str], weights: np.ndarray | None = None, noise: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their vectors as columns; each vector's greatest entry is positive."""
    e, v = np.linalg.eigh(covariance(df, columns, weights, noise))
    e, v = e[::-1], v[:, ::-1]
    return e, v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])


def project(df: DataFrame, columns: list[str], vectors: np.ndarray, names: list[str]) -> DataFrame:
    """Add the dot product with each vector, as plain columns."""
    dot = lambda j: sum((F.col(c) * float(vectors[i, j]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.withColumns({n: dot(j) for j, n in enumerate(names)})


def template_power(template: np.ndarray, vectors: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(template)) if weights is None else weights
    return (vectors.T @ (np.asarray(template) * w)) ** 2


def signal_to_noise(template: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> float:
    return float(np.sqrt((template_power(template, vectors) / values).sum()))


def chi2_from(template: np.ndarray, data: np.ndarray, values: np.ndarray, vectors: np.ndarray, start: int) -> float:
    """Squared residual over the modes from ``start`` on, each over its eigenvalue."""
    r = vectors.T @ (np.asarray(data) - np.asarray(template))
    return float((r[start:] ** 2 / values[start:]).sum())


def mode_coefficients(rows: DataFrame, keys: list[str], vectors: DataFrame, i: str = "i", value: str = "value") -> DataFrame:
    """keys, mode, coef: dot products of vectors given as rows (keys, i, value) with the modes (i, mode, v). The modes are a
    K x K matrix that an eigen solve on the driver has made, so they are broadcast."""
    return rows.join(F.broadcast(vectors), i).groupBy(*keys, "mode").agg(F.sum(F.col(value) * F.col("v")).alias("coef"))


def template_snr(coefficients: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """keys and snr = sqrt(sum of coef^2 over the modes' eigenvalues); values (mode, lam) has K rows."""
    return coefficients.join(F.broadcast(values), "mode").groupBy(*keys).agg(F.sqrt(F.sum(F.col("coef") * F.col("coef") / F.col("lam"))).alias("snr"))


def chi2_table(data: DataFrame, templates: DataFrame, values: DataFrame, start: int) -> DataFrame:
    """data_id, template_id, chi2: of each datum and template (data_id or template_id, mode, coef) the squared residual over
    the modes from ``start`` on, each over its eigenvalue. Data meet all templates in their modes; templates are a stated
    set and are broadcast if counted to be at most 100,000 rows."""
    t = templates.filter(F.col("mode") >= start).join(F.broadcast(values), "mode").select("mode", "template_id", F.col("coef").alias("_t"), "lam")
    few = F.broadcast(t) if t.count() <= 100_000 else t
    r = F.col("coef") - F.col("_t")
    return data.filter(F.col("mode") >= start).join(few, "mode").groupBy("data_id", "template_id").agg(F.sum(r * r / F.col("lam")).alias("chi2"))


def normal_equations(df: DataFrame, design: list[str], data: str, weight: str, prior: np.ndarray | None = None) -> np.ndarray:
    """Solution of (J' N^-1 J + S^-1) x = J' N^-1 d for rows of the design J, data d, and inverse noise variance."""
    root = F.sqrt(F.col(weight))
    cols = {f"_j{i}": F.col(c) * root for i, c in enumerate(design)} | {"_d": F.col(data) * root}
    _, _, g = gram(df.withColumns(cols), list(cols))
    a = g[:-1, :-1] + (np.diag(prior) if prior is not None else 0)
    low = np.linalg.cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, g[:-1, -1]))


def power_spectrum(alm: DataFrame, keys: list[str]) -> DataFrame:
    """keys, l, c_l of rows (keys, l, m, re, im) with m >= 0: the sum of |a|^2, m > 0 twice, over 2 l + 1."""
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.when(F.col("m") > 0, 2).otherwise(1)
    return alm.groupBy(*keys, "l").agg((F.sum(p) / (2 * F.first("l") + 1)).alias("c_l"))


def inverse_prior(alm: DataFrame, keys: list[str]) -> DataFrame:
    """Add 1 / C_l to every (l, m); 0 where C_l is not positive."""
    c = power_spectrum(alm, keys)
    return alm.join(c, [*keys, "l"]).withColumn("prior", F.when(F.col("c_l") > 0, 1 / F.col("c_l")).otherwise(0.0)).drop("c_l")


def mean_product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the sphere's mean of the product of two harmonic tables: m = 0 once, m > 0 twice the real part, over 4 pi."""
    b = b.select(*keys, "l", "m", F.col("re").alias("_re"), F.col("im").alias("_im"))
    x = (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")) * F.when(F.col("m") > 0, 2).otherwise(1)
    return a.join(b, [*keys, "l", "m"]).groupBy(*keys).agg((F.sum(x) / (4 * np.pi)).alias("mean"))


def correlation_by_degree(a: DataFrame, b: DataFrame) -> DataFrame:
    """l and c_xy / sqrt(c_xx c_yy) of two harmonic tables (l, m, re, im)."""
    b = b.select("l", "m", F.col("re").alias("_re"), F.col("im").alias("_im"))
    w = F.when(F.col("m") > 0, 2).otherwise(1)
    dot = lambda x, y: F.sum(w * (F.col(x[0]) * F.col(y[0]) + F.col(x[1]) * F.col(y[1])))
    p, q = ("re", "im"), ("_re", "_im")
    g = a.join(b, ["l", "m"]).groupBy("l").agg((dot(p, q) / (2 * F.first("l") + 1)).alias("xy"), (dot(p, p) / (2 * F.first("l") + 1)).alias("xx"), (dot(q, q) / (2 * F.first("l") + 1)).alias("yy"))
    return g.select("l", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy") + 1e-30)).alias("correlation"))
