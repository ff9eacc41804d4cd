"""Principal components: Z Z' = U diag(e) U' of the standardised matrix Z.

values = e/div; projection = U sqrt(values); loadings = Z'U diag(1/sqrt(e)); trace = sum(Z^2)/div;
pve = values/trace. div is p, n-1 or 1. Signs: of each dimension's loadings the entry of largest size
(ties: the least index) is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import config
from ..plans.matrix import Matrix, check_dosages, lists, standardized
from . import linalg


@dataclass(frozen=True)
class PCA:
    """values, pve: (dim, value); vectors, projection: (sample_idx, values); loadings: (var_idx, values); scale: (var_idx, mean, sd)."""

    values: DataFrame
    pve: DataFrame
    vectors: DataFrame
    projection: DataFrame
    loadings: DataFrame
    scale: DataFrame | None
    trace: float
    k: int
    n: int
    p: int
    divisor: float

    def __repr__(self) -> str:
        return f"PCA of {self.n} samples and {self.p} variables, {self.k} dimensions"


def by_dim(spark, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "dim int, value double")


def arrays(spark, idx: str, x: np.ndarray) -> DataFrame:
    """A row for each row of an array."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({idx: pa.array(np.arange(len(x))), "values": lists(np.asarray(x, float))}), f"{idx} long, values array<double>")


def flip_of(loadings: DataFrame, k: int) -> np.ndarray:
    """Signs of distributed loadings: one aggregation of k maxima."""
    size = [F.max(F.struct(F.round(F.abs(F.col("values")[i]), 12), -F.col("idx"), F.signum(F.col("values")[i]).alias("s"))).getField("s").alias(f"s{i}") for i in range(k)]
    got = loadings.agg(*size).first()
    return np.array([-1.0 if got[i] is not None and got[i] < 0 else 1.0 for i in range(k)])


def pca(x: Matrix, k: int = config.NDIM, stand: str = "binom2", divisor: str = "p", tol: float = config.TOL, maxiter: int = config.MAXITER, seed: int = config.SEED, check_geno: bool = True, zero_var: str = "zero", gram_width: int = linalg.GRAM_WIDTH, persist: bool = True) -> PCA:
    """The k largest components. Rows are read for the Gram matrix, and once for the other side when used."""
    config.check_shape(x.n, x.p)
    config.check_ndim(k, x.n, x.p)
    div = config.divisor(divisor, x.n, x.p)
    if check_geno and stand in ("binom", "binom2"):
        check_dosages(x)
    z, scale = standardized(x, stand, zero_var=zero_var)
    z = z.persist() if persist else z
    spark = x.rows.sparkSession
    e, w, total = linalg.eigen_and_trace(z, k, tol, maxiter, seed, gram_width)
    e = np.maximum(e, 0.0)
    d = e / div
    trace = total / div
    back = w / np.sqrt(np.where(e > 0, e, np.inf))
    if x.by == "sample":  # w holds loadings
        flip = linalg.signs(w)
        loadings = arrays(spark, "var_idx", w * flip)
        vectors = linalg.rows_times(z, back * flip).withColumnRenamed("idx", "sample_idx")
    else:
        raw = linalg.rows_times(z, back)
        flip = flip_of(raw, k)
        loadings = linalg.rows_times(z, back * flip).withColumnRenamed("idx", "var_idx")
        vectors = arrays(spark, "sample_idx", w * flip)
    root = F.array(*[F.lit(float(v)) for v in np.sqrt(d)])
    projection = vectors.select("sample_idx", F.zip_with("values", root, lambda a, b: a * b).alias("values"))
    return PCA(by_dim(spark, d), by_dim(spark, d / trace if trace > 0 else d * np.nan), vectors, projection, loadings, None if stand == "none" else scale, trace, k, x.n, x.p, div)


def with_ids(values: DataFrame, ids: DataFrame, idx: str, prefix: str) -> DataFrame:
    """Array rows with their ids and a column for each dimension: U1.., PC1.., V1.."""
    k = values.select(F.max(F.size("values"))).first()[0] or 0
    return ids.join(values, idx).select(*ids.columns, *[F.col("values")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """The n loadings of largest size of each dimension, rank 1 first."""
    from pyspark.sql import Window

    cells = loadings.select("var_idx", F.posexplode("values").alias("dim", "loading")).filter("loading <> 0").withColumn("dim", F.col("dim") + 1)
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.abs("loading").desc(), "var_idx"))
    return cells.withColumn("rank", rank).filter(F.col("rank") <= n)
