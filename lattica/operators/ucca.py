"""Each variable against all phenotypes at once: R, F and P of the multiple correlation.

r2 = cov(x,Y) Cov(Y)^-1 cov(x,Y)' / var(x), both sides centred; F has k and n-k-1 degrees of freedom.
Directions of Y without variance are left out of the inverse. A constant variable has null R, F and P.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.special import wilks
from ..plans import config
from ..plans.matrix import Matrix, block, check_dosages, standardized
from . import linalg

RESULT = "var_idx long, R double, Fstat double, P double"


def inverse_root(cov: np.ndarray) -> np.ndarray:
    """W with W W' the pseudo-inverse of cov."""
    e, v = np.linalg.eigh(cov)
    keep = e > max(e.max(initial=0.0), 0.0) * 1e-12
    return v[:, keep] / np.sqrt(e[keep])


def results(var_x: np.ndarray, cov_xy: np.ndarray, root: np.ndarray, n: int, k: int) -> list[np.ndarray]:
    """R, F and P; NaN for constant variables."""
    known = var_x > 1e-18
    r2 = np.minimum(1.0, ((cov_xy @ root) ** 2).sum(1)[known] / var_x[known])
    out = [np.full(len(var_x), np.nan) for _ in range(3)]
    for column, own in zip(out, wilks(r2, n, k), strict=True):
        column[known] = own
    return out


def ucca(x: Matrix, y: Matrix, standx: str = "binom2", standy: str = "sd", check_geno: bool = True) -> DataFrame:
    """var_idx, R, Fstat, P. y is by sample: phenotypes as columns.

    By variable, phenotypes are broadcast (n x k) and each row is tested by itself; by sample, moments
    of the joined rows are summed in one pass.
    """
    if y.by != "sample":
        raise ValueError("phenotypes must be by sample")
    if x.n != y.n:
        raise ValueError(f"{x.n} samples in X and {y.n} in Y")
    n, k, p = x.n, y.p, x.p
    config.check_ucca(n, k)
    if check_geno and standx in ("binom", "binom2"):
        check_dosages(x)
    zx, zy = standardized(x, standx)[0], standardized(y, standy)[0] if k > 1 else standardized_single(y, standy)
    spark = x.rows.sparkSession
    if x.by == "variable":
        got = zy.rows.collect()
        values = np.zeros((n, k))
        for r in got:
            values[r["idx"]] = r["values"]
        values -= values.mean(0)
        shared = linalg.sent(spark, (values, inverse_root(values.T @ values / (n - 1))), values.nbytes)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                v = block(batch, n)
                v = v - v.mean(1, keepdims=True)
                own, root = shared.value
                found = results((v**2).sum(1) / (n - 1), v @ own / (n - 1), root, n, k)
                yield pa.RecordBatch.from_arrays([batch.column("idx"), *(pa.array(c, pa.float64(), from_pandas=True) for c in found)], names=["var_idx", "R", "Fstat", "P"])

        return zx.rows.mapInArrow(run, RESULT)
    both = zx.rows.join(zy.rows.withColumnRenamed("values", "y"), "idx")

    def add(sums, idx, v, batch):
        own = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        sums[:p, :k] += v.T @ own
        sums[:p, k] += v.sum(0)
        sums[:p, k + 1] += (v**2).sum(0)
        sums[p:, :k] += own.T @ own
        sums[p:, k] += own.sum(0)

    s = linalg.total(both, p, add, (p + k, k + 2))
    mean_x, mean_y = s[:p, k] / n, s[p:, k] / n
    var_x = (s[:p, k + 1] - n * mean_x**2) / (n - 1)
    cov = (s[:p, :k] - n * np.outer(mean_x, mean_y)) / (n - 1)
    cov_y = (s[p:, :k] - n * np.outer(mean_y, mean_y)) / (n - 1)
    found = results(np.where(var_x > 1e-12 * np.maximum(1.0, mean_x**2), var_x, 0.0), cov, inverse_root(cov_y), n, k)
    return spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(zip(*found, strict=True))], RESULT)


def standardized_single(y: Matrix, method: str) -> Matrix:
    """One phenotype: statistics don't need two columns."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    wide = replace(y, rows=y.rows.select("idx", F.concat("values", "values").alias("values")), p=2)
    z = standardized(wide, method)[0]
    return replace(y, rows=z.rows.select("idx", F.slice("values", 1, 1).alias("values")))
