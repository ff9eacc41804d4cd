"""Standardisation of variables: statistics over non-missing values, scaling, missing values to the mean.

method   mean  sd                     value      missing
none     avg   1                      x          the mean
center   avg   1                      x-mean     0
sd       avg   sample sd              (x-mean)/sd  0
binom    avg   sqrt(P(1-P)), P=mean/2 (x-mean)/sd  0
binom2   avg   sqrt(2P(1-P))          (x-mean)/sd  0

Where sd is at most VAR_TOL all values become 0 (zero_var="mean": the mean, for non-missing ones).
Without any value mean and sd are null and all values 0. NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: standard deviations up to this count as zero.
VAR_TOL = 1e-9
METHODS = ("none", "sd", "binom", "binom2", "center")


def known(x: Column) -> Column:
    """x as a double, null where NaN."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def sd_of(method: str, mean: Column, sample_sd: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    half = mean / F.lit(2.0)
    if method == "sd":
        return F.when(mean.isNotNull(), F.coalesce(sample_sd, F.lit(0.0)))
    if method in ("binom", "binom2"):
        # A share outside 0..1 has no binomial deviation; it counts as zero.
        return F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0 if method == "binom2" else 1.0) * half * (F.lit(1.0) - half))))
    return F.when(mean.isNotNull(), F.lit(1.0))


def scaled(x: Column, mean: Column, sd: Column, method: str, zero_var: str = "zero", impute: bool = True) -> Column:
    """A standardised value; x must have been made `known`."""
    missing = F.lit(0.0) if impute else F.lit(None).cast("double")
    if method == "none":
        return F.coalesce(x, mean if impute else F.lit(None).cast("double"), missing)
    flat = F.when(x.isNull(), missing).otherwise(mean if zero_var == "mean" else F.lit(0.0))
    return F.when(F.coalesce(sd, F.lit(0.0)) <= F.lit(VAR_TOL), flat).otherwise(F.when(x.isNull(), missing).otherwise((x - mean) / sd))


def stats(long: DataFrame, method: str = "binom2", var: str = "var_idx", value: str = "value") -> DataFrame:
    """var, n, mean, sd of a long frame: one aggregation, combined before its shuffle."""
    x = known(F.col(value))
    got = long.groupBy(var).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("__sd"))
    return got.select(var, "n", "mean", sd_of(method, F.col("mean"), F.col("__sd")).alias("sd"))


def standardize(long: DataFrame, method: str = "binom2", var: str = "var_idx", value: str = "value", given: DataFrame | None = None, zero_var: str = "zero", impute: bool = True) -> DataFrame:
    """The long frame with column z; `given` (var, mean, sd) replaces the frame's own statistics."""
    own = (given if given is not None else stats(long, method, var, value)).select(var, F.col("mean").alias("__mean"), F.col("sd").alias("__sd"))
    out = long.join(own, var)
    return out.withColumn("z", scaled(known(F.col(value)), F.col("__mean"), F.col("__sd"), method, zero_var, impute)).drop("__mean", "__sd")


def scale2(long: DataFrame, type: str = "2", impute: bool = True, var: str = "var_idx", value: str = "value") -> DataFrame:  # noqa: A002
    """Binomial scaling of dosages: type "2" is binom2, "1" binom. Without impute missing values stay null."""
    return standardize(long, {"2": "binom2", "1": "binom"}[type], var, value, impute=impute)


def maf_to_meansd(maf: Column, method: str = "binom2") -> tuple[Column, Column]:
    """Mean and sd that a minor allele frequency implies."""
    mean = F.lit(2.0) * maf
    return mean, sd_of(method, mean, mean)


def sign(a: Column) -> Column:
    return F.signum(a)


def soft_threshold(a: Column, penalty: float) -> Column:
    return F.signum(a) * F.greatest(F.abs(a) - F.lit(float(penalty)), F.lit(0.0))


def norm_threshold(df: DataFrame, column: str, penalty: float, by: list[str] | None = None) -> DataFrame:
    """column scaled to norm 1, soft-thresholded and scaled again, over all rows or groups; norms of 0 leave it."""
    by = by or []

    def unit(frame: DataFrame) -> DataFrame:
        norms = frame.groupBy(*by).agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("__norm"))
        joined = frame.join(norms, by) if by else frame.crossJoin(F.broadcast(norms))  # one row
        return joined.withColumn(column, F.when(F.col("__norm") > 0, F.col(column) / F.col("__norm")).otherwise(F.col(column))).drop("__norm")

    return unit(unit(df).withColumn(column, soft_threshold(F.col(column), penalty)))
