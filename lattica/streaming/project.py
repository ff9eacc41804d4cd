"""Scores of samples as they arrive: stateless, so a stream of rows goes through unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.project import project_rows, weights
from ..plans import config


def project_stream(stream: DataFrame, variables: DataFrame, loadings: DataFrame, meansd: DataFrame, idx: str = "sample_idx", values: str = "values", divisor: str = "p") -> DataFrame:
    """sample_idx, values for each row of a (streaming) frame of arrays over all variables. Saved tables are as wide as a row."""
    keys = ["var_id", "ref_allele"]
    p = variables.count()
    saved = variables.select("var_idx", *keys).join(loadings, keys).join(meansd, keys).select("var_idx", "v", "mean", "sd")
    if divisor == "n1":
        raise ValueError("a stream has no number of samples")
    rows = stream.select(F.col(idx).cast("long").alias("idx"), F.col(values).cast("array<double>").alias("values"))
    return project_rows(rows, weights(saved, p), config.divisor(divisor, 2, p) ** 0.5)
