"""Checks and filters of samples and variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_regions(variants: DataFrame, regions: DataFrame) -> DataFrame:
    """variants outside all regions (chrom, start, stop), ends included. Regions are merged by chromosome first, so each variant meets one row."""
    spans = regions.groupBy(F.col("chrom").alias("__c")).agg(F.collect_list(F.struct("start", "stop")).alias("__r"))
    inside = F.exists("__r", lambda r: F.col("bp").between(r.start, r.stop))
    return variants.join(spans, F.col("chrom") == F.col("__c"), "left").filter(F.col("__r").isNull() | ~inside).select(*variants.columns)


def variable_rates(long: DataFrame, var: str = "var_idx", value: str = "value") -> DataFrame:
    """var, n, missing, call_rate, maf of dosages."""
    n, known = F.count("*"), F.count(value)
    got = long.groupBy(var).agg(n.alias("n"), (n - known).alias("missing"), (known / n).alias("call_rate"), (F.avg(value) / 2).alias("freq"))
    return got.select(var, "n", "missing", "call_rate", F.least("freq", 1 - F.col("freq")).alias("maf"))


def sample_rates(long: DataFrame, sample: str = "sample_idx", value: str = "value") -> DataFrame:
    """sample, n, missing."""
    return long.groupBy(sample).agg(F.count("*").alias("n"), (F.count("*") - F.count(value)).alias("missing"))


def drop_empty_samples(long: DataFrame, sample: str = "sample_idx", value: str = "value") -> DataFrame:
    """Cells of samples with at least one known value."""
    some = long.groupBy(sample).agg(F.count(value).alias("__n")).filter("__n > 0").select(sample)
    return long.join(some, sample, "left_semi")


def annotated(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of labels that have the same keys, null where there are none. Keys must be unique in labels."""
    return rows.join(labels, keys, "left")


def keep(long: DataFrame, ids: DataFrame, on: str = "sample_idx") -> DataFrame:
    return long.join(ids.select(on), on, "left_semi")


def remove(long: DataFrame, ids: DataFrame, on: str = "sample_idx") -> DataFrame:
    return long.join(ids.select(on), on, "left_anti")


def spread(long: DataFrame, var: str = "var_idx", value: str = "value") -> DataFrame:
    """var, largest, iqr, median."""
    return long.groupBy(var).agg(F.max(value).alias("largest"), (F.expr(f"percentile({value}, 0.75)") - F.expr(f"percentile({value}, 0.25)")).alias("iqr"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def top_by_both(long: DataFrame, share: float, var: str = "var_idx", value: str = "value") -> DataFrame:
    """Variables in the top share both by maximum and by interquartile range."""
    got = spread(long, var, value)
    cut = got.agg(F.expr(f"percentile(largest, {1 - share})").alias("a"), F.expr(f"percentile(iqr, {1 - share})").alias("b"))
    both = got.crossJoin(F.broadcast(cut))  # one row
    return both.filter("largest >= a").select(var).intersect(both.filter("iqr >= b").select(var))


def dosage_faults(long: DataFrame, value: str = "value") -> DataFrame:
    """Cells that are neither 0, 1, 2 nor missing."""
    return long.filter(F.col(value).isNotNull() & ~F.col(value).isin(0, 1, 2))
