"""A samples x variables matrix as a DataFrame of rows (idx, values), by sample or by variable.

Keep the longer side as rows: `by="sample"` for many samples, `by="variable"` for many variables. The
width of a row is the shorter side, and everything that reaches the driver or is broadcast has that
width. No order of rows is relied on: every row carries its index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import VAR_TOL, known, scaled, sd_of
from .config import check_shape

ROWS = "idx long, values array<double>"


@dataclass(frozen=True)
class Matrix:
    """rows (idx, values; null is missing); n samples, p variables; ids by index, where known."""

    rows: DataFrame
    by: str
    n: int
    p: int
    variables: DataFrame | None = None  # var_idx, var_id, ref_allele, ...
    samples: DataFrame | None = None  # sample_idx, fid, iid, ...

    def __post_init__(self):
        if self.by not in ("sample", "variable"):
            raise ValueError("by must be 'sample' or 'variable'")

    @property
    def width(self) -> int:
        return self.p if self.by == "sample" else self.n

    @property
    def count(self) -> int:
        return self.n if self.by == "sample" else self.p

    def persist(self) -> Matrix:
        return replace(self, rows=self.rows.persist())

    def long(self) -> DataFrame:
        """sample_idx, var_idx, value."""
        cells = self.rows.select("idx", F.posexplode("values").alias("at", "value"))
        sample, var = ("idx", "at") if self.by == "sample" else ("at", "idx")
        return cells.select(F.col(sample).cast("long").alias("sample_idx"), F.col(var).cast("long").alias("var_idx"), "value")


def fill_batches(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = np.full((batch.num_rows, width), np.nan)
            cells = batch.column("cells")
            at = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            out[at, flat.field("at").to_numpy()] = flat.field("value").to_numpy(zero_copy_only=False)
            values = pa.array(out.reshape(-1), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), values)], names=["idx", "values"])

    return run


def group_batches(batches: Iterator) -> Iterator:
    """Cells (idx, at, value) to a row for each idx of a batch."""
    import pyarrow as pa

    for batch in batches:
        idx, at, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(idx, kind="stable")
        own, starts = np.unique(idx[order], return_index=True)
        offsets = pa.array(np.append(starts, len(idx)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(offsets, pa.array(at[order])), pa.ListArray.from_arrays(offsets, pa.array(value[order]))], names=["idx", "at", "value"])


def join_batches(width: int):
    """Rows come sorted by idx; those of an idx become one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, out = None, np.empty(0)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(out, from_pandas=True))], names=["idx", "values"])
        for batch in batches:
            offsets, at, value = batch.column("at").offsets.to_numpy(), batch.column("at").flatten().to_numpy(), batch.column("value").flatten().to_numpy()
            offsets = offsets - offsets[:1]
            for i, idx in enumerate(batch.column("idx").to_pylist()):
                if idx != last:
                    if last is not None:
                        yield row()
                    last, out = idx, np.full(width, np.nan)
                own = slice(offsets[i], offsets[i + 1])
                out[at[own]] = value[own]
        if last is not None:
            yield row()

    return run


#: Rows above so many values are put together out of parts, not out of single cells.
LONG_ROW = 4096


def from_long(long: DataFrame, sample: str = "sample_idx", var: str = "var_idx", value: str = "value", by: str = "sample", n: int | None = None, p: int | None = None, **ids) -> Matrix:
    """From cells; indices are 0-based, absent cells are missing."""
    if n is None or p is None:
        got = long.agg(F.max(sample), F.max(var)).first()
        n, p = n or (got[0] if got[0] is not None else -1) + 1, p or (got[1] if got[1] is not None else -1) + 1
    row, at = (sample, var) if by == "sample" else (var, sample)
    width = p if by == "sample" else n
    if width > LONG_ROW:
        own = long.select(F.col(row).cast("long").alias("idx"), F.col(at).cast("int").alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))
        parts = own.mapInArrow(group_batches, "idx long, at array<int>, value array<double>")
        return Matrix(parts.repartition("idx").sortWithinPartitions("idx").mapInArrow(join_batches(width), ROWS), by, n, p, **ids)
    cells = long.groupBy(F.col(row).cast("long").alias("idx")).agg(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), known(F.col(value)).alias("value"))).alias("cells"))
    return Matrix(cells.mapInArrow(fill_batches(width), ROWS), by, n, p, **ids)


def from_wide(df: DataFrame, idx: str, columns: list[str], n: int | None = None, **ids) -> Matrix:
    """From a row for each sample and a column for each variable."""
    rows = df.select(F.col(idx).cast("long").alias("idx"), F.array(*[known(F.col(c)) for c in columns]).alias("values"))
    return Matrix(rows, "sample", df.count() if n is None else n, len(columns), **ids)


def from_arrays(df: DataFrame, idx: str, values: str, by: str = "sample", width: int | None = None, count: int | None = None, **ids) -> Matrix:
    """From arrays of equal length."""
    rows = df.select(F.col(idx).cast("long").alias("idx"), F.transform(values, known).alias("values"))
    if width is None or count is None:
        got = rows.agg(F.count("*"), F.max(F.size("values"))).first()
        count, width = count or got[0], width or got[1] or 0
    return Matrix(rows, by, *((count, width) if by == "sample" else (width, count)), **ids)


def check_dosages(x: Matrix) -> None:
    """Raises if a value is not 0, 1, 2 or missing."""
    bad = x.rows.filter(F.exists("values", lambda v: ~v.isin(0.0, 1.0, 2.0))).limit(1).count()
    if bad:
        raise ValueError("values other than 0, 1, 2 and missing: binom and binom2 can't be used")


def statistics(x: Matrix, method: str) -> DataFrame:
    """var_idx, mean, sd. By variable a row's own affair, without a shuffle; by sample one aggregation."""
    if x.by == "sample":
        cells = x.rows.select(F.posexplode("values").alias("var_idx", "v"))
        got = cells.groupBy(F.col("var_idx").cast("long").alias("var_idx")).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("__sd"))
    else:
        return beside(x, method).select(F.col("idx").alias("var_idx"), "mean", "sd")
    return got.select("var_idx", "mean", sd_of(method, F.col("mean"), F.col("__sd")).alias("sd"))


def scale_batches(mean, sd, method: str, zero_var: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m, s = mean.value, sd.value
        flat = ~(s > VAR_TOL)
        for batch in batches:
            x = block(batch, len(m))
            gone = np.isnan(x)
            if method == "none":
                z = np.where(gone, np.nan_to_num(m), x)
            else:
                z = np.where(gone, 0.0, (x - np.nan_to_num(m)) / np.where(flat, 1.0, s))
                z[:, flat] = np.where(gone, 0.0, np.nan_to_num(m))[:, flat] if zero_var == "mean" else 0.0
            yield pa.RecordBatch.from_arrays([batch.column("idx"), lists(z)], names=["idx", "values"])

    return run


def block(batch, width: int) -> np.ndarray:
    """The values of a batch as rows x width; null is NaN."""
    values = batch.column("values")
    if batch.num_rows and (np.diff(values.offsets.to_numpy()) != width).any():
        raise ValueError(f"rows must have {width} values")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))


def standardized(x: Matrix, method: str = "binom2", given: DataFrame | None = None, zero_var: str = "zero") -> tuple[Matrix, DataFrame]:
    """The matrix with every value present and scaled, and its statistics (var_idx, mean, sd)."""
    check_shape(x.n, x.p)
    told = given if given is not None else statistics(x, method)
    if x.by == "variable":
        if given is None:  # statistics of the same row: no join
            return replace(x, rows=beside(x, method, zero_var).select("idx", "values")), told
        rows = x.rows.join(told.withColumnRenamed("var_idx", "idx"), "idx")
        z = F.transform("values", lambda v: scaled(v, F.col("mean"), F.col("sd"), method, zero_var))
        return replace(x, rows=rows.select("idx", z.alias("values"))), told
    # One mean and sd for each of the row's values: as wide as a row.
    kept = told.collect()
    mean, sd = np.full(x.p, np.nan), np.full(x.p, np.nan)
    for r in kept:
        mean[r["var_idx"]], sd[r["var_idx"]] = (np.nan if v is None else v for v in (r["mean"], r["sd"]))
    sc = x.rows.sparkSession.sparkContext
    rows = x.rows.mapInArrow(scale_batches(sc.broadcast(mean), sc.broadcast(sd), method, zero_var), ROWS)
    told = x.rows.sparkSession.createDataFrame([(int(r["var_idx"]), r["mean"], r["sd"]) for r in kept], "var_idx long, mean double, sd double")
    return replace(x, rows=rows), told


def beside_batches(width: int, method: str, zero_var: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = block(batch, width)
            gone = np.isnan(x)
            n = (~gone).sum(1)
            mean = np.where(gone, 0.0, x).sum(1) / np.maximum(n, 1)
            off = np.where(gone, 0.0, x - mean[:, None])
            if method == "sd":
                sd = np.sqrt((off**2).sum(1) / np.maximum(n - 1, 1))
            elif method in ("binom", "binom2"):
                sd = np.sqrt(np.maximum(0.0, (2.0 if method == "binom2" else 1.0) * mean / 2 * (1 - mean / 2)))
            else:
                sd = np.ones(len(x))
            if method == "none":
                z = np.where(gone, mean[:, None], x)
            else:
                flat = ~(sd > VAR_TOL)
                z = off / np.where(flat, 1.0, sd)[:, None]
                z[flat] = np.where(gone, 0.0, mean[:, None])[flat] if zero_var == "mean" else 0.0
            some = n == 0
            yield pa.RecordBatch.from_arrays([batch.column("idx"), lists(z), pa.array(mean, mask=some), pa.array(sd, mask=some)], names=["idx", "values", "mean", "sd"])

    return run


def beside(x: Matrix, method: str, zero_var: str = "zero") -> DataFrame:
    """Rows of a matrix by variable, scaled, with the mean and sd of each."""
    sd_of(method, F.lit(0.0), F.lit(0.0))  # checks the method
    return x.rows.mapInArrow(beside_batches(x.n, method, zero_var), f"{ROWS}, mean double, sd double")
