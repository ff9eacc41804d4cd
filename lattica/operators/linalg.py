"""Products and eigenpairs of a matrix of rows: numpy on Arrow batches, sums by tree.

Each partition adds up its own part and sends it in blocks of at most `BLOCK` bytes; blocks are added
in up to 32 lots, then once more. What reaches the driver
is checked against `DRIVER_BYTES`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import Matrix, block, lists

BLOCK, DRIVER_BYTES = 1 << 20, 2 << 30
#: Bytes of all rows' pieces over the same columns, as they are multiplied at once.
PIECE = 16 << 20
#: Widest Gram matrix that is made; beyond it eigenpairs come by subspace iteration.
GRAM_WIDTH = 4096
PARTS = "lot int, block int, sums binary"


def sum_batches(width: int, add: Callable, shape: tuple[int, int], lots: int):
    """add(sums, idx, values): adds a batch's part to sums."""

    def run(batches: Iterator) -> Iterator:
        sums, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                some = True
                add(sums, batch.column("idx").to_numpy(), block(batch, width), batch)
        if some:
            yield own_part(sums, lots)

    return run


def own_part(sums: np.ndarray, lots: int):
    """A partition's sums in blocks."""
    import pyarrow as pa
    from pyspark import TaskContext

    flat, each = sums.reshape(-1), BLOCK // 8
    cut = [flat[i : i + each].tobytes() for i in range(0, len(flat), each)]
    lot = TaskContext.get().partitionId() % lots
    return pa.RecordBatch.from_arrays([pa.array([lot] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["lot", "block", "sums"])


def add_up(parts):
    import pandas as pd

    total = np.sum([np.frombuffer(x) for x in parts["sums"]], axis=0)
    return pd.DataFrame({"lot": parts["lot"].iloc[:1], "block": parts["block"].iloc[:1], "sums": [total.tobytes()]})


def total(rows: DataFrame, width: int, add: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of add()'s parts, on the driver."""
    return summed(lambda lots: rows.mapInArrow(sum_batches(width, add, shape, lots), PARTS), shape)


def summed(parts_of: Callable[[int], DataFrame], shape: tuple[int, int]) -> np.ndarray:
    """The sum of partitions' parts, dealt to so many lots, on the driver."""
    if 8 * shape[0] * shape[1] > DRIVER_BYTES:
        raise ValueError(f"{shape[0]} x {shape[1]} sums are more than the driver takes ({DRIVER_BYTES} bytes)")
    parts = parts_of(32 if shape[0] * shape[1] > 1 << 16 else 8)
    parts = parts.groupBy("block", "lot").applyInPandas(add_up, PARTS).groupBy("block").applyInPandas(add_up, PARTS)
    out = np.zeros(shape[0] * shape[1])
    for r in parts.collect():
        own = np.frombuffer(r["sums"])
        out[r["block"] * (BLOCK // 8) :][: len(own)] = own
    return out.reshape(shape)


def sent(spark, value, nbytes: int):
    """value as a broadcast, if executors can be expected to hold its bytes: as wide as a row, times some columns."""
    if nbytes > DRIVER_BYTES:
        raise ValueError(f"{nbytes} bytes are more than is broadcast ({DRIVER_BYTES})")
    return spark.sparkContext.broadcast(value)


def gram(x: Matrix) -> np.ndarray:
    """Sum of the outer products of rows: width x width."""

    def add(sums, idx, values, batch):
        sums += values.T @ values

    return total(x.rows, x.width, add, (x.width, x.width))


def piece_batches(width: int, piece: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            values = block(batch, width)
            for i, at in enumerate(range(0, width, piece)):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), batch.column("idx"), lists(values[:, at : at + piece])], names=["piece", "idx", "values"])

    return run


def piece_gram_batches(width: int, piece: int, count: int, lots: int):
    """Rows come sorted by piece. Of the sums' last row piece 0 fills in the indices, rising, and how many there are."""

    def run(batches: Iterator) -> Iterator:
        sums, some = np.zeros((count + 1, count + 1)), False

        def close(at: int, idx: list, values: list):
            idx, values = np.concatenate(idx), np.concatenate(values)
            order = np.argsort(idx)
            m = len(idx)
            if m > count or (np.diff(idx[order]) == 0).any():
                raise ValueError(f"{count} rows with different indices are expected")
            values = values[order]
            sums[:m, :m] += values @ values.T
            if at == 0:
                sums[count, :m], sums[count, count] = idx[order], m

        at, idx, values = None, [], []
        for batch in batches:
            pieces = batch.column("piece").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1), len(pieces)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if at is not None and pieces[start] != at:
                    close(at, idx, values)
                    idx, values = [], []
                at, some = pieces[start], True
                own = batch.slice(start, stop - start)
                idx.append(own.column("idx").to_numpy())
                values.append(block(own, min(piece, width - piece * int(at))))
        if some:
            close(at, idx, values)
            yield own_part(sums, lots)

    return run


def row_gram(x: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Products of the rows with each other, and their indices, rising: as wide as there are rows, however long those are.

    Rows are cut into pieces; pieces over the same columns meet in one task.
    """
    count, width = x.count, x.width
    piece = max(1, min(width, PIECE // (8 * count)))
    cut = x.rows.select("idx", "values").mapInArrow(piece_batches(width, piece), "piece int, idx long, values array<double>")
    cut = cut.repartition("piece").sortWithinPartitions("piece")
    s = summed(lambda lots: cut.mapInArrow(piece_gram_batches(width, piece, count, lots), PARTS), (count + 1, count + 1))
    m = int(s[count, count])
    return s[:m, :m], s[count, :m].astype(np.int64)


def shorter_gram(x: Matrix) -> np.ndarray:
    """The Gram matrix of the shorter side. That of the longer side has the same trace, norm and eigenvalues other than 0."""
    return gram(x) if x.width <= x.count else row_gram(x)[0]


def squares(x: Matrix) -> float:
    """Sum of all squared values."""
    own = F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)
    return float(x.rows.agg(F.sum(own)).first()[0] or 0.0)


def rows_times(x: Matrix, m: np.ndarray, name: str = "values") -> DataFrame:
    """idx, row . m for each row: no shuffle."""
    shared = sent(x.rows.sparkSession, m, m.nbytes)
    width = x.width

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("idx"), lists(block(batch, width) @ shared.value)], names=["idx", name])

    return x.rows.mapInArrow(run, f"idx long, {name} array<double>")


def transposed_times(x: Matrix, right: DataFrame, k: int, column: str = "values") -> np.ndarray:
    """Sum over rows of row' . right[idx]: width x k. right: idx and an array of k."""
    both = x.rows.join(right.select("idx", F.col(column).alias("__right")), "idx")

    def add(sums, idx, values, batch):
        sums += values.T @ batch.column("__right").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    return total(both.select("idx", "values", "__right"), x.width, add, (x.width, k))


def gram_times(x: Matrix, m: np.ndarray) -> np.ndarray:
    """gram(x) . m, without the Gram matrix: one pass."""
    shared = sent(x.rows.sparkSession, m, m.nbytes)

    def add(sums, idx, values, batch):
        sums += values.T @ (values @ shared.value)

    return total(x.rows, x.width, add, m.shape)


def top_eigen(x: Matrix, k: int, tol: float = 1e-6, maxiter: int = 500, seed: int = 1, gram_width: int = GRAM_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    return eigen_and_trace(x, k, tol, maxiter, seed, gram_width)[:2]


def eigen_and_trace(x: Matrix, k: int, tol: float = 1e-6, maxiter: int = 500, seed: int = 1, gram_width: int = GRAM_WIDTH) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of gram(x), falling, their vectors (width x k), and the sum of all eigenvalues.

    Up to `gram_width` from the Gram matrix: one pass. Fewer rows than that, but wider: from the products of
    rows with each other, and one more pass for vectors. Else by subspace iteration with
    Rayleigh-Ritz steps, a pass each, until residuals are at most tol times the largest eigenvalue.
    """
    if x.width <= gram_width:
        g = gram(x)
        values, vectors = np.linalg.eigh(g)
        return values[::-1][:k].copy(), vectors[:, ::-1][:, :k].copy(), float(np.trace(g))
    rng = np.random.default_rng(seed)
    if k <= x.count <= gram_width:
        g, idx = row_gram(x)
        if k <= len(idx):
            values, own = np.linalg.eigh(g)
            values, own = values[::-1][:k].copy(), own[:, ::-1][:, :k]
            return values, across(x, idx, own, values, rng), float(np.trace(g))
    q = np.linalg.qr(rng.standard_normal((x.width, min(x.width, k + max(10, k)))))[0]
    for _ in range(maxiter):
        y = gram_times(x, q)
        small, turn = np.linalg.eigh(q.T @ y)
        order = np.argsort(-small)
        values, turn = small[order], turn[:, order]
        vectors, image = q @ turn[:, :k], y @ turn[:, :k]
        if np.linalg.norm(image - vectors * values[:k], axis=0).max() <= tol * max(values[0], 1e-300):
            return values[:k], vectors, squares(x)
        q = np.linalg.qr(y)[0]
    raise RuntimeError(f"no convergence after {maxiter} passes")


def across(x: Matrix, idx: np.ndarray, own: np.ndarray, values: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Eigenvectors of gram(x), width x k, from those of row_gram(x): rows' sum by own's column. For values of 0 any others at right angles."""

    def add(sums, at, rows, batch):
        sums += rows.T @ own[np.searchsorted(idx, at)]

    found = total(x.rows, x.width, add, (x.width, len(values)))
    known = int((values > max(values[0], 0.0) * 1e-13).sum())
    found[:, :known] /= np.linalg.norm(found[:, :known], axis=0)
    if known < len(values):
        rest = rng.standard_normal((x.width, len(values) - known))
        for _ in range(2):  # twice, for rounding
            rest = np.linalg.qr(rest - found[:, :known] @ (found[:, :known].T @ rest))[0]
        found[:, known:] = rest
    return found


def signs(v: np.ndarray) -> np.ndarray:
    """1 or -1 for each column, so that its entry of largest size (the first of equals) becomes positive."""
    at = np.argmax(np.round(np.abs(v), 12), axis=0)
    return np.where(v[at, np.arange(v.shape[1])] < 0, -1.0, 1.0)
