"""PLINK filesets: packed dosages (.bed), variants (.bim) and samples (.fam); and a writer.

The packed file is read by a data source whose partitions are ranges of variants: each seeks to its own
bytes and decodes them with a table of the four 2-bit codes. Paths go through pyarrow's file systems,
so a store that executors share is enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.matrix import Matrix
from .text import lines

#: File header (variant-major), and dosages of the first allele by 2-bit code 00 01 10 11.
MAGIC = b"\x6c\x1b\x01"
DOSAGE = (2, None, 1, 0)
#: Bytes of dosages that a partition decodes at most, and below which a file isn't cut further to give each core some.
PARTITION, LEAST = 32 << 20, 256 << 10


def open_file(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def codes_of(packed: np.ndarray, n: int) -> np.ndarray:
    """Rows of packed bytes to rows of n 2-bit codes, the lowest bits of a byte first."""
    codes = (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return codes.reshape(len(packed), -1)[:, :n].astype(np.int8)


def decode(packed: np.ndarray, n: int) -> np.ndarray:
    """Rows of packed bytes to rows of n dosages; -1 is missing."""
    return np.array([-1 if d is None else d for d in DOSAGE], np.int8)[codes_of(packed, n)]


def encode(dosages: np.ndarray) -> np.ndarray:
    """Rows of dosages (-1: missing) to rows of packed bytes."""
    codes = np.array([3, 2, 0, 1], np.uint8)[dosages]
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))
    quads = codes.reshape(len(codes), -1, 4)
    return (quads << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)


class Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class BedReader(DataSourceReader):
    def __init__(self, path: str, n: int, raw: bool = False, cores: int = 1):
        self.path, self.n, self.raw, self.cores = path, n, raw, cores
        self.each = -(-n // 4)
        with open_file(path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{path} is not a variant-major packed genotype file")
            size = f.size() - 3
        if size % self.each:
            raise ValueError(f"{path} doesn't hold whole variants of {n} samples")
        self.count = size // self.each

    def partitions(self) -> Sequence[InputPartition]:
        n = max(1, self.n)
        rows = max(1, min(PARTITION // n, max(LEAST // n, -(-self.count // self.cores))))
        return [Range(i, min(i + rows, self.count)) for i in range(0, self.count, rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        step = max(1, (4 << 20) // max(1, self.n))
        with open_file(self.path) as f:
            f.seek(3 + self.each * partition.start)
            for at in range(partition.start, partition.stop, step):
                rows = min(step, partition.stop - at)
                got = (codes_of if self.raw else decode)(np.frombuffer(f.read(rows * self.each), np.uint8).reshape(rows, self.each), self.n)
                flat = got.reshape(-1)
                values = pa.array(flat, pa.int8(), mask=flat < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * self.n, pa.int32()), values)], names=["var_idx", "codes" if self.raw else "dosages"])


class BedSource(DataSource):
    """Options: path, samples (their number), raw (codes instead of dosages), cores (that are to have some)."""

    def raw(self) -> bool:
        return self.options.get("raw", "false").lower() == "true"

    @classmethod
    def name(cls) -> str:
        return "packed_genotypes"

    def schema(self) -> str:
        return f"var_idx long, {'codes' if self.raw() else 'dosages'} array<tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return BedReader(self.options["path"], int(self.options["samples"]), self.raw(), int(self.options.get("cores", "1")))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """var_idx, chrom, var_id, cm, bp, ref_allele, alt_allele."""
    f = F.col("fields")
    bp = F.coalesce(f[3].try_cast("long"), F.raise_error(F.concat(F.lit(f"{path}: position is no number: "), f[3])).cast("long"))
    return lines(spark, path).select(F.col("idx").alias("var_idx"), f[0].alias("chrom"), f[1].alias("var_id"), f[2].try_cast("double").alias("cm"), bp.alias("bp"), f[4].alias("ref_allele"), f[5].alias("alt_allele"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, fid, iid, pid, mid, sex, pheno."""
    f = F.col("fields")
    return lines(spark, path).select(F.col("idx").alias("sample_idx"), f[0].alias("fid"), f[1].alias("iid"), f[2].alias("pid"), f[3].alias("mid"), f[4].try_cast("int").alias("sex"), f[5].try_cast("double").alias("pheno"))


def paths(prefix: str | None = None, bed: str | None = None, bim: str | None = None, fam: str | None = None) -> tuple[str, str, str]:
    """The three files of a prefix, or as given."""
    got = tuple(own or (f"{prefix}.{end}" if prefix else None) for own, end in ((bed, "bed"), (bim, "bim"), (fam, "fam")))
    if not all(got):
        raise ValueError("give a prefix, or bed, bim and fam")
    return got


def read_bed(spark: SparkSession, path: str, samples: int, raw: bool = False) -> DataFrame:
    """var_idx, dosages (null: missing); raw: var_idx, codes (0 to 3) as they are packed."""
    spark.dataSource.register(BedSource)
    return spark.read.format("packed_genotypes").option("path", path).option("samples", samples).option("raw", raw).option("cores", spark.sparkContext.defaultParallelism).load()


def read_plink(spark: SparkSession, prefix: str | None = None, bed: str | None = None, bim: str | None = None, fam: str | None = None) -> Matrix:
    """A matrix by variable with ids of variables and samples."""
    bed, bim, fam = paths(prefix, bed, bim, fam)
    variants, samples = read_bim(spark, bim), read_fam(spark, fam)
    n, p = samples.count(), variants.count()
    rows = read_bed(spark, bed, n).select(F.col("var_idx").alias("idx"), F.col("dosages").cast("array<double>").alias("values"))
    return Matrix(rows, "variable", n, p, variants, samples)


def impute_batches(column: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells = batch.column(column)
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(len(sizes)), sizes)
            n = np.bincount(row[known], minlength=len(sizes))
            mean = np.bincount(row[known], values[known], len(sizes)) / np.maximum(n, 1)
            filled = pa.array(np.where(known, values, mean[row]), mask=~known & (n == 0)[row])
            offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            out = pa.ListArray.from_arrays(offsets, filled, mask=cells.is_null())
            yield batch.set_column(batch.schema.get_field_index(column), column, out)

    return run


def impute_mean(rows: DataFrame, column: str = "dosages") -> DataFrame:
    """Arrays with missing values set to the row's mean, not scaled; null where a row has no value at all."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == column else f.dataType) for f in rows.schema])
    return rows.mapInArrow(impute_batches(column), schema)


def write_plink(prefix: str, dosages: np.ndarray, variants: Sequence[Sequence], samples: Sequence[Sequence]) -> None:
    """Writes a small fileset to a local folder, for tests and exchange. dosages: variants x samples, -1 missing."""
    with open(f"{prefix}.bed", "wb") as f:
        f.write(MAGIC + encode(dosages).tobytes())
    for end, rows in (("bim", variants), ("fam", samples)):
        with open(f"{prefix}.{end}", "w") as f:
            f.writelines("\t".join(map(str, r)) + "\n" for r in rows)
