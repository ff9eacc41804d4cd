"""Queries that go through files: the fixtures written as a fileset or text, read by the sources, and worked on."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import pca as pca_op
from ..operators import project as project_op
from ..operators import scca as scca_op
from ..sources import plink, text
from ..streaming.project import project_stream
from . import fixtures as fx
from .catalog import K, PROJECT, SQL, cells, fixed_loadings, query, r, saved_scale
from .matrix import Matrix, from_arrays

#: Folders of this process by session and table folder, so that a fixture is written once.
WRITTEN: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder that executors can read: in spark.checkpoint.dir, or of our own in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-files-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def put(path: str, content: bytes) -> None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(content)


def table(rows) -> bytes:
    return "".join("\t".join(map(str, row)) + "\n" for row in rows).encode()


def packable(x: Matrix) -> dict[int, np.ndarray]:
    """The rows by index, as 1 x width dosages of a byte; -1 is missing."""
    out = {}
    for batch in x.rows.select("idx", F.transform("values", lambda v: v.cast("tinyint")).alias("d")).toArrow().to_batches():
        rows = batch.column("d").flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(batch.num_rows, x.width)
        out |= {idx: rows[i : i + 1] for i, idx in enumerate(batch.column("idx").to_pylist())}
    return out


def fileset(spark: SparkSession, sf_dir: str) -> str:
    """Prefix of the dosage fixture as a fileset, with its frequencies (.frq) and phenotypes (.pheno). The fixture is small."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in WRITTEN:
        x = fx.geno_matrix(spark, sf_dir, "variable")
        dosages = np.concatenate([row for _, row in sorted(packable(x).items())])
        variants = [(v["chrom"], v["var_id"], 0, v["bp"], v["ref_allele"], "C") for v in fx.variants(spark).orderBy("var_idx").collect()]
        prefix = f"{folder(spark)}/geno"
        put(f"{prefix}.bed", plink.MAGIC + plink.encode(dosages).tobytes())
        put(f"{prefix}.bim", table(variants))
        put(f"{prefix}.fam", table((f"f{i}", f"i{i}", 0, 0, i % 2 + 1, -9) for i in range(x.n)))
        rates = [(d[d >= 0].sum() / (2 * (d >= 0).sum()), 2 * int((d >= 0).sum())) for d in dosages]
        put(f"{prefix}.frq", table([("CHR", "SNP", "A1", "A2", "MAF", "NCHROBS"), *((v[0], v[1], v[4], v[5], repr(float(min(f, 1 - f))), n) for v, (f, n) in zip(variants, rates, strict=True))]))
        pheno = [row["y"] for row in fx.pheno(spark, sf_dir, 4).orderBy("sample_idx").collect()]
        put(f"{prefix}.pheno", table((f"f{i}", f"i{i}", *("NA" if v is None else repr(v) for v in y)) for i, y in enumerate(pheno)))
        WRITTEN[key] = prefix
    return WRITTEN[key]


@query("file_genotypes", f"with {fx.GENO} select sample_idx, var_idx, value from geno")
def _genotypes(spark, d):
    prefix = fileset(spark, d)
    n = plink.read_fam(spark, f"{prefix}.fam").count()
    rows = plink.read_bed(spark, f"{prefix}.bed", n)
    return rows.select("var_idx", F.posexplode("dosages").alias("at", "x")).select(F.col("at").cast("long").alias("sample_idx"), "var_idx", F.col("x").cast("double").alias("value"))


@query("file_codes", f"with {fx.GENO} select sample_idx, var_idx, cast(case when value is null then 1 when value = 2 then 0 when value = 1 then 2 else 3 end as integer) code from geno")
def _codes(spark, d):
    """The 2-bit codes as they are packed."""
    rows = plink.read_bed(spark, f"{fileset(spark, d)}.bed", fx.samples(spark, d), raw=True)
    return rows.select("var_idx", F.posexplode("codes").alias("at", "x")).select(F.col("at").cast("long").alias("sample_idx"), "var_idx", F.col("x").cast("int").alias("code"))


@query("file_genotypes_imputed", SQL["impute_mean"])
def _genotypes_imputed(spark, d):
    prefix = fileset(spark, d)
    rows = plink.impute_mean(plink.read_bed(spark, f"{prefix}.bed", fx.samples(spark, d)))
    return rows.select("var_idx", F.posexplode("dosages").alias("at", "x")).select(F.col("at").cast("long").alias("sample_idx"), "var_idx", r("x").alias("value"))


@query("file_variants", f"with {fx.VARIANTS} select var_idx, chrom, var_id, 0.0::double cm, bp, ref_allele, 'C' alt_allele from variants")
def _variants(spark, d):
    return plink.read_bim(spark, f"{fileset(spark, d)}.bim")


@query("file_samples", "select cast(c_custkey as bigint) sample_idx, 'f'||c_custkey fid, 'i'||c_custkey iid, '0' pid, '0' mid, cast(c_custkey % 2 + 1 as integer) sex, -9.0::double pheno from customer")
def _samples(spark, d):
    return plink.read_fam(spark, f"{fileset(spark, d)}.fam")


@query("file_frequencies", f"with {fx.GENO}, {fx.VARIANTS}, q as (select var_idx, least(avg(value)/2, 1-avg(value)/2) maf, 2 * count(value) nchrobs from geno group by 1) select var_idx, chrom, var_id, ref_allele a1, 'C' a2, round(maf, 9) + 0.0 maf, nchrobs from q join variants using (var_idx)")
def _frequencies(spark, d):
    prefix = fileset(spark, d)
    return text.read_maf(spark, f"{prefix}.frq", plink.read_bim(spark, f"{prefix}.bim")).withColumn("maf", r("maf", 9))


@query("file_phenotypes", f"with {fx.PHENO} select sample_idx, 'f'||sample_idx fid, 'i'||sample_idx iid, y1, y2, round(y3, 6) + 0.0 y3, round(y4, 6) + 0.0 y4 from ph")
def _phenotypes(spark, d):
    y = F.col("y")
    return text.read_pheno(spark, f"{fileset(spark, d)}.pheno").select("sample_idx", "fid", "iid", y[0].alias("y1"), y[1].alias("y2"), r(y[2]).alias("y3"), r(y[3]).alias("y4"))


@query("file_matrix_rows", f"with {fx.PHENO} select sample_idx - 5 idx, y1, y2 from ph where sample_idx between 5 and 24")
def _matrix_rows(spark, d):
    """From the sixth row on, twenty rows, two columns."""
    got = text.read_matrix(spark, f"{fileset(spark, d)}.pheno", firstcol=3, skip=5, nrows=20)
    return got.select("idx", F.col("values")[0].alias("y1"), F.col("values")[1].alias("y2"))


@query("file_pca_pcs", SQL["pca_pcs"])
def _file_pcs(spark, d):
    return cells(pca_op.pca(plink.read_plink(spark, fileset(spark, d)), K, persist=False).projection, "sample_idx", "pc")


@query("file_project", f"with {fx.GENO}, {fx.VARIANTS}, w as (select var_id, ((var_idx % 7) - 3) / 10.0::double a from variants), q as (select var_idx, least(avg(value)/2, 1-avg(value)/2) maf from geno group by 1), z as (select sample_idx, var_id, coalesce((value - 2*maf) / sqrt(2*maf*(1-maf)), 0) z from geno join q using (var_idx) join variants using (var_idx)) select sample_idx, round(sum(z*a) / sqrt(40), 6) + 0.0 as pc from z join w using (var_id) group by 1")
def _file_project(spark, d):
    """Genotypes, and the scale from frequencies, out of files."""
    prefix = fileset(spark, d)
    x = plink.read_plink(spark, prefix)
    maf = text.read_maf(spark, f"{prefix}.frq", x.variables).withColumnRenamed("a1", "ref_allele")
    got = project_op.project(x, fixed_loadings(spark), project_op.meansd_of_maf(maf))
    return got.select("sample_idx", r(F.col("values")[0]).alias("pc"))


@query("file_scca", SQL["scca_penalised"])
def _file_scca(spark, d):
    """Genotypes and phenotypes out of files; X stays by variable, as it is read."""
    prefix = fileset(spark, d)
    x = plink.read_plink(spark, prefix)
    y = from_arrays(text.read_pheno(spark, f"{prefix}.pheno").select("sample_idx", F.slice("y", 1, 2).alias("y")), "sample_idx", "y", width=2, count=x.n)
    got = scca_op.scca(x, y, 0.05, 0.02, 1, v0=np.array([[1.0], [0.0]]), tol=1e-10)
    return got.weights().select("side", "var_idx", r("weight").alias("weight"), F.lit(round(float(got.d[0]), 6)).alias("d"))


@query("file_saved_table", "select 'f'||c_custkey fid, 'i'||c_custkey iid, c_acctbal::double value from customer")
def _saved_table(spark, d):
    """Written as text and read again."""
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("i"), F.concat(F.lit("f"), "c_custkey").alias("FID"), F.concat(F.lit("i"), "c_custkey").alias("IID"), F.col("c_acctbal").cast("double").alias("PC1"))
    path = folder(spark)
    text.save_text(rows, path, "i", precision=9)
    return text.read_keyed(spark, path, ["fid", "iid"]).select("fid", "iid", F.col("values")[0].alias("value"))


@query("cli_pca", SQL["pca_eigenvalues"].replace("round(lam, 6)", "round(lam, 2)"))
def _cli(spark, d):
    """The command's eigenvalues, from its file."""
    from .. import cli

    out = folder(spark)
    written = cli.run(["--bfile", fileset(spark, d), "--ndim", str(K), "--notime", *(x for name in cli.OUTPUTS for x in (f"--{name}", f"{out}/{name}"))], spark)
    return text.read_values(spark, written[f"{out}/outval"]).select("dim", r("value", 2).alias("value"))


@query("stream_project", PROJECT)
def _stream(spark, d):
    """Rows of samples as a stream from parquet files, scored and written as they come."""
    place = folder(spark)
    x = fx.geno_matrix(spark, d)
    x.rows.select(F.col("idx").alias("sample_idx"), "values").write.parquet(f"{place}/in")
    stream = spark.readStream.schema("sample_idx long, values array<double>").parquet(f"{place}/in")
    scores = project_stream(stream, fx.variants(spark), fixed_loadings(spark), saved_scale(spark, d))
    scores.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return cells(spark.read.parquet(f"{place}/out"), "sample_idx", "pc")
