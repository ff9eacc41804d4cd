"""The six verbs against numpy, their invariants, files, and edges."""

import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.functions import special
from lattica.functions import standardize as st
from lattica.operators import check as check_op
from lattica.operators import linalg
from lattica.operators import pca as pca_op
from lattica.operators import project as project_op
from lattica.operators import scca as scca_op
from lattica.operators import ucca as ucca_op
from lattica.plans.matrix import Matrix, from_arrays, from_long, from_wide, standardized, statistics
from lattica.sources import plink, text

N, P = 60, 14


def scale(x, method):
    m = np.nanmean(x, 0)
    sd = {"sd": np.nanstd(x, 0, ddof=1), "binom": np.sqrt(m / 2 * (1 - m / 2)), "binom2": np.sqrt(m * (1 - m / 2)), "center": np.ones(x.shape[1]), "none": np.ones(x.shape[1])}[method]
    if method == "none":
        return np.where(np.isnan(x), m, x)
    return np.nan_to_num((x - m) / sd)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    pop = rng.integers(0, 3, N)
    freq = rng.uniform(0.1, 0.9, (3, P))
    x = rng.binomial(2, freq[pop]).astype(float)
    x[rng.random((N, P)) < 0.03] = np.nan
    y = np.nan_to_num(x[:, :3]) @ rng.standard_normal((3, 4)) + rng.standard_normal((N, 4))
    cells = [(i, j, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(N) for j in range(P)]
    long = spark.createDataFrame(cells, "sample_idx long, var_idx long, value double").repartition(5)
    variants = spark.createDataFrame([(j, f"rs{j}", "AG"[j % 2]) for j in range(P)], "var_idx long, var_id string, ref_allele string")
    frame_y = spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(N)], "i long, y array<double>")
    return SimpleNamespace(x=x, y=y, long=long, variants=variants, sample=from_long(long, variables=variants), variable=from_long(long, by="variable", variables=variants), pheno=from_arrays(frame_y, "i", "y"))


def dense(df, idx, n):
    rows = {r[idx]: r["values"] for r in df.collect()}
    assert sorted(rows) == list(range(n))
    return np.array([rows[i] for i in range(n)])


@pytest.mark.parametrize("method", st.METHODS)
@pytest.mark.parametrize("by", ["sample", "variable"])
def test_standardised_values(data, method, by):
    z, told = standardized(getattr(data, by), method)
    got = dense(z.rows.withColumnRenamed("idx", "i"), "i", N if by == "sample" else P)
    np.testing.assert_allclose(got if by == "sample" else got.T, scale(data.x, method), atol=1e-10)
    means = {r["var_idx"]: r["mean"] for r in told.collect()}
    np.testing.assert_allclose([means[j] for j in range(P)], np.nanmean(data.x, 0))


@pytest.mark.parametrize("by", ["sample", "variable"])
@pytest.mark.parametrize("stand,div", [("binom2", "p"), ("sd", "n1"), ("center", "none"), ("binom", "p"), ("none", "p")])
def test_pca(data, by, stand, div):
    k = 3
    got = pca_op.pca(getattr(data, by), k, stand, div)
    z = scale(data.x, stand)
    d = {"p": P, "n1": N - 1, "none": 1}[div]
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    sign = linalg.signs(vt[:k].T)
    np.testing.assert_allclose([r["value"] for r in got.values.orderBy("dim").collect()], s[:k] ** 2 / d, rtol=1e-9)
    np.testing.assert_allclose([r["value"] for r in got.pve.orderBy("dim").collect()], s[:k] ** 2 / (s**2).sum(), rtol=1e-9)
    np.testing.assert_allclose(dense(got.vectors, "sample_idx", N), u[:, :k] * sign, atol=1e-8)
    np.testing.assert_allclose(dense(got.loadings, "var_idx", P), vt[:k].T * sign, atol=1e-8)
    np.testing.assert_allclose(dense(got.projection, "sample_idx", N), u[:, :k] * s[:k] / d**0.5 * sign, atol=1e-8)
    assert np.isclose(got.trace, (z**2).sum() / d)
    assert "3 dimensions" in repr(got)
    claim = check_op.check(getattr(data, by), got.vectors, [r["value"] for r in got.values.orderBy("dim").collect()], stand, div)
    assert claim.mse < 1e-12


def test_subspace_iteration_equals_the_gram_path(data):
    z = standardized(data.sample, "sd")[0]
    a, va = linalg.top_eigen(z, 3)
    b, vb = linalg.top_eigen(z, 3, tol=1e-12, gram_width=2)
    np.testing.assert_allclose(a, b, rtol=1e-8)
    np.testing.assert_allclose(np.abs((va * vb).sum(0)), 1, atol=1e-8)


@pytest.mark.parametrize("piece", [linalg.PIECE, 8 * P * 7, 1])
def test_gram_by_the_shorter_side(data, monkeypatch, piece):
    """Rows longer than they are many, in pieces that fit and that don't, and without a square of their length."""
    monkeypatch.setattr(linalg, "PIECE", piece)
    z = standardized(data.variable, "binom2")[0]
    g, idx = linalg.row_gram(z)
    x = scale(data.x, "binom2")
    np.testing.assert_allclose(g, x.T @ x, atol=1e-9)
    assert idx.tolist() == list(range(P))
    monkeypatch.setattr(linalg, "DRIVER_BYTES", 8 * N * P)
    got = linalg.shorter_gram(z)
    assert np.isclose(np.trace(got), (x**2).sum()) and np.isclose((got**2).sum(), ((x @ x.T) ** 2).sum())
    with pytest.raises(ValueError):
        linalg.gram(z)


def test_gram_of_rows_with_gaps_and_repeats(data):
    z = standardized(data.variable, "binom2")[0]
    some = Matrix(z.rows.filter("idx % 3 <> 1"), "variable", N, P)
    keep = [j for j in range(P) if j % 3 != 1]
    g, idx = linalg.row_gram(some)
    x = scale(data.x, "binom2")[:, keep]
    np.testing.assert_allclose(g, x.T @ x, atol=1e-9)
    assert idx.tolist() == keep
    with pytest.raises(Exception):  # noqa: B017
        linalg.row_gram(Matrix(z.rows.union(z.rows), "variable", N, 2 * P))


def test_partitions_do_not_matter(data):
    want = None
    for parts in (1, 4, 13):
        m = Matrix(data.sample.rows.repartition(parts), "sample", N, P)
        got = dense(pca_op.pca(m, 2).projection, "sample_idx", N)
        want = got if want is None else want
        np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("by", ["sample", "variable"])
def test_check_formula(data, by, spark):
    rng = np.random.default_rng(1)
    u, d = rng.standard_normal((N, 2)), np.array([2.0, 1.0])
    vectors = spark.createDataFrame([(i, [float(v) for v in u[i]]) for i in range(N)], "sample_idx long, values array<double>")
    z = scale(data.x, "binom2")
    e = z @ (z.T @ u) / P - u * d
    got = check_op.check(getattr(data, by), vectors, list(d))
    np.testing.assert_allclose([r["value"] for r in got.err.orderBy("dim").collect()], (e**2).sum(0))
    assert np.isclose(got.rmse, np.sqrt((e**2).mean()))
    with pytest.raises(ValueError):
        check_op.check(getattr(data, by), vectors.limit(5), list(d))
    with pytest.raises(ValueError):
        check_op.check(getattr(data, by), vectors, [1.0, 2.0, 3.0])


def test_projection(data, spark):
    fit = pca_op.pca(data.sample, 3)
    loadings = fit.loadings.join(data.variants, "var_idx").select("var_id", "ref_allele", F.col("values").alias("v"))
    meansd = fit.scale.join(data.variants, "var_idx").select("var_id", "ref_allele", "mean", "sd")
    want = dense(fit.projection, "sample_idx", N)
    np.testing.assert_allclose(dense(project_op.project(data.sample, loadings, meansd), "sample_idx", N), want, atol=1e-9)
    np.testing.assert_allclose(dense(project_op.project(data.variable, loadings, meansd), "sample_idx", N), want, atol=1e-9)
    cells = data.long.join(data.variants, "var_idx").select("sample_idx", "var_id", "ref_allele", "value")
    np.testing.assert_allclose(dense(project_op.project_long(cells, loadings, meansd), "sample_idx", N), want, atol=1e-9)
    for bad in (loadings.filter("var_id <> 'rs3'"), loadings.withColumn("ref_allele", F.lit("T"))):
        with pytest.raises(ValueError):
            project_op.project(data.sample, bad, meansd)
    with pytest.raises(ValueError):
        project_op.project(data.sample, loadings, meansd.withColumn("sd", F.lit(0.0)))


def test_streamed_projection(data, spark, tmp_path):
    from lattica.streaming.project import project_stream

    fit = pca_op.pca(data.sample, 2)
    loadings = fit.loadings.join(data.variants, "var_idx").select("var_id", "ref_allele", F.col("values").alias("v"))
    meansd = fit.scale.join(data.variants, "var_idx").select("var_id", "ref_allele", "mean", "sd")
    data.sample.rows.withColumnRenamed("idx", "sample_idx").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample_idx long, values array<double>").parquet(str(tmp_path / "in"))
    q = project_stream(stream, data.variants, loadings, meansd).writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    np.testing.assert_allclose(dense(spark.table("scores"), "sample_idx", N), dense(fit.projection, "sample_idx", N), atol=1e-9)


@pytest.mark.parametrize("by", ["sample", "variable"])
@pytest.mark.parametrize("k", [1, 4])
def test_ucca_equals_least_squares(data, spark, by, k):
    y = data.y[:, :k]
    pheno = from_arrays(spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(N)], "i long, y array<double>"), "i", "y")
    got = {r["var_idx"]: r for r in ucca_op.ucca(getattr(data, by), pheno).collect()}
    z = scale(data.x, "binom2")
    a = np.column_stack([np.ones(N), y])
    for j in range(P):
        fit = a @ np.linalg.lstsq(a, z[:, j], rcond=None)[0]
        r2 = 1 - ((z[:, j] - fit) ** 2).sum() / ((z[:, j] - z[:, j].mean()) ** 2).sum()
        assert np.isclose(got[j]["R"], r2**0.5) and np.isclose(got[j]["Fstat"], r2 / (1 - r2) * (N - k - 1) / k)
        w, b = 1 - r2, (N - k - 1) / 2
        if k == 4:
            assert np.isclose(got[j]["P"], w**b * (1 + b * r2), rtol=1e-9)


def test_tails_of_f_against_the_library(spark):
    f = spark._jvm.org.apache.commons.math3.distribution.FDistribution
    for k, n in ((1, 30), (3, 100), (7, 20)):
        for r2 in (0.01, 0.3, 0.7):
            _, (stat,), (p,) = special.wilks(r2, n, k)
            assert np.isclose(p, 1 - f(float(k), float(n - k - 1)).cumulativeProbability(float(stat)), rtol=1e-6, atol=1e-12)


def test_ucca_edges(data, spark):
    flat = from_wide(spark.createDataFrame([(i, 1.0, float(i % 3)) for i in range(20)], "i long, a double, b double"), "i", ["a", "b"])
    y = from_arrays(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(20)], "i long, y array<double>"), "i", "y")
    got = {r["var_idx"]: r for r in ucca_op.ucca(flat, y, "sd").collect()}
    assert got[0]["R"] is None and 0 <= got[1]["R"] <= 1  # constant variable; phenotypes of rank 1
    with pytest.raises(ValueError):
        ucca_op.ucca(data.sample, y)
    with pytest.raises(ValueError):
        ucca_op.ucca(flat, y, "binom2") if False else ucca_op.ucca(from_wide(flat.rows.select("idx", F.lit(0.5).alias("a"), F.lit(1.0).alias("b")), "idx", ["a", "b"]), y)


def test_scca_of_itself_gives_eigenvalues(data):
    x = data.sample
    got = scca_op.scca(x, x, 1e-9, 1e-9, 3, standy="binom2", divisor="n1", tol=1e-9, maxiter=5000)
    z = scale(data.x, "binom2")
    s = np.linalg.svd(z)[1]
    assert got.converged
    np.testing.assert_allclose(got.d, s[:3] ** 2 / (N - 1), rtol=1e-5)
    px, py = dense(got.px, "sample_idx", N), dense(got.py, "sample_idx", N)
    for j in range(3):
        assert np.isclose(abs(np.corrcoef(px[:, j], py[:, j])[0, 1]), 1, atol=1e-6)


def test_scca_divisor_start_and_streamed_steps(data):
    a = scca_op.scca(data.sample, data.pheno, 0.05, 0.05, 2, divisor="n1")
    b = scca_op.scca(data.sample, data.pheno, 0.05, 0.05, 2, divisor="none", v0=a.v0)
    np.testing.assert_allclose(b.d, a.d * (N - 1), rtol=1e-6)
    np.testing.assert_allclose(np.abs(a.u), np.abs(b.u), atol=1e-5)
    v0 = np.eye(4)[:, :1]
    c = scca_op.scca(data.sample, data.pheno, 0.05, 0.05, 1, v0=v0, tol=1e-3)
    e = scca_op.scca(data.sample, data.pheno, 0.05, 0.05, 1, v0=v0, tol=1e-3, limit=1)
    np.testing.assert_allclose(c.u, e.u, atol=1e-9)
    assert scca_op.scca(data.sample, data.pheno, 2.0, 0.0, 2).converged is False
    with pytest.raises(ValueError):
        scca_op.scca(data.sample, data.pheno, -1.0)
    with pytest.raises(ValueError):
        scca_op.scca(data.sample, data.pheno, k=5)


def test_cross_validation_equals_a_plain_loop(data, spark):
    folds = data.sample.rows.select("idx", (F.col("idx") % 3).cast("int").alias("fold"))
    cv = scca_op.cv_scca(data.sample, data.pheno, [0.0, 0.1], [0.05], 1, nfolds=3, folds=folds, maxiter=2000, tol=1e-6)
    got = {(r["lambda1"], r["lambda2"]): r for r in cv.grid.collect()}
    fold = np.arange(N) % 3
    for l1 in (0.0, 0.1):
        a, b = np.zeros(N), np.zeros(N)
        for f in range(3):
            tr = fold != f
            c = scale(data.x[tr], "binom2").T @ scale(data.y[tr], "sd") / (N - 1)
            cross = scca_op.InMemory(c)
            v0 = scca_op.iterate(cross, scca_op.start(4, 1, 1), 1e-12, 1e-12, 1, 2000, 1e-6)
            u, v, _, ok = scca_op.iterate(cross, v0[1], l1, 0.05, 1, 2000, 1e-6)
            assert ok
            a[~tr], b[~tr] = (np.nan_to_num(data.x[~tr]) @ u)[:, 0], (data.y[~tr] @ v)[:, 0]
        assert np.isclose(got[l1, 0.05]["corr"], np.corrcoef(a, b)[0, 1], atol=1e-6)
    assert cv.best()[2] == max(r["corr"] for r in got.values())
    assert cv.converged.count() == 6 and cv.curve().count() == 2
    with pytest.raises(ValueError):
        scca_op.cv_scca(data.sample, data.pheno, [0.0], [0.0], 1, nfolds=1000)


def test_limits_of_dimensions_and_dosages(data, spark):
    for k in (0, 7):
        with pytest.raises(ValueError):
            pca_op.pca(data.sample, k)
    with pytest.raises(ValueError):
        pca_op.pca(from_wide(spark.range(9).select("id", F.lit(0.5).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c")), "id", ["a", "b", "c"]), 1)
    with pytest.raises(ValueError):
        pca_op.pca(from_wide(spark.range(9).select("id", F.lit(1.0).alias("a")), "id", ["a"]), 1)


def test_zero_variance_and_all_missing(spark):
    rows = [(i, 2.0, None, float(i % 2), float("nan") if i else 1.0) for i in range(6)]
    wide = spark.createDataFrame(rows, "i long, a double, b double, c double, d double")
    x = from_wide(wide, "i", ["a", "b", "c", "d"])
    for m in (x, from_long(x.long(), by="variable")):
        for zero_var, a in (("zero", 0.0), ("mean", 2.0)):
            z = {(r["sample_idx"], r["var_idx"]): r["value"] for r in standardized(m, "sd", zero_var=zero_var)[0].long().collect()}
            assert {z[i, 0] for i in range(6)} == {a} and {z[i, 1] for i in range(6)} == {0.0} and len({z[i, 2] for i in range(6)}) == 2
        told = {r["var_idx"]: r for r in statistics(m, "sd").collect()}
        assert told[1]["mean"] is None and told[1]["sd"] is None and told[0]["sd"] == 0.0


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_packed_genotypes(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    d = rng.integers(-1, 3, (9, n)).astype(np.int8)
    variants = [(j % 3 + 1, f"rs{j}", 0, 1000 + j, "A", "G") for j in range(9)]
    people = [(f"f{i}", f"i{i}", 0, 0, 1, -9) for i in range(n)]
    prefix = str(tmp_path / "x")
    plink.write_plink(prefix, d, variants, people)
    m = plink.read_plink(spark, prefix)
    assert (m.n, m.p) == (n, 9)
    rows = {r["idx"]: r["values"] for r in m.rows.collect()}
    assert all([-1 if v is None else v for v in rows[j]] == d[j].tolist() for j in range(9))
    assert [r["var_id"] for r in m.variables.orderBy("var_idx").collect()] == [v[1] for v in variants]
    filled = {r["idx"]: r["values"] for r in plink.impute_mean(m.rows, "values").collect()}
    for j in range(9):
        ok = d[j] >= 0
        if ok.any():
            np.testing.assert_allclose(filled[j], np.where(ok, d[j], d[j][ok].mean()))
    (tmp_path / "bad.bed").write_bytes(b"\x6c\x1b\x00" + b"0" * 9)
    with pytest.raises(Exception):  # noqa: B017
        plink.read_bed(spark, str(tmp_path / "bad.bed"), n).count()


def test_all_byte_values_decode():
    packed = np.arange(256, dtype=np.uint8)[:, None]
    got = plink.decode(packed, 4)
    np.testing.assert_array_equal(plink.encode(got), packed)
    assert got[0].tolist() == [2, 2, 2, 2] and got[0b11100100].tolist() == [2, -1, 1, 0]


def test_text_files(spark, tmp_path):
    (tmp_path / "p").write_text("f1 i1 1.5 NA\nf2\ti2  2 3e2")  # no last newline
    got = text.read_pheno(spark, str(tmp_path / "p")).orderBy("sample_idx").collect()
    assert [r["y"] for r in got] == [[1.5, None], [2.0, 300.0]] and got[1]["iid"] == "i2"
    (tmp_path / "ragged").write_text("1 2\n3\n")
    (tmp_path / "word").write_text("1 x\n")
    for bad in ("ragged", "word"):
        with pytest.raises(Exception):  # noqa: B017
            text.read_matrix(spark, str(tmp_path / bad)).collect()
    (tmp_path / "m.frq").write_text("CHR SNP A1 A2 MAF NCHROBS\n1 rs0 A G 0.25 100\n1 rs1 C T 0.5 98\n")
    variants = spark.createDataFrame([(0, "rs0"), (1, "rs1")], "var_idx long, var_id string")
    assert [r["maf"] for r in text.read_maf(spark, str(tmp_path / "m.frq"), variants).orderBy("var_idx").collect()] == [0.25, 0.5]
    with pytest.raises(ValueError):
        text.read_maf(spark, str(tmp_path / "m.frq"), variants.withColumn("var_id", F.lit("rs9")))
    df = spark.createDataFrame([(1, "b", 1 / 3, None), (0, "a", 123456789.0, 1e-7)], "i int, id string, v double, w double")
    text.save_text(df, str(tmp_path / "out"), "i")
    back = text.lines(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert back[0]["fields"] == ["id", "v", "w"] and back[1]["fields"][0] == "a" and back[2]["fields"] == ["b", "0.3333333", "NA"]
    assert float(back[1]["fields"][1]) == 123456800.0 and float(back[1]["fields"][2]) == 1e-7


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    d = rng.binomial(2, rng.uniform(0.2, 0.8, (12, 1)), (12, 30)).astype(np.int8)
    prefix = str(tmp_path / "d")
    plink.write_plink(prefix, d, [(1, f"rs{j}", 0, j, "A", "G") for j in range(12)], [(f"f{i}", f"i{i}", 0, 0, 1, -9) for i in range(30)])
    (tmp_path / "y").write_text("".join(f"f{i} i{i} {rng.standard_normal()} {rng.standard_normal()}\n" for i in range(30)))
    at = lambda x: str(tmp_path / x)
    names = [f"--{o}={at(o)}" for o in cli.OUTPUTS]
    cli.run(["--bfile", prefix, "--ndim", "3", "--precision", "12", f"--outload={at('load')}", f"--outmeansd={at('msd')}", *names], spark)
    pcs = {r["iid"]: r["values"] for r in text.read_keyed(spark, at("outpc.txt"), ["fid", "iid"]).collect()}
    cli.run(["--project", "--bfile", prefix, f"--inload={at('load.txt')}", f"--inmeansd={at('msd.txt')}", *[x.replace("outproj", "outproj2") if "outproj=" not in x else f"--outproj={at('again')}" for x in names]], spark)
    again = {r["iid"]: r["values"] for r in text.read_keyed(spark, at("again.txt"), ["fid", "iid"]).collect()}
    np.testing.assert_allclose([again[f"i{i}"] for i in range(30)], [pcs[f"i{i}"] for i in range(30)], atol=1e-5)
    cli.run(["--check", "--bfile", prefix, f"--inval={at('outval.txt')}", f"--invec={at('outvec.txt')}", "--verbose"], spark)
    cli.run(["--ucca", "--bfile", prefix, f"--pheno={at('y')}", f"--outucca={at('u')}"], spark)
    assert text.lines(spark, at("u.txt")).count() == 13
    cli.run(["--scca", "--bfile", prefix, f"--pheno={at('y')}", "--ndim", "1", "--div", "n1", "--lambda1", "0.01", *[f"--{o}={at('s' + o)}" for o in cli.OUTPUTS]], spark)
    assert text.lines(spark, at("soutvecx.txt")).count() == 12
    for bad in ([], ["--bfile", prefix, "--ucca"], ["--bfile", prefix, "--project"], ["--bfile", prefix, "--scca", "--ucca"], ["--bfile", prefix, "--tol", "0"], ["--bfile", prefix, "-m", "1", "-b", "1"]):
        with pytest.raises(SystemExit):
            cli.options(bad)


def test_long_rows_from_parts(data, spark, monkeypatch):
    """Rows put together out of parts equal those from cells, with NaN, absent cells and absent rows."""
    cells = data.long.filter("var_idx <> 3 and not (sample_idx = 2 and var_idx = 5)").withColumn("value", F.when((F.col("sample_idx") == 1) & (F.col("var_idx") == 1), float("nan")).otherwise(F.col("value")))
    for by in ("sample", "variable"):
        want = {r["idx"]: r["values"] for r in from_long(cells, by=by, n=N, p=P).rows.collect()}
        monkeypatch.setattr("lattica.plans.matrix.LONG_ROW", 1)
        got = {r["idx"]: r["values"] for r in from_long(cells.repartition(3), by=by, n=N, p=P).rows.collect()}
        monkeypatch.undo()
        assert got == want


def test_imputing_takes_a_row_once(spark):
    """A row's mean is taken once, not for each value: this took the square of a row's length."""
    n = 100_000
    rows = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 4 != 0, (i % 4).cast("tinyint"))).alias("dosages"), F.lit("x").alias("kept"))
    began = time.monotonic()
    got = plink.impute_mean(rows).select("id", "kept", F.expr("aggregate(dosages, 0D, (a, v) -> a + v)").alias("total"), F.size("dosages").alias("size")).collect()
    assert time.monotonic() - began < 30
    assert [(r["id"], r["kept"], r["total"], r["size"]) for r in sorted(got)] == [(i, "x", 2.0 * n, n) for i in range(2)]


def test_imputing_edges(spark):
    rows = spark.createDataFrame([(0, [None, 1, 3]), (1, [None, None]), (2, []), (3, None), (4, [2])], "i int, dosages array<tinyint>").coalesce(1)
    got = {r["i"]: r["dosages"] for r in plink.impute_mean(rows).collect()}
    assert got == {0: [2.0, 1.0, 3.0], 1: [None, None], 2: [], 3: None, 4: [2.0]}


def test_few_long_variants_are_dealt_to_all_cores(spark, tmp_path):
    n, p = 150_000, 8
    d = np.random.default_rng(1).integers(-1, 3, (p, n)).astype(np.int8)
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + plink.encode(d).tobytes())
    rows = plink.read_bed(spark, str(tmp_path / "x.bed"), n)
    assert rows.rdd.getNumPartitions() == 4  # cores of the session
    got = plink.impute_mean(rows).select("var_idx", F.expr("aggregate(dosages, 0D, (a, v) -> a + v)").alias("total"), F.size("dosages").alias("size")).collect()
    assert sorted(r["var_idx"] for r in got) == list(range(p))
    for r in got:
        own = d[r["var_idx"]]
        assert r["size"] == n and np.isclose(r["total"], own[own >= 0].mean() * n)


def test_eigenpairs_of_few_long_rows(data, monkeypatch):
    """Without a pass for each step: from the products of rows, vectors of value 0 too."""
    z = standardized(data.variable, "sd")[0]
    x = scale(data.x, "sd")
    monkeypatch.setattr(linalg, "gram_times", None)
    for rows, dense_x in ((z, x), (Matrix(z.rows.withColumn("values", F.when(F.col("idx") < 3, F.col("values")).otherwise(F.transform("values", lambda v: v * 0.0))), "variable", N, P), x * (np.arange(P) < 3))):
        values, vectors, trace = linalg.eigen_and_trace(rows, 5, gram_width=P)
        g = dense_x @ dense_x.T
        np.testing.assert_allclose(values, np.linalg.eigvalsh(g)[::-1][:5], atol=1e-9)
        np.testing.assert_allclose(g @ vectors, vectors * values, atol=1e-8)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(5), atol=1e-9)
        assert np.isclose(trace, np.trace(g))


@pytest.mark.parametrize("n", [100_000, 256_410, 2_500_000])
def test_tails_of_f_of_many_variables_over_many_rows(n):
    """Variables need different numbers of terms; those that have theirs don't hold up the others."""
    rng = np.random.default_rng(3)
    for k in (1, 4, 9):
        r2 = np.concatenate([rng.uniform(0, 1, 20), np.abs(rng.normal(k / n, (2 * k) ** 0.5 / n, 44)), 10.0 ** rng.uniform(-12, 0, 20)])
        p = special.wilks(r2, n, k)[2]
        np.testing.assert_array_equal(p, [special.wilks(v, n, k)[2][0] for v in r2])
        assert ((p >= 0) & (p <= 1)).all() and (np.diff(p[np.argsort(r2)]) <= 1e-9).all()
        if k == 4:
            b = (n - k - 1) / 2
            np.testing.assert_allclose(p, np.exp(b * np.log1p(-r2)) * (1 + b * r2), rtol=1e-7, atol=1e-9)
