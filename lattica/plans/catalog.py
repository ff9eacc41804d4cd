"""Queries over the fixtures, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import standardize as st
from ..operators import check as check_op
from ..operators import linalg, qc
from ..operators import pca as pca_op
from ..operators import project as project_op
from ..operators import scca as scca_op
from ..operators import ucca as ucca_op
from . import fixtures as fx
from .matrix import standardized

QUERIES: dict = {}
SQL: dict = {}
K = 4


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(c, digits: int = 6):
    """A rounded double, never -0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def cells(df: DataFrame, idx: str, value: str, digits: int = 6) -> DataFrame:
    """Array rows to idx, dim (from 1), value."""
    return df.select(idx, F.posexplode("values").alias("at", "x")).select(idx, (F.col("at") + 1).alias("dim"), r("x", digits).alias(value))


# --- standardisation ---------------------------------------------------------------------------------------

SD = {"none": "1.0::double", "center": "1.0::double", "sd": "coalesce(stddev_samp(value), 0)", "binom": "sqrt(avg(value)/2*(1-avg(value)/2))", "binom2": "sqrt(2*(avg(value)/2)*(1-avg(value)/2))"}


def z_sql(method: str = "binom2", src: str = "geno", out: str = "z", stat: str = "st") -> str:
    value = "coalesce(value, mean)" if method == "none" else "case when sd <= 1e-9 or value is null then 0.0::double else (value - mean) / sd end"
    return f"""{stat} as (select var_idx, count(value) n, avg(value) mean, {SD[method]} sd from {src} group by 1),
{out} as materialized (select sample_idx, var_idx, {value} z from {src} join {stat} using (var_idx))"""


for _m in st.METHODS:
    query(f"std_stats_{_m}", f"with {fx.GENO} select var_idx, count(value) n, round(avg(value), 9) + 0.0 mean, round({SD[_m]}, 9) + 0.0 sd from geno group by 1")(
        lambda spark, d, m=_m: st.stats(fx.geno(spark, d), m).select("var_idx", "n", r("mean", 9).alias("mean"), r("sd", 9).alias("sd"))
    )
    query(f"std_values_{_m}", f"with {fx.GENO}, {z_sql(_m)} select sample_idx, var_idx, round(z, 6) + 0.0 z from z")(
        lambda spark, d, m=_m: st.standardize(fx.geno(spark, d), m).select("sample_idx", "var_idx", r("z").alias("z"))
    )


@query("std_values_by_variable", SQL["std_values_binom2"])
def _std_rows(spark, d):
    z = standardized(fx.geno_matrix(spark, d, "variable"), "binom2")[0]
    return z.long().select("sample_idx", "var_idx", r("value").alias("z"))


@query("std_values_by_sample", SQL["std_values_sd"])
def _std_samples(spark, d):
    z = standardized(fx.geno_matrix(spark, d), "sd")[0]
    return z.long().select("sample_idx", "var_idx", r("value").alias("z"))


@query("scale2_keep_missing", f"with {fx.GENO}, m as (select var_idx, avg(value) mean, {SD['binom']} sd from geno group by 1) select sample_idx, var_idx, round((value - mean) / sd, 6) + 0.0 z from geno join m using (var_idx)")
def _scale2(spark, d):
    return st.scale2(fx.geno(spark, d), "1", impute=False).select("sample_idx", "var_idx", r("z").alias("z"))


@query("impute_mean", f"with {fx.GENO} select sample_idx, var_idx, round(coalesce(value, avg(value) over (partition by var_idx)), 6) + 0.0 as value from geno")
def _impute(spark, d):
    from ..sources.plink import impute_mean

    x = fx.geno_matrix(spark, d, "variable")
    rows = impute_mean(x.rows, "values")
    return rows.select(F.col("idx").alias("var_idx"), F.posexplode("values").alias("at", "x")).select(F.col("at").cast("long").alias("sample_idx"), "var_idx", r("x").alias("value"))


EDGE = "edge as (select i sample_idx, j var_idx, case j when 0 then 0.0 when 1 then 2.0 when 2 then null when 3 then case when i = 3 then null else cast(i % 3 as double) end else cast(i % 2 as double) * 2 end as value from (select unnest(generate_series(0, 7)) i), (select unnest(generate_series(0, 4)) j))"


def edge(spark):
    i, j = F.col("i"), F.col("j")
    value = F.when(j == 0, 0.0).when(j == 1, 2.0).when(j == 2, None).when(j == 3, F.when(i != 3, (i % 3).cast("double"))).otherwise((i % 2).cast("double") * 2)
    return spark.range(8).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select(i.alias("sample_idx"), j.cast("long").alias("var_idx"), value.alias("value"))


@query("zero_variance", f"with {EDGE}, m as (select var_idx, avg(value) mean, coalesce(stddev_samp(value), 0) sd from edge group by 1) select cast(sample_idx as bigint) sample_idx, cast(var_idx as bigint) var_idx, round(case when coalesce(sd, 0) <= 1e-9 or value is null then 0 else (value - mean) / sd end, 6) + 0.0 zero, round(case when value is null then 0 when coalesce(sd, 0) <= 1e-9 then mean else (value - mean) / sd end, 6) + 0.0 as \"mean\" from edge join m using (var_idx)")
def _zero_variance(spark, d):
    a = st.standardize(edge(spark), "sd").select("sample_idx", "var_idx", r("z").alias("zero"))
    b = st.standardize(edge(spark), "sd", zero_var="mean").select("sample_idx", "var_idx", r("z").alias("mean"))
    return a.join(b, ["sample_idx", "var_idx"])


TRAIN = "('0x'||substr(md5('t|'||sample_idx),1,6))::bigint % 5 <> 0"


def is_train():
    return fx.part(F.concat(F.lit("t|"), F.col("sample_idx").cast("string"))) % 5 != 0


@query("scale_by_saved", f"with {fx.GENO}, m as (select var_idx, avg(value) mean, {SD['binom2']} sd from geno where {TRAIN} group by 1) select sample_idx, var_idx, round(coalesce((value - mean) / sd, 0), 6) + 0.0 z from geno join m using (var_idx)")
def _saved(spark, d):
    g = fx.geno(spark, d)
    return st.standardize(g, "binom2", given=st.stats(g.filter(is_train()), "binom2")).select("sample_idx", "var_idx", r("z").alias("z"))


@query("maf_to_meansd", f"with {fx.GENO}, q as (select var_idx, least(avg(value)/2, 1-avg(value)/2) maf from geno group by 1) select var_idx, round(2*maf, 9) + 0.0 as mean, round(sqrt(2*maf*(1-maf)), 9) + 0.0 as sd_binom2, round(sqrt(maf*(1-maf)), 9) + 0.0 as sd_binom from q")
def _maf(spark, d):
    q = qc.variable_rates(fx.geno(spark, d))
    mean, sd2 = st.maf_to_meansd(F.col("maf"), "binom2")
    return q.select("var_idx", r(mean, 9).alias("mean"), r(sd2, 9).alias("sd_binom2"), r(st.maf_to_meansd(F.col("maf"), "binom")[1], 9).alias("sd_binom"))


@query("soft_threshold", "select cast(c_custkey as bigint) id, round(sign(c_acctbal/1000) * greatest(abs(c_acctbal/1000) - 2.5, 0), 9) + 0.0 w, cast(sign(c_acctbal) as double) s from customer")
def _soft(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), r(st.soft_threshold(F.col("c_acctbal") / 1000, 2.5), 9).alias("w"), st.sign(F.col("c_acctbal")).alias("s"))


@query("norm_threshold", "with a as (select c_custkey id, c_nationkey g, c_acctbal / sqrt(sum(c_acctbal*c_acctbal) over (partition by c_nationkey)) w from customer), b as (select id, g, sign(w) * greatest(abs(w) - 0.05, 0) w from a), c as (select id, w, sqrt(sum(w*w) over (partition by g)) n from b) select cast(id as bigint) id, round(case when n > 0 then w / n else w end, 9) + 0.0 w from c")
def _norm(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_nationkey", F.col("c_acctbal").alias("w"))
    return st.norm_threshold(c, "w", 0.05, ["c_nationkey"]).select("id", r("w", 9).alias("w"))


# --- checks and filters ------------------------------------------------------------------------------------


@query("geno_missingness", f"with {fx.GENO} select sample_idx, count(*) n, count(*) - count(value) missing from geno group by 1")
def _missing(spark, d):
    return qc.sample_rates(fx.geno(spark, d))


@query("variable_rates", f"with {fx.GENO} select var_idx, count(*) n, count(*) - count(value) missing, round(count(value) / count(*), 9) + 0.0 call_rate, round(least(avg(value)/2, 1-avg(value)/2), 9) + 0.0 maf from geno group by 1")
def _rates(spark, d):
    return qc.variable_rates(fx.geno(spark, d)).select("var_idx", "n", "missing", r("call_rate", 9).alias("call_rate"), r("maf", 9).alias("maf"))


@query("dosage_faults", f"with {fx.GENO} select sample_idx, var_idx, value + case when var_idx = 7 and sample_idx % 10 = 0 then 0.5 else 0 end as value from geno where value is not null and var_idx = 7 and sample_idx % 10 = 0")
def _faults(spark, d):
    spoilt = F.col("value") + F.when((F.col("var_idx") == 7) & (F.col("sample_idx") % 10 == 0), 0.5).otherwise(0.0)
    return qc.dosage_faults(fx.geno(spark, d).withColumn("value", spoilt))


@query("region_exclusion", f"with {fx.VARIANTS}, re(chrom, a, b) as (values ('1', 500000, 1500000), ('1', 20000000, 30000000), ('6', 5000000, 6000000), ('8', 1, 2)) select var_idx, var_id, chrom, bp from variants v where not exists (select 1 from re where re.chrom = v.chrom and v.bp between a and b)")
def _regions(spark, d):
    regions = spark.createDataFrame([("1", 500000, 1500000), ("1", 20000000, 30000000), ("6", 5000000, 6000000), ("8", 1, 2)], "chrom string, start long, stop long")
    return qc.exclude_regions(fx.variants(spark).select("var_idx", "var_id", "chrom", "bp"), regions)


@query("keep_train", f"with {fx.GENO} select sample_idx, count(value) n, sum(value) total from geno where {TRAIN} group by 1")
def _train(spark, d):
    g = fx.geno(spark, d)
    return qc.keep(g, g.select("sample_idx").distinct().filter(is_train())).groupBy("sample_idx").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query("remove_train", f"with {fx.GENO} select sample_idx, count(value) n, sum(value) total from geno where not ({TRAIN}) group by 1")
def _test(spark, d):
    g = fx.geno(spark, d)
    return qc.remove(g, g.select("sample_idx").distinct().filter(is_train())).groupBy("sample_idx").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


SUPPLY = "select l_suppkey % 20 as var_idx, l_extendedprice::double as value from lineitem"


def supply(spark, d):
    return fx.table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("var_idx"), F.col("l_extendedprice").cast("double").alias("value"))


@query("spread", f"with x as ({SUPPLY}) select var_idx, round(max(value), 6) + 0.0 largest, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 iqr, round(median(value), 6) + 0.0 as median from x group by 1")
def _spread(spark, d):
    return qc.spread(supply(spark, d)).select("var_idx", r("largest").alias("largest"), r("iqr").alias("iqr"), r("median").alias("median"))


@query("top_by_both", f"with x as ({SUPPLY}), s as (select var_idx, max(value) a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) b from x group by 1) select var_idx from s where a >= (select quantile_cont(a, 0.4) from s) and b >= (select quantile_cont(b, 0.4) from s)")
def _top(spark, d):
    return qc.top_by_both(supply(spark, d), 0.6)


# --- products ----------------------------------------------------------------------------------------------

Z = f"{fx.GENO}, {z_sql()}"


def z_of(spark, d, by="sample"):
    return standardized(fx.geno_matrix(spark, d, by), "binom2")[0]


@query("gram_vars", f"with {Z} select a.var_idx i, b.var_idx j, round(sum(a.z*b.z), 6) + 0.0 v from z a join z b using (sample_idx) group by 1, 2")
def _gram(spark, d):
    g = linalg.gram(z_of(spark, d))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))], "i long, j long, v double").select("i", "j", r("v").alias("v"))


@query("gram_samples_norms", f"with {Z}, g as (select sum(a.z*b.z) v, a.var_idx = b.var_idx d from z a join z b using (sample_idx) group by a.var_idx, b.var_idx) select round(sum(v) filter (d), 4) + 0.0 trace, round(sum(v*v) / 1e3, 4) + 0.0 as squares from g")
def _gram_samples(spark, d):
    """Of the samples' Gram matrix, by the shorter side: it is never made."""
    g = linalg.shorter_gram(z_of(spark, d, "variable"))
    return spark.createDataFrame([(float(np.trace(g)), float((g**2).sum()) / 1e3)], "trace double, squares double").select(r("trace", 4).alias("trace"), r("squares", 4).alias("squares"))


@query("trace", f"with {Z} select round(sum(z*z) / 40, 6) + 0.0 trace from z")
def _trace(spark, d):
    z = z_of(spark, d, "variable")
    return z.rows.agg(r(F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v)) / 40).alias("trace"))


@query("gram_times_vec", f"with {Z}, x as (select sample_idx, sum(z * ((var_idx % 7) - 3)) s from z group by 1) select var_idx, round(sum(z*s), 5) + 0.0 v from z join x using (sample_idx) group by 1")
def _gram_vec(spark, d):
    v = linalg.gram_times(z_of(spark, d), np.array([[j % 7 - 3.0] for j in range(fx.P)]))
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(v[:, 0])], "var_idx long, v double").select("var_idx", r("v", 5).alias("v"))


@query("xt_mul", f"with {Z} select var_idx, round(sum(z * ((sample_idx % 5) - 2)), 6) + 0.0 a, round(sum(z * ((sample_idx % 3) - 1)), 6) + 0.0 b from z group by 1")
def _xt(spark, d):
    x = z_of(spark, d, "variable")
    i = np.arange(x.n)
    got = linalg.rows_times(x, np.stack([i % 5 - 2.0, i % 3 - 1.0], axis=1))
    return got.select(F.col("idx").alias("var_idx"), r(F.col("values")[0]).alias("a"), r(F.col("values")[1]).alias("b"))


@query("x_mul", f"with {Z} select sample_idx, round(sum(z * ((var_idx % 7) - 3)), 6) + 0.0 a from z group by 1")
def _xm(spark, d):
    got = linalg.rows_times(z_of(spark, d), np.array([[j % 7 - 3.0] for j in range(fx.P)]))
    return got.select(F.col("idx").alias("sample_idx"), r(F.col("values")[0]).alias("a"))


@query("covariances", f"with {fx.PHENO} select round(covar_samp(y1, y2), 4) + 0.0 c12, round(covar_samp(y2, y3) / 1e3, 4) + 0.0 c23, round(var_samp(y2), 6) + 0.0 v2, round(corr(y2, y3), 9) + 0.0 r23 from ph")
def _cov(spark, d):
    y = fx.pheno(spark, d, 4).select(*[F.col("y")[i].alias(f"y{i + 1}") for i in range(4)])
    return y.agg(r(F.covar_samp("y1", "y2"), 4).alias("c12"), r(F.covar_samp("y2", "y3") / 1e3, 4).alias("c23"), r(F.var_samp("y2")).alias("v2"), r(F.corr("y2", "y3"), 9).alias("r23"))


# --- principal components ----------------------------------------------------------------------------------


def eigen_sql(k: int, div: str, squarings: int = 10) -> str:
    """CTEs e1..ek (vectors: j, c) and l1..lk (values: lam) of Z'Z/div by repeated squaring and deflation; needs z."""
    out = [f"g1 as materialized (select a.var_idx i, b.var_idx j, sum(a.z*b.z) / {div} v from z a join z b using (sample_idx) group by 1, 2)"]
    for d in range(1, k + 1):
        last = f"g{d}"
        for s in range(squarings):
            out.append(f"q{d}_{s} as materialized (select i, j, v / max(abs(v)) over () v from (select a.i, b.j, sum(a.v*b.v) v from {last} a join {last} b on a.j = b.i group by 1, 2))")
            last = f"q{d}_{s}"
        out.append(f"c{d} as materialized (select i j, v from {last} where j = (select j from {last} group by j order by sum(v*v) desc, j limit 1))")
        out.append(f"u{d} as materialized (select j, v / sqrt(sum(v*v) over ()) c from c{d})")
        out.append(f"e{d} as materialized (select j, c * (select sign(c) from u{d} order by round(abs(c), 12) desc, j limit 1) c from u{d})")
        out.append(f"l{d} as materialized (select sum(g.v * a.c * b.c) lam from g{d} g join e{d} a on g.i = a.j join e{d} b on g.j = b.j)")
        if d < k:
            out.append(f"g{d + 1} as materialized (select g.i, g.j, g.v - lam * a.c * b.c v from g{d} g join e{d} a on g.i = a.j join e{d} b on g.j = b.j, l{d})")
    return ",\n".join(out)


EIGEN = f"with {Z}, {eigen_sql(K, '40')}"
UNION = lambda form: " union all ".join(form.format(d=d) for d in range(1, K + 1))


def fit(spark, d, by="sample"):
    return pca_op.pca(fx.geno_matrix(spark, d, by), K, persist=False)


@query("pca_eigenvalues", f"{EIGEN} {UNION('select {d} dim, round(lam, 6) + 0.0 as value from l{d}')}")
def _values(spark, d):
    return fit(spark, d).values.select("dim", r("value").alias("value"))


@query("pca_eigenvalues_wide", SQL["pca_eigenvalues"])
def _values_wide(spark, d):
    """By variable: the Gram matrix of samples, wider than is made; from the products of variables."""
    return pca_op.pca(fx.geno_matrix(spark, d, "variable"), K, gram_width=100, tol=1e-10, persist=False).values.select("dim", r("value").alias("value"))


@query("pca_pve", f"{EIGEN}, t as (select sum(z*z) / 40 t from z) {UNION('select {d} dim, round(lam / t, 9) + 0.0 as value from l{d}, t')}")
def _pve(spark, d):
    return fit(spark, d).pve.select("dim", r("value", 9).alias("value"))


@query("pca_loadings", f"{EIGEN} {UNION('select j var_idx, {d} dim, round(c, 6) + 0.0 loading from e{d}')}")
def _loadings(spark, d):
    return cells(fit(spark, d).loadings, "var_idx", "loading")


@query("pca_pcs", f"{EIGEN} {UNION('select sample_idx, {d} dim, round(sum(z*c) / sqrt(40), 6) + 0.0 pc from z join e{d} on var_idx = j group by 1')}")
def _pcs(spark, d):
    return cells(fit(spark, d).projection, "sample_idx", "pc")


@query("pca_vectors", f"{EIGEN} {UNION('select sample_idx, {d} dim, round(sum(z*c) / sqrt(40) / sqrt(any_value(lam)), 6) + 0.0 u from z join e{d} on var_idx = j, l{d} group by 1')}")
def _vectors(spark, d):
    return cells(fit(spark, d).vectors, "sample_idx", "u")


@query("pca_scale", f"with {fx.GENO} select var_idx, round(avg(value), 9) + 0.0 as mean, round({SD['binom2']}, 9) + 0.0 as sd from geno group by 1")
def _scale(spark, d):
    return fit(spark, d).scale.select("var_idx", r("mean", 9).alias("mean"), r("sd", 9).alias("sd"))


@query("pca_identities", f"with {Z}, g as (select sum(a.z*b.z) / 40 v, a.var_idx = b.var_idx d from z a join z b using (sample_idx) group by a.var_idx, b.var_idx) select round(sum(v) filter (d), 5) + 0.0 total, round(sum(v*v), 4) + 0.0 as squares from g")
def _identities(spark, d):
    z = z_of(spark, d)
    e = linalg.top_eigen(z, z.p)[0] / z.p
    return spark.createDataFrame([(float(e.sum()), float((e**2).sum()))], "total double, squares double").select(r("total", 5).alias("total"), r("squares", 4).alias("squares"))


@query("pca_lines", f"with x as (select row_number() over () sample_idx, l_quantity::double a, l_extendedprice::double b, l_discount::double c, l_tax::double d, p_size::double e from lineitem join part on l_partkey = p_partkey), geno as materialized (select sample_idx, 0 var_idx, a as value from x union all select sample_idx, 1, b from x union all select sample_idx, 2, c from x union all select sample_idx, 3, d from x union all select sample_idx, 4, e from x), {z_sql('sd')}, {eigen_sql(1, '(select count(*) - 1 from x)', 16)} select 1 dim, round(lam, 6) + 0.0 as value from l1")
def _lines(spark, d):
    return pca_op.pca(fx.line_matrix(spark, d), 1, "sd", "n1", persist=False).values.select("dim", r("value").alias("value"))


@query("pca_embeddings_trace", "with x as (select vec_id, unnest(generate_series(1, 64)) j, embedding from embeddings), y as (select j, embedding[j]::double v from x), m as (select j, avg(v) mean from y group by 1) select round(sum((v - mean) * (v - mean)) / 64, 6) + 0.0 trace from y join m using (j)")
def _emb(spark, d):
    return spark.createDataFrame([(pca_op.pca(fx.embedding_matrix(spark, d), K, "center", persist=False).trace,)], "trace double").select(r("trace").alias("trace"))


@query("top_loadings", f"{EIGEN}, a as ({UNION('select j var_idx, {d} dim, c from e{d}')}) select dim, rank, var_idx, round(c, 6) + 0.0 loading from (select *, row_number() over (partition by dim order by abs(c) desc, var_idx) rank from a) where rank <= 5")
def _top_loadings(spark, d):
    return pca_op.top_loadings(fit(spark, d).loadings, 5).select("dim", F.col("rank").cast("long").alias("rank"), "var_idx", r("loading").alias("loading"))


@query("annotate_loadings", f"{EIGEN}, {fx.VARIANTS}, a as ({UNION('select j var_idx, {d} dim, c from e{d}')}) select dim, rank, var_id, chrom, bp, round(c, 6) + 0.0 loading from (select *, row_number() over (partition by dim order by abs(c) desc, var_idx) rank from a) join variants using (var_idx) where rank <= 3")
def _annotate_loadings(spark, d):
    """The largest loadings with their variants' ids and places."""
    top = pca_op.top_loadings(fit(spark, d).loadings, 3)
    got = qc.annotated(top, fx.variants(spark).select("var_idx", "var_id", "chrom", "bp"), ["var_idx"])
    return got.select("dim", F.col("rank").cast("long").alias("rank"), "var_id", "chrom", "bp", r("loading").alias("loading"))


@query("label_components", f"{EIGEN}, p as (select sample_idx, sum(z*c) / sqrt(40) pc from z join e1 on var_idx = j group by 1) select r_name as population, count(*) n, round(avg(pc), 5) + 0.0 mean from p join customer on c_custkey = sample_idx join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def _label_components(spark, d):
    """First component by population of the samples."""
    c, n, g = (fx.table(spark, d, t) for t in ("customer", "nation", "region"))
    labels = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").cast("long").alias("sample_idx"), F.col("r_name").alias("population"))
    got = qc.annotated(fit(spark, d).projection.select("sample_idx", F.col("values")[0].alias("pc")), labels, ["sample_idx"])
    return got.groupBy("population").agg(F.count("*").alias("n"), r(F.avg("pc"), 5).alias("mean"))


# --- check and project -------------------------------------------------------------------------------------

CLAIM = "select sample_idx, ((sample_idx % 11) - 5) / 50.0::double a, ((sample_idx % 13) - 6) / 50.0::double b from (select distinct sample_idx from geno)"


@query("check_residuals", f"with {Z}, u as ({CLAIM}), t as (select var_idx, sum(z*a) a, sum(z*b) b from z join u using (sample_idx) group by 1), e as (select sample_idx, sum(z*t.a) / 40 - any_value(u.a) * 3.5 a, sum(z*t.b) / 40 - any_value(u.b) * 2.5 b from z join t using (var_idx) join u using (sample_idx) group by 1), sums as (select sum(a*a) ea, sum(b*b) eb, count(*) n from e) select round(ea, 5) + 0.0 err1, round(eb, 5) + 0.0 err2, round((ea+eb)/(2*n), 8) + 0.0 mse, round(sqrt((ea+eb)/(2*n)), 8) + 0.0 rmse from sums")
def _check(spark, d):
    return claimed(spark, d, "sample")


def claimed(spark, d, by):
    x = fx.geno_matrix(spark, d, by)
    u = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("sample_idx"), F.array((F.col("c_custkey") % 11 - 5) / F.lit(50.0), (F.col("c_custkey") % 13 - 6) / F.lit(50.0)).alias("values"))
    got = check_op.check(x, u, [3.5, 2.5])
    err = [row["value"] for row in got.err.orderBy("dim").collect()]
    return spark.createDataFrame([(*err, got.mse, got.rmse)], "err1 double, err2 double, mse double, rmse double").select(r("err1", 5).alias("err1"), r("err2", 5).alias("err2"), r("mse", 8).alias("mse"), r("rmse", 8).alias("rmse"))


@query("check_residuals_by_variable", SQL["check_residuals"])
def _check_variable(spark, d):
    return claimed(spark, d, "variable")


@query("check_of_pca", f"{EIGEN}, u as ({UNION('select sample_idx, {d} dim, sum(z*c) / sqrt(40) / sqrt(any_value(lam)) u from z join e{d} on var_idx = j, l{d} group by 1')}), t as (select var_idx, dim, sum(z*u) t from z join u using (sample_idx) group by 1, 2), lam as ({UNION('select {d} dim, lam from l{d}')}), off as (select sample_idx, dim, sum(z*t) / 40 e from z join t using (var_idx) group by 1, 2), err as (select dim, sum(power(e - u*lam, 2)) err from off join u using (sample_idx, dim) join lam using (dim) group by 1) select cast(dim as integer) dim, round(err, 6) + 0.0 err, round((select sum(err) from err) / (4 * (select count(*) from customer)), 6) + 0.0 mse, round(sqrt((select sum(err) from err) / (4 * (select count(*) from customer))), 4) + 0.0 rmse from err")
def _check_pca(spark, d):
    """What is off in a fit's own eigenpairs: nothing, up to rounding."""
    x = fx.geno_matrix(spark, d)
    p = pca_op.pca(x, K)
    got = check_op.check(x, p.vectors, [v["value"] for v in p.values.orderBy("dim").collect()])
    return got.err.select("dim", r("value").alias("err"), r(F.lit(got.mse)).alias("mse"), r(F.lit(got.rmse), 4).alias("rmse"))


LOADED = "w as (select var_id, ref_allele, ((var_idx % 7) - 3) / 10.0::double a, ((var_idx % 5) - 2) / 10.0::double b from variants)"


def fixed_loadings(spark):
    v = fx.variants(spark)
    return v.select("var_id", "ref_allele", F.array((F.col("var_idx") % 7 - 3) / F.lit(10.0), (F.col("var_idx") % 5 - 2) / F.lit(10.0)).alias("v"))


def saved_scale(spark, d):
    return st.stats(fx.geno(spark, d).filter(is_train()), "binom2").join(fx.variants(spark), "var_idx").select("var_id", "ref_allele", "mean", "sd")


PROJECT = f"with {fx.GENO}, {fx.VARIANTS}, {LOADED}, m as (select var_idx, avg(value) mean, {SD['binom2']} sd from geno where {TRAIN} group by 1), z as (select sample_idx, var_id, coalesce((value - mean) / sd, 0) z from geno join m using (var_idx) join variants using (var_idx)), p as (select sample_idx, sum(z*a) / sqrt(40) a, sum(z*b) / sqrt(40) b from z join w using (var_id) group by 1) select sample_idx, 1 dim, round(a, 6) + 0.0 pc from p union all select sample_idx, 2, round(b, 6) + 0.0 from p"


@query("project_fixed_loadings", PROJECT)
def _project(spark, d):
    return cells(project_op.project(fx.geno_matrix(spark, d), fixed_loadings(spark), saved_scale(spark, d)), "sample_idx", "pc")


@query("project_by_variable", PROJECT)
def _project_variable(spark, d):
    return cells(project_op.project(fx.geno_matrix(spark, d, "variable"), fixed_loadings(spark), saved_scale(spark, d)), "sample_idx", "pc")


@query("join_keyed_alignment", PROJECT)
def _keyed(spark, d):
    """Cells whose variables come in another order are matched by id and allele."""
    long = fx.geno(spark, d).withColumn("place", F.lit(39) - F.col("var_idx")).join(fx.variants(spark), "var_idx").select("sample_idx", "place", "var_id", "ref_allele", "value")
    return cells(project_op.project_long(long, fixed_loadings(spark), saved_scale(spark, d)), "sample_idx", "pc")


@query("project_self", SQL["pca_pcs"])
def _self(spark, d):
    """Projecting the samples of a fit gives its components."""
    x = fx.geno_matrix(spark, d)
    p = pca_op.pca(x, K, persist=False)
    v = fx.variants(spark)
    loadings = p.loadings.join(v, "var_idx").select("var_id", "ref_allele", F.col("values").alias("v"))
    scale = p.scale.join(v, "var_idx").select("var_id", "ref_allele", "mean", "sd")
    return cells(project_op.project(x, loadings, scale), "sample_idx", "pc")


# --- association -------------------------------------------------------------------------------------------


def ucca_sql(k: int) -> str:
    """R and F of all 40 variables on k standardised phenotypes, made orthogonal one after another; P in closed form for even k."""
    out = [f"with {Z}, {fx.PHENO}"]
    for i in range(1, k + 1):
        out.append(f", p{i} as (select sample_idx, coalesce((y{i} - avg(y{i}) over ()) / stddev_samp(y{i}) over (), 0) y from ph)")
        out.append(f", o{i}_0 as materialized (select sample_idx, y - avg(y) over () y from p{i})")
        for j in range(1, i):
            out.append(f", o{i}_{j} as materialized (select a.sample_idx, a.y - q.y * (sum(a.y*q.y) over ()) / (sum(q.y*q.y) over ()) y from o{i}_{j - 1} a join q{j} q using (sample_idx))")
        out.append(f", q{i} as materialized (select * from o{i}_{i - 1})")
    parts = " + ".join(f"power(covar_samp(z, q{i}.y), 2) / var_samp(q{i}.y)" for i in range(1, k + 1))
    joins = " ".join(f"join q{i} using (sample_idx)" for i in range(1, k + 1))
    out.append(f", r as (select var_idx, count(*) n, ({parts}) / var_samp(z) r2 from z {joins} group by 1)")
    # k = 1 and an even number of samples: the two-sided tail of Student's t as a finite sum.
    one = "1 - sqrt(r2) * list_sum(list_transform(range(0, (n - 2) // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1.0) + i * ln(1 - r2)))) / sqrt(pi())"
    p = {1: one, 2: "power(1-r2, (n-3)/2.0)", 4: "power(1-r2, (n-5)/2.0) * (1 + (n-5)/2.0 * r2)"}.get(k)
    out.append(f" select var_idx, round(sqrt(r2), 9) + 0.0 as \"R\", round(r2/(1-r2)*(n-{k}-1)/{k}, 6) + 0.0 as \"Fstat\"" + (f", round({p}, 9) + 0.0 as \"P\"" if p else "") + " from r")
    return "".join(out)


def ucca(spark, d, k, by="sample"):
    got = ucca_op.ucca(fx.geno_matrix(spark, d, by), fx.pheno_matrix(spark, d, k))
    return got.select("var_idx", r("R", 9).alias("R"), r("Fstat").alias("Fstat"), r("P", 9).alias("P"))


for _k in (1, 2, 4):
    query(f"ucca_k{_k}", ucca_sql(_k))(lambda spark, d, k=_k: ucca(spark, d, k))
query("ucca_k2_by_variable", ucca_sql(2))(lambda spark, d: ucca(spark, d, 2, "variable"))


@query("ucca_labels", "with x as (select label, unnest(generate_series(1, 64)) j, embedding from embeddings), y as (select label, j, embedding[j]::double v from x), t as (select j, count(*) n, var_pop(v) * count(*) sst from y group by 1), g as (select j, label, count(*) c, avg(v) m from y group by 1, 2), k as (select count(distinct label) - 1 k from embeddings), b as (select j, sum(c * m * m) - power(sum(c * m), 2) / sum(c) ssb from g group by 1), r as (select j, n, k, ssb / sst r2 from t join b using (j), k) select cast(j - 1 as bigint) var_idx, round(sqrt(r2), 8) + 0.0 as \"R\", round(r2/(1-r2)*(n-k-1)/k, 6) + 0.0 as \"Fstat\" from r")
def _labels(spark, d):
    got = ucca_op.ucca(fx.embedding_matrix(spark, d), fx.label_matrix(spark, d), "sd", "center")
    return got.select("var_idx", r("R", 8).alias("R"), r("Fstat").alias("Fstat"))


# --- sparse canonical correlation --------------------------------------------------------------------------


def scca_sql(l1: float, l2: float, steps: int = 30) -> str:
    """One dimension from v = (1, 0): every half step a CTE."""
    out = [f"with {Z}, {fx.PHENO}, w as (select sample_idx, 1 l, coalesce((y1 - avg(y1) over ()) / stddev_samp(y1) over (), 0) y from ph union all select sample_idx, 2, coalesce((y2 - avg(y2) over ()) / stddev_samp(y2) over (), 0) from ph)"]
    out.append(", c as materialized (select var_idx j, l, sum(z*y) / ((select count(*) from ph) - 1) v from z join w using (sample_idx) group by 1, 2), v0 as (select 1 l, 1.0::double x union all select 2, 0.0)")

    def shrink(name, key, source, penalty):
        out.append(f", {name}a as materialized (select {key}, x / sqrt(sum(x*x) over ()) x from ({source}))")
        out.append(f", {name}b as materialized (select {key}, sign(x) * greatest(abs(x) - {penalty}::double, 0) x from {name}a)")
        out.append(f", {name} as materialized (select {key}, x / sqrt(sum(x*x) over ()) x from {name}b)")

    for i in range(1, steps + 1):
        shrink(f"u{i}", "j", f"select j, sum(c.v * v.x) x from c join v{i - 1} v using (l) group by 1", l1)
        shrink(f"v{i}", "l", f"select l, sum(c.v * u.x) x from c join u{i} u using (j) group by 1", l2)
    out.append(f", d as (select sum(c.v * u.x * v.x) d from c join u{steps} u using (j) join v{steps} v using (l)) select 'x' side, cast(j as bigint) var_idx, round(x, 6) + 0.0 weight, round(d, 6) + 0.0 d from u{steps}, d union all select 'y', cast(l - 1 as bigint), round(x, 6) + 0.0, round(d, 6) + 0.0 from v{steps}, d")
    return "".join(out)


def scca_weights(spark, d, l1, l2, limit=scca_op.CROSS):
    got = scca_op.scca(fx.geno_matrix(spark, d), fx.pheno_matrix(spark, d, 2), l1, l2, 1, v0=np.array([[1.0], [0.0]]), tol=1e-10, limit=limit)
    if not got.converged:
        raise RuntimeError("no convergence")
    return got.weights().select("side", "var_idx", r("weight").alias("weight"), F.lit(round(float(got.d[0]), 6)).alias("d"))


query("scca_unpenalised", scca_sql(0.0, 0.0, 60))(lambda spark, d: scca_weights(spark, d, 0.0, 0.0))
query("scca_penalised", scca_sql(0.05, 0.02, 60))(lambda spark, d: scca_weights(spark, d, 0.05, 0.02))


def listed(a) -> str:
    return "[" + ", ".join(listed(x) if np.ndim(x) else f"{float(x)!r}::double" for x in a) + "]"


def fits_sql(source: str, keys: str, v0: np.ndarray, warm: bool, steps: int = 200) -> str:
    """CTEs to `fits` (keys, l1, l2, u1, v1, d1, u2, v2, d2): two dimensions by penalised power iteration from source (keys, c, ct: the
    cross-product by rows and by columns) over the grid `points` (l1, l2). Weights are lists; each iteration is a recursive CTE.

    warm: the start is an unpenalised fit from v0, as without a start given; else v0 itself."""
    p, q = "len(c)", "len(ct)"
    times = lambda m, w: f"list_transform({m}, lambda row: list_inner_product(row, {w}))"
    unit = lambda w: f"(case when list_inner_product({w}, {w}) > 0 then list_transform({w}, lambda e: e / sqrt(list_inner_product({w}, {w}))) else {w} end)"
    soft = lambda w, pen: f"list_transform({w}, lambda e: sign(e) * greatest(abs(e) - {pen}, 0))"
    apart = lambda w, by, n: f"list_transform(range(1, {n} + 1), lambda i: {w}[i] - {by}[i] * list_inner_product({w}, {by}) / list_inner_product({by}, {by}))"

    def dim(name, src, l1, l2, start, by=None):
        side = lambda w, y, n: apart(w, y, n) if by else w
        held = f"{keys}, c, ct, l1, l2, s1, s2" + (", u1, v1, d1" if by else "")
        return f"""{name}_it as (select {held}, 0 step, {start} v, cast(null as double[]) u from {src} union all
    select {held}, step + 1, {unit("vs")} v, u from (select *, {soft(unit("va"), l2)} vs from (select *, {side("vr", "v1", q)} va from (select *, {times("ct", "u")} vr from (
    select {held}, step, {unit("us")} u from (select *, {soft(unit("ua"), l1)} us from (select *, {side("ur", "u1", p)} ua from (select {held}, step, {times("c", "v")} ur from {name}_it where step < {steps}))))))))"""

    last = lambda name, more: f"select * exclude (step, v, u), u {more[0]}, v {more[1]}, list_inner_product(u, {times('c', 'v')}) {more[2]} from {name}_it where step = {steps}"
    a, b = (listed(v0[:, j]) for j in range(2))
    grid = f"select {keys}, c, ct, l1, l2, s1, s2 from starts cross join points"
    starts = f"starts as (select {keys}, c, ct, 0 l1, 0 l2, {a} s1, {b} s2 from {source})"
    if not warm:
        return f"{starts}, cold as ({grid.replace('c, ct, l1, l2', 'c, ct, points.l1, points.l2')}), {dim('one', 'cold', 'l1', 'l2', 's1')}, one as ({last('one', ('u1', 'v1', 'd1'))}), {dim('two', 'one', 'l1', 'l2', 's2', True)}, fits as ({last('two', ('u2', 'v2', 'd2'))})"
    return (
        f"{starts}, {dim('wone', 'starts', '0', '0', 's1')}, wone as ({last('wone', ('u1', 'v1', 'd1'))}), {dim('wtwo', 'wone', '0', '0', 's2', True)}, wtwo as ({last('wtwo', ('u2', 'v2', 'd2'))}), "
        f"warmed as (select {keys}, c, ct, points.l1, points.l2, v1 s1, v2 s2 from wtwo cross join points), {dim('one', 'warmed', 'l1', 'l2', 's1')}, one as ({last('one', ('u1', 'v1', 'd1'))}), {dim('two', 'one', 'l1', 'l2', 's2', True)}, fits as ({last('two', ('u2', 'v2', 'd2'))})"
    )


def points_sql(l1, l2) -> str:
    return "points as (select unnest([" + ", ".join(f"{{'l1': {float(a)!r}::double, 'l2': {float(b)!r}::double}}" for a in l1 for b in l2) + "], recursive := true))"


#: Phenotype columns as rows, and for which samples' statistics and products are taken in each fold (fold -1: all samples).
def cross_sql(folds: str, scale: str) -> str:
    """CTE `cx` (fold, c, ct) from `folds` (fold, sample_idx): Z_x'Z_y times scale, both standardised by the samples of the fold."""
    return f"""yl as (select sample_idx, l, y from (select sample_idx, unnest([1, 2, 3, 4]) l, unnest([y1, y2, y3, y4]) y from ph)),
xs as materialized (select fold, var_idx j, avg(value) mean, {SD["binom2"]} sd from geno join {folds} using (sample_idx) group by 1, 2),
ys as materialized (select fold, l, avg(y) mean, stddev_samp(y) sd from yl join {folds} using (sample_idx) group by 1, 2),
zx as materialized (select fold, sample_idx, j, case when sd > 1e-9 then (value - mean) / sd end z from geno join {folds} using (sample_idx) join xs using (fold) where xs.j = geno.var_idx),
zy as materialized (select fold, sample_idx, l, case when sd > 1e-9 then (y - mean) / sd end z from yl join {folds} using (sample_idx) join ys using (fold, l)),
cells as materialized (select fold, j, l, coalesce(sum(zx.z * zy.z), 0) / ({scale}) v from zx join zy using (fold, sample_idx) group by 1, 2, 3),
cx as materialized (select a.fold, c, ct from (select fold, list(r order by j) c from (select fold, j, list(v order by l) r from cells group by 1, 2) group by 1) a join (select fold, list(r order by l) ct from (select fold, l, list(v order by j) r from cells group by 1, 2) group by 1) b on a.fold = b.fold)"""


UNIT_START = np.array([[1.0, 0.5], [0.25, 1.0], [0.5, -0.5], [0.75, 0.25]])
NZ = "len(list_filter({}, lambda e: e <> 0))"
ALL_FOLDS = "(select -1 fold, sample_idx from ph)"
GRID_SQL = f"with recursive {fx.GENO}, {fx.PHENO}, {cross_sql(ALL_FOLDS, '(select count(*) - 1 from ph)')}, {points_sql([0.0, 0.05], [0.0, 0.05])}, {fits_sql('cx', 'fold', UNIT_START, False)} " + " union all ".join(
    f"select l1 lambda1, l2 lambda2, {j} dim, round(d{j}, 6) + 0.0 d, {NZ.format(f'u{j}')} nzero_x, {NZ.format(f'v{j}')} nzero_y, true converged from fits" for j in (1, 2)
)


@query("scca_grid", GRID_SQL)
def _grid(spark, d):
    got = scca_op.scca_grid(fx.geno_matrix(spark, d), fx.pheno_matrix(spark, d, 4), [0.0, 0.05], [0.0, 0.05], 2, v0=UNIT_START, tol=1e-12)
    rows = [(float(a), float(b), j + 1, float(x.d[j]), int(np.count_nonzero(x.u[:, j])), int(np.count_nonzero(x.v[:, j])), x.converged) for (a, b), x in got.items() for j in range(2)]
    return spark.createDataFrame(rows, "lambda1 double, lambda2 double, dim int, d double, nzero_x long, nzero_y long, converged boolean").withColumn("d", r("d"))


FOLDS = 5
FOLD_SQL = f"('0x'||substr(md5('k|'||sample_idx),1,6))::bigint % {FOLDS}"
#: Correlations of raw scores over all samples, each scored by `fits` of its own fold; missing values count as 0.
POOLED = """both_u as (select l1, l2, fold, 1 dim, u1 w from fits union all select l1, l2, fold, 2, u2 from fits),
both_v as (select l1, l2, fold, 1 dim, v1 w from fits union all select l1, l2, fold, 2, v2 from fits),
sc as materialized (select l1, l2, sample_idx, dim, sum(coalesce(value, 0) * w) a from (select l1, l2, fold, dim, unnest(w) w, generate_subscripts(w, 1) - 1 j from both_u) join (select geno.*, fold from geno join held using (sample_idx)) g using (fold) where g.var_idx = j group by 1, 2, 3, 4),
sy as materialized (select l1, l2, sample_idx, dim, sum(coalesce(y, 0) * w) b from (select l1, l2, fold, dim, unnest(w) w, generate_subscripts(w, 1) l from both_v) v join (select yl.*, fold from yl join held using (sample_idx)) g using (fold) where g.l = v.l group by 1, 2, 3, 4),
co as (select l1, l2, dim, corr(a, b) corr from sc join sy using (l1, l2, sample_idx, dim) group by 1, 2, 3),
nz as (select l1, l2, dim, avg(nx) nx, avg(ny) ny from (select l1, l2, 1 dim, len(list_filter(u1, lambda e: e <> 0)) nx, len(list_filter(v1, lambda e: e <> 0)) ny from fits union all select l1, l2, 2, len(list_filter(u2, lambda e: e <> 0)), len(list_filter(v2, lambda e: e <> 0)) from fits) group by 1, 2, 3)"""
CV_SQL = f"with recursive {fx.GENO}, {fx.PHENO}, held as materialized (select sample_idx, {FOLD_SQL} fold from ph), tr as materialized (select f.fold, sample_idx from held cross join (select unnest(range({FOLDS})) fold) f where held.fold <> f.fold), {cross_sql('tr', '(select count(*) - 1 from ph)')}, {points_sql([0.0, 0.05, 0.1], [0.0, 0.05])}, {fits_sql('cx', 'fold', scca_op.start(4, 2, 1), True)}, {POOLED}"


def cross_validated(spark, d):
    idx = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx"))
    folds = idx.withColumn("fold", (fx.part(F.concat(F.lit("k|"), F.col("idx").cast("string"))) % FOLDS).cast("int"))
    return scca_op.cv_scca(fx.geno_matrix(spark, d), fx.pheno_matrix(spark, d, 4), [0.0, 0.05, 0.1], [0.0, 0.05], 2, nfolds=FOLDS, folds=folds, tol=1e-12)


@query("cv_scca_grid", CV_SQL + " select cast(dim as integer) dim, l1 lambda1, l2 lambda2, round(corr, 6) + 0.0 corr, nx::double nzero_x, ny::double nzero_y from co join nz using (l1, l2, dim)")
def _cv(spark, d):
    g = cross_validated(spark, d).grid
    return g.select("dim", "lambda1", "lambda2", r("corr").alias("corr"), "nzero_x", "nzero_y")


@query("cv_scca_best", CV_SQL + " select l1 lambda1, l2 lambda2, round(corr, 6) + 0.0 corr from co where dim = 1 and corr is not null order by corr desc, l1, l2 limit 1")
def _best(spark, d):
    return spark.createDataFrame([x] if (x := cross_validated(spark, d).best()) else [], "lambda1 double, lambda2 double, corr double").withColumn("corr", r("corr"))


@query("score_correlation", f"with {Z}, {fx.PHENO}, a as (select sample_idx, sum(z * ((var_idx % 7) - 3)) s, sum(z * ((var_idx % 5) - 2)) t from z group by 1) select round(corr(s, y1), 9) + 0.0 s1, round(corr(s, y2), 9) + 0.0 s2, round(corr(t, y1), 9) + 0.0 t1, round(corr(t, y2), 9) + 0.0 t2 from a join ph using (sample_idx)")
def _scores(spark, d):
    w = np.array([[j % 7 - 3.0, j % 5 - 2.0] for j in range(fx.P)])
    a = linalg.rows_times(z_of(spark, d), w).join(fx.pheno(spark, d, 2).withColumnRenamed("sample_idx", "idx"), "idx")
    return a.agg(*[r(F.corr(F.col("values")[i], F.col("y")[j]), 9).alias(f"{n}{j + 1}") for i, n in enumerate("st") for j in range(2)])


def split(spark, d):
    """Both matrices of the training samples and of the others."""
    from .matrix import from_arrays, from_long

    g, y = fx.geno(spark, d), fx.pheno(spark, d, 4)
    out = []
    for keep in (is_train(), ~is_train()):
        rows = y.filter(keep)
        n = rows.count()
        out += [from_long(g.filter(keep), n=n, p=fx.P), from_arrays(rows, "sample_idx", "y", width=4, count=n)]
    return out


TUNED_SQL = (
    f"with recursive {fx.GENO}, {fx.PHENO}, held as materialized (select sample_idx, 0 fold from ph where not ({TRAIN})), tr as materialized (select 0 fold, sample_idx from ph where {TRAIN}), {cross_sql('tr', '(select count(*) - 1 from tr)')}, {points_sql([0.0, 0.05], [0.0, 0.05])}, {fits_sql('cx', 'fold', UNIT_START, False)}, {POOLED} "
    "select cast(dim as integer) dim, l1 lambda1, l2 lambda2, round(corr, 6) + 0.0 corr, cast(nx as bigint) nzero_x, cast(ny as bigint) nzero_y, true converged from co join nz using (l1, l2, dim)"
)


@query("scca_tuned", TUNED_SQL)
def _tuned(spark, d):
    x, y, x_test, y_test = split(spark, d)
    got = scca_op.tune(x, y, x_test, y_test, [0.0, 0.05], [0.0, 0.05], 2, v0=UNIT_START, tol=1e-12)
    return got.select("dim", "lambda1", "lambda2", r("corr").alias("corr"), "nzero_x", "nzero_y", "converged")


@query("drop_empty_samples", f"with {fx.GENO}, spoilt as (select sample_idx, var_idx, case when sample_idx % 9 <> 0 then value end as value from geno), known as (select sample_idx from spoilt group by 1 having count(value) > 0) select sample_idx, var_idx, value from spoilt where sample_idx in (select sample_idx from known)")
def _drop_empty(spark, d):
    """Every ninth sample loses all its values."""
    return qc.drop_empty_samples(fx.geno(spark, d).withColumn("value", F.when(F.col("sample_idx") % 9 != 0, F.col("value"))))


@query("pca_pcs_named", f"{EIGEN}, p as (select sample_idx, " + ", ".join(f"sum(z*e{i}.c) / sqrt(40) p{i}" for i in range(1, K + 1)) + " from z " + " ".join(f"join e{i} on z.var_idx = e{i}.j" for i in range(1, K + 1)) + " group by 1) select sample_idx, c_name as name, " + ", ".join(f'round(p{i}, 6) + 0.0 as "PC{i}"' for i in range(1, K + 1)) + " from p join customer on c_custkey = sample_idx")
def _named(spark, d):
    ids = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("sample_idx"), F.col("c_name").alias("name"))
    got = pca_op.with_ids(fit(spark, d).projection, ids, "sample_idx", "PC")
    return got.select("sample_idx", "name", *[r(f"PC{i}").alias(f"PC{i}") for i in range(1, K + 1)])


@query("project_maf_scale", f"with {fx.GENO}, {fx.VARIANTS}, {LOADED}, q as (select var_idx, least(avg(value)/2, 1-avg(value)/2) maf from geno group by 1), z as (select sample_idx, var_id, coalesce((value - 2*maf) / sqrt(2*maf*(1-maf)), 0) z from geno join q using (var_idx) join variants using (var_idx)) select sample_idx, round(sum(z*a) / sqrt(40), 6) + 0.0 as pc from z join w using (var_id) group by 1")
def _maf_scale(spark, d):
    maf = qc.variable_rates(fx.geno(spark, d)).join(fx.variants(spark), "var_idx").select("var_id", "ref_allele", "maf")
    got = project_op.project(fx.geno_matrix(spark, d), fixed_loadings(spark), project_op.meansd_of_maf(maf))
    return got.select("sample_idx", r(F.col("values")[0]).alias("pc"))


from . import catalog_files  # noqa: E402, F401  (adds its queries)
