"""Matrices derived from the star-schema tables, the same in Spark and in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import Matrix, from_arrays, from_long

#: Variables of the dosage fixture.
P = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(of) -> object:
    """The first 24 bits of md5 as a share of 1."""
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 6), 16, 10).cast("long")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, var_idx, value: dosages with a population for each region; about one in fifty is missing."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("i"), F.col("n_regionkey").alias("pop"))
    s = s.repartition(spark.sparkContext.defaultParallelism, "i")  # a few files can hold all customers; their cells are the work
    cells = s.select("i", "pop", F.explode(F.sequence(F.lit(0), F.lit(P - 1))).alias("j"))
    bar = lambda *x: F.concat_ws("|", *[c.cast("string") for c in x])
    fr = F.lit(0.1) + F.lit(0.8) * (part(bar(F.lit("f"), F.col("j"), F.col("pop"))) / F.lit(16777216.0))
    hit = lambda tag: (part(bar(F.lit(tag), F.col("i"), F.col("j"))) / F.lit(16777216.0) < F.col("fr")).cast("int")
    d = F.when(part(bar(F.lit("m"), F.col("i"), F.col("j"))) % 50 != 0, hit("a") + hit("b"))
    return cells.withColumn("fr", fr).select(F.col("i").alias("sample_idx"), F.col("j").cast("long").alias("var_idx"), d.cast("double").alias("value"))


GENO = """
s as (select cast(c_custkey as bigint) sample_idx, n_regionkey pop from customer join nation on c_nationkey = n_nationkey),
v as (select unnest(generate_series(0, 39)) snp_idx),
f as (select snp_idx, pop, 0.1::double + 0.8::double * (('0x'||substr(md5('f|'||snp_idx||'|'||pop),1,6))::bigint / 16777216.0::double) fr from v, (select distinct pop from s)),
geno as materialized (select sample_idx, cast(snp_idx as bigint) var_idx,
  case when ('0x'||substr(md5('m|'||sample_idx||'|'||snp_idx),1,6))::bigint % 50 <> 0 then
    ((('0x'||substr(md5('a|'||sample_idx||'|'||snp_idx),1,6))::bigint / 16777216.0::double < fr)::int
   + (('0x'||substr(md5('b|'||sample_idx||'|'||snp_idx),1,6))::bigint / 16777216.0::double < fr)::int)::double end as value
  from s join f using (pop))
"""


def samples(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


#: Fixture matrices by application, tables and side: derived once a session, as a user keeps a matrix that many passes read.
KEPT: dict[tuple[str, str, str], Matrix] = {}


def geno_matrix(spark: SparkSession, sf_dir: str, by: str = "sample") -> Matrix:
    """Keys of customers count from 0, so they serve as sample indices by variable too."""
    key = (spark.sparkContext.applicationId, sf_dir, by)
    if key not in KEPT:
        x = from_long(geno(spark, sf_dir), by=by, n=samples(spark, sf_dir), p=P, variables=variants(spark))
        KEPT[key] = replace(x, rows=x.rows.persist())
    return KEPT[key]


def variants(spark: SparkSession) -> DataFrame:
    """var_idx, var_id, chrom, bp, ref_allele."""
    return spark.range(P).select(F.col("id").alias("var_idx"), F.concat(F.lit("rs"), F.col("id")).alias("var_id"), (F.col("id") % 22 + 1).cast("string").alias("chrom"), ((F.col("id") + 1) * 1000000).alias("bp"), F.when(F.col("id") % 2 == 0, "A").otherwise("G").alias("ref_allele"))


VARIANTS = """variants as (select cast(i as bigint) var_idx, 'rs'||i var_id, cast(i % 22 + 1 as varchar) chrom, (cast(i as bigint) + 1) * 1000000 bp, case when i % 2 = 0 then 'A' else 'G' end ref_allele from (select unnest(generate_series(0, 39)) i))"""


def pheno(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """sample_idx, y: balance, number of orders, their sum and mean (null without orders)."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total"), F.avg(F.col("o_totalprice").cast("double")).alias("mean"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("sample_idx"), F.col("c_acctbal").cast("double").alias("bal")).join(orders, F.col("sample_idx") == F.col("c"), "left")
    y = [F.col("bal"), F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.col("total"), F.col("mean")]
    return rows.select("sample_idx", F.array(*y[:k]).alias("y"))


PHENO = """
ph as (select cast(c_custkey as bigint) sample_idx, c_acctbal::double y1, coalesce(n, 0)::double y2, total y3, mean y4
  from customer left join (select o_custkey, count(*) n, sum(o_totalprice::double) total, avg(o_totalprice::double) mean from orders group by 1) on c_custkey = o_custkey)
"""


def pheno_matrix(spark: SparkSession, sf_dir: str, k: int) -> Matrix:
    return from_arrays(pheno(spark, sf_dir, k), "sample_idx", "y", width=k, count=samples(spark, sf_dir))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def label_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """A column for each label but the least."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    y = F.array(*[(F.col("label") == x).cast("double") for x in labels[1:]])
    return from_arrays(rows.select("vec_id", y.alias("y")), "vec_id", "y", width=len(labels) - 1)


def line_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """Five columns of all line items."""
    part_size = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").join(part_size, F.col("l_partkey") == F.col("p_partkey"))
    y = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size")])
    return from_arrays(rows.select("l_orderkey", y.alias("y")), "l_orderkey", "y", width=5)
