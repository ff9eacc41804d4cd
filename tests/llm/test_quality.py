import zlib

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op10_additive_model(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    print("held-out accuracy", right)
    assert right >= 0.95
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pair_tables_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20, pair_rounds=30)
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "words " * 30000, "c"), (2, "", "b")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, quality.train(docs, labels)).select("__doc.*", "__score").collect()
    assert len(rows) == 4 and all(0 <= r["__score"] <= 1 for r in rows)
    assert len({r["__score"] for r in rows if not r.text}) == 1
    assert quality.accepted(docs, labels.limit(0)).count() == 4
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_query_equals_plain_addition(spark):
    """Scores of the whole table by adding the model's cells one by one, text by text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.op10_additive_model(spark, SF).collect():
        x = quality.features((texts[r.doc_id] or "").encode())
        odds = model.base + sum(t[sum(e <= x[j] for e in model.edges[j])] for j, t in enumerate(model.tables))
        odds += sum(t[sum(e <= x[i] for e in model.coarse[i])][sum(e <= x[j] for e in model.coarse[j])] for i, j, t in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(odds, -40, 40)))) < 1e-9 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_tables_equal_a_plain_boosting():
    """One feature with two values: each round adds the rate times a Newton step, worked out by hand."""
    x, y = np.repeat([[0.0], [1.0]], 50, axis=0), np.array([1.0] * 40 + [0.0] * 10 + [1.0] * 10 + [0.0] * 40)
    model = quality.fit(x, y, rounds=7, pair_rounds=0, pairs=0)
    base, cells = 0.0, [0.0, 0.0]
    for _ in range(7):
        for v, ones in ((0, 40), (1, 10)):
            q = 1 / (1 + np.exp(-base - cells[v]))
            cells[v] += 0.15 * (ones - 50 * q) / (50 * q * (1 - q) + 1.0)
    np.testing.assert_allclose(model.log_odds(np.array([[0.0], [1.0]])), cells, atol=1e-12)
