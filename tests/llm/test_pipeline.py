import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import exact_dedup, packing, pii, quality, simhash

from .test_exact_dedup import low
from .test_packing import check_pieces
from .test_pii import ADDED, base_spans, plain_features, plain_redaction
from .test_similar import plain_classes

SF = "/root/testdata/sf0.001"


def plain_private(texts):
    """Texts by id with personal data replaced: spans, votes, fit and decisions by plain Python."""
    every = {i: [*base_spans(t or ""), *((m.start(), m.end(), k) for k, p in ADDED.items() for m in re.finditer(p, t or ""))] for i, t in texts.items()}
    told = {(i, *x): plain_features(texts[i], *x) for i, spans in every.items() for x in spans}
    counts = Counter(tuple(f[n] for n in pii.FEATURES) for f in told.values())
    model = pii.learn(sorted(((dict(zip(pii.FEATURES, p, strict=True)), n) for p, n in counts.items()), key=lambda x: sorted(x[0].items())))
    out = {}
    for i, t in texts.items():
        kept = [(s, pii.KINDS.index(k), e) for s, e, k in every[i] if pii.KINDS.index(k) < 4 or model.bias + sum(model.weights.get((n, told[i, s, e, k][n]), 0.0) for n in pii.FEATURES) >= 0]
        out[i] = plain_redaction(t, [Span(*x) for x in sorted(kept)]) if kept else t
    return out


class Span:
    def __init__(self, start, kind, end):
        self.start, self.kind, self.end = start, kind, end


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF).persist()
        assert got.columns == columns
        kept.append({r.doc_id: r.text for r in got.collect()})
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Scores by plain addition of the model's cells, one text and one feature at a time.
    want = {i: t for i, t in texts.items() if plain_log_odds(model, quality.features((t or "").encode())) >= 0}
    assert kept[0] == want
    last = {}
    for i in sorted(want):
        last[low(want[i])] = i
    want = {i: want[i] for i in last.values()}
    assert kept[1] == want
    # The least doc_id of each class of five-word Jaccard similarity 0.8 or more, from all pairs.
    want = {i: want[i] for i in set(plain_classes(want).values())}
    assert kept[2] == want
    want = plain_private(want)
    assert kept[3] == want
    check_pieces(corpus_pipeline.run(spark, SF).collect(), want)


def plain_log_odds(model, x):
    out = model.base
    for j, table in enumerate(model.tables):
        out += table[sum(edge <= x[j] for edge in model.edges[j])]
    for i, j, table in model.pairs:
        out += table[sum(e <= x[i] for e in model.coarse[i])][sum(e <= x[j] for e in model.coarse[j])]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Long and repeated texts, nulls, and columns called as the stages call their own."""
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").orderBy("doc_id").limit(4).collect()
    long = " ".join(good[0].text for _ in range(60))
    rows = [(r.doc_id, r.text) for r in good] + [(good[0].doc_id, good[0].text), (900001, long), (900002, long), (None, good[1].text), (900003, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "d", "keep_id", "__doc", "__text", "__fp", "__score", "fp", "root", "node", "kept", "token", "start", "spans"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


def test_columns_of_users_pass_every_stage(spark, odd):
    got = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == odd.columns
        for r in got.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in odd.columns[2:])
    assert corpus_pipeline.STAGES[-1][1](spark, got, SF).count() > 0


def test_empty_table_passes_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stages_call_their_operators():
    names = [set(f.__code__.co_names) for _, f in corpus_pipeline.STAGES]
    assert ["quality" in names[0], "exact_dedup" in names[1], "simhash" in names[2], "pii" in names[3], "packing" in names[4]] == [True] * 5
    assert all((exact_dedup, packing, pii, quality, simhash))
