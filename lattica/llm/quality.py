"""Op 10: document quality by a generalised additive model with pairwise interactions.

Features of the whole text are binned; boosting goes round the features in turn, each time fitting a
shallow tree (up to four leaves) to the residuals and adding it to that feature's table. The pairs
with the largest gain then get tables over two features. Scoring is an addition of table cells per
feature and pair, vectorised over a batch.

The model is fitted on the driver on at most `TRAIN_ROWS` labelled documents (those with the least
hash of doc_id), whatever the input; scoring covers every row and needs no shuffle.

Defined cases: null text is empty and gets the score of an empty text; labels without doc_id or
quality are left out; of conflicting labels of a document the least counts; without labels of both
classes every score is the share of label 1 (1.0 without any); texts are read whole, however long;
equal texts get equal scores, and a score of exactly `least` is accepted; other columns pass through
inside `__doc` (accepted: as they are), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, slices

TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "log_bytes", "bytes_a_word", "distinct_words", "words_as_before", "log_lines", "distinct_lines", "words_a_line",
    "upper", "digits", "symbols", "exclamation", "bars", "stops", "commas", "other_bytes", "bytes_as_before", "blank", "odd_ends",
)
UPPER = np.arange(65, 91)
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
ODD_ENDS = (b"#", b"$", b"%", b"&", b"*", b"|", b"!", b"~", b"^")


def features(text: bytes) -> list[float]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, m, k = len(text), len(words), len(lines)
    codes = np.frombuffer(text, np.uint8)
    count = np.bincount(codes, minlength=256)
    share = lambda x: float(x) / n if n else 0.0
    return [
        np.log1p(m), np.log1p(n), n / m if m else 0.0, len(set(words)) / m**0.9 if m else 1.0, sum(map(eq, words, words[1:])) / m if m else 0.0, np.log1p(k), len(set(lines)) / k if k else 1.0, m / k if k else 0.0,
        share(count[UPPER].sum()), share(count[48:58].sum()), share(count[SYMBOLS].sum()), share(count[33]), share(count[124]), share(count[46]), share(count[44]), share(count[128:].sum()), share((codes[1:] == codes[:-1]).sum()), share(count[32] + count[9] + count[10] + count[13]), sum(w.endswith(ODD_ENDS) for w in words) / m if m else 0.0,
    ]


@dataclass
class Model:
    """Log odds = base + a cell of each feature's table + a cell of each pair's table."""

    base: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of bins with about as many values each; heaps of equal values get bins of their own."""
    at = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])
    return np.unique(np.concatenate([at, np.nextafter(at, np.inf)]))


def split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    gain = np.where((hl >= least) & (hr >= least), gain, -1.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2, penalty: float = 1.0, least: float = 2.0) -> np.ndarray:
    """The values of a tree of so many levels on ordered bins."""
    gain, at = split(g, h, penalty, least) if depth and len(g) > 1 else (-1.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + penalty))
    return np.concatenate([tree(g[:at], h[:at], depth - 1, penalty, least), tree(g[at:], h[at:], depth - 1, penalty, least)])


def tree2(g: np.ndarray, h: np.ndarray, penalty: float = 1.0, least: float = 2.0) -> tuple[float, np.ndarray]:
    """A tree that cuts one axis and then the other on each side; gain and values, the better order of axes."""
    best = (-1.0, np.zeros_like(g))
    whole = g.sum() ** 2 / (h.sum() + penalty)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            gain, sides = -whole, []
            for s in (slice(None, at), slice(at, None)):
                values = tree(a[s].sum(0), b[s].sum(0), 1, penalty, least)
                gain += float((values * a[s].sum(0)).sum())
                sides.append(np.broadcast_to(values, a[s].shape))
            if gain > best[0]:
                out = np.concatenate(sides)
                best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 20, pairs: int = 6, bins: int = 48, coarse_bins: int = 8, rate: float = 0.15) -> Model:
    if not len(y) or y.min() == y.max():
        p = 1.0 if not len(y) else float(y[0])
        return Model(40.0 if p >= 0.5 else -40.0)
    p = float(y.mean())
    model = Model(float(np.log(p / (1 - p))))
    model.edges = [cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.coarse = [cuts(x[:, j], coarse_bins) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)
    odds = lambda: 1 / (1 + np.exp(-f))
    for _ in range(rounds):
        for j, b in enumerate(binned):
            q = odds()
            add = rate * tree(np.bincount(b, y - q, len(model.tables[j])), np.bincount(b, q * (1 - q), len(model.tables[j])))
            model.tables[j] += add
            f += add[b]
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def sums(i, j):
        q, shape = odds(), (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = grid[i] * shape[1] + grid[j]
        return cell, shape, np.bincount(cell, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(cell, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((tree2(*sums(i, j)[2:])[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    kept = [[i, j, np.zeros(sums(i, j)[1])] for gain, i, j in gains if gain > 0]
    for _ in range(pair_rounds):
        for pair in kept:
            cell, shape, g, h = sums(pair[0], pair[1])
            add = rate * tree2(g, h)[1]
            pair[2] += add
            f += add.reshape(-1)[cell]
    model.pairs = [tuple(x) for x in kept]
    return model


def featured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        values = [features(x) for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(values, pa.list_(pa.float64()))], names=["id", "label", "x"])


def held_out(doc_id: str):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, **options) -> Model:
    """The sample of labels is bounded by `rows` and so is what is broadcast and collected."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("k")).agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("k"), "k").limit(rows)
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), F.col("id") == F.col("k")).select("id", "label", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    got = got.mapInArrow(featured, f"id {kind}, label int, x array<double>").groupBy("id").agg(F.min(F.struct("label", "x")).alias("s")).select("id", "s.label", "s.x").orderBy("id").collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.label for r in got], float), **options)


def score_batches(model: Model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            x = np.array([features(t) for t in as_bytes(batch.column("__text"))]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), pa.array(model.score(x))], names=["__doc", "__score"])

    return run


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs as a struct `__doc`, and `__score`, 0 to 1."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__text"))
    return packed.mapInArrow(score_batches(model), T.StructType([packed.schema["__doc"], T.StructField("__score", T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.5, **options) -> DataFrame:
    """docs with a score of at least `least`; the columns of docs."""
    return scored(docs, train(docs, labels, text, doc_id, **options), text).filter(F.col("__score") >= least).select("__doc.*")


def op10_additive_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = scored(docs, train(docs, labels)).select("__doc.doc_id", F.col("__score").alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
