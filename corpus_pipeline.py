"""The corpus pipeline: five stages, each the whole of what the one before kept.

quality   drops documents that the additive model scores below one half
exact     drops documents whose text a kept document has (A-Z lower-cased)
near      keeps one document of each class linked by a Jaccard similarity of 0.8 or more (five-word shingles):
          SimHash fingerprints and pigeonhole blocks first, then the links that 64 bits can't tell
private   puts kinds in the place of personal data
packed    packs what is left into token windows: a row for each piece

Null texts count as empty; texts are read whole, however long; repeated rows are exact copies; of equal
or similar documents the largest (exact) or smallest (near) doc_id stays; other columns pass through with
their values until the last stage, whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact_dedup, packing, pii, quality, simhash
from lattica.llm.shared import staged, temporary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Five-word shingles and similarity 0.8: the stage has no contract of its own.
    return simhash.keep_one_similar(docs, words=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", good), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: Scores, fingerprints and token ids have no SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # What a stage stages for itself goes when its result is written.
        with temporary(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
