"""A training corpus in five stages, each on all that the stage before it kept.

1. quality: documents that the quality classifier rejects go.
2. near duplicates: one document of each group of the n-gram Jaccard join stays.
3. personal data: the sanitised texts take the place of the texts.
4. mixing: a document stays as often as the mix of the sources serves it.
5. tokens: byte-level BPE of what is left; ids and the decoded bytes, by digest.

The classifier and the join cannot be said in SQL; the tests replay the stages by brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import bpe, mixing, ngram_join, pii, quality_model
from trialloom.llm.common import ship
from trialloom.staging import staging_root


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the classifier scores at its threshold or above."""
    ship(spark)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # With no labels to learn from nothing is rejected.
    least = quality_model.THRESHOLD if model else 0.0
    scored = quality_model.score(docs.withColumnRenamed("score", "_score_given") if "score" in docs.columns else docs, model)
    kept = scored.filter(F.col("score") >= least).drop("score")
    return kept.withColumnRenamed("_score_given", "score").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id."""
    ship(spark)
    return ngram_join.representatives(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without what reveals it; ``n_chars`` follows where it is there."""
    ship(spark)
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as it is served: not at all, or up to three times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    ship(spark)
    done = bpe.encode(docs, decoded=True)
    n = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return done.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", sanitise),
    ("mixing", mix_sources),
    ("tokens", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{staging_root(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{number}-{name}")
        docs = spark.read.parquet(f"{root}/{number}-{name}")
    return docs
