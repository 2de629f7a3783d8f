"""Corpus pipeline: toxicity, quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; results
are written as Parquet in the shared folder and read again. Labels are read from ``sf_dir``.
Every stage takes null ids and texts, empty and very long texts, repeated rows and ids, further columns with any
names and empty tables; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, quality, signature_join, toxicity
from tidemark.llm.common import delete_folder, fresh, read, shared_dir, work_area, write_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.5 stay, texts of any length compared whole. Null and empty texts have the score
    of no evidence and stay; repeated rows have one score; without labels of both kinds nothing is rejected, unless all are toxic."""
    name = fresh("toxicity", docs.columns)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.7 or more stay, texts of any length scored whole. Null and empty texts have the share
    of good documents in training as score; repeated rows have one score. With no label at all there is nothing to judge by,
    and every document stays."""
    name = fresh("quality_score", docs.columns)
    labels = read(spark, sf_dir, "labels")
    if labels.where("quality IN (0, 1)").isEmpty():
        return docs
    model = quality.fit(docs, labels)
    return quality.score(docs, model, out_col=name).where(F.col(name) >= 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the join the document with the smallest doc_id stays, once (without any id: one of them). Different
    texts of one id are judged by their own sets. Documents without words are linked with nothing and stay."""
    return signature_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is a source; documents without
    words follow their rank; repeated rows are taken alike."""
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its columns, and length, bucket, boundary, batch, slot and padding. Null and empty texts have length 0
    and a bucket of their own; repeated rows are packed as often as they come."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Trained models and the exact join cannot be written as one SQL query over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. A stage's work tables, and its predecessor's result, are deleted once its own result is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with work_area(spark, f"pipeline-work-{name}"):
            docs = write_out(stage(spark, docs, sf_dir), path)
        if before is not None:
            delete_folder(spark, before)
        before = path
    return docs
