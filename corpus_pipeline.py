"""Corpus pipeline over documents: each stage's rows are written as Parquet and read as the next one's docs.

quality -> lines -> near_duplicates -> private_data -> packing. Stages keep every
document that they don't reject, and the columns of documents; the last adds where
each document is packed. A document is a row: rows that share an id and differ in their
text are judged apart. Nulls, ties, empty tables and further columns are handled as
the operators say.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstline.llm import jaccard_join, line_dedup, packing, pii, quality_knn
from karstline.llm.common import cut, shared_dir, table

ACCEPT = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text")


def _open(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__doc.`{c}`").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows that are not held out."""
    model = quality_knn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~quality_knn.held_out()))
    return _open(quality_knn.score_documents(_packed(docs), model).where(F.col("score") >= ACCEPT), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one exactly or nearly."""
    return line_dedup.line_dedup(docs, widths=line_dedup.WIDTHS).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id and hash of its text, of each component of five-word shingle sets at 0.8, and all that link
    with none. Rows equal in id and text stay or go together."""
    comp = jaccard_join.jaccard_components(docs, width=5, percent=80)
    gone = comp.where("not first").select("doc_id", "row").distinct()
    hashed = _packed(docs).withColumn("row", F.xxhash64(F.col("text").cast("string")))
    return _open(hashed.join(gone, ["doc_id", "row"], "left_anti"), docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with all its columns, and where it goes: n_tokens, bucket, padded_length, batch_id, slot. A column of
    docs with one of these names comes back with the prefix doc_. Rows are numbered and written first, so that each
    row has its own place even where ids repeat."""
    keyed = cut(_packed(docs).withColumn("__key", F.monotonically_increasing_id()), "numbered")
    places = packing.pack(keyed.select(F.col("__key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__key")
    added = [c for c in places.columns if c != "__key"]
    own = [F.col(f"__doc.`{c}`").alias(f"doc_{c}" if c in added else c) for c in docs.columns]
    return keyed.select("__key", "__doc").join(places, "__key").select(*own, *added)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", pack),
]

#: Not written in SQL; tests hold the operators against brute-force versions and run the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
