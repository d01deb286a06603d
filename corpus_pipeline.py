"""A corpus pipeline: each stage works on the documents that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.llm.common import fresh, shared_dir, stored, with_row_key
from lingloom.llm.jaccard import jaccard_components
from lingloom.llm.mixing import mix_sources
from lingloom.llm.packing import pack_documents
from lingloom.llm.quality import keep_quality
from lingloom.llm.secrets import redact_secrets
from lingloom.llm.tokens import vocabulary
from lingloom.storage import small_or_shuffled

# Every stage takes rows as they are: null and repeated ids, repeated rows and columns of any name; each row has its own
# verdict. An empty table goes through as one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep; null and empty texts go."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, that of the smallest id (null last; of several, the first in the table).
    Near: Jaccard similarity of 0.8 or more over five-word shingles. Rows without words stay."""
    rows, key = with_row_key(docs)
    groups = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), shingle=5, num=80, den=100).where("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, F.col("doc_id").alias("own_id")), key)
    order = F.struct(F.col("own_id").isNull(), "own_id", key)
    least = groups.groupBy("component_id").agg(F.min(order).alias("least"))
    copies = groups.join(least, "component_id").where(F.col(key) != F.col(f"least.{key}")).select(key)
    return rows.join(small_or_shuffled(stored(copies, "copies")), key, "left_anti").select([f"`{c}`" for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; null texts stay null."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: complete epochs, and once more for the fractional selection. Rows without
    words are not taken."""
    rows, key = with_row_key(docs)
    taken = mix_sources(rows, carried=key).where("copies > 0").select(key, F.col("copies").alias(copies := fresh(rows, "copies")))
    return rows.join(small_or_shuffled(stored(taken, "taken")), key).withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select([f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts are an end id alone."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Tokenisation is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
