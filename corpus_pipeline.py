"""A pipeline over `documents`: five of the training-data operators, each on all that the one before kept.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, 0.8): the document of least doc_id of each group of similar ones stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: secrets in texts are replaced by their kind;
5. mixing sources to target weights: copies of documents, with their epoch and place.

Each stage is written as Parquet and read again by `run` in a folder under spark.checkpoint.dir. Stages take the columns of documents,
whatever else there is, and all but the last return them; the last adds `epoch, block, position, key`, and leaves out columns of
the documents that have one of these names. Documents with a null doc_id stay, as groups of their own.
Rows that share a doc_id are documents of their own if their texts differ; of rows equal in doc_id and text, one stays.
Null and empty texts are scored by the classifier, are similar to nothing and hold nothing. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import durable, read_table, shared_folder
from tersely.llm.decontaminate import decontaminate
from tersely.llm.jaccard_join import join_similar
from tersely.llm.mixing import mix_sources
from tersely.llm.quality_classifier import keep_good
from tersely.llm.secrets import redact
from tersely.session import ship

PLACED = ("epoch", "block", "position", "key")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns`, a hash of them all, and the row as a whole, out of the way of other names."""
    known = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return docs.select(*columns, F.xxhash64(*known).alias("row_key"), F.struct("*").alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs, "doc_id", "text")
    known = rows.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.join(others(known), F.col("doc_id") == F.col("other_id"), "left_anti").select("row.*")
    # Some ids are shared: each different row gets a number, in the order of doc_id, and is compared by it.
    known = durable(known.dropDuplicates(["doc_id", "row_key"]), "different")
    numbers = known.select("doc_id", "row_key").sort("doc_id", "row_key").withColumn("number", F.monotonically_increasing_id())
    numbered = durable(known.join(durable(numbers, "numbers"), ["doc_id", "row_key"]), "numbered")
    gone = others(numbered.select(F.col("number").alias("doc_id"), "text"))
    kept = numbered.join(gone, F.col("number") == F.col("other_id"), "left_anti")
    return kept.select("row").unionByName(rows.filter("doc_id is null").select("row")).select("row.*")


def others(docs: DataFrame) -> DataFrame:
    """`other_id`: the documents that are similar to one of a smaller id."""
    groups = join_similar(docs, k=5, percent=80)
    return groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("other_id")).distinct()


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, "text", "n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A copy goes back to the row it was taken of; rows equal in id, source and text are told apart by number.
    rows = keyed(docs, "doc_id", "source", "text")
    copies = mix_sources(rows, carry=("row_key",)).select(F.col("row_key").alias("taken_key"), *PLACED)
    taken = copies.withColumn("taken_nth", F.row_number().over(Window.partitionBy("taken_key", "epoch").orderBy("key")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("row_key")))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in PLACED]
    return rows.join(taken, (F.col("row_key") == F.col("taken_key")) & (F.col("nth") == F.col("taken_nth"))).select(*own, *PLACED)


STAGES = [("quality_classifier", quality), ("ngram_jaccard_join", similar), ("decontamination", benchmark), ("secret_scans", secrets), ("mix_sources", mixing)]

#: The classifier's scores cannot be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
