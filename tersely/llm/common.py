"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id where ids are ordered: larger than every real id.
NULL_ID = (1 << 63) - 1
#: Bytes of text that a Python worker takes out of a batch at once.
PIECE_BYTES = 1 << 20


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id long, text string` of any table of documents; a null text counts as empty, other columns are left out."""
    return docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_text` with `rk`, a hash of the row, so that rows which share an id or lack one stay apart.

    Rows equal in id and text share the key as well; every operator gives them equal results."""
    return id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column without nulls."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def pieces(batch: pa.RecordBatch, name: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in slices of about `most` bytes of a string column: workers keep the memory of the largest they had."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = taken = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, taken + most, "right")))
        yield batch.slice(start, stop - start)
        start, taken = stop, int(ends[stop - 1])


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]):
    """A function for mapInArrow: `make` runs once a task, what it returns once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    return shared


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage with checkpoint(), in the folder the cluster names; a local one is set only where none is.

    What the step has shuffled is of no use afterwards, and Spark removes it as the step ends. A frame reads that setting when
    it is made, not when it runs, so a new one is made of the given one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_UP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
