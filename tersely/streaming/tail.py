"""Streams: following the record table, a live state, compaction as data arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tersely.operators import metrics, reports
from tersely.sources.snapshots import Batches

FIRST, PAGE, LEAST_POLL_MS, POLL_MS = 50, 500, 200, 2000


def record_stream(spark: SparkSession, path: str, schema: str = metrics.RECORD, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def first_page(records: DataFrame, n: int = FIRST) -> tuple[DataFrame, int]:
    """What a follower shows first: the last records of all commands, and the id after which it goes on."""
    return metrics.history(records, n), metrics.max_record_id(records).first()[0]


def pages(rows: DataFrame, emit: Callable[[DataFrame], None], page: int = PAGE) -> None:
    """Give rows to `emit` by id, a page at a time, for a reader at the driver.

    The rows are read and sorted once; the driver holds a page and the part of the sorted rows that it comes from."""
    held: list = []
    for row in rows.orderBy("id").toLocalIterator():
        held.append(row)
        if len(held) == page:
            emit(rows.sparkSession.createDataFrame(held, rows.schema))
            held = []
    if held:
        emit(rows.sparkSession.createDataFrame(held, rows.schema))


def wanted(stream: DataFrame, after: int, command: str | None) -> DataFrame:
    """Records after an id, of a command or beginning with it and a space."""
    rows = stream.filter(F.col("id") > after)
    return rows if command is None else rows.filter((F.col("command") == command) | F.col("command").ilike(f"{command} %"))


def started(writer, once: bool, poll_ms: int) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(poll_ms, LEAST_POLL_MS)} milliseconds")).start()


def tail(stream: DataFrame, checkpoint: str, emit: Callable[[DataFrame], None], after: int = 0, command: str | None = None, poll_ms: int = POLL_MS, once: bool = False) -> StreamingQuery:
    """Give new records (by id) to `emit` as they come, in pages. The checkpoint is the cursor, so a restart goes on where it
    stopped; a batch that was cut off is given again, so what must not be doubled goes through `follow`."""
    writer = wanted(stream, after, command).writeStream.foreachBatch(lambda rows, _: pages(rows, emit)).option("checkpointLocation", checkpoint)
    return started(writer, once, poll_ms)


def follow(stream: DataFrame, checkpoint: str, path: str, after: int = 0, command: str | None = None, poll_ms: int = POLL_MS, once: bool = False) -> StreamingQuery:
    """Write new records to `Batches(spark, path)`, each exactly once whatever is cut off and run again; one scan a batch."""
    out = Batches(stream.sparkSession, path)
    writer = wanted(stream, after, command).writeStream.foreachBatch(lambda rows, batch: out.write(rows, batch) and None).option("checkpointLocation", checkpoint)
    return started(writer, once, poll_ms)


def live_summary(stream: DataFrame, name: str, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """The session summary, kept up to date in a memory table of this name."""
    writer = metrics.session_summary(stream).writeStream.outputMode("complete").format("memory").queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def carried(stream: DataFrame, checkpoint: str, path: str, step: Callable[[DataFrame | None, DataFrame], DataFrame], once: bool, poll_ms: int) -> StreamingQuery:
    """Each batch's state from that of the batch before and its rows, stored once by batch. The state is one small row."""
    states = Batches(stream.sparkSession, path)

    def advance(rows: DataFrame, batch: int) -> None:
        if not states.has(batch):
            before = max((b for b in states.done() if b < batch), default=None)
            states.write(step(None if before is None else states.read(batches=[before]), rows).coalesce(1), batch)

    return started(stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint), once, poll_ms)


def live_state(stream: DataFrame, checkpoint: str, path: str, once: bool = False, poll_ms: int = 500) -> StreamingQuery:
    """The session summary and the last records, carried from batch to batch. Rows are summed up where they lie, so a batch
    costs its own rows and not those before it; `state_now` reads the result."""

    def step(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        parts = metrics.summary_parts(rows).withColumn("recent", F.lit(None).cast(reports.latest_kind(rows, "id")))
        last = reports.latest(rows, "id").select(F.col("of").alias("recent"))
        both = parts.unionByName(last, allowMissingColumns=True)
        both = both if before is None else both.unionByName(before)
        return metrics.joined_parts(both).crossJoin(F.broadcast(reports.latest_of(both, "recent", "id")))

    return carried(stream, checkpoint, path, step, once, poll_ms)


def live_warnings(stream: DataFrame, checkpoint: str, path: str, once: bool = False, poll_ms: int = 500) -> StreamingQuery:
    """The last warnings (`at, message`), carried from batch to batch."""

    def step(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        last = reports.latest(rows, "at").select(F.col("of").alias("warns"))
        return reports.latest_of(last if before is None else last.unionByName(before), "warns", "at")

    return carried(stream, checkpoint, path, step, once, poll_ms)


def state_now(spark: SparkSession, path: str, warnings: str | None = None) -> DataFrame:
    """What `reports.state` gives for all records (and warnings) so far: one row, from the last stored states."""

    def last(where: str) -> DataFrame:
        states = Batches(spark, where)
        return states.read(batches=[max(states.done(), default=-1)])

    out = metrics.finished_parts(last(path))
    return out if warnings is None else out.crossJoin(F.broadcast(last(warnings)))


def compact_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Compact texts as they arrive: rows are whole documents, so no state is kept."""
    writer = step(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
