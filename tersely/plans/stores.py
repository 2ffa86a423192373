"""Queries over tables and streams that survive a crash: what was followed, the live state, pruned snapshots. Their SQL is that of the plain forms."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.operators import cache, context, metrics, reports
from tersely.session import shared_folder
from tersely.sources import readers
from tersely.sources.snapshots import Batches, Table, prune_all
from tersely.streaming import tail

NOW = datetime(2001, 8, 1)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored_records(spark: SparkSession, sf_dir: str, base: str, files: int = 4) -> str:
    """The records in some files, for a stream to come upon one after the other."""
    from tersely.plans.queries import records

    path = f"{base}/records"
    records(spark, sf_dir).repartition(files, "id").write.parquet(path)
    return path


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record stream, run over what there is: the rows that each batch wrote once."""
    base = scratch(spark, "follow")
    stream = tail.record_stream(spark, stored_records(spark, sf_dir, base), files_a_trigger=2)
    tail.follow(stream, f"{base}/cursor", f"{base}/out", after=100, command="cmd3", once=True).awaitTermination()
    return Batches(spark, f"{base}/out").read(metrics.RECORD).select("id", "command")


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that micro-batches of one file have carried on."""
    base = scratch(spark, "state")
    stream = tail.record_stream(spark, stored_records(spark, sf_dir, base), files_a_trigger=1)
    tail.live_state(stream, f"{base}/cursor", f"{base}/out", once=True).awaitTermination()
    ids = F.array_join(F.transform("recent", lambda x: x["id"].cast("string")), ",")
    return tail.state_now(spark, f"{base}/out").select("total_compressions", "total_tokens_saved", ids.alias("ids"))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and cache entries in tables by months, pruned in one call: how many rows went and how many are left of each."""
    from tersely.plans.queries import cache_table, records

    base = scratch(spark, "prune")
    tables = {name: Table(spark, f"{base}/{name}", by="created_at", period="month") for name in ("cache", "records")}
    tables["records"].replace(records(spark, sf_dir))
    tables["cache"].replace(cache_table(spark, sf_dir))
    gone = {"records": tables["records"].prune(700, NOW), **prune_all({"cache": tables["cache"]}, 7, NOW)}
    left = [t.read().agg(F.lit(n).alias("name"), F.lit(gone[n]).cast("long").alias("removed"), F.count("*").alias("kept")) for n, t in tables.items()]
    return left[0].unionByName(left[1])


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache table, replaced by what an upsert makes of it."""
    from tersely.plans.queries import cache_table, now

    table = Table(spark, scratch(spark, "cache"))
    table.replace(cache_table(spark, sf_dir))
    entries = table.read().filter("output like '%3'").withColumn("output", F.lit("new")).withColumn("created_at", now())
    table.replace(cache.upsert(table.read(), entries))
    table.vacuum()
    return table.read().select("hash", "output")


def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session summary as a JSON report."""
    from tersely.plans.queries import records

    return reports.as_json(metrics.session_summary(records(spark, sf_dir)), kind="report", version="1")


SESSIONS = 16


def transcript_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSONL transcripts, some in each file, and each file's newest user messages as they are read back."""
    base = scratch(spark, "transcripts")
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    event = F.to_json(F.struct(F.col("role").alias("type"), F.lit(False).alias("isMeta"), F.struct("role", F.col("text").alias("content")).alias("message")))
    rows = talk.select((F.col("conv_id") % SESSIONS).alias("session"), "conv_id", "turn", event.alias("value"))
    rows.repartition("session").sortWithinPartitions("session", "conv_id", "turn").select("session", "value").write.partitionBy("session").text(base)
    lines = readers.transcripts(spark, base, r"session=(\d+)/")
    return context.intent(context.parse_events(lines), 3).withColumn("session", F.col("session").cast("long"))


QUERIES = {"metrics_report": metrics_report, "transcript_intents": transcript_intents, "tail_stream": followed, "state_stream": live, "prune_snapshots": pruned, "upsert_snapshot": upserted}


def sql(plain: dict[str, str]) -> dict[str, str]:
    """From the SQL of the plain forms."""
    from tersely.plans import oracle

    messages = oracle.MESSAGES.replace("conv_id AS session, turn AS n", f"conv_id % {SESSIONS} AS session, row_number() OVER (PARTITION BY conv_id % {SESSIONS} ORDER BY conv_id, turn) AS n").replace(
        "PARTITION BY conv_id ORDER BY turn DESC", f"PARTITION BY conv_id % {SESSIONS} ORDER BY conv_id DESC, turn DESC"
    )
    fields = [c for c in metrics.PARTS if c not in ("ratios", "rated")]
    fields.insert(fields.index("layer_1"), "average_ratio")
    pairs = ", ',', ".join(f"""'"{c}":', {c}::VARCHAR""" for c in fields)
    return {
        "metrics_report": f"""SELECT concat('{{', {pairs}, ',"kind":"report","version":"1"}}') AS value FROM ({plain["session_summary"]})""",
        "transcript_intents": plain["intent_decay"].replace(oracle.MESSAGES, messages),
        "state_stream": plain["state_view"],
        "upsert_snapshot": plain["cache_upsert"],
        "prune_snapshots": f"""WITH {oracle.RECORDS}, {oracle.CACHE}, r AS (SELECT created_at::TIMESTAMP < TIMESTAMP '2001-08-01' - to_days(700) AS old FROM records), c AS (SELECT created_at < TIMESTAMP '2001-08-01' - to_days(7) AS old FROM (SELECT DISTINCT ON (hash) * FROM cache))
SELECT 'records' AS name, count(*) FILTER (old) AS removed, count(*) FILTER (NOT old) AS kept FROM r UNION ALL SELECT 'cache', count(*) FILTER (old), count(*) FILTER (NOT old) FROM c""",
    }
