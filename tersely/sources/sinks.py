"""Sinks: records, cache entries, audit lines, traces, CSV and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.sources.snapshots import Files

BENCH_COLUMNS = (
    "fixture", "bytes_in", "tokens_before", "tokens_after_l1", "tokens_after_l2", "tokens_after_l3", "tokens_after", "layer_used", "ratio",
    "latency_ms_total", "latency_ms_l1", "latency_ms_l2", "latency_ms_l3", "http_status", "error",
)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def replace_table(table: DataFrame, path: str) -> None:
    """Write a table beside the plain folder it replaces, then put it in its place by renaming; for tables made from what is at
    `path`. A crash leaves the old table, or no table and a whole one beside it, which `recover` puts in place.
    (`sources.snapshots.Table` has no such gap.)"""
    spark = table.sparkSession
    recover(spark, path)
    files = Files(spark, path)
    table.write.mode("overwrite").parquet(f"{path}.next")
    files.remove(f"{path}.old")
    if files.fs.exists(files.at(path)):
        files.rename(path, f"{path}.old")
    files.rename(f"{path}.next", path)
    files.remove(f"{path}.old")


def recover(spark: SparkSession, path: str) -> None:
    """After a crash of `replace_table`: the new table, if it was whole, else the old one."""
    files = Files(spark, path)
    if files.fs.exists(files.at(path)):
        return
    for beside in (f"{path}.next", f"{path}.old"):
        if files.fs.exists(files.at(f"{beside}/_SUCCESS")):
            files.rename(beside, path)
            return


def audit(results: DataFrame, path: str) -> None:
    """JSON lines that hold the output's SHA-256, never the output."""
    results.select("created_at", "command", "layer_used", "original_tokens", "compressed_tokens", F.sha2("output", 256).alias("output_sha256")).write.mode("append").json(path)


def traces(results: DataFrame, path: str) -> None:
    """JSON by day with nested token counts."""
    tokens = F.struct(F.col("original_tokens").alias("before"), F.col("tokens_after_l1").alias("after_l1"), F.col("tokens_after_l2").alias("after_l2"), F.col("compressed_tokens").alias("after"))
    results.withColumn("tokens", tokens).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).drop("original_tokens", "tokens_after_l1", "tokens_after_l2", "compressed_tokens").write.mode("append").partitionBy("day").json(path)


def bench_csv(runs: DataFrame, path: str) -> None:
    runs.select(*(F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in BENCH_COLUMNS)).write.mode("overwrite").option("header", True).csv(path)


def usage_csv(usage: DataFrame, path: str) -> None:
    """Usage by turn; total rows have TOTAL for their turn."""
    usage.withColumn("turn", F.coalesce(F.col("turn").cast("string"), F.lit("TOTAL"))).write.mode("overwrite").option("header", True).csv(path)


def markdown(table: DataFrame, title: str, most: int = 1000) -> str:
    """A result as a Markdown table of at most so many rows; what was left out is said below it."""
    found = table.limit(most + 1).collect()
    rows = [table.columns, ["---"] * len(table.columns), *([("-" if v is None else str(v)) for v in r] for r in found[:most])]
    rest = f"\nOnly the first {most} rows are shown.\n" if len(found) > most else ""
    return f"## {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n" + rest


def responses(results: DataFrame) -> DataFrame:
    """Each result as a JSON answer."""
    latency = F.struct(*(F.col(c).alias(n) for n, c in (("l1", "latency_l1"), ("l2", "latency_l2"), ("l3", "latency_l3")) if c in results.columns))
    names = [c for c in ("compressed", "ratio", "layer", "tokens_before", "tokens_after", "tokens_after_l1", "tokens_after_l2", "tokens_after_l3") if c in results.columns]
    return results.select(F.to_json(F.struct(*names, *([latency.alias("latency_ms")] if any(c.startswith("latency_l") for c in results.columns) else []))).alias("value"))


def sparkline(levels: list[int]) -> str:
    return "".join("▁▂▃▄▅▆▇█"[max(0, min(7, v))] for v in levels)
