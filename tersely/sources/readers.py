"""Sources: texts, transcripts, requests, tool events, configs, tables. All scans are Spark's own and lazy."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.sources.checks import bounded, local_url, loopback, rules_path

REQUEST = "output string, command string, context string, transcript_path string, cwd string"
TOOL_EVENT = "tool_name string, tool_input struct<command:string>, tool_response struct<output:string,stdout:string>, cwd string, transcript_path string"
RPC = "jsonrpc string, id string, method string, params string"
LEAST_EVENT_CHARS = 500


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, stem, text`: each file as one text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path)


def json_rpc(spark: SparkSession, path: str) -> DataFrame:
    """One call a line; blank and malformed lines are left out, and calls without an id get no answer (`answered` false)."""
    parsed = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", RPC, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter("r.method is not null").select("r.*").withColumn("answered", F.col("id").isNotNull())


def tool_events(spark: SparkSession, path: str, least: int = LEAST_EVENT_CHARS) -> DataFrame:
    """Outputs of shell tools from hook events, long ones only."""
    rows = spark.read.schema(TOOL_EVENT).json(path).filter("tool_name = 'Bash'")
    output = F.coalesce(F.nullif(F.col("tool_response.output"), F.lit("")), F.col("tool_response.stdout"))
    return rows.select(output.alias("output"), F.col("tool_input.command").alias("command"), "cwd", "transcript_path").filter(F.length("output") >= least)


def transcripts(spark: SparkSession, path: str, session: str = r"([^/]+)$") -> DataFrame:
    """`session, n, value`: the lines of JSONL transcripts in their order within each file, empty ones left out. The session
    is what the pattern finds in the file's path.

    Files of any size are read in blocks by many tasks. A block's lines are counted where they lie, and each line's place is
    its place in the block plus the lines of the file's blocks before, so no task numbers a whole file."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*block, F.monotonically_increasing_id().alias("at"), "value")
    sizes = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    value = F.regexp_replace("value", r"\r$", "")
    return placed.select(F.regexp_extract("file", session, 1).alias("session"), (F.col("at") + F.col("shift")).alias("n"), value.alias("value")).filter("value <> ''")


def newest(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """`path` of the file modified last, from the folder's metadata alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def fixtures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Texts and their meta (`stem, category, min_ratio, expected_layer, command`) of a folder."""
    texts = text_files(spark, f"{folder}/*.txt")
    schema = "category string, description string, min_ratio double, expected_layer int, command string"
    meta = spark.read.schema(schema).json(f"{folder}/*.meta.json", multiLine=True)
    return texts, meta.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.meta\.json$", 1))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The record table, of files with and without the later columns."""
    from tersely.operators.metrics import migrated

    return migrated(spark.read.option("mergeSchema", True).parquet(path))


def merged(base: dict, over: dict) -> dict:
    """Two settings trees as one; the second wins, objects are merged key by key."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


#: All settings with their defaults, by section. Fixed values.
DEFAULTS = {
    "daemon": {"port": 8765, "host": "127.0.0.1", "auto_start": True, "log_level": "warn"},
    "compression": {
        "enabled": True, "layer1_enabled": True, "layer2_enabled": True, "layer3_enabled": True, "inference_threshold_tokens": 300, "context_aware": True, "max_output_tokens": 500,
        "preserve_first_stacktrace": True, "preserve_error_counts": True, "context_max_messages": 3, "tokenizer": "cl100k_base", "spec_rules_path": None, "max_input_chars": 100_000,
    },
    "model": {
        "provider": "ollama", "model_name": "phi3:mini", "quantization": "q5_k_m", "ollama_url": "http://localhost:11434", "timeout_ms": 2000, "fallback_to_layer1_on_timeout": True, "temperature": 0.1, "backend_chain": [],
    },
    "metrics": {"history_days": 30},
    "exclusions": {"commands": ["cat", "echo", "pwd"], "max_input_chars": 100_000},
    "display": {"show_compression_ratio": True, "show_layer_used": False, "show_backend": True, "color": True},
    "telemetry": {"enabled": False},
    "security": {"audit_log": False, "audit_log_path": "audit"},
    "l3_cache": {"enabled": True, "ttl_days": 7},
}


def settings(path: str | None = None, project: str | None = None) -> dict:
    """DEFAULTS under a settings file under a project's own; missing files count as empty. What is out of range, would
    listen to other machines or would send texts to them is refused."""
    out = DEFAULTS
    for p in (path, project):
        if p and Path(p).exists():
            out = merged(out, json.loads(Path(p).read_text()))
    out = merged(out, {"compression": {"max_input_chars": out["exclusions"]["max_input_chars"], "spec_rules_path": rules_path(out["compression"]["spec_rules_path"])}})
    checked(out)
    return out


def checked(config: dict) -> None:
    limits = config["compression"]
    if limits["max_input_chars"] <= 0 or limits["inference_threshold_tokens"] < 0 or config["metrics"]["history_days"] < 0 or config["l3_cache"]["ttl_days"] < 0:
        raise ValueError("settings out of range")
    bounded(limits["max_input_chars"], limits["inference_threshold_tokens"])
    local_url(config["model"]["ollama_url"])
    if not loopback(config["daemon"]["host"]):
        raise ValueError(f"the host must be this machine, not {config['daemon']['host']}")


def synthetic_logs(spark: SparkSession, n: int, lines: int = 40, seed: int = 7) -> DataFrame:
    """`doc_id, text`: n log-like texts, the same for a seed."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("n"))
    h = F.pmod(F.xxhash64("doc_id", "n", F.lit(seed)), F.lit(1000))
    line = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit("Z "), F.when(h < 100, "ERROR").otherwise("INFO"), F.lit(" worker-"), (h % 4).cast("string"), F.lit(" took "), h.cast("string"), F.lit(" ms"))
    return rows.select("doc_id", "n", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
