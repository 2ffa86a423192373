"""One query for each operator, over the standard tables, for side-by-side checks with SQL (plans.oracle).

Tables hold no logs, so log-like lines come from `events` (a document a user), records from `orders`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.functions import text as x
from tersely.functions import tokens
from tersely.functions.lines import assemble, explode_lines, lines_of
from tersely.operators import arrow, benchmarks, cache, context, metrics, reports, windows
from tersely.operators.rules import Rule, apply_rules, line_form
from tersely.plans import stores, traces
from tersely.plans.compaction import compact, discover



def now() -> Column:
    """The time that relative queries take for now."""
    return F.lit("2001-08-01").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


def event_lines(spark: SparkSession, sf_dir: str, line: Column | None = None) -> DataFrame:
    """`doc_id, n, line`: events of a user in their order, as log lines."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.concat(stamp, F.lit(" "), F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" v="), F.floor("value").cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("n"), (plain if line is None else line).alias("line"))


def typed(mapping: dict[str, str], otherwise: str) -> Column:
    """Another line for each kind of event."""
    out = F.when(F.lit(False), "")
    for kind, line in mapping.items():
        out = out.when(F.col("event_type") == kind, line)
    return out.otherwise(otherwise)


STACK = {"error": "  at org.springframework.web.Dispatcher.run", "view": "at node:internal/process", "click": "at com.example.Main.main"}
NOISE = {"error": "      ~~~^^^", "view": "index 12ab34..99cd00 100644", "click": "--- a/src/x.py", "signup": "+++ b/src/x.py"}
PROGRESS = {"error": "   Compiling serde v1.0.1", "view": "[####    ] 40%", "click": "Compiling by hand", "signup": "⠋ resolving"}
TESTS = {"error": "test a::b ... ok", "view": "test a::c ... FAILED", "click": "  test a::d ... ignored ", "signup": "running"}
BLOCKS = {"error": "ERROR retry 1", "view": "GET page", "click": "ERROR retry 2"}
SIGNALS = {"error": "ValueError: bad", "view": "path exception.py", "click": "build FAILED here", "signup": "warning: unused"}


def line_query(line: Column | None, step):
    return lambda spark, sf_dir: step(event_lines(spark, sf_dir, line))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    original = F.when(k % 97 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 100)).cast("long")
    base = o.select(
        k.alias("id"), F.concat(F.lit("cmd"), (F.col("o_custkey") % 12).cast("string"), F.lit(" "), F.col("o_orderstatus")).alias("command"), F.element_at(F.array(*map(F.lit, metrics.TYPES)), (k % 5 + 1).cast("int")).alias("output_type"),
        original.alias("original_tokens"), F.floor(original * (k % 11) / 8).cast("long").alias("compressed_tokens"), (k % 4).cast("int").alias("layer_used"), (F.col("o_custkey") % 700).alias("latency_ms"),
        (k % 7 == 0).alias("pre_filtered"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    old = F.col("id") % 3 == 0
    return base.select("*", F.when(~old, F.floor(F.col("original_tokens") * 9 / 10)).cast("long").alias("tokens_after_l1"), F.when(~old, F.floor(F.col("original_tokens") * 8 / 10)).cast("long").alias("tokens_after_l2"))


def cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    stamp = F.timestamp_seconds(F.lit(996624000) - (F.col("doc_id") % 14) * 86400)
    return d.select(document_key().alias("hash"), F.concat(F.lit("out "), F.col("doc_id").cast("string")).alias("output"), F.lit("m").alias("model"), stamp.alias("created_at")).dropDuplicates(["hash"])


def document_key() -> Column:
    return cache.cache_key(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("text")), F.lit("generic"), F.lit("m"), F.lit(""))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("n"), F.col("role").alias("type"), F.lit(False).alias("is_meta"), "role", "text")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).groupBy(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("stem"))
    return rows.agg(F.round(F.avg(metrics.ratio()), 9).alias("ratio"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p") % 40
    rows = spark.range(0, 40).withColumnRenamed("id", "p").filter("p % 6 <> 0")
    return rows.select(F.concat(F.lit("s"), k.cast("string")).alias("stem"), F.concat(F.lit("c"), (F.col("p") % 4).cast("string")).alias("category"), (F.col("p") % 10 / 10).cast("double").alias("min_ratio"), (F.col("p") % 4).cast("int").alias("expected_layer"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select(F.element_at(F.array(*map(F.lit, context.FORMATS)), (F.col("id") % 4 + 1).cast("int")).alias("format"), F.concat(F.lit("s"), (F.col("id") % 9).cast("string")).alias("stem"), (F.floor(F.col("id") / 8) % 2 == 0).alias("context"), F.round(metrics.ratio(), 6).alias("ratio"), "layer_used", F.when(F.col("id") % 50 == 0, "timeout").alias("error"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    size = F.length("text").cast("long")
    return c.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), "role", size.alias("input_tokens"), F.when(F.col("turn") % 3 == 0, size * 2).alias("cache_creation_tokens"), (size * 3).alias("cache_read_tokens"), F.floor(size / 2).alias("output_tokens"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.filter("role = 'assistant'").agg(F.count("*").alias("turns"), *(F.coalesce(F.sum(u), F.lit(0)).cast("long").alias(u) for u in benchmarks.USAGE))


def ab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return benchmarks.compared(totals(t.filter("session % 2 = 0")), totals(t.filter("session % 2 = 1")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


RULES = {
    "frames": Rule("frames", {"kind": "frame-run", "classifier": "starts_with", "values": ["at org.springframework."]}, {"kind": "collapse-run", "min_run": 2, "replacement": "... [{n} frames omitted]"}, ["preserve_errors"]),
    "drop": Rule("drop", {"kind": "line-match", "classifier": "contains", "values": [" VIEW ", " CLICK "]}, {"kind": "delete"}, []),
    "rewrite": Rule("rewrite", {"kind": "line-match", "classifier": "regex", "values": ["v=[0-9]+$", "user=[0-9]+"]}, {"kind": "rewrite", "replacement": "#"}, []),
    "dedup": Rule("dedup", {"kind": "template-dedup", "normalize": [{"regex": "[0-9]+"}]}, {"kind": "dedup", "min_run": 3, "format": "[×{n}] {exemplar}"}, []),
    "prefix": Rule("prefix", {"kind": "prefix-factor", "min_lines": 4}, {"kind": "factor-prefix", "replacement": "prefix: {prefix}"}, []),
}


def rule_query(name: str, line: Column | None = None):
    """A rule over event lines, as texts, so that the numbering of lines doesn't matter."""
    return line_query(line, lambda lines: assemble(line_form(lines, RULES[name])))


def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines with blanks put in: after each line of an even number two, and two at the end."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.concat(F.regexp_replace("text", "\n", "\n\n  \n"), F.lit("\n\n \n")).alias("text"))


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = documents(spark, sf_dir).select("doc_id", F.col("text").alias("output"), F.col("source").alias("command"))
    return compact(requests, [list(RULES.values())], vocabulary())


def compact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: event logs through template dedup, with what it saves for each user."""
    lines = event_lines(spark, sf_dir)
    before = lines.groupBy("doc_id").agg(F.count("*").alias("lines_before"), F.sum(F.octet_length("line")).alias("bytes_before"))
    after = windows.template_dedup(lines, unicode=False).groupBy("doc_id").agg(F.count("*").alias("lines_after"), F.sum(F.octet_length("line")).alias("bytes_after"))
    both = before.join(after, "doc_id")
    return both.withColumn("ratio", F.round((F.col("bytes_before") - F.col("bytes_after")) / F.col("bytes_before"), 9))


def on_documents(*columns: Column):
    return lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", *columns)


def on_records(step):
    return lambda spark, sf_dir: step(records(spark, sf_dir))


def catalogue() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries; columns need a session, so it is made when one is there."""
    text, line = F.col("text"), F.col("line")
    EXTRA = F.concat(text, F.lit(" eyJabcdefghij.klmnopqrstuv.wxyzabcdefghi ?a=1&b=2&c=3&d=4&e=5&f=6 "), F.sha2(text, 256))

    return {
        "compact_logs": compact_logs,
        "line_split": lambda s, d: explode_lines(documents(s, d)),
        "template_normalize": line_query(None, lambda t: t.select("doc_id", "n", x.template(line, False).alias("template"))),
        "template_dedup": line_query(None, lambda t: windows.template_dedup(t, unicode=False).select("doc_id", "n", "line")),
        "template_dedup_documents": lambda s, d: windows.template_dedup(explode_lines(documents(s, d)), unicode=False).select("doc_id", "n", "line"),
        "opaque_normalize": on_documents(x.opaque(EXTRA, False).alias("text")),
        "opaque_urls": lambda s, d: table(s, d, "pages").select("page_id", x.opaque(F.concat("url", F.lit("?utm_source=a&utm_medium=b&x=1")), False).alias("url")),
        "whitespace_collapse": on_documents(x.tidy_whitespace(F.regexp_replace(F.regexp_replace(text, ", ", ",      "), "\n", "  \n      ")).alias("text")),
        "prefix_consolidate": line_query(F.concat(F.upper("event_type"), F.lit(": user "), F.col("user_id").cast("string"), F.lit(" v"), F.floor("value").cast("string")), windows.merge_prefixes),
        "path_shorten": lambda s, d: table(s, d, "pages").select("page_id", x.shorten_paths(F.concat(F.lit("at ("), "url", F.lit(":12:7), /usr/lib/x.py"))).alias("line")),
        "progress_filter": line_query(typed(PROGRESS, "plain"), lambda t: windows.drop_lines(t, x.is_progress(line))),
        "diag_filter": line_query(typed(NOISE, "--- keep"), lambda t: windows.drop_lines(t, x.is_noise(line))),
        "test_failures": line_query(typed(TESTS, "other"), windows.drop_passing_tests),
        "blank_collapse": lambda s, d: windows.collapse_blanks(explode_lines(pad(s, d))),
        "ansi_strip": on_documents(x.strip_ansi(F.concat(F.lit("\x1b[31m"), text, F.lit("\x1b[0m\x1b]0;t\x07\t."))).alias("text")),
        "detect_class": lambda s, d: documents(s, d).select("doc_id", x.detect(text).alias("class")).unionByName(assemble(event_lines(s, d)).select((-F.col("doc_id") - 1).alias("doc_id"), x.detect(text).alias("class"))),
        "log_share": line_query(None, lambda t: assemble(t).select("doc_id", x.is_log(text).alias("is_log"), x.is_diff(text).alias("is_diff"))),
        "request_route": on_documents(x.route(text, F.when(F.col("doc_id") % 5 == 0, F.lit("cat x")).otherwise(F.col("source")), 3000).alias("route"), x.is_prefiltered(text, F.lit("rtk ls")).alias("pre_filtered")),
        "stack_collapse": line_query(typed(STACK, "plain"), lambda t: assemble(windows.collapse_frames(t))),
        "rule_frame_run": rule_query("frames", typed(STACK, "plain")),
        "rule_delete": rule_query("drop"),
        "rule_rewrite": rule_query("rewrite"),
        "rule_dedup": rule_query("dedup"),
        "rule_prefix": rule_query("prefix"),
        "error_signal_count": line_query(typed(SIGNALS, "E0123: x"), lambda t: assemble(t).select("doc_id", x.error_signals(text, False).cast("long").alias("signals"))),
        "prefix_first_round": line_query(None, lambda t: windows.best_prefix(t)),
        "prose_tail": line_query(typed({"error": "Note: see above", "view": "value not found"}, "done"), lambda t: windows.tail_without(t, windows.is_prose(line))),
        "session_summary": on_records(metrics.session_summary),
        "summary_window": on_records(lambda r: metrics.summary(r, 365, now())),
        "history_topk": on_records(lambda r: metrics.history(r, 50).select("id", "command", "original_tokens", F.round(metrics.ratio(), 9).alias("ratio"))),
        "records_since": on_records(lambda r: metrics.records_since(r, 1000, 500, "CMD3").select("id", "command")),
        "max_record_id": on_records(metrics.max_record_id),
        "prune_preview": on_records(lambda r: metrics.prune(r, 700, now())[1]),
        "pruned": on_records(lambda r: metrics.prune(r, 700, now())[0].select("id", "created_at")),
        "winning_layer": on_records(lambda r: r.withColumn("tokens_after_l3", F.when(F.col("id") % 5 == 0, F.floor(F.col("tokens_after_l2") / 2).cast("long"))).select("id", metrics.winning_layer().alias("layer"))),
        "command_top8": on_records(metrics.command_chart),
        "layer_distribution": on_records(metrics.layer_distribution),
        "weekly_series": on_records(lambda r: metrics.weekly(r, F.lit("2001-07-31").cast("date"))),
        "weighted_ratio": on_records(metrics.weighted_ratio),
        "latency_stats": on_records(lambda r: metrics.latency(r, "output_type")),
        "model_speed": on_records(lambda r: metrics.model_speed(r.select(F.col("latency_ms").alias("ms"), F.col("original_tokens").alias("input_tokens"), F.col("compressed_tokens").alias("output_tokens")))),
        "cache_key": on_documents(document_key().alias("hash")),
        "cache_lookup_ttl": lambda s, d: cache.lookup(documents(s, d).select("doc_id", document_key().alias("hash")), cache_table(s, d), 7, now()),
        "cache_stale": lambda s, d: cache.stale(documents(s, d).select("doc_id", document_key().alias("hash")), cache_table(s, d), 7, now()).select("hash", "output"),
        "cache_upsert": lambda s, d: cache.upsert(cache_table(s, d), cache_table(s, d).filter("output like '%3'").withColumn("output", F.lit("new")).withColumn("created_at", now())).select("hash", "output"),
        "intent_recent": lambda s, d: context.intent(events_of(s, d), 1),
        "intent_decay": lambda s, d: context.intent(events_of(s, d), 3),
        "intent_format": lambda s, d: context.intent(events_of(s, d), 1).select("session", *(context.format_context(F.col("intent"), f).alias(f"as_{f}") for f in context.FORMATS)),
        "meta_gate": lambda s, d: benchmarks.gate(ratios(s, d), meta(s, d)),
        "meta_missing": lambda s, d: benchmarks.without_meta(ratios(s, d), meta(s, d)),
        "meta_category": lambda s, d: benchmarks.with_category(ratios(s, d), meta(s, d)),
        "usage_rollup": lambda s, d: benchmarks.usage(turns(s, d)),
        "layer_tally": lambda s, d: benchmarks.tally(runs(s, d), "s0"),
        "ab_delta": ab_delta,
        "format_average": lambda s, d: benchmarks.by_format(runs(s, d), "format", "context"),
        "format_pivot": lambda s, d: benchmarks.context_gain(runs(s, d)),
        "flagged_runs": lambda s, d: reports.flagged(runs(s, d), "s0"),
        "gain": on_records(lambda r: reports.gain(r, now())),
        "gain_chart": on_records(reports.gain_chart),
        "graph_chart": on_records(reports.graph_chart),
        "graph_summary": on_records(lambda r: reports.graph_summary(r, 30, now())),
        "history_table": on_records(reports.history_table),
        "layer_steps": on_records(reports.layers),
        "state_view": on_records(lambda r: reports.state(r).select("total_compressions", "total_tokens_saved", F.transform("recent", lambda x: x["id"]).alias("ids")).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))),
        "metrics_json": on_records(lambda r: reports.as_json(metrics.max_record_id(r), kind="report")),
        "floor_check": lambda s, d: reports.floors(documents(s, d).select(F.col("doc_id").alias("name"), F.concat(text, F.when(F.col("doc_id") % 2 == 0, " error").otherwise("")).alias("before"), text.alias("after"), (F.col("doc_id") % 10 / 10).alias("ratio"), F.lit(0.5).alias("floor"))),
        "text_cap": on_documents(x.capped(text, 101).alias("text")),
        "text_helpers": on_documents(reports.padded(F.concat(F.lit("\x1b[1m"), F.substring("source", 1, 9), F.lit("\x1b[0m")), 12).alias("padded"), reports.thousands(F.col("doc_id") * 1234).alias("number"), reports.uptime(F.col("doc_id") * 97).alias("uptime")),
        "discover_top10": lambda s, d: discover(documents(s, d).select(F.col("source").alias("command"), F.col("text").alias("output"))),
        "block_dedup": lambda s, d: documents(s, d).select("doc_id", arrow.block_dedup(text).alias("text")),
        "block_dedup_logs": line_query(typed(BLOCKS, "INFO idle"), lambda t: assemble(t).select("doc_id", arrow.block_dedup(text).alias("text"))),
        "prefix_factor": line_query(None, lambda t: assemble(t).select("doc_id", arrow.factor_prefix(text).alias("text"))),
        "suffix_factor": line_query(None, lambda t: assemble(t).select("doc_id", arrow.factor_suffix(text).alias("text"))),
        "rules_fold": line_query(typed(STACK, "ValueError: x"), lambda t: assemble(t).select("doc_id", apply_rules(text, [list(RULES.values())]).alias("r")).select("doc_id", "r.output", *(F.array_join(f"r.{c}", ",").alias(c) for c in ("applied", "rejected")))),
        "token_count": lambda s, d: documents(s, d).select("doc_id", tokens.token_count(text, vocabulary()).alias("tokens")),
        "pipeline_compress": compaction,
        "lines_per_document": on_documents(F.size(lines_of(text)).cast("long").alias("lines")),
    }


NAMES = """
    compact_logs line_split template_normalize template_dedup template_dedup_documents opaque_normalize opaque_urls whitespace_collapse
    prefix_consolidate path_shorten progress_filter diag_filter test_failures blank_collapse ansi_strip detect_class log_share request_route
    stack_collapse rule_frame_run rule_delete rule_rewrite rule_dedup rule_prefix error_signal_count prefix_first_round prose_tail
    session_summary summary_window history_topk records_since max_record_id prune_preview pruned winning_layer command_top8
    layer_distribution weekly_series weighted_ratio latency_stats model_speed cache_key cache_lookup_ttl cache_stale cache_upsert
    intent_recent intent_decay intent_format meta_gate meta_missing meta_category usage_rollup layer_tally ab_delta format_average
    format_pivot discover_top10 block_dedup prefix_factor suffix_factor rules_fold token_count pipeline_compress
    lines_per_document flagged_runs gain gain_chart graph_chart graph_summary history_table layer_steps state_view metrics_json floor_check text_cap
    text_helpers block_dedup_logs
""".split()


def lazily(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: catalogue()[name](spark, sf_dir)


QUERIES = {name: lazily(name) for name in NAMES} | traces.QUERIES | stores.QUERIES
