"""Metrics, cache, context, inference, sources, sinks, streams and the whole pipeline."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tersely.functions import tokens
from tersely.operators import benchmarks, cache, context, inference, metrics
from tersely.plans.compaction import compact, discover
from tersely.sources import readers, sinks
from tersely.streaming import tail

NOW = dt.datetime(2024, 5, 1)


def record(i, command="git diff", original=100, compressed=40, layer=2, l1=None, l2=None, days=1, kind="diff"):
    return (i, command, kind, original, compressed, layer, 10 * i, i % 2 == 0, NOW - dt.timedelta(days=days), l1, l2)


@pytest.fixture
def records(spark):
    rows = [record(1), record(2, "cargo test", 0, 0, 1), record(3, "git log", 50, 80, 3, days=40), record(4, "gitk", 200, 20, 2, 90, 50), record(5, "git diff", 10, 1, 0, days=9)]
    return spark.createDataFrame(rows, metrics.RECORD)


def test_summaries(records):
    s = metrics.session_summary(records).first()
    assert (s.total_compressions, s.total_tokens_saved, s.total_saved_l1, s.total_saved_l2, s.total_saved_l3) == (5, 60 + 0 + 0 + 180 + 9, 110, 60 + 40 + 9, 30)
    assert (s.layer_1, s.layer_2, s.layer_3) == (2, 2, 1) and s.average_ratio == pytest.approx((0.6 + 0 + 0 + 0.9 + 0.9) / 5)
    empty = metrics.session_summary(records.limit(0)).first()
    assert empty.total_compressions == 0 and empty.average_ratio == 0.0 and empty.layer_1 == 0
    w = metrics.summary(records, 30, F.lit(NOW)).first()
    assert w.n == 4 and w.tokens_saved == 60 + 180 + 9 and w.average_ratio == pytest.approx((0.6 + 0.9 + 0.9) / 3)


def test_history_cursor_prune(records):
    assert [r.id for r in metrics.history(records, 2).collect()] == [4, 5]
    assert [r.id for r in metrics.records_since(records, 1, 10, "GIT").collect()] == [3, 5]
    assert metrics.max_record_id(records.limit(0)).first().max_id == 0
    kept, gone = metrics.prune(records, 30, F.lit(NOW))
    assert kept.count() == 4 and gone.first().removed == 1
    assert [r.name for r in metrics.command_chart(records).collect()] == ["gitk", "git", "cargo"]


def test_migration_adds_columns(spark):
    old = spark.createDataFrame([(1, "strange")], "id long, output_type string")
    assert metrics.migrated(old).first().asDict() == {"id": 1, "output_type": "generic", "tokens_after_l1": None, "tokens_after_l2": None}


def test_winning_layer(spark):
    rows = [(100, 50, 40, None), (100, 90, 40, None), (100, 80, 60, None), (100, 90, 80, 60)]
    frame = spark.createDataFrame(rows, "original_tokens int, tokens_after_l1 int, tokens_after_l2 int, tokens_after_l3 int")
    assert [r[0] for r in frame.select(metrics.winning_layer()).collect()] == [1, 2, 2, 3]


def test_cache(spark):
    rows = [("a", "old", "m", NOW - dt.timedelta(days=9)), ("b", "new", "m", NOW - dt.timedelta(days=1))]
    table = spark.createDataFrame(rows, "hash string, output string, model string, created_at timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "hash string")
    assert {r.hash: r.cached for r in cache.lookup(asked, table, 7, F.lit(NOW)).collect()} == {"a": None, "b": "new", "c": None}
    assert [r.hash for r in cache.stale(asked, table, 7, F.lit(NOW)).collect()] == ["a"]
    entries = spark.createDataFrame([("a", "fresh", "m", NOW), ("c", "c", "m", NOW)], table.schema)
    assert {r.hash: r.output for r in cache.upsert(table, entries).collect()} == {"a": "fresh", "b": "new", "c": "c"}
    keys = spark.createDataFrame([("x", None), ("x", "")], "a string, b string").select(cache.cache_key(F.col("a"), F.col("b"), F.lit("m"), F.lit("")))
    assert len({r[0] for r in keys.collect()}) == 1


def event(kind, content=None, meta=False, role=None, top=None):
    out = {"type": kind, "isMeta": meta}
    if content is not None:
        out["message"] = {"role": role or kind, "content": content}
    if top is not None:
        out["content"] = top
    return json.dumps(out)


def test_intents(spark):
    lines = [
        event("user", "first request"), event("assistant", "ok"), event("user", [{"type": "text", "text": "second"}, {"type": "image"}, {"type": "text", "text": "part"}]), event("assistant", "x"), "not json", "",
        event("assistant", "y"), event("user", [{"type": "tool_result"}]), event("user", "<command-name>c</command-name>  third " + "x" * 600), event("user", "meta", meta=True), event("user", top="top <command-args>a</command-args>level"), event("assistant", "z"),
    ]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "session int, n int, value string")
    events = context.parse_events(frame)
    messages = {r.age: r for r in context.user_messages(events).collect()}
    assert [messages[i].intent[:12] for i in range(4)] == ["top level", "third " + "x" * 6, "second\npart", "first reques"]
    assert [messages[i].turns_ago for i in range(4)] == [1, 1, 3, 4] and len(messages[1].intent) == 503
    one = context.intent(events, 1).first()
    assert one.intent == "top level" and one.turns_ago == 1
    three = context.intent(events, 3).first().intent
    assert three.startswith("Earlier (3 turns ago): second\npart | Earlier (1 turns ago): third xxx") and three.endswith("... | Current: top level") and len(three) <= 500


def test_contexts(spark):
    frame = spark.createDataFrame([('say "hi"\nnow',)], "i string")
    assert frame.select(context.format_context(F.col("i"), "json")).first()[0] == '{"user_intent": "say \\"hi\\"\\nnow"}\n\n'
    assert frame.select(context.chosen_context(F.lit("  "), F.col("i"))).first()[0] == 'say "hi"\nnow'


def test_inference_chain_and_cache(spark):
    def broken(prompt, text):
        raise OSError("down")

    clients = [("first", broken), ("second", lambda prompt, text: text.upper())]
    asked = spark.createDataFrame([("a", "p", "one"), ("b", "p", "two"), ("b", "p", "two")], "hash string, prompt string, text string")
    known = spark.createDataFrame([("a", "cached", "m", NOW)], "hash string, output string, model string, created_at timestamp")
    got = {(r.hash, r.output, r.backend) for r in inference.summarise(asked, known, clients, 7, F.lit(NOW)).collect()}
    assert got == {("a", "cached", "cache"), ("b", "TWO", "second")}
    failed = inference.summarise(asked, known, clients[:1], 7, F.lit(NOW)).filter("hash = 'b'").first()
    assert failed.output == "two" and failed.backend is None


def test_benchmarks(spark):
    runs = spark.createDataFrame([("s", 0.5), ("t", 0.1), ("u", 0.9)], "stem string, ratio double")
    meta = spark.createDataFrame([("s", "c", 0.4, 2), ("t", "c", 0.2, 2), ("v", "c", 0.2, 3)], "stem string, category string, min_ratio double, expected_layer int")
    assert {r.stem: r.passed for r in benchmarks.gate(runs, meta).collect()} == {"s": True, "t": False}
    assert [r.stem for r in benchmarks.without_meta(runs, meta).collect()] == ["u"]
    turns = spark.createDataFrame([(1, 1, "assistant", 5, None, 2, 1), (1, 2, "user", 9, 9, 9, 9), (1, 3, "assistant", 1, 1, 1, 1)], "session int, at int, role string, input_tokens int, cache_creation_tokens int, cache_read_tokens int, output_tokens int")
    assert {(r.turn, r.total) for r in benchmarks.usage(turns).collect()} == {(1, 8), (2, 4), (None, 12)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\n")
    (tmp_path / "a.meta.json").write_text(json.dumps({"category": "c", "min_ratio": 0.1, "expected_layer": 2}))
    texts, meta = readers.fixtures(spark, str(tmp_path))
    assert texts.join(meta, "stem").select("stem", "text", "category").first() == ("a", "line\n", "c")
    (tmp_path / "e.jsonl").write_text(json.dumps({"tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_response": {"output": "", "stdout": "x" * 600}}) + "\n" + json.dumps({"tool_name": "Edit"}) + "\n")
    assert [r.command for r in readers.tool_events(spark, str(tmp_path / "e.jsonl")).collect()] == ["ls"]
    (tmp_path / "r.jsonl").write_text('{"id": "1", "method": "ping"}\n\nnope\n{"method": "note"}\n')
    assert [(r.method, r.answered) for r in readers.json_rpc(spark, str(tmp_path / "r.jsonl")).collect()] == [("ping", True), ("note", False)]
    assert readers.newest(spark, str(tmp_path)).first().path.endswith(".jsonl")
    assert [r.n for r in readers.transcripts(spark, str(tmp_path / "e.jsonl")).orderBy("n").collect()] == [0, 1]
    (tmp_path / "s.json").write_text('{"metrics": {"history_days": 3}}')
    config = readers.settings(str(tmp_path / "s.json"), str(tmp_path / "missing"))
    assert config["metrics"] == {"history_days": 3} and config["compression"]["max_input_chars"] == 100_000
    assert readers.synthetic_logs(spark, 3).count() == 3


def test_sinks(spark, tmp_path, records):
    sinks.append_records(records, str(tmp_path / "r"))
    kept, _ = metrics.prune(readers.records(spark, str(tmp_path / "r")), 30, F.lit(NOW))
    sinks.replace_table(kept, str(tmp_path / "r"))
    assert readers.records(spark, str(tmp_path / "r")).count() == 4
    results = records.withColumn("output", F.lit("secret text"))
    sinks.audit(results, str(tmp_path / "audit"))
    assert "secret text" not in "".join(p.read_text() for p in (tmp_path / "audit").glob("*.json"))
    sinks.traces(results, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "traces")).select("tokens.before", "day").count() == 5
    sinks.bench_csv(records.select(F.col("command").alias("fixture"), F.lit(0.5).alias("ratio")), str(tmp_path / "csv"))
    assert tuple(readers.csv_table(spark, str(tmp_path / "csv")).columns) == sinks.BENCH_COLUMNS
    assert sinks.markdown(records.select("id").limit(1), "T").startswith("## T\n\n| id |")


def test_streams(spark, tmp_path, records):
    path = str(tmp_path / "stream")
    records.filter("id <= 3").write.parquet(path)
    seen = []
    emit = lambda rows: seen.append([r.id for r in rows.collect()])
    run = lambda: tail.tail(tail.record_stream(spark, path), str(tmp_path / "cursor"), emit, after=0, command="git", once=True).awaitTermination()
    run()
    records.filter("id > 3").write.mode("append").parquet(path)
    run()
    assert seen == [[1, 3], [5]]
    tail.live_summary(tail.record_stream(spark, path), "live", once=True).awaitTermination()
    assert spark.table("live").first().total_compressions == 5
    texts = str(tmp_path / "texts")
    spark.createDataFrame([("a 1\na 2\na 3", "x")], "output string, command string").write.parquet(texts)
    stream = spark.readStream.schema("output string, command string").parquet(texts)
    tail.compact_stream(stream, compact, str(tmp_path / "out"), str(tmp_path / "c2"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().compressed == "[×3] a 1"


def test_compaction(spark):
    log = "\n".join(f"2024-01-01T00:00:{i:02d}Z INFO tick {i}" for i in range(40)) + "\nERROR: broken"
    rows = [(log, "journal"), (log, "cat file"), ("x" * 100_001, "big"), (None, None), ("[×2] seen", "rtk ls")]
    got = compact(spark.createDataFrame(rows, "output string, command string")).collect()
    assert [r.route for r in got] == ["accepted", "bypassed", "rejected", "accepted", "accepted"]
    assert got[0].compressed == "[×40] 2024-01-01T00:00:00Z INFO tick 0\nERROR: broken" and got[0]["class"] == "log" and got[0].ratio > 0.9
    assert got[1].compressed == log and got[1].layer == 0 and got[2].compressed is None and got[4].pre_filtered
    assert "Exchange" not in compact(spark.createDataFrame(rows, "output string, command string"))._jdf.queryExecution().executedPlan().toString()
    found = discover(spark.createDataFrame([(None, "word " * 200), ("ls", "short")], "command string, output string")).collect()
    assert [(r.command, r.estimated) for r in found] == [("unknown", 175)]


def test_token_counts(spark):
    import tiktoken  # noqa: F401

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    frame = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(tokens.token_count(F.col("t"), path).alias("n"))
    assert [r.n for r in frame.collect()] == [2, 0, None]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_token_counts_are_the_librarys(vocabulary, monkeypatch):
    import base64
    import random
    import time

    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(vocabulary)
    known = {base64.b64decode(t): int(r) for t, r in (x.split() for x in open(path, "rb") if x.strip())}
    library = tiktoken.Encoding("own", pat_str=tokens.PIECES, mergeable_ranks=known, special_tokens={})
    counter = tokens.TokenCounter(tokens.ranks(path))
    r = random.Random(3)
    alphabet = ["a", "b", "the ", "ing", "tion", " ", "  ", "\n", "é", "ß", "Ж", "梦", "😀", "0", "42", "'s", "...", "_", "\x00", "x" * 30, "<|endoftext|>"]
    texts = ["", *("".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(800)), "".join(r.choices("abcdefghij", k=5000)), "\u00a0 \t\r\n"]
    expected = [len(library.encode_ordinary(t)) for t in texts]
    assert [counter.count(t) for t in texts] == expected
    monkeypatch.setattr(tokens, "SHORT", 0)  # the heap for all
    assert [tokens.TokenCounter(tokens.ranks(path)).count(t) for t in texts] == expected
    start = time.perf_counter()
    assert counter.count("ab" * 100_000) > 0 and time.perf_counter() - start < 20
