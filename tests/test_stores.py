"""Tables and streams that survive a crash."""

import random
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tersely.operators import context, metrics, reports
from tersely.sources import readers, sinks, snapshots
from tersely.sources.snapshots import Batches, Conflict, Table, prune_all
from tersely.streaming import tail

NOW = datetime(2024, 3, 20, 12)


def records(spark, ids):
    i = F.col("id")
    rows = spark.createDataFrame([(x,) for x in ids], "id long")
    return rows.select(
        "id", F.when(i % 2 == 0, "git log").otherwise("cargo").alias("command"), F.lit("log").alias("output_type"), (i * 7).alias("original_tokens"), (i * 3).alias("compressed_tokens"), (i % 4).cast("int").alias("layer_used"), i.alias("latency_ms"),
        (i % 5 == 0).alias("pre_filtered"), F.timestamp_seconds(F.lit(1710936000) - i * 36_000).alias("created_at"), F.when(i % 3 > 0, i * 6).alias("tokens_after_l1"), F.when(i % 3 > 0, i * 5).alias("tokens_after_l2"),
    )


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def forget_last_batch(checkpoint):
    """As if the driver had died between a batch's work and its commit."""
    last = max((p for p in (Path(checkpoint) / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    return int(last.name)


def test_followed_rows_come_once_after_crashes(spark, tmp_path, monkeypatch):
    source, cursor, out = (str(tmp_path / n) for n in ("in", "cursor", "out"))
    follow = lambda: tail.follow(tail.record_stream(spark, source, files_a_trigger=1), cursor, out, after=3, command="git", once=True).awaitTermination()
    for part in ([1, 2, 4, 6], [8, 9, 10]):
        records(spark, part).coalesce(1).write.mode("append").parquet(source)
    follow()
    assert ids(Batches(spark, out).read()) == [4, 6, 8, 10]
    replayed = forget_last_batch(cursor)
    assert Batches(spark, out).has(replayed)
    follow()
    assert ids(Batches(spark, out).read()) == [4, 6, 8, 10]
    records(spark, [12, 14]).coalesce(1).write.mode("append").parquet(source)
    publish = snapshots.Files.publish
    monkeypatch.setattr(snapshots.Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(Exception, match="died"):
        follow()
    assert ids(Batches(spark, out).read()) == [4, 6, 8, 10]  # the data are there, but in no manifest
    monkeypatch.setattr(snapshots.Files, "publish", publish)
    follow()
    assert ids(Batches(spark, out).read()) == [4, 6, 8, 10, 12, 14]
    assert Batches(spark, str(tmp_path / "none")).read("id long").count() == 0


def same_state(got, expected):
    got, expected = got.first().asDict(True), expected.first().asDict(True)
    assert got == expected


def test_live_state_is_the_state_of_all_records(spark, tmp_path):
    source, cursor, out = (str(tmp_path / n) for n in ("in", "cursor", "out"))
    live = lambda: tail.live_state(tail.record_stream(spark, source, files_a_trigger=1), cursor, out, once=True).awaitTermination()
    so_far = []
    for part in ([5, 2, 30], [1], [40, 7, 3, 41, 6], [8]):
        so_far += part
        records(spark, part).coalesce(1).write.mode("append").parquet(source)
        live()
        same_state(tail.state_now(spark, out), reports.state(records(spark, so_far)))
        forget_last_batch(cursor)
        live()  # the batch is run again
        same_state(tail.state_now(spark, out), reports.state(records(spark, so_far)))
    warned, kept = str(tmp_path / "warned"), str(tmp_path / "warns")
    for part in ([(1, "a"), (4, "d")], [(2, "b"), (9, "z"), (3, "c")]):
        spark.createDataFrame(part, "at long, message string").coalesce(1).write.mode("append").parquet(warned)
    tail.live_warnings(spark.readStream.schema("at long, message string").option("maxFilesPerTrigger", 1).parquet(warned), str(tmp_path / "c2"), kept, once=True).awaitTermination()
    same_state(tail.state_now(spark, out, kept), reports.state(records(spark, so_far), spark.read.parquet(warned)))
    assert [w.message for w in tail.state_now(spark, out, kept).first().warns] == ["c", "d", "z"]


def test_tables_change_in_one_step(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.append(records(spark, [1, 2, 3]))
    table.append(records(spark, [4]))
    table.replace(table.read().filter("id <> 2"))  # made from itself
    assert ids(table.read()) == [1, 3, 4]
    publish = snapshots.Files.publish
    monkeypatch.setattr(snapshots.Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        table.replace(table.read().filter("id = 1"))
    monkeypatch.setattr(snapshots.Files, "publish", publish)
    assert ids(table.read()) == [1, 3, 4]
    number, content = table.manifest()
    table.append(records(spark, [9]))
    with pytest.raises(Conflict):
        table.commit(number, content["schema"], content["parts"])
    before = table.read()
    assert table.vacuum() == 3 and ids(table.read()) == [1, 3, 4, 9] == ids(before)
    table.replace(table.read().limit(0))
    assert table.read().count() == 0


@pytest.mark.parametrize("period", ["day", "month"])
def test_pruning_by_periods_is_pruning_by_rows(spark, tmp_path, period):
    tables = {n: Table(spark, str(tmp_path / n), by="created_at", period=period) for n in ("records", "cache")}
    own = {"records": records(spark, range(1, 60)).withColumn("created_at", F.when(F.col("id") != 50, F.col("created_at"))), "cache": records(spark, range(1, 20))}
    for name, table in tables.items():
        table.append(own[name].filter("id % 2 = 0"))
        table.append(own[name].filter("id % 2 = 1"))
    for days in (30, 9, 9, 4, 0):
        expected = {n: metrics.prune(t.read(), days, F.lit(NOW)) for n, t in tables.items()}
        left, gone = {n: ids(x[0]) for n, x in expected.items()}, {n: x[1].first().removed for n, x in expected.items()}
        assert prune_all(tables, days, NOW) == gone
        assert {n: ids(t.read()) for n, t in tables.items()} == left
    assert ids(tables["records"].read()) == [50]
    with pytest.raises(ValueError, match="by days"):
        Table(spark, str(tmp_path / "x")).prune(1, NOW)


def test_plain_folders_recover(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    records(spark, [1, 2]).write.parquet(path)
    rename = snapshots.Files.rename
    for dies_at, expected in ((1, [1, 2]), (2, [2])):
        calls = []

        def dying(self, a, b, calls=calls, dies_at=dies_at):
            calls.append(a)
            if len(calls) == dies_at:
                raise OSError("died")
            rename(self, a, b)

        monkeypatch.setattr(snapshots.Files, "rename", dying)
        with pytest.raises(OSError, match="died"):
            sinks.replace_table(spark.read.parquet(path).filter("id = 2"), path)
        monkeypatch.setattr(snapshots.Files, "rename", rename)
        sinks.recover(spark, path)
        assert ids(spark.read.parquet(path)) == expected
    sinks.replace_table(records(spark, [7]), path)
    assert ids(spark.read.parquet(path)) == [7]
    assert sinks.markdown(records(spark, [1, 2, 3]).select("id"), "T", 2).endswith("Only the first 2 rows are shown.\n")


def test_transcripts_are_numbered_across_tasks(spark, tmp_path):
    files = {"a.jsonl": [f'{{"i": {i}}}' if i % 7 else "" for i in range(5000)], "b.jsonl": ["x\r"] * 3, "c.jsonl": []}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(y + "\n" for y in lines), newline="")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        frame = readers.transcripts(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {(r.session, r.n): r.value for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {(name, i): y.rstrip("\r") for name, lines in files.items() for i, y in enumerate(lines) if y}


def test_newest_messages_are_those_of_the_whole_session(spark):
    r = random.Random(4)
    rows = [(s, n, r.choice(["user", "assistant", "assistant", "system"]), r.random() < 0.1, r.choice([f"say {n}", "  ", "<command-name>x</command-name>"])) for s in [*range(12), None] for n in range(r.randint(0, 60))]
    events = spark.createDataFrame(rows, "session int, n long, type string, is_meta boolean, text string").repartition(5)
    columns = ["session", "age", "turns_ago", "intent"]
    for most in (1, 3, 5):
        assert Counter(map(tuple, context.newest_messages(events, most).select(columns).collect())) == Counter(map(tuple, context.user_messages(events).filter(F.col("age") < most).select(columns).collect()))
