"""Report helpers, checks of settings, the rule command, paging, the cap."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tersely.functions.text import capped
from tersely.operators import reports
from tersely.plans.compaction import configured
from tersely.sources import checks, readers
from tersely.streaming import tail

ROOT = Path(__file__).resolve().parent.parent


def test_the_cap_never_cuts_a_character(spark):
    texts = ["", "abc", "aé" * 5, "a😀😀😀", "梦想梦想", "x" * 20]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(1, 9):
        got = [r.c for r in frame.select(capped(F.col("t"), most).alias("c")).collect()]
        assert got == [t.encode()[:most].decode(errors="ignore") for t in texts]


def test_hosts_and_addresses():
    assert all(map(checks.loopback, ("127.0.0.1", " LOCALHOST ", "::1", "[::1]", "127.9.9.9")))
    assert not any(map(checks.loopback, ("0.0.0.0", "example.org", "", "::2")))
    assert checks.local_url("http://localhost:11434") and checks.local_url("http://[::1]:1/x")
    for url in ("http://127.0.0.2", "http://10.0.0.1", "http://localhost.example.org", "nothing"):
        with pytest.raises(ValueError, match="localhost"):
            checks.local_url(url)
    with pytest.raises(ValueError, match="more than"):
        checks.bounded(10_000_001, 1)
    assert checks.same_token(None, None) and checks.same_token("a", "a") and not checks.same_token(None, "a") and not checks.same_token("b", "a")


def test_the_variable_wins_over_the_setting(monkeypatch):
    monkeypatch.setenv("TERSELY_RULES", "  ")
    assert checks.rules_path("set") == "set"
    monkeypatch.setenv("TERSELY_RULES", " /elsewhere ")
    assert checks.rules_path("set") == "/elsewhere"


def test_rules_from_the_command_line(tmp_path):
    run = lambda *a, given="": subprocess.run([sys.executable, "-m", "tersely", *a], cwd=ROOT, input=given, capture_output=True, text=True)
    assert run().returncode == 1 and run(str(tmp_path)).returncode == 1 and run("--help").returncode == 0
    done = run(str(ROOT / "tersely" / "rulesets"), given="plain text\nstays\n")
    assert (done.returncode, done.stdout) == (0, "plain text\nstays\n")
    rule = "  - {id: gone, pattern: {kind: line-match, classifier: contains, values: [%s]}, transform: {kind: delete}, invariants: [preserve_errors]}\n"
    (tmp_path / "a.yaml").write_text("spec_version: 0.1\nrules:\n" + rule % "Error")
    done = run(str(tmp_path), given="ok\nError: bad")
    assert (done.returncode, done.stdout) == (2, "ok\nError: bad") and "a.yaml: gone" in done.stderr
    (tmp_path / "a.yaml").write_text("spec_version: 0.1\nrules:\n" + rule % "ok")
    assert run(str(tmp_path), given="ok\nError: bad").stdout == "Error: bad"


def test_pages_hold_all_rows_in_order(spark):
    rows = spark.range(1, 1204).withColumn("command", F.lit("x"))
    got = []
    tail.pages(rows, lambda page: got.append([r.id for r in page.collect()]), 500)
    assert [len(g) for g in got] == [500, 500, 203] and sum(got, []) == list(range(1, 1204))


def test_text_helpers(spark):
    row = spark.range(1).select(reports.uptime(F.lit(3723)).alias("a"), reports.uptime(F.lit(59)).alias("b"), reports.padded(F.lit("\x1b[1mab\x1b[0m"), 4).alias("c"), reports.thousands(F.lit(1234567)).alias("d")).first()
    assert tuple(row) == ("1h 02m 03s", "59s", "\x1b[1mab\x1b[0m  ", "1,234,567")


def test_settings_govern_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("TERSELY_RULES", raising=False)
    write = lambda content: (tmp_path / "s.json").write_text(json.dumps(content)) and str(tmp_path / "s.json")
    assert set(readers.settings()) == {"daemon", "compression", "model", "metrics", "exclusions", "display", "telemetry", "security", "l3_cache"}
    for wrong, said in (
        ({"exclusions": {"max_input_chars": 10_000_001}}, "max_input_chars"), ({"compression": {"inference_threshold_tokens": 100_001}}, "threshold"), ({"model": {"ollama_url": "http://example.org:1"}}, "localhost"),
        ({"daemon": {"host": "0.0.0.0"}}, "this machine"), ({"l3_cache": {"ttl_days": -1}}, "out of range"),
    ):
        with pytest.raises(ValueError, match=said):
            readers.settings(write(wrong))
    (tmp_path / "rules.yaml").write_text("spec_version: 0.1\nrules: [{id: q, pattern: {kind: line-match, values: [gone]}, transform: {kind: delete}}]")
    rows = spark.createDataFrame([("a 1\na 2\ngone\nb", "ls"), ("x" * 300, "ls"), ("y", "cat z"), ("a 1\na 2", "cargo t")], "output string, command string")
    config = readers.settings(write({"exclusions": {"commands": ["cargo"], "max_input_chars": 200}, "compression": {"spec_rules_path": str(tmp_path / "rules.yaml"), "layer2_enabled": False}}))
    got = [(r.route, r.compressed) for r in configured(rows, config).collect()]
    assert got == [("accepted", "[×2] a 1\nb"), ("rejected", None), ("accepted", "y"), ("bypassed", "a 1\na 2")]
    off = configured(rows, readers.settings(write({"compression": {"enabled": False}}))).collect()
    assert [r.compressed for r in off] == ["a 1\na 2\ngone\nb", "x" * 300, None if off[2].route == "rejected" else "y", "a 1\na 2"]
    monkeypatch.setenv("TERSELY_RULES", str(tmp_path / "other.yaml"))
    assert readers.settings()["compression"]["spec_rules_path"].endswith("other.yaml")
