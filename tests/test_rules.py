"""The rule engine: each pair, the fold with its error check, files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import tersely
from tersely.functions.lines import assemble, explode_lines
from tersely.operators import kernels
from tersely.operators.rules import Rule, RuleError, apply_rules, compiled, fold, line_form, load_file, load_folder, parse, veto

FRAMES = Rule("f", {"kind": "frame-run", "classifier": "starts_with", "values": ["at lib."]}, {"kind": "collapse-run", "min_run": 3, "replacement": "[{n} left out]"}, ["preserve_errors"])
RULES = [
    (FRAMES, "a\n at lib.x\nat lib.y\nat lib.z\nat lib.w\nb", "a\n at lib.x\n[2 left out]\nat lib.w\nb"),
    (Rule("d", {"kind": "line-match", "classifier": "contains", "values": ["drop"]}, {"kind": "delete"}), "a\ndrop me\nb", "a\nb"),
    (Rule("e", {"kind": "line-match", "classifier": "equals", "values": ["x"]}, {"kind": "rewrite", "replacement": "y"}), "x\nxx", "y\nxx"),
    (Rule("r", {"kind": "line-match", "classifier": "regex", "values": ["v=(\\d+)"]}, {"kind": "rewrite", "replacement": "<$1>"}), "v=12 b\nq", "<12> b\nq"),
    (Rule("t", {"kind": "template-dedup", "normalize": [{"regex": "\\d+"}]}, {"kind": "dedup", "min_run": 2, "format": "{n}x {exemplar}"}), "a 1\na 2\n\na 3\nb", "2x a 1\n\na 3\nb"),
    (Rule("p", {"kind": "prefix-factor", "min_lines": 3}, {"kind": "factor-prefix", "replacement": "of {prefix}:"}), "pre a\npre b\npre ce", "of pre :\n  a\n  b\n  ce"),
]


@pytest.mark.parametrize(("rule", "before", "after"), RULES)
def test_each_pair_in_both_forms(spark, rule, before, after):
    assert fold(before, [(rule, compiled(rule))]) == (after, [rule.id], [])
    docs = spark.createDataFrame([(1, before)], "doc_id long, text string")
    assert assemble(line_form(explode_lines(docs), rule)).first().text == after
    assert fold("none", [(rule, compiled(rule))]) == ("none", [], [])


def test_units_of_two_lines(spark):
    rule = Rule("u", {**FRAMES.pattern, "unit": 2}, FRAMES.transform)
    rows = [y for i in range(4) for y in (f"at lib.{i}", f"  code {i}")]
    assert fold("\n".join(["head", *rows, "tail"]), [(rule, compiled(rule))])[0] == "\n".join(["head", *rows[:2], "[2 left out]", *rows[-2:], "tail"])
    docs = spark.createDataFrame([(1, "\n".join(["head", *rows, "tail"]))], "doc_id long, text string")
    assert assemble(line_form(explode_lines(docs), rule)).first().text == fold("\n".join(["head", *rows, "tail"]), [(rule, compiled(rule))])[0]


def test_a_rule_that_loses_errors_is_rejected(spark):
    rule = Rule("x", {"kind": "line-match", "classifier": "contains", "values": ["Error"]}, {"kind": "delete"}, ["preserve_errors"])
    assert fold("a\nValueError: bad", [(rule, compiled(rule))]) == ("a\nValueError: bad", [], ["x"])
    frame = spark.createDataFrame([("ValueError: bad", "gone"), ("exception.py", "y")], "a string, b string")
    assert [r[0] for r in frame.select(veto(F.col("a"), F.col("b"))).collect()] == ["ValueError: bad", "y"]


def test_unusable_rules_are_rejected():
    odd = Rule("odd", {"kind": "line-match", "classifier": "contains", "values": ["a"]}, {"kind": "dedup"})
    bad = Rule("bad", {"kind": "line-match", "classifier": "regex", "values": ["("]}, {"kind": "rewrite", "replacement": "x"})
    assert fold("a", [(odd, compiled(odd)), (bad, compiled(bad))]) == ("a", [], ["odd", "bad"])
    with pytest.raises(RuleError):
        parse({"spec_version": "1.0", "rules": []})


def test_files(tmp_path):
    (tmp_path / "b.yaml").write_text("spec_version: 0.1\nrules: [{id: q, pattern: {kind: line-match, values: [z]}, transform: {kind: delete}}]")
    (tmp_path / "a.yaml").write_text("spec_version: 9\nrules: []")
    (tmp_path / "c.json").write_text(json.dumps({"spec_version": "0.1", "rules": []}))
    told = []
    assert [r.id for f in load_folder(tmp_path, told.append) for r in f] == ["q"] and len(told) == 1
    assert load_file(tmp_path / "c.json") == []
    with pytest.raises(RuleError):
        load_folder(tmp_path / "none")


def test_shipped_rules_keep_errors(spark):
    files = load_folder(Path(tersely.__file__).parent / "rulesets")
    rules = [r for f in files for r in f]
    assert len(rules) >= 15 and all(compiled(r) for r in rules)
    trace = "\n".join(["Exception: bad", *(f"  at org.springframework.a.B{i}" for i in range(9)), "ValueError: x", *(f"2024-01-01T00:00:0{i}Z tick" for i in range(5)), "\x1b[31mERROR\x1b[0m"])
    r = spark.createDataFrame([(trace,), (None,)], "t string").select(apply_rules(F.col("t"), files).alias("r")).collect()
    assert r[1].r is None or r[1].r.output is None
    out = r[0].r
    assert out.rejected == [] and {"trace.jvm_framework", "generic.csi", "generic.repeats"} <= set(out.applied)
    assert kernels.error_signals(out.output) >= kernels.error_signals(trace) and len(out.output) < len(trace)
