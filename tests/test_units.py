"""Units of several lines as windows against the kernels, and chains of rules in both forms."""

import random

import pytest
from pyspark.sql import functions as F

from tersely.functions.lines import assemble, explode_lines
from tersely.operators import kernels, windows
from tersely.operators.benchmarks import every_ruleset
from tersely.operators.rules import Rule, compiled, fold, line_form

PARTS = [
    '  File "/usr/lib/site-packages/django/x.py", line 3', "    return handler(request)", 'File "/app/site-packages/a.py", line 1', "runtime.goexit()", "\t/usr/go/src/runtime/asm.s.go:12", "runtime.main()",
    "at org.springframework.a.B", "    at node:internal/x", "plain", "", "main.main()", "    ",
]


def random_docs(parts, n, seed, most=30):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        weights = [r.random() ** 3 for _ in parts]
        out.append("\n".join(r.choices(parts, weights, k=r.randint(1, most)) + ["end"]))
    return out


def both(spark, texts, window, kernel):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = dict(assemble(window(explode_lines(docs))).collect())
    for i, t in enumerate(texts):
        assert got.get(i, "") == "\n".join(kernel(kernels.lines(t))), t


def test_frames_with_source_lines(spark):
    texts = random_docs(PARTS, 300, 5) + ["\n".join([PARTS[0], PARTS[1]] * 40), "\n".join([PARTS[3]] * 20 + [PARTS[4]] * 3), "\n".join(PARTS * 6)]
    folded = sum("framework frames omitted" in "\n".join(kernels.collapse_frames(kernels.lines(t))) for t in texts)
    assert folded > 40
    both(spark, texts, windows.collapse_frames, kernels.collapse_frames)


@pytest.mark.parametrize("unit", [1, 2, 3, 5])
def test_units_of_rules(spark, unit):
    rule = Rule("u", {"kind": "frame-run", "classifier": "contains", "values": ["hit"], "unit": unit}, {"kind": "collapse-run", "min_run": 2, "replacement": "[{n} of {n}]"})
    texts = random_docs(["hit a", "hit b", "x", "y"], 250, unit, 40)
    step = compiled(rule)
    assert sum(step(kernels.lines(t)) is not None for t in texts) > 50
    both(spark, texts, lambda t: line_form(t, rule), lambda rows: step(rows) or rows)


def test_starts_are_those_of_a_walk(spark):
    r = random.Random(3)
    sizes = [[r.choice([0, 0, 1, 2, 3, 4, 4]) for _ in range(r.randint(1, 200))] for _ in range(40)]
    lines = spark.createDataFrame([(d, 7 * i, str(s)) for d, own in enumerate(sizes) for i, s in enumerate(own)], "doc_id long, n int, line string").repartition(4)
    got = {(x.doc_id, x.n // 7) for x in windows.unit_starts(lines, F.col("line").cast("int"), 4).filter("first").collect()}
    expected = set()
    for d, own in enumerate(sizes):
        i = 0
        while i < len(own):
            expected.add((d, i))
            i += max(1, own[i])
    assert got == expected


@pytest.mark.parametrize("reverse", [False, True])
def test_all_rounds_of_factoring(spark, reverse):
    r = random.Random(9)
    heads = ["/srv/app/module/alpha/", "/srv/app/module/beta_long_name/", "2024-01-01 INFO worker ", "/srv/app/module/", "ERROR in component gamma: ", "éééé ünïcödé prefix "]
    texts = []
    for _ in range(60):
        own = r.sample(heads, r.randint(0, len(heads)))
        rows = [r.choice(own) + r.choice(["x", "yy", "file.py", ""]) + str(r.randint(0, 30)) for _ in range(r.randint(0, 60))] if own else [f"{i} short" for i in range(9)]
        rows += r.choices(["", "plain", "── common prefix: /srv ──", "↳ /srv/app/module/alpha/1"], k=r.randint(0, 4))
        r.shuffle(rows)
        texts.append("\n".join(y[::-1] if reverse and not kernels.marker(y) else y for y in rows) + "\nend")
    kernel = kernels.factor_suffix if reverse else kernels.factor_prefix
    assert sum(len(kernels.clusters([y[::-1] if reverse else y for y in kernels.lines(t)])) > 1 for t in texts) > 15
    both(spark, texts, lambda t: windows.factor_ends(t, reverse), kernel)


def test_rule_sets_meet_fixtures_in_one_scan(spark):
    sets = {"a": [CHAIN[1], CHAIN[2]], "b": [Rule("bad", {"kind": "line-match", "classifier": "contains", "values": ["Error"]}, {"kind": "delete"}, ["preserve_errors"])]}
    fixtures = spark.createDataFrame([("s1", "drop x\nv=3"), ("s2", "ValueError: x"), ("s3", None)], "stem string, text string")
    frame = every_ruleset(fixtures, sets)
    got = {(x.stem, x.ruleset): (x.applied, x.rejected) for x in frame.collect()}
    assert got == {("s1", "a"): (["drop", "rewrite"], []), ("s1", "b"): ([], []), ("s2", "a"): ([], []), ("s2", "b"): ([], ["bad"]), ("s3", "a"): ([], []), ("s3", "b"): ([], [])}
    assert frame._jdf.queryExecution().executedPlan().toString().count("Scan ") <= 1


CHAIN = [
    Rule("frames", {"kind": "frame-run", "classifier": "starts_with", "values": ["at lib."], "unit": 2}, {"kind": "collapse-run", "min_run": 2, "replacement": "abc [{n} left out]"}),
    Rule("drop", {"kind": "line-match", "classifier": "contains", "values": ["drop"]}, {"kind": "delete"}),
    Rule("rewrite", {"kind": "line-match", "classifier": "regex", "values": ["v=[0-9]+"]}, {"kind": "rewrite", "replacement": "<V>"}),
    Rule("dedup", {"kind": "template-dedup", "normalize": [{"regex": "[0-9]+"}]}, {"kind": "dedup", "min_run": 2, "format": "abc [x{n}] {exemplar}"}),
    Rule("prefix", {"kind": "prefix-factor", "min_lines": 3}, {"kind": "factor-prefix", "replacement": "abc of {prefix}:"}),
]


@pytest.mark.parametrize("first", CHAIN, ids=lambda r: r.id)
@pytest.mark.parametrize("second", CHAIN, ids=lambda r: r.id)
def test_chains_of_rules_keep_all_text(spark, first, second):
    parts = ["abc 1", "abc 22", "abc v=3", "abc drop this"]
    texts = random_docs(parts, 30, 11, 8) + ["\n".join(x) for x in (["drop VIEW", *(f"abc {i}" for i in range(5))], ["at lib.x", "  code"] * 4 + ["abc"], ["drop"] * 3)]
    texts = [t.removesuffix("\nend") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(assemble(line_form(line_form(explode_lines(docs), first), second)).collect())
    rules = [(r, compiled(r)) for r in (first, second)]
    assert [got.get(i, "") for i in range(len(texts))] == [fold(t, rules)[0] for t in texts]
