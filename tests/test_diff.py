"""Line diffs: shortest scripts, patches that apply, hunks."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersely.operators import diff, kernels


def common(a, b):
    """Length of the longest common subsequence, by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edits(ops):
    return sum(n - i + m - j for tag, i, n, j, m in ops if tag != "equal")


LINES = st.lists(st.sampled_from(["a", "b", "c", "d", ""]), max_size=40)


def check(a, b):
    ops = diff.script(a, b)
    assert edits(ops) == len(a) + len(b) - 2 * common(a, b)
    assert [x for tag, i, n, *_ in ops if tag != "insert" for x in a[i:n]] == a
    assert [x for tag, i, n, j, m in ops if tag != "delete" for x in (a[i:n] if tag == "equal" else b[j:m])] == b
    for context in (0, 1, 3):
        assert diff.applied(a, diff.unified(a, b, context)) == b


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_scripts_are_shortest_and_patches_apply(a, b):
    check(a, b)


@pytest.mark.parametrize("seed", range(6))
def test_all_diagonals_at_once(monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(diff, "SMALL", 0)
    for _ in range(60):
        a = r.choices("abcde", k=r.randint(0, 60))
        b = [x for x in a if r.random() < 0.8] if seed % 2 else r.choices("abcdefg", k=r.randint(0, 60))
        check(a, [y for x in b for y in ([x, r.choice("abcdz")] if r.random() < 0.1 else [x])])


def test_long_and_repetitive_texts_stay_fast():
    r = random.Random(1)
    a = [f"line {r.randrange(50)}" for _ in range(6000)]
    b = [x for x in a if r.random() < 0.9]
    start = time.perf_counter()
    ops = diff.script(a, b)
    assert edits(ops) == len(a) - len(b) and time.perf_counter() - start < 10
    start = time.perf_counter()
    assert edits(diff.script(["x"] * 200_000, ["x"] * 100_000 + ["y"])) == 100_001 and time.perf_counter() - start < 10
    other = r.sample(a, len(a))
    start = time.perf_counter()
    assert 0 < edits(diff.script(a, other)) < 12_000 and time.perf_counter() - start < 30


def test_hunks_and_views():
    a = [f"l{i}" for i in range(30)]
    b = [*a[:5], "new", *a[6:20], *a[22:]]
    assert diff.unified(a, b, 1).split("\n") == ["--- before", "+++ after", "@@ -5,3 +5,3 @@", " l4", "-l5", "+new", " l6", "@@ -20,4 +20,2 @@", " l19", "-l20", "-l21", " l22"]
    assert diff.unified(a, a) == "" and diff.unified([], ["x"]) == "--- before\n+++ after\n@@ -0,0 +1 @@\n+x" and diff.applied([], diff.unified([], ["x"])) == ["x"]
    assert diff.numbered(a, b, 1).split("\n") == ["   5    5    l4", "   6      -- l5", "        6 ++ new", "   7    7    l6", "  …", "  20   20    l19", "  21      -- l20", "  22      -- l21", "  23   21    l22"]
    assert len(diff.hunks(diff.script(a, b), 8)) == 1
    with pytest.raises(ValueError, match="is not"):
        diff.applied(b, diff.unified(a, b))


def test_columns(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "x\r\ny", None), (4, None, None), (5, "@@ -1 +1 @@\n-x\n+y", "-x\n@@ -1 +1 @@")]
    frame = spark.createDataFrame(rows, "id int, a string, b string").withColumn("patch", diff.line_diff(F.col("a"), F.col("b")))
    got = {r.id: r for r in frame.select("id", "a", "b", "patch", diff.patched(F.col("a"), F.col("patch")).alias("made"), diff.numbered_diff(F.col("a"), F.col("b")).alias("view")).collect()}
    assert all(got[i].made == "\n".join(kernels.lines(b or "")) for i, _, b in rows) and got[4].patch == "" == got[4].view
    told = frame.filter("id = 1").select(F.inline(diff.diff_rows(F.col("a"), F.col("b"), 0))).collect()
    assert [tuple(r) for r in told] == [(0, "delete", 2, None, "b"), (1, "insert", None, 3, "d")]


def test_middle_of_empty_sides():
    assert diff.script([], []) == [] and list(diff.matches(np.array([1, 2]), np.array([], dtype=np.int64))) == []
