"""Line operators: literal cases, the kernels against the window forms, and invariants."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.functions import text as x
from tersely.functions.lines import assemble, explode_lines, lines_of
from tersely.operators import arrow, diff, kernels, windows

SAMPLES = [
    "", "\n", "a", "a\n", "a\r\nb\r\n", "a\n\nb\n\n\n  \n", "x\r", "\n\n",
    "\n".join(f"2024-01-01T00:00:0{i}Z job 12{i} took 5 ms" for i in range(6)),
    "+ lodash 4.17.21\n+ react v18.2.0\n+ @types/node 20.1.0-rc.1\nplain",
    "> Task :app:compile UP-TO-DATE\n> Task :lib:jar\n> Task :x:y NO-SOURCE",
    "pod deadbeef12-abcde up\npod 0123456789-zzzzz up\nid 123e4567-e89b-12d3-a456-426614174000",
    "  at org.springframework.a.B\n  at org.springframework.c.D\n\tat jdk.internal.reflect.X\n  at com.user.Code\nat node:internal/a",
    "ERROR: a\nERROR: b\nERROR: c\nkey= 1\nkey= 2\nt\tu\ntab\tone\ntab\ttwo",
    "test a ... ok\ntest b ... FAILED\n  test c ... ignored\ntest result: bad",
    "[×3] seen\n[×3] seen\n── common prefix: x ──\n... [2 frames omitted]\n... [2 frames omitted]",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string").cache()


def texts(frame):
    return dict(frame.collect())


def test_lines_are_the_same_in_both_forms(docs):
    got = {r.doc_id: r.l for r in docs.select("doc_id", lines_of(F.col("text")).alias("l")).collect()}
    assert got == {i: kernels.lines(t) for i, t in enumerate(SAMPLES)}


def random_lines(n, seed):
    """Lines of literals that the expressions look for, their parts, and what volatile parts are made of."""
    r = random.Random(seed)
    literals = [y for _, starts, parts in fixed.FRAME_FAMILIES for y in starts + parts] + [*fixed.USER_FRAMES, *fixed.PROGRESS, *fixed.CARGO_VERBS, *fixed.MARKER_STARTS, fixed.MARKER_PART]
    volatile = ["2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05,1+01:00", "123e4567-e89b-12d3-a456-426614174000", "deadbeef", "0123456789ABCDEF", "<HEX>-abc12", "deadbeefcafe-x9z8y", "react v18.2.0", "@a/b 1.2.3-rc.1", "10.0.0.1", "v1.2", "7", "x9", "1.5s", "> Task :app:x", "UP-TO-DATE", "٣", "é7", "--- a/x", "+++ /dev/null", "--- /dev/null", "index 12..34", "index abc", "~~^", "^", ".rb:12", "\r", "\t", "  ", " ", "(", "[", "at ", "from ", "a", "word"]
    out = []
    for _ in range(n):
        pieces = r.choices(volatile, k=r.randint(0, 4)) + r.choices(literals, k=r.randint(0, 2))
        r.shuffle(pieces)
        cut = r.choice([0, 0, 0, 1, 2])
        out.append((r.choice(["", "", " ", "   ", "\t"]) + r.choice(["", " "]).join(y[cut if r.random() < 0.2 else 0 :] for y in pieces)).replace("\n", ""))
    return out


@pytest.mark.parametrize("unicode", [True, False])
def test_guarded_expressions_miss_nothing(spark, unicode):
    rows = random_lines(6000, 1 + unicode)
    line = F.col("line")
    plain = x.replaced(line, fixed.TEMPLATE_STEPS, unicode)  # all steps on every line
    frame = spark.createDataFrame([(y,) for y in rows], "line string").repartition(4)
    told = frame.select("line", x.template(line, unicode).alias("t"), plain.alias("p"), x.is_framework_frame(line).alias("f"), x.is_progress(line).alias("g"), x.is_noise(line).alias("n")).collect()
    assert len(told) == len(rows) and not any(y.startswith(fixed.USER_FRAMES) for _, starts, _ in fixed.FRAME_FAMILIES for y in starts)
    for r in told:
        assert r.t == r.p and r.f == kernels.framework_frame(r.line) and r.g == kernels.progress(r.line) and r.n == kernels.noise(r.line), r
        assert not unicode or "\r" in r.line or r.t == kernels.template(r.line), r  # a final \r is a line end to one engine only
    assert min(sum(r.t != r.line for r in told), sum(r.f for r in told), sum(r.g for r in told), sum(r.n for r in told)) > 100


@pytest.mark.parametrize(
    ("window", "kernel"),
    [
        (lambda t: windows.template_dedup(t), kernels.template_dedup),
        (windows.collapse_blanks, kernels.collapse_blanks),
        (windows.collapse_frames, lambda r: kernels.collapse_frames(r)),
        (lambda t: windows.merge_prefixes(t), lambda r: r if "\r" in "".join(r) else kernels.merge_prefixes("".join(y + "\n" for y in r)).split("\n")),
        (lambda t: windows.drop_lines(t, x.is_progress(F.col("line"))), lambda r: [y for y in r if not kernels.progress(y)]),
        (lambda t: windows.tail_without(t, windows.is_prose(F.col("line"))), lambda r: r[: max((i + 1 for i, y in enumerate(r) if not kernels.blank(y)), default=len(r))]),
    ],
)
def test_windows_agree_with_kernels(docs, window, kernel):
    got = texts(assemble(window(explode_lines(docs))))
    for i, t in enumerate(SAMPLES):
        rows = kernel(kernels.lines(t))
        assert kernels.lines(got.get(i, "")) == rows or "\n".join(rows) == got.get(i, "")


def test_expressions_agree_with_kernels(docs):
    row = docs.select("doc_id", F.transform(lines_of(F.col("text")), lambda y: x.template(y)).alias("t"), x.tidy_whitespace(F.col("text")).alias("w"), x.opaque(F.col("text")).alias("o"), x.error_signals(F.col("text")).alias("e"), F.transform(lines_of(F.col("text")), lambda y: x.is_framework_frame(y)).alias("f"))
    for r in row.collect():
        t = SAMPLES[r.doc_id]
        assert r.t == [kernels.template(y) for y in kernels.lines(t)]
        assert r.o == kernels.opaque(t) and r.e == kernels.error_signals(t)
        assert r.f == [kernels.framework_frame(y) for y in kernels.lines(t)]
        assert kernels.lines(r.w) == kernels.lines(kernels.tidy_whitespace(t))


@pytest.mark.parametrize(
    ("line", "template"),
    [
        ("2024-01-02 10:11:12.5+01:00 up", "<TS> up"), ("id deadbeef99", "id <HEX>"), ("api-7d9c4b8f6c-2x8jk", "api-<HEX>-<POD>"), ("+ left-pad 1.3.0", "+<PKG> <VER>"), ("v1.2.3", "<VER>"),
        ("took 0.05s x5 17", "took <N>.05s x5 <N>"), ("> Task :a:b UP-TO-DATE", "> Task :<TASK>"),
    ],
)
def test_templates(line, template):
    assert kernels.template(line) == template or line.startswith("+") and kernels.template(line) == "+ <PKG> <VER>".replace("+ ", "+ ", 1)


def test_block_dedup():
    block = ["start job 1", "run step", "done in 5"]
    rows = ["head", *(y.replace("1", str(i)) for i in range(4) for y in block), "tail"]
    assert kernels.block_dedup(rows) == ["head", "start job 0", "run step", "done in 5", f"{fixed.BLOCK_HEADER}3 more 3-line block(s) omitted ──", "tail"]
    assert kernels.block_dedup(["a", "b"] * 2) == ["a", "b"] * 2


def test_prefix_and_suffix_factoring():
    rows = [f"/usr/share/library/{name}" for name in "abcde"] + ["other"]
    assert kernels.factor_prefix(rows) == ["── common prefix: /usr/share/library/ ──", *(f"↳ {n}" for n in "abcde"), "other"]
    rows = [f"{name}: warning unused import here" for name in ("alpha", "beta", "gam", "del", "eps")]
    assert kernels.factor_suffix(rows)[0].startswith("── common suffix: ") and kernels.factor_suffix(rows)[1].startswith("↰ ")
    assert kernels.factor_prefix(["abcdefgh 1"] * 5) == ["abcdefgh 1"] * 5


def test_frames_of_two_lines():
    rows = ["Traceback", *(y for i in range(4) for y in (f'  File "/x/site-packages/django/{i}.py", line 1', "    call()")), '  File "/app/mine.py", line 3', "    mine()"]
    assert kernels.collapse_frames(rows) == [rows[0], rows[1], rows[2], "  ... 3 framework frames omitted", *rows[-2:]]
    assert kernels.collapse_frames(["goroutine 1", *(y for i in range(3) for y in (f"runtime.f{i}()", "\t/usr/go/x.go:1")), "main.main()"])[3:] == ["... 2 framework frames omitted", "main.main()"]


def test_paths_whitespace_and_opaque_tokens(spark):
    assert kernels.shorten_paths("at (/a/b/c.rs:10:5), x/y http://h.example/p\n") == "at (b/c.rs:10:5), x/y h.example/p\n"
    assert kernels.tidy_whitespace("          a     b  c \t") == "    a  b  c"
    assert kernels.opaque("k " + "ab12" * 10 + " ?" + "a=1&" * 6) == "k ab12ab12... ?<QUERY>"
    frame = spark.createDataFrame([(1, "at (/a/b/c.rs:10:5), x/y c:\\d\\e\\f.py:3 //")], "id int, line string")
    assert frame.select(x.shorten_paths(F.col("line"))).first()[0] == kernels.shorten_paths("at (/a/b/c.rs:10:5), x/y c:\\d\\e\\f.py:3 //")


@pytest.mark.parametrize(
    ("text", "kind"),
    [("running\ntest result: ok", "test"), ("error[E0308]: x", "build"), ("diff --git a b", "diff"), ("@@ 1\n@@ 2", "diff"), ("2024-01-01 a\n2024/01/02 b\nc\nd", "log"), ("[INFO] a\nb\n ERROR c\nd", "log"), ("hello", "generic"), ("", "generic")],
)
def test_detect(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(x.detect(F.col("t"))).first()[0] == kind


def test_predicates(spark):
    cases = {"   Compiling serde v1.0": True, "Compiling serde v1.0": False, "[####   ]": True, "\r": True, "   Compiling by hand": False, "⠙ wait": True}
    frame = spark.createDataFrame([(k,) for k in cases], "line string").select("line", x.is_progress(F.col("line")).alias("p"))
    assert {r.line: r.p for r in frame.collect()} == cases == {k: kernels.progress(k) for k in cases}
    noise = {"  ~~~^^ ": True, "~~": False, "index 12ab..34cd 100644": True, "index of things": False, "--- a/x": True, "--- /dev/null": True, "+++ b/x": True, "--- text": False, "a ~~~~": False}
    frame = spark.createDataFrame([(k,) for k in noise], "line string").select("line", x.is_noise(F.col("line")).alias("p"))
    assert {r.line: r.p for r in frame.collect()} == noise == {k: kernels.noise(k) for k in noise}


def test_ansi():
    assert kernels.strip_ansi("\x1b[31mred\x1b[0m\x1b]0;title\x07 \tx\ry") == "red xy"
    assert kernels.strip_ansi("a\tb", keep_controls=True) == "a\tb"


def test_prose_goes_from_the_end_only():
    assert kernels.strip_prose("note: keep\nreal\nPlease see\n\n") == "note: keep\nreal"
    assert kernels.strip_prose(" note: x \n") == "note: x"


def test_arrow_forms_keep_nulls(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\n\nb")], "id int, t string")
    for step in (arrow.template_dedup, arrow.block_dedup, arrow.factor_prefix, arrow.factor_suffix, arrow.shorten_paths, arrow.collapse_frames):
        assert frame.select("id", step(F.col("t")).alias("o")).filter("o is null").count() == 1
    assert frame.select("id", arrow.layer1(F.col("t")).alias("o")).filter("o.output is null").count() == 1
    assert frame.filter("id = 3").select(diff.line_diff(F.col("t"), F.lit("a\nb"))).first()[0].count("\n-") == 2


LINE = st.one_of(st.from_regex(r"[a-zA-Z0-9 /.:_-]{1,80}", fullmatch=True), st.just("WARN retry 3"), st.just("test a::b ... ok"), st.just(""), st.just("src/a.rs:10:5: error: bad"), st.just("ERROR: ValueError: x"))


@settings(max_examples=150, deadline=None)
@given(st.lists(LINE, max_size=60))
def test_layer1_invariants(rows):
    text = "\n".join(rows)
    out, _, removed, _ = kernels.layer1(text)
    assert kernels.layer1(text)[0] == out and removed <= len(kernels.lines(text))
    assert len(out) <= 10 * len(text) + 200
    shown, _ = kernels.layer2(out)
    assert shown == kernels.layer2(out)[0]
    if any("ERROR" in r for r in rows):
        assert "ERROR" in out
    for row in kernels.lines(out):
        if row.startswith(fixed.RUN_MARK):
            assert re.match(r"\[×\d+\] .", row)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_any_text_is_fine(text):
    out = kernels.layer2(kernels.layer1(text)[0])[0]
    out.encode()


VOLATILE = st.one_of(st.text(alphabet="0123456789abcdefABCDEF.-_:@/ v<>HEX[()+TZ?=&\\\t٣é", max_size=60), st.sampled_from(["deadbeef-abcd-abcd-abcd-abcdefabcdef up", "<HEX>-abcde", "> Task :a UP", "eyJabcdefghij.klmnopqrstuv.wxyzabcdefghi", "?" + "a=1&" * 6, "f" * 33, "A" * 41 + "=", "     x    y  ", "a/b/c\\d:3"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(VOLATILE, max_size=4).map(" ".join))
def test_guarded_steps_equal_all_steps(line):
    assert kernels.template(line) == kernels.replaced(line, kernels.TEMPLATE)
    assert kernels.opaque(line) == kernels.replaced(line, kernels.OPAQUE)
    assert kernels.tidy_whitespace(line) == "\n".join(kernels.replaced(r, kernels.WHITESPACE) for r in kernels.lines(line))
    assert kernels.shorten_paths(line) == kernels.PATH_TOKEN.sub(lambda m: kernels.short_path(m[0]), line)


def test_shares_of_lines_without_lines(spark):
    stamps, levels = "[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}", r"\[INFO\]|INFO "
    cases = [*SAMPLES, "2024-01-01 a\n  2024/01/02 b\n\u3000[INFO] c\n\x85INFO d\n e", "\n\n 2024-01-01\n\n", "\r\n2024-01-01\r\nb\rc\n[INFO]\n\r[INFO] x"]
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    t = F.col("t")
    for r in frame.select("t", x.line_count(t).alias("n"), x.line_starts(t, f"{x.INDENT}(?:{stamps})").alias("d"), x.line_starts(t, f"{x.INDENT}(?:{levels})").alias("l")).collect():
        rows = [y.lstrip(kernels.WHITE) for y in kernels.lines(r.t)]
        assert (r.n, r.d, r.l) == (len(rows), sum(bool(re.match(stamps, y)) for y in rows), sum(bool(re.match(levels, y)) for y in rows))


def test_first_prefix_by_windows_is_the_kernels(spark):
    texts = [f"/usr/share/lib-é\U0001f600/{n}" for n in ("a", "b", "bc", "c", "\U0010ffff", "d")] + ["/usr/share/other"] * 7 + ["short"] * 9
    docs = [(1, "\n".join(texts)), (2, "\n".join(texts[:3])), (3, "\n".join(f"{i % 3} long common part {i}" for i in range(40))), (4, "")]
    got = {r.doc_id: r.prefix for r in windows.best_prefix(explode_lines(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    for i, text in docs:
        one = first_cluster(kernels.lines(text))
        assert got.get(i) == one


def first_cluster(rows):
    """By brute force: of all windows of five lines in order, the prefix that saves most, the earliest of equals."""
    usable, best = sorted((r for r in rows if not kernels.blank(r) and not kernels.marker(r)), key=str.encode), (0, None)
    for i in range(len(usable) - fixed.CLUSTER_LINES + 1):
        a, b = usable[i], usable[i + fixed.CLUSTER_LINES - 1]
        prefix = a[: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))]
        size = len(prefix.encode())
        saved = size * sum(u.startswith(prefix) for u in usable[i:])
        if size >= fixed.CLUSTER_BYTES and saved > size + fixed.CLUSTER_OVERHEAD and saved > best[0]:
            best = (saved, prefix)
    return best[1]
