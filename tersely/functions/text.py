"""Column expressions on lines and texts. `unicode` picks Unicode classes (the default); False gives ASCII ones."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.functions.lines import left_trimmed, trimmed

WORD = "0-9A-Za-z_"
#: White space within a line, by Unicode.
INDENT = r"(?U:[\s&&[^\n]]*+)"


def dialect(pattern: str, unicode: bool) -> str:
    """The pattern for Spark: Unicode classes, or ASCII ones with ASCII word ends."""
    if unicode:
        return "(?U)" + pattern
    begun = re.sub(r"(^|\||\(|\?:)\\b", rf"\1(?<![{WORD}])", pattern)
    return re.sub(r"\\b", rf"(?![{WORD}])", begun)


def replaced(text: Column, steps: tuple, unicode: bool) -> Column:
    return functools.reduce(lambda c, s: F.regexp_replace(c, dialect(s[0], unicode), s[1]), steps, text)


#: The template steps that need two numbers joined by a dot, and those that need a long hexadecimal run (or its placeholder).
DOTTED_STEPS, HEX_STEPS = (4, 5), (1, 2, 3)


def template(line: Column, unicode: bool = True) -> Column:
    """A line with its volatile parts (times, ids, versions, numbers) replaced by placeholders.

    Most lines have nothing that a step could replace; three cheap searches tell which steps are worth their patterns."""
    digits = line.rlike(dialect(r"\d", unicode))
    dotted = line.rlike(dialect(r"\d\.\d", unicode))
    hexes = line.rlike("[0-9a-fA-F]{8}") | line.contains("<HEX>-")

    def without(*steps: int) -> Column:
        return replaced(line, tuple(s for i, s in enumerate(fixed.TEMPLATE_STEPS) if i not in steps), unicode)

    some = F.when(dotted, without(*HEX_STEPS)).otherwise(without(*HEX_STEPS, *DOTTED_STEPS))
    with_hexes = F.when(dotted, without()).otherwise(without(*DOTTED_STEPS))
    return F.when(hexes, with_hexes).when(digits | line.startswith("> Task :"), some).otherwise(line)


def opaque(text: Column, unicode: bool = True) -> Column:
    """Tokens, long hashes, query strings and base64 replaced."""
    return replaced(text, fixed.OPAQUE_STEPS, unicode)


def tidy_whitespace(text: Column) -> Column:
    """At most four leading spaces, at most two within a line, none (nor tabs) at its end."""
    body = F.regexp_replace(F.regexp_replace(text, r"\r?\n\z", ""), r"\r\n", "\n")
    steps = ((r"(?m)^( {4}) +", "$1"), (r"([^ \n]) {3,}", "$1  "), (r"(?m)[ \t]+$", ""))
    return functools.reduce(lambda c, s: F.regexp_replace(c, *s), steps, body)


PATH_TOKEN = r"[^\s,()'\"]+"


def short_path(token: Column) -> Column:
    """A token of two separators or more as its last two segments; trailing `:digits` groups stay."""
    tail = F.regexp_extract(token, r"((?::[0-9]+)*)$", 1)
    path = F.substring(token, F.lit(1), F.length(token) - F.length(tail))
    segments = F.filter(F.split(path, r"[/\\]"), lambda s: s != "")
    short = F.concat(F.element_at(segments, -2), F.lit("/"), F.element_at(segments, -1), tail)
    return F.when((F.regexp_count(path, F.lit(r"[/\\]")) >= 2) & (F.size(segments) >= 2), short).otherwise(token)


def shorten_paths(line: Column) -> Column:
    """A line with each path-like token shortened."""
    tokens = F.transform(F.regexp_extract_all(line, F.lit(f"({PATH_TOKEN})"), 1), short_path)
    gaps = F.split(line, PATH_TOKEN)
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit("")))), "")


def line_prefix(line: Column) -> Column:
    """Up to the first ': ', else the first '= ', else the first tab; else empty."""
    found = [F.regexp_extract(line, p, 1) for p in (r"(?s)^(.*?: )", r"(?s)^(.*?= )", r"(?s)^(.*?\t)")]
    return F.coalesce(*(F.when(f != "", f) for f in found), F.lit(""))


def any_of(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return functools.reduce(operator.and_, tests, F.lit(True))


def holds(text: Column, *parts: str) -> Column:
    return all_of([text.contains(p) for p in parts])


def strip_ansi(text: Column, keep_controls: bool = False) -> Column:
    """Without terminal escapes; other control characters but line ends go as well, unless kept."""
    out = F.regexp_replace(text, "\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)|\\x1b[PX^_][^\\x1b]*\\x1b\\\\|\\x1b\\[[0-?]*[ -/]*[@-~]|\\x1b[ -/]*[0-~]", "")
    return out if keep_controls else F.regexp_replace(out, r"[\x00-\x09\x0b-\x1f\x7f]", "")


def is_cargo_progress(line: Column) -> Column:
    t = left_trimmed(line)
    return line.startswith(" ") & (F.octet_length(line) >= 4) & any_of([t.startswith(v) for v in fixed.CARGO_VERBS]) & (t.contains(" v") | t.contains(" ("))


def is_progress(line: Column) -> Column:
    t = F.when(line.startswith("\r"), F.regexp_replace(line, r"^\r+", "")).otherwise(line)
    return ((t == "") & line.contains("\r")) | any_of([t.contains(p) for p in fixed.PROGRESS]) | is_cargo_progress(t)


def is_wavy_underline(line: Column) -> Column:
    found = line.rlike(r"(?U)^[~^\s]+$") & (F.regexp_count(line, F.lit(r"[~^]")) >= 3)
    return F.when(line.contains("~") | line.contains("^"), found).otherwise(False)


def is_diff_metadata(line: Column) -> Column:
    return (line.startswith("index ") & F.substring(line, 7, 20).contains("..")) | any_of([line.startswith(f"{s} {p}/") | (line == f"{s} /dev/null") for s, p in (("---", "a"), ("+++", "b"))])


def is_noise(line: Column) -> Column:
    return is_wavy_underline(line) | is_diff_metadata(line)


def is_marker(line: Column) -> Column:
    return any_of([line.startswith(m) for m in fixed.MARKER_STARTS]) | line.contains(fixed.MARKER_PART)


def is_framework_frame(line: Column) -> Column:
    """By the table of families; a Ruby frame also by its file.

    Families with starts are looked at only for lines that one anchored pattern, the first characters of all starts, lets through."""
    t = F.when(line.rlike(r"(?U)^\s"), left_trimmed(line)).otherwise(line)

    def any_family(families: tuple) -> Column:
        return any_of([any_of([t.startswith(s) for s in starts] or [F.lit(True)]) & any_of([t.contains(p) for p in parts] or [F.lit(True)]) for _, starts, parts in families])

    begun, free = ([f for f in fixed.FRAME_FAMILIES if bool(f[1]) is b] for b in (True, False))
    heads = {s.split(" ")[0] + " " if " " in s else s for _, starts, _ in begun for s in starts}
    may = line.rlike(rf"(?U)^\s*+(?:{'|'.join(map(re.escape, sorted(heads)))})")
    ruby = F.when(line.contains(".rb:"), any_of([t.contains(p) for p in fixed.RUBY_PARTS])).otherwise(False)
    users = any_of([t.startswith(u) for u in fixed.USER_FRAMES])
    before = [f for f in fixed.BEFORE_USER_FRAMES if not f[1]]
    by_start = F.when(may, any_family(tuple(begun))).otherwise(False)  # no user's frame has such a start
    return ruby | by_start | any_family(tuple(before)) | (any_family(tuple(f for f in free if f not in before)) & ~users)


def is_test_output(text: Column) -> Column:
    return text.contains("test result:") | text.contains("FAILED")


def is_passing_test(line: Column) -> Column:
    t = trimmed(line)
    return t.startswith("test ") & (t.endswith(" ... ok") | t.endswith(" ... ignored"))


def is_prefiltered(text: Column, command: Column | None = None) -> Column:
    found = text.contains(fixed.RUN_MARK)
    return found if command is None else found | (F.split(F.ltrim(command), r"\s+")[0] == "rtk")


def is_test(text: Column) -> Column:
    h = functools.partial(holds, text)
    both = h("passed", "failed")
    return h("test result:") | h("running 0 tests") | (h("FAILED") & (h("passed") | h("failed"))) | h("✓", "✗") | h("PASS", "FAIL", "Tests:") | (both & (h("===") | h("Playwright")))


def is_build(text: Column) -> Column:
    h = functools.partial(holds, text)
    return any_of([h(p) for p in ("error[E", "error TS", "warning TS", "warning[", "Compiling ", "Building ", "eslint", "Creating an optimized production build", "Route (app)")]) | h("error", "warning", "problem")


def line_starts(text: Column, pattern: str) -> Column:
    """Lines that the pattern begins, by one pass over the text; the lines are never built."""
    return F.regexp_count(F.concat(F.lit("\n"), text), F.lit(rf"\n(?:{pattern})"))


def line_count(text: Column) -> Column:
    """How many lines `lines_of` has: a final line end starts none."""
    ends = F.regexp_count(text, F.lit("\n"))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def share_over(text: Column, pattern: str, percent: int) -> Column:
    """More than three lines, and more than this percent of them begin, after white space, with the pattern."""
    n, hits = line_count(text), line_starts(text, rf"{INDENT}(?:{pattern})")
    return (hits > 0) & (n > 3) & (hits * 100 > n * percent)


def is_diff(text: Column) -> Column:
    return any_of([text.startswith(p) for p in ("diff --git", "--- ", "+++ ")]) | F.when(text.contains("@@ "), line_starts(text, "@@ ") >= 2).otherwise(False)


def is_log(text: Column) -> Column:
    dated, marked = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}", "|".join(re.escape(v) for v in fixed.LEVELS)
    return share_over(text, dated, 30) | F.when(any_of([text.contains(v) for v in fixed.LEVELS]), share_over(text, marked, 30)).otherwise(False)


def detect(text: Column) -> Column:
    """test, build, diff, log or generic: the first that holds."""
    return F.when(is_test(text), "test").when(is_build(text), "build").when(is_diff(text), "diff").when(is_log(text), "log").otherwise("generic")


def error_signals(text: Column, unicode: bool = True) -> Column:
    return F.regexp_count(text, F.lit(dialect(fixed.ERROR_SIGNAL, unicode)))


def route(text: Column, command: Column, max_bytes: int = fixed.MAX_INPUT_BYTES, excluded: tuple[str, ...] = fixed.EXCLUDED_COMMANDS) -> Column:
    """What a request meets first: rejected (too large), bypassed (excluded command) or accepted."""
    first = F.split(F.ltrim(F.coalesce(command, F.lit(""))), r"\s+")[0]
    return F.when(F.octet_length(text) > max_bytes, "rejected").when(first.isin(*excluded), "bypassed").otherwise("accepted")


def capped(text: Column, most: int = fixed.HARD_CAP_BYTES) -> Column:
    """The text's first bytes up to the cap, without a character that the cap would cut."""
    data = F.encode(text, "UTF-8")
    goes_on = lambda k: F.hex(F.substring(data, most + 1 - k, 1)).rlike("^[89AB]")
    end = F.when(~goes_on(0), most).when(~goes_on(1), most - 1).when(~goes_on(2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) > most, F.substring(data, F.lit(1), end).cast("string")).otherwise(text)
