"""Sequential line operators as plain functions on lists of lines, one document at a time.

They are the exact form of what greedy choices make sequential; operators.arrow runs them inside Arrow UDFs, a document a
value, so no shuffle is needed. Window forms of the others are in operators.windows."""

from __future__ import annotations

import re
from collections.abc import Callable

from tersely.functions import fixed

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def lines(text: str) -> list[str]:
    """Lines of a text; a final line end starts no line, and takes one carriage return with it."""
    if not text:
        return []
    out = text.split("\n")
    last = out.pop()
    out = [x[:-1] if x.endswith("\r") else x for x in out]
    return out + [last] if last else out


def blank(line: str) -> bool:
    return not line.strip(WHITE)


def marker(line: str) -> bool:
    return line.startswith(fixed.MARKER_STARTS) or fixed.MARKER_PART in line


def python_steps(steps: tuple) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", r)) for p, r in steps]


TEMPLATE, OPAQUE = python_steps(fixed.TEMPLATE_STEPS), python_steps(fixed.OPAQUE_STEPS)
ERROR_SIGNAL = re.compile(fixed.ERROR_SIGNAL)


def replaced(text: str, steps: list[tuple[re.Pattern, str]]) -> str:
    for pattern, by in steps:
        text = pattern.sub(by, text)
    return text


#: What a line must hold for each template step to find anything, so that most lines meet few patterns.
DIGIT, DOTTED = re.compile(r"\d"), re.compile(r"\d\.\d")
HEX_RUN = re.compile("[0-9a-fA-F]{8}")


def template(line: str) -> str:
    """The line with its volatile parts replaced. A step is skipped where a cheaper test shows that it can't match."""
    digits, dotted, hexes = DIGIT.search(line), DOTTED.search(line), HEX_RUN.search(line)
    can = (digits, hexes and "-" in line, hexes, hexes or "<HEX>-" in line, dotted, dotted, digits, line.startswith("> Task :"))
    return replaced(line, [step for step, might in zip(TEMPLATE, can, strict=True) if might])


def error_signals(text: str) -> int:
    return sum(1 for _ in ERROR_SIGNAL.finditer(text))


ANSI = re.compile("\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\x1b[PX^_][^\x1b]*\x1b\\\\|\x1b\\[[0-?]*[ -/]*[@-~]|\x1b[ -/]*[0-~]")
CONTROLS = re.compile("[\x00-\x09\x0b-\x1f\x7f]")


def strip_ansi(text: str, keep_controls: bool = False) -> str:
    text = ANSI.sub("", text)
    return text if keep_controls else CONTROLS.sub("", text)


def progress(line: str) -> bool:
    t = line.lstrip("\r")
    if (not t and "\r" in line) or any(p in t for p in fixed.PROGRESS):
        return True
    inner = t.lstrip(WHITE)
    return t.startswith(" ") and len(t.encode()) >= 4 and inner.startswith(fixed.CARGO_VERBS) and (" v" in inner or " (" in inner)


WAVY = re.compile(r"[~^\s]*[~^][~^\s]*[~^][~^\s]*[~^][~^\s]*")
DIFF_META = re.compile(r"index (?=.{0,18}\.\.)|--- (?:a/|/dev/null$)|\+\+\+ (?:b/|/dev/null$)")


def noise(line: str) -> bool:
    return bool(WAVY.fullmatch(line) or DIFF_META.match(line))


def runs(keys: list) -> list[tuple[int, int]]:
    """Starts and ends of maximal runs of equal neighbours; None equals nothing."""
    cuts = [i for i in range(len(keys)) if i == 0 or keys[i] is None or keys[i] != keys[i - 1]]
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True)) if cuts else []


def template_dedup(rows: list[str]) -> list[str]:
    """Runs of lines of one template as their first line with a count. A marker only starts no run; blank lines end one."""
    keys: list = []
    for row in rows:
        keys.append(None if blank(row) else template(row))
    out, i, n = [], 0, len(rows)
    while i < n:
        if keys[i] is None or marker(rows[i]):
            out.append(rows[i])
            i += 1
            continue
        end = next((j for j in range(i + 1, n) if keys[j] is None or keys[j] != keys[i]), n)
        out.append(f"{fixed.RUN_MARK}{end - i}] {rows[i]}" if end - i > 1 else rows[i])
        i = end
    return out


def framework_frame(line: str) -> bool:
    t = line.lstrip(WHITE)

    def fits(starts: tuple, parts: tuple) -> bool:
        return (not starts or t.startswith(starts)) and (not parts or any(p in t for p in parts))

    families = fixed.FRAME_FAMILIES if not t.startswith(fixed.USER_FRAMES) else fixed.BEFORE_USER_FRAMES
    return any(fits(starts, parts) for _, starts, parts in families) or (".rb:" in t and any(p in t for p in fixed.RUBY_PARTS))


def frame_unit(rows: list[str], i: int) -> int:
    """Lines of the framework frame that starts here: 0 if none does."""
    if i >= len(rows) or not framework_frame(rows[i]):
        return 0
    t, following = rows[i].lstrip(WHITE), rows[i + 1] if i + 1 < len(rows) else ""
    body = following.lstrip(WHITE)
    if t.startswith('File "') and following.startswith("    ") and body and not body.startswith(('File "', "at ", "from ")):
        return 2
    return 2 if t.startswith("runtime.") and following.startswith("\t") and ".go:" in body else 1


def collapse_frames(rows: list[str]) -> list[str]:
    """Runs of three framework frames or more as the first, then how many were left out."""
    if len(rows) < 3:
        return rows
    out, i = [], 0
    while i < len(rows):
        ends = [i]
        while size := frame_unit(rows, ends[-1]):
            ends.append(ends[-1] + size)
        units = len(ends) - 1
        if units >= fixed.FRAME_RUN:
            indent = rows[i][: len(rows[i]) - len(rows[i].lstrip(WHITE))]
            out += [*rows[i : ends[1]], f"{indent}... {units - 1} {fixed.OMITTED}"]
        else:
            out += rows[i : max(ends[-1], i + 1)]
        i = max(ends[-1], i + 1)
    return out


def collapse_blanks(rows: list[str]) -> list[str]:
    """The first of each run of blank lines; none at the end."""
    kept = [r for i, r in enumerate(rows) if not (blank(r) and i and blank(rows[i - 1]))]
    while kept and blank(kept[-1]):
        kept.pop()
    return kept


def block_dedup(rows: list[str]) -> list[str]:
    """Blocks of 2 to 50 lines that follow one another three times or more, as one and a count.

    For each size, how far every place equals the place one size on gives the number of blocks that start there."""
    low, high = fixed.BLOCK_SIZES
    n = len(rows)
    if n < low * fixed.BLOCK_RUN:
        return rows
    keys = [template(r) for r in rows]
    barrier = [marker(r) for r in rows]
    clear = [0] * (n + 1)  # lines from here without a marker
    for i in range(n - 1, -1, -1):
        clear[i] = 0 if barrier[i] else clear[i + 1] + 1
    same = {}
    for size in range(low, min(high, n) + 1):
        reach = [0] * (n + 1)
        for i in range(n - size - 1, -1, -1):
            reach[i] = reach[i + 1] + 1 if keys[i] == keys[i + size] else 0
        if max(reach) >= (fixed.BLOCK_RUN - 1) * size:
            same[size] = reach
    out, i = [], 0
    while i < n:
        best = (0, 0, 0)
        for size, reach in same.items():
            if size > clear[i]:
                break
            count = 1 + reach[i] // size
            if count >= fixed.BLOCK_RUN and (count - 1) * size - 1 > best[0]:
                best = ((count - 1) * size - 1, size, count)
        _, size, count = best
        if size:
            out += [*rows[i : i + size], f"{fixed.BLOCK_HEADER}{count - 1} more {size}-line block(s) omitted ──"]
            i += size * count
        else:
            out.append(rows[i])
            i += 1
    return out


def shared(a: str, b: str) -> int:
    """Characters of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def clusters(rows: list[str]) -> list[str]:
    """Prefixes worth a header, longest first. In sorted order the prefix of a window is the least of its neighbours' prefixes."""
    usable = sorted(r for r in rows if not blank(r) and not marker(r))
    found: list[str] = []
    width = fixed.CLUSTER_LINES
    while len(found) < fixed.CLUSTERS and len(usable) >= width:
        near = [shared(a, b) for a, b in zip(usable, usable[1:], strict=False)]
        best, gain = "", 0
        for i in range(len(usable) - width + 1):
            k = min(near[i : i + width - 1])
            prefix = usable[i][:k]
            size = len(prefix.encode())
            if size < fixed.CLUSTER_BYTES:
                continue
            end = i + width
            while end < len(usable) and near[end - 1] >= k:
                end += 1
            saved = size * (end - i)
            if saved > size + fixed.CLUSTER_OVERHEAD and saved > gain:
                best, gain = prefix, saved
        if not best:
            break
        found.append(best)
        usable = [u for u in usable if not u.startswith(best)]
    return sorted(found, key=lambda p: -len(p.encode()))


def factored(rows: list[str], found: list[str], matches: Callable, header: str, mark: str, rest: Callable) -> list[str]:
    out, told = [], set()
    for row in rows:
        own = None if marker(row) else next((c for c in found if matches(row, c)), None)
        if own is None:
            out.append(row)
            continue
        if own not in told:
            told.add(own)
            out.append(f"{header} {own} ──")
        out.append(mark + rest(row, own))
    return out


def factor_prefix(rows: list[str]) -> list[str]:
    """Lines that share long prefixes under a header with the prefix."""
    found = clusters(rows)
    return factored(rows, found, str.startswith, fixed.PREFIX_HEADER, fixed.PREFIX_ROW, lambda r, c: r[len(c) :]) if found else rows


def factor_suffix(rows: list[str]) -> list[str]:
    """The same for suffixes: on the lines read backwards."""
    found = [c[::-1] for c in clusters([r[::-1] for r in rows if not marker(r)])]
    return factored(rows, found, str.endswith, fixed.SUFFIX_HEADER, fixed.SUFFIX_ROW, lambda r, c: r[: len(r) - len(c)]) if found else rows


def passing_test(line: str) -> bool:
    t = line.strip(WHITE)
    return t.startswith("test ") and t.endswith((" ... ok", " ... ignored"))


#: What a text must hold for each opaque step, likewise; a run of 32 of these characters is in every long hash and in all base64.
LONG_RUN = re.compile("[A-Za-z0-9+/]{32}")


def opaque(text: str) -> str:
    runs_long = LONG_RUN.search(text)
    can = ("eyJ" in text, runs_long, "?" in text, runs_long)
    return replaced(text, [step for step, might in zip(OPAQUE, can, strict=True) if might])


PATH_TOKEN = re.compile(r"[^\s,()'\"]+")
POSITION = re.compile(r"(?::[0-9]+)*\Z")


def short_path(token: str) -> str:
    cut = POSITION.search(token).start()
    pieces = re.split(r"[/\\]", token[:cut])
    named = [p for p in pieces if p]
    return f"{named[-2]}/{named[-1]}{token[cut:]}" if len(pieces) > 2 and len(named) > 1 else token


def shorten_paths(text: str) -> str:
    out = "\n".join(PATH_TOKEN.sub(lambda m: short_path(m[0]), row) if row.count("/") + row.count("\\") > 1 else row for row in lines(text))
    return out + "\n" if text.endswith("\n") else out


WHITESPACE = [(re.compile(r"^( {4}) +"), r"\1"), (re.compile(r"([^ ]) {3,}"), r"\1  "), (re.compile(r"[ \t]+\Z"), "")]


def tidy_whitespace(text: str) -> str:
    return "\n".join(replaced(row, WHITESPACE) if "   " in row else row.rstrip(" \t") for row in lines(text))


def line_prefix(line: str) -> str:
    for mark in (": ", "= ", "\t"):
        if (at := line.find(mark)) >= 0:
            return line[: at + len(mark)]
    return ""


def merge_prefixes(text: str) -> str:
    """Neighbouring lines of one prefix as the prefix and the rests, joined by commas."""
    rows = lines(text)
    keys = [p if len((p := line_prefix(r)).encode()) >= 4 else None for r in rows]
    return "\n".join(rows[a] if b - a == 1 else keys[a] + ", ".join(r[len(keys[a]) :] for r in rows[a:b]) for a, b in runs(keys))


def layer1(text: str, keep_controls: bool = False) -> tuple[str, bool, int, list[str]]:
    """All line operators in their order: text, whether it had been filtered before, lines removed, steps that did something."""
    text = text.encode()[: fixed.HARD_CAP_BYTES].decode(errors="ignore") if len(text.encode()) > fixed.HARD_CAP_BYTES else text
    clean = strip_ansi(text, keep_controls)
    steps = [f"ansi_strip({len(text) - len(clean)} chars)"] if len(clean) < len(text) else []
    if before := fixed.RUN_MARK in clean:
        steps.append("rtk_pre_filtered")
    start = rows = lines(clean)

    def note(name: str, after: list[str], amount: str, fired: bool) -> list[str]:
        if fired:
            steps.append(f"{name}({amount})" if amount else name)
        return lines("\n".join(after))

    kept = [r for r in rows if not progress(r)]
    rows = note("progress_removed", kept, f"{len(rows) - len(kept)} lines", len(kept) < len(rows))
    quiet = [r for r in rows if not noise(r)]
    marks = sum(r.startswith(fixed.RUN_MARK) for r in rows)
    rows = note("diagnostic_noise", quiet, f"{len(rows) - len(quiet)} lines", len(quiet) < len(rows))
    grouped = template_dedup(rows)
    groups = max(0, sum(r.startswith(fixed.RUN_MARK) for r in grouped) - marks)
    rows = note("template_dedup", grouped, f"{groups} groups", groups > 0)
    framed = collapse_frames(rows)
    omitted = sum(fixed.OMITTED in r for r in framed) - sum(fixed.OMITTED in r for r in rows)
    rows = note("stack_trace_collapse", framed, f"{omitted} runs", framed != rows)
    body = "\n".join(rows)
    failing = [r for r in rows if not passing_test(r)] if "test result:" in body or "FAILED" in body else rows
    rows = note("test_failure_extracted", failing, f"{len(rows) - len(failing)} lines", len(failing) < len(rows))
    dense = collapse_blanks(rows)
    rows = note("blank_lines_collapsed", dense, str(len(rows) - len(dense)), len(dense) < len(rows))
    blocks = block_dedup(rows)
    repeated = sum(r.startswith(fixed.BLOCK_HEADER) for r in blocks) - sum(r.startswith(fixed.BLOCK_HEADER) for r in rows)
    rows = note("block_dedup", blocks, f"{repeated} runs", blocks != rows)
    for name, step in (("common_suffix_factored", factor_suffix), ("common_prefix_factored", factor_prefix)):
        after = step(rows)
        rows = note(name, after, "", after != rows)
    return "\n".join(rows), before, max(0, len(start) - len(rows)), steps


def layer2(text: str) -> tuple[str, list[str]]:
    """Token-aware rewriting, and the steps that changed the text."""
    steps = []
    for name, step in (("opaque_normalized", opaque), ("paths_shortened", shorten_paths), ("whitespace_collapsed", tidy_whitespace), ("prefixes_consolidated", merge_prefixes)):
        after = step(text)
        if after != text:
            steps.append(name)
        text = after
    return text, steps


def strip_prose(text: str) -> str:
    """Without comment-like lines at the end; a text of nothing else stays, trimmed."""
    rows = lines(text)

    def prose(row: str) -> bool:
        t = row.strip(WHITE).lower()
        return t.startswith(fixed.PROSE_STARTS) or any(p in t for p in fixed.PROSE_PARTS)

    real = [i for i, r in enumerate(rows) if not blank(r) and not prose(r)]
    return "\n".join(rows[: real[-1] + 1]) if real else text.strip(WHITE)
