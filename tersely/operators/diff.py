"""Line diffs: a shortest edit script of two texts' lines, hunks with context, patches and their application.

The script is Myers' shortest path in the edit graph, in linear space: furthest points of the forward and the backward search
are kept by diagonal until they meet, and what lies before and behind the meeting point is solved in the same way. Lines that the
other side lacks can't be on any common path and are set aside first, so that only lines with a counterpart are searched.
A document pair is a row; rows need no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.operators import kernels

Op = tuple[str, int, int, int, int]
#: Sizes up to which diagonals are walked one by one; beyond, all diagonals of a step at once.
SMALL = 256


def walked(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """Where a shortest path has its middle: from (x, y) equal lines up to (u, v)."""
    n, m = len(a), len(b)
    delta, odd, most = n - m, (n - m) & 1, (n + m + 1) // 2
    front, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = front[k + 1] if k == -d or k != d and front[k - 1] < front[k + 1] else front[k - 1] + 1
            x0, y0 = x, x - k
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            front[k] = x
            if odd and abs(delta - k) < d and x + back[delta - k] >= n:
                return x0, y0, x, x - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            x0, y0 = x, x - k
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if not odd and abs(delta - k) <= d and x + front[delta - k] >= n:
                return n - x, m - x + k, n - x0, m - y0
    raise AssertionError("the searches meet at the latest after all steps")


def at_once(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """`walked` with all diagonals of a step in arrays; a place beyond the edges is kept and extends no more."""
    n, m = len(a), len(b)
    delta, odd, most = n - m, (n - m) & 1, (n + m + 1) // 2
    far = most + 2  # index of diagonal 0
    sides = [np.full(2 * far + 1, -1, dtype=np.int64) for _ in range(2)]
    sides[0][far + 1] = sides[1][far + 1] = 0
    given = ((a, b), (a[::-1], b[::-1]))
    for d in range(most + 1):
        k = np.arange(-d, d + 1, 2)
        for side, (left, right) in enumerate(given):
            own, other = sides[side], sides[1 - side]
            down, over = own[far + k + 1], own[far + k - 1] + 1
            x = np.where((k == -d) | ((k != d) & (over - 1 < down)), down, over)
            x0 = x.copy()
            live = np.flatnonzero((x < n) & (x - k < m) & (x >= k))
            while len(live):
                live = live[left[x[live]] == right[x[live] - k[live]]]
                x[live] += 1
                live = live[(x[live] < n) & (x[live] - k[live] < m)]
            own[far + k] = x
            if (side == 0) == bool(odd):
                across = delta - k
                reached = np.abs(across) <= (d - 1 if side == 0 else d)
                meets = np.flatnonzero(reached & (x + other[far + np.where(reached, across, 0)] >= n))
                if len(meets):
                    at = meets[0]
                    u, v, s, t = int(x0[at]), int(x0[at] - k[at]), int(x[at]), int(x[at] - k[at])
                    return (u, v, s, t) if side == 0 else (n - s, m - t, n - u, m - v)
    raise AssertionError("the searches meet at the latest after all steps")


def matches(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place in a, place in b, length) of the equal stretches of a shortest script, in order."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        if i < 0:  # a stretch that is done
            yield n, j, m
            continue
        x, y = a[i:n], b[j:m]
        size = min(len(x), len(y))
        unlike = np.flatnonzero(x[:size] != y[:size])
        head = int(unlike[0]) if len(unlike) else size
        if head:
            yield i, j, head
            i, j, x, y = i + head, j + head, x[head:], y[head:]
            size -= head
        unlike = np.flatnonzero(x[len(x) - size :][::-1] != y[len(y) - size :][::-1])
        tail = int(unlike[0]) if len(unlike) else size
        if tail:
            todo.append((-1, n - tail, m - tail, tail))
            n, m, x, y = n - tail, m - tail, x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y):
            continue
        u, v, s, t = walked(x.tolist(), y.tolist()) if len(x) + len(y) <= SMALL else at_once(x, y)
        todo.append((i + s, n, j + t, m))
        if s > u:
            todo.append((-1, i + u, j + v, s - u))
        todo.append((i, i + u, j, j + v))


def script(before: list[str], after: list[str]) -> list[Op]:
    """(tag, start and end before, start and end after): equal, delete and insert, deletions first where both meet."""
    number: dict[str, int] = {}
    a = np.array([number.setdefault(x, len(number)) for x in before], dtype=np.int64)
    b = np.array([number.setdefault(x, len(number)) for x in after], dtype=np.int64)
    at, bt = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    out: list[Op] = []
    i = j = 0

    def upto(x: int, y: int) -> None:
        if x > i:
            out.append(("delete", i, x, j, j))
        if y > j:
            out.append(("insert", x, x, j, y))

    pairs = [(p, q) for x, y, size in matches(a[at], b[bt]) for p, q in zip(at[x : x + size].tolist(), bt[y : y + size].tolist(), strict=True)]
    for p, q in pairs:
        upto(p, q)
        if p == i and q == j and out and out[-1][0] == "equal":
            _, s, _, t, _ = out.pop()
            out.append(("equal", s, p + 1, t, q + 1))
        else:
            out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    upto(len(a), len(b))
    return out


def hunks(ops: list[Op], context: int = 3) -> list[list[Op]]:
    """The changes with up to so many equal lines around them; changes that twice as many or fewer lines part share a hunk."""
    out: list[list[Op]] = [[]]
    for at, op in enumerate(ops):
        tag, i, n, j, m = op
        if tag != "equal":
            out[-1].append(op)
            continue
        head, tail = (context if at else 0), (context if at + 1 < len(ops) else 0)
        if n - i <= head + tail:
            out[-1].append(op)
            continue
        if head:
            out[-1].append((tag, i, i + head, j, j + head))
        out.append([(tag, n - tail, n, m - tail, m)] if tail else [])
    return [h for h in out if any(tag != "equal" for tag, *_ in h)]


def shown_range(start: int, size: int) -> str:
    """A hunk's place: counted from 1, an empty one as the line before it."""
    return f"{start + bool(size)},{size}" if size != 1 else f"{start + 1}"


def unified(before: list[str], after: list[str], context: int = 3) -> str:
    """A patch: hunks under `@@`, lines with ' ', '-' or '+'. No difference gives an empty text."""
    out = []
    for hunk in hunks(script(before, after), context):
        i, n, j, m = hunk[0][1], hunk[-1][2], hunk[0][3], hunk[-1][4]
        out.append(f"@@ -{shown_range(i, n - i)} +{shown_range(j, m - j)} @@")
        for tag, s, t, u, v in hunk:
            out += [" " + x for x in before[s:t]] if tag == "equal" else ["-" + x for x in before[s:t]] + ["+" + x for x in after[u:v]]
    return "\n".join(["--- before", "+++ after", *out]) if out else ""


def numbered(before: list[str], after: list[str], context: int = 3) -> str:
    """Hunks with both line numbers, parted by an ellipsis."""
    parts = []
    for hunk in hunks(script(before, after), context):
        rows = []
        for tag, s, t, u, v in hunk:
            if tag == "equal":
                rows += [f"{x + 1:>4} {y + 1:>4}    {before[x]}" for x, y in zip(range(s, t), range(u, v), strict=True)]
            else:
                rows += [f"{x + 1:>4}      -- {before[x]}" for x in range(s, t)] + [f"     {y + 1:>4} ++ {after[y]}" for y in range(u, v)]
        parts.append("\n".join(rows))
    return "\n  …\n".join(parts)


PLACE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def applied(before: list[str], patch: str) -> list[str]:
    """The lines that a patch of `unified` makes of a text's lines. ValueError where it doesn't fit them."""
    out, at, rows = [], 0, patch.split("\n")[2:] if patch else []
    left = (0, 0)
    for row in rows:
        if left == (0, 0):
            if not (m := PLACE.fullmatch(row)):
                raise ValueError(f"no hunk begins with {row!r}")
            old = int(m[2] or 1)
            start = int(m[1]) - bool(old)
            out += before[at:start]
            at, left = start, (old, int(m[4] or 1))
            continue
        if row[:1] in (" ", "-"):
            if at >= len(before) or before[at] != row[1:]:
                raise ValueError(f"line {at + 1} is not {row[1:]!r}")
            at += 1
        if row[:1] in (" ", "+"):
            out.append(row[1:])
        left = (left[0] - (row[:1] != "+"), left[1] - (row[:1] != "-"))
    return out + before[at:]


ROWS = "array<struct<hunk:int,tag:string,old:int,new:int,line:string>>"


def diff_rows(before: Column, after: Column, context: int = 3) -> Column:
    """The hunks' lines as rows: hunk, tag (equal, delete, insert), line numbers (null where a side lacks the line), line.

    A null text has no lines."""

    @F.pandas_udf(ROWS)
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: str | None, y: str | None) -> list:
            a, b = kernels.lines(x or ""), kernels.lines(y or "")
            out = []
            for number, hunk in enumerate(hunks(script(a, b), context)):
                for tag, s, t, u, v in hunk:
                    places = zip(range(s, t), range(u, v), strict=True) if tag == "equal" else [(p, None) for p in range(s, t)] + [(None, p) for p in range(u, v)]
                    out += [(number, tag, None if p is None else p + 1, None if q is None else q + 1, b[q] if p is None else a[p]) for p, q in places]
            return out

        return pd.Series([[dict(zip(("hunk", "tag", "old", "new", "line"), r, strict=True)) for r in one(x, y)] for x, y in zip(left, right, strict=True)], dtype=object)

    return run(before, after)


def on_pairs(step):
    @F.pandas_udf("string")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([step(x or "", y or "") for x, y in zip(left, right, strict=True)], dtype=object)

    return run


def line_diff(before: Column, after: Column, context: int = 3) -> Column:
    """The patch from one text to the other, by lines; a null text has none."""
    return on_pairs(lambda x, y: unified(kernels.lines(x), kernels.lines(y), context))(before, after)


def numbered_diff(before: Column, after: Column, context: int = 3) -> Column:
    """The differences with line numbers, to be read."""
    return on_pairs(lambda x, y: numbered(kernels.lines(x), kernels.lines(y), context))(before, after)


def patched(before: Column, patch: Column) -> Column:
    """The text that a patch makes of another, lines joined."""
    return on_pairs(lambda x, p: "\n".join(applied(kernels.lines(x), p)))(before, patch)
