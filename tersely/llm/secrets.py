"""Secret scans by assignment-aware lexing.

Three base patterns (assign, access, hex) give spans. Beyond them, source and configuration syntax is lexed into
name-literal pairs: assignments (of several targets, too) and typed declarations, keyword arguments, entries of maps, calls
that set a named entry, elements and key-value attributes, unquoted values and block scalars of configuration files. Of a
value, the string literals count (plain, tripled, formatted, side by side or joined by operators, arguments of calls but for
what names a variable or an entry to look up), and the names in it are references, wherever in the text they are set.

Names and references are a graph. Its strongly connected components are condensed and summed up in order, each once,
so rings, chains of any length and names that are set very often take time in proportion to the text. A pair is scored by how
sensitive its target name is and by how much its literals and those it refers to look like key material; a pair that
scores at least `MIN_SCORE` adds spans of kind `lexed`, of its own literals and of all it refers to, unless a single base span
covers them. A bare word that refers to a name is no literal. Comments are lexed as code.

Null text counts as empty, a null doc_id is carried along, repeated rows give repeated results, an empty table gives an
empty one, other columns are left alone. Texts are scanned whole, in one pass without a shuffle; nothing limits how long a
call, a line or a chain of names may be.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import column_bytes, id_text, per_batch, quoted

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as a scan meets it at its first character
KINDS = ("assign", "access", "hex", "lexed")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"

#: How sensitive a part of a target name is. Fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8,
    "authorization": 0.7, "auth": 0.6, "connectionstring": 0.7, "cookie": 0.6, "salt": 0.6, "key": 0.5,
}
#: Last parts of names that tell of a secret without holding it. Fixed values.
DESCRIBING = {"url", "uri", "endpoint", "name", "path", "file", "filename", "dir", "field", "header", "type", "length", "size", "policy", "hint", "label", "prefix", "expiry", "ttl", "format", "column"}
#: Values that stand for a secret but are none. Fixed values.
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "placeholder", "undefined", "redacted", "required", "optional", "string", "yourpassword"}
MIN_SCORE = 0.45

LITERAL = r'''[rbuf]{0,2}(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)'''
STRING = re.compile(LITERAL, re.A | re.S | re.I)
#: A target, its type where one is declared, and what sets it.
PAIR = re.compile(
    r"""(?<![\w.\-])(?:(?P<quote>["'`])(?P<key>[\w.\-]+)(?P=quote)\]?|(?P<name>[A-Za-z_][\w.\-]*+))(?:\x20*:\x20*[A-Za-z_][\w.<>\[\]|?]*+(?=\x20*=[^=>]))?[\x20\t]*+(?P<op>:=|=>|=(?![=>])|:(?!:))[\x20\t]*+""",
    re.A,
)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*+)[^<>]*+>(?P<value>[^<>\n]++)</(?P=name)>", re.A)
ATTRIBUTES = re.compile(r"""\b(?:key|name)=(["'])(?P<name>[\w.\-]+)\1\s++value=(["'])(?P<value>[^"'\n]+)\3""", re.A | re.I)
NAME = re.compile(r"[A-Za-z_][\w.]*+", re.A)
JOINS = re.compile(r"\s*+(?:\+|\.\.|\|\||\?\?|\bor\b)\s*+")
OPENED = re.compile(r"(?:await|new)\x20+")
#: An unquoted value ends its line, but for a comment, and its target begins it.
BARE = re.compile(r"(?P<value>[^\s\"'`,;(){}\[\]<>|&]++)[\x20\t]*+(?=\n|\r|\Z|#|//)")
BEGINS = re.compile(r"[\x20\t]*+(?:-\x20++|export\x20++|set\x20++|(?:#|//)\x20*+)?[\"']?")
BLOCK_HEAD = re.compile(r"[|>][+\-]?[\x20\t]*+\n(?P<indent>[\x20\t]++)")
BLOCK = re.compile(r"[|>][+\-]?[\x20\t]*+\n(?P<lines>(?P<indent>[\x20\t]++)[^\n]*+(?:\n(?P=indent)[^\n]*+)*+)")
FIELDS = re.compile(r"\{([A-Za-z_][\w.]*+)[^{}]*+\}", re.A)
TOKEN = re.compile(LITERAL + r"|[()\[\]{}]", re.A | re.S | re.I)
BESIDE = re.compile(r"[\x20\t]++(?=[rbuf]{0,2}[\"'])", re.I)
#: Several targets at once, calls that set an entry, a shell's `set name value`.
TARGETS = re.compile(r"^[\x20\t]*+(?:(?:var|let|const|local)\x20++)?[\[(]?(?P<names>[A-Za-z_][\w.]*+(?:\x20*+,\x20*+[A-Za-z_][\w.]*+)++)[\])]?\x20++:?=\x20*+[\[(]?", re.A | re.M)
COMMA = re.compile(r"\s*+,\s*+")
SETTERS = re.compile(r"""\b(?:set|put|setenv|putenv|setproperty|setattribute|setdefault|setstring|setoption|define)\(\s*+(?:[A-Za-z_][\w.]*+\s*+,\s*+)?(["'])(?P<name>[\w.\-]+)\1\s*+,\s*+""", re.A | re.I)
SET_LINE = re.compile(r"^[\x20\t]*+(?:set|setenv)[\x20\t]++(?P<name>[A-Za-z_][\w.\-]*+)[\x20\t]++(?P<value>[^\s=:\"'][^\s\"']*+)[\x20\t]*+$", re.A | re.M)
#: Calls whose first argument names what is looked up. Fixed values.
GETTERS = {"getenv", "get", "env", "environ", "lookup", "getproperty", "getstring", "config", "var", "fetch"}
#: Words before a credential. Fixed values.
SCHEMES = {"bearer", "basic", "token", "digest"}
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """Of a target name: the highest weight of a part of it or of two neighbouring parts."""
    parts = [p.lower() for p in CAMEL.findall(name)]
    if parts and parts[-1] in DESCRIBING:
        return 0.0
    whole = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in whole), default=0.0)


def strength(value: str) -> float:
    """From 0 to 1, how much a literal looks like key material: its length, its kinds of characters, its entropy."""
    if len(parts := value.split()) > 1:  # of a phrase, the part that looks most like a key
        return max((strength(p) for p in parts if p.lower() not in SCHEMES), default=0.0)
    if len(value) < 6 or value != value.strip() or value.lower().strip("<>${}%_-") in PLACEHOLDERS or value[:2] in ("${", "{{", "<%") or len(set(value)) < 4:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * kinds + 0.1 * entropy + 0.01 * min(len(value), 40))


def inner(m: re.Match) -> tuple[int, int]:
    """Span of what stands in a literal's quotes."""
    whole = m.group()
    start = len(whole) - len(whole.lstrip("rbufRBUF"))
    quotes = 3 if whole[start : start + 3] in ('"""', "'''") and len(whole) >= start + 6 else 1
    return m.start() + start + quotes, m.end() - quotes


class Brackets:
    """Of a stretch of text, by one pass over it: where each bracket closes, which literals stand in it directly, and which
    brackets do. A bracket that nothing closes ends at the next one.

    A bracket within a literal is looked up in the literal's own text, which gets a pass of its own when first asked for."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.literals = text, []
        self.closed: dict[int, int] = {}
        self.direct: dict[int, list[tuple[int, int]]] = {}
        self.children: dict[int, list[int]] = {}
        self.inner: dict[int, Brackets] = {}
        open_: list[int] = []
        places: list[int] = []
        for m in TOKEN.finditer(text, start, end):
            c = text[m.start()] if m.end() - m.start() == 1 else '"'
            if c in "([{":
                if open_:
                    self.children[open_[-1]].append(m.start())
                open_.append(m.start())
                places.append(m.start())
                self.direct[m.start()], self.children[m.start()] = [], []
            elif c in ")]}":
                places.append(m.start())
                if open_:
                    self.closed[open_.pop()] = m.start()
            else:
                self.literals.append(m.span())
                if open_:
                    self.direct[open_[-1]].append(inner(m))
        for at in open_:
            i = bisect_right(places, at)
            self.closed[at] = stop = places[i] if i < len(places) else end
            self.direct[at], self.children[at] = [x for x in self.direct[at] if x[1] <= stop], []
        self.starts = [x[0] for x in self.literals]

    def find(self, at: int) -> tuple[Brackets, int] | None:
        """The pass that knows the bracket at this place, and where it closes."""
        if at in self.closed:
            return self, self.closed[at]
        i = bisect_right(self.starts, at) - 1
        if i < 0 or self.literals[i][1] <= at or self.literals[i][1] - self.literals[i][0] < 2:
            return None
        if i not in self.inner:
            m = STRING.fullmatch(self.text, *self.literals[i])
            self.inner[i] = Brackets(self.text, *inner(m))
        return self.inner[i].find(at)


#: Target, spans of literals, names referred to, calls (pass, bracket, whether its first literal only names something), whether the value may be one of its own.
Entry = tuple[str, list[tuple[int, int]], list[str], list[tuple[Brackets, int, bool]], bool]


class Lexer:
    """The pairs of a text: everything that is set."""

    def __init__(self, text: str):
        self.text, self.end, self.brackets = text, len(text), None
        self.pairs: list[Entry] = []
        many = {m.end(): m["names"] for m in TARGETS.finditer(text)}
        line, looked, fresh = 0, 0, True  # where the pair's line begins, up to where ends of lines were sought, whether no pair is before it in the line
        for m in PAIR.finditer(text):
            name, at = m["key"] or m["name"], m.end()
            if (last := text.rfind("\n", looked, m.start())) >= 0:
                line, fresh = last + 1, True
            looked = m.start()
            if at in many:
                continue
            spans, names, calls = self.value(at)
            bare = None
            if not spans and not calls and m["op"] in (":", "=") and fresh and BEGINS.fullmatch(text, line, m.start() + (1 if m["key"] else 0)):
                margin = len(text[line : m.start()]) - len(text[line : m.start()].lstrip(" \t"))
                if m["op"] == ":" and (head := BLOCK_HEAD.match(text, at)) and len(head["indent"]) > margin:
                    block = BLOCK.match(text, at)
                    start = block.start("lines")
                    spans = [(start + x.start(), start + x.end()) for x in re.finditer(r"[^\s][^\n]*", block["lines"])]
                elif bare := BARE.match(text, at):
                    spans = [bare.span("value")]
            fresh = False
            self.pairs.append((name, spans, names, calls, bool(bare)))
        for at, targets in many.items():
            for name in targets.split(","):
                self.pairs.append((name.strip(), *self.value(at), False))
                if not (comma := COMMA.match(text, self.at)):
                    break
                at = comma.end()
        for m in SETTERS.finditer(text):
            self.pairs.append((m["name"], *self.value(m.end()), False))
        for pattern in (ELEMENT, ATTRIBUTES, SET_LINE):
            self.pairs += [(m["name"], [m.span("value")], [], [], False) for m in pattern.finditer(text)]

    def bracket(self, at: int) -> tuple[list[tuple[Brackets, int]], int]:
        if self.brackets is None:
            self.brackets = Brackets(self.text, 0, self.end)
        found = self.brackets.find(at)
        return ([(found[0], at)], min(self.end, found[1] + 1)) if found else ([], at + 1)

    def value(self, at: int) -> tuple[list[tuple[int, int]], list[str], list[tuple[Brackets, int, bool]]]:
        """Literals, names and calls of the value that begins here; `self.at` is where it ends."""
        text, spans, names, calls = self.text, [], [], []
        self.at = at
        while True:
            if m := OPENED.match(text, at):
                at = m.end()
            if m := STRING.match(text, at):
                spans.append(inner(m))
                if m.group()[:2].lower().strip("\"'`rbu").startswith("f") or m.group()[0] == "`":
                    names += FIELDS.findall(m.group())
                self.at = at = m.end()
                if m := BESIDE.match(text, at):
                    at = m.end()
                    continue
            elif m := NAME.match(text, at):
                self.at = at = m.end()
                if text[at : at + 1] == "(":
                    own, self.at = self.bracket(at)
                    calls += [(b, p, m.group().rpartition(".")[2].lower() in GETTERS) for b, p in own]
                elif text[at : at + 1] == "[":  # an entry that is looked up
                    self.at = self.bracket(at)[1]
                else:
                    names.append(m.group())
                at = self.at
            else:
                return spans, names, calls
            if not (m := JOINS.match(text, at)):
                return spans, names, calls
            at = m.end()


class Summary:
    """What is known of literals taken together: how many spans, the only one, the strongest one's strength, and characters of
    those without white space. Sums count shared literals once on each way to them; only shares of characters matter."""

    __slots__ = ("n", "one", "best", "chars")

    def __init__(self):
        self.n, self.one, self.best = 0, None, 0.0
        self.chars: dict[int, float] = {}

    def add_literal(self, text: str, span: tuple[int, int]) -> None:
        value = text[span[0] : span[1]]
        self.n += 1
        self.one = span
        self.best = max(self.best, strength(value))
        if not any(map(str.isspace, value)):
            for c in value:
                b = ord(c) if c < "\x80" else 128 + ord(c) % 64
                self.chars[b] = self.chars.get(b, 0.0) + 1.0

    def add(self, other: Summary) -> None:
        if other.n and not (self.n == other.n == 1 and self.one == other.one):
            self.n += other.n
            self.one = other.one if self.n == 1 else None
            self.n = min(self.n, 2) if self.one is None else self.n
            self.best = max(self.best, other.best)
            for b, x in other.chars.items():
                self.chars[b] = self.chars.get(b, 0.0) + x
            if (total := sum(self.chars.values())) > 1e9:
                self.chars = {b: x * 1e6 / total for b, x in self.chars.items()}

    def strength(self) -> float:
        if self.n < 2 or self.one is not None:
            return self.best
        total = sum(self.chars.values())
        if total < 6 or len(self.chars) < 4:
            return self.best
        entropy = -sum(x / total * math.log2(x / total) for x in self.chars.values() if x > 0)
        kinds = len({0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 for b in self.chars})
        return max(self.best, min(1.0, 0.15 * kinds + 0.1 * entropy + 0.01 * min(total, 40)))


def components(edges: list[list[int]]) -> list[list[int]]:
    """Strongly connected components of a graph, each after all that it leads to."""
    n = len(edges)
    index, low, on, out, stack, count = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        todo = [(root, 0)]
        while todo:
            v, i = todo.pop()
            if i == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            for i in range(i, len(edges[v])):
                w = edges[v][i]
                if index[w] < 0:
                    todo += [(v, i + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                        on[own[-1]] = False
                    out.append(own)
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
    return out


class Graph:
    """Nodes are names and brackets; each has literals of its own and leads to others."""

    def __init__(self, pairs: list[Entry]):
        self.number: dict = {}
        self.literals: list[list[tuple[int, int]]] = []
        self.edges: list[list[int]] = []
        for name, *_ in pairs:
            self.node(name)
            self.node(name.rpartition(".")[2])
        names = len(self.edges)
        self.refs: list[list[int]] = []
        self.own: list[list[tuple[int, int]]] = []
        for name, spans, said, calls, bare in pairs:
            known = [r for n in said if (r := n if n in self.number else n.rpartition(".")[2]) in self.number]
            self.refs.append(list(dict.fromkeys([*(self.number[r] for r in known if r != name), *(self.node(c) for c in calls)])))
            self.own.append([] if bare and known else spans)
            for n in {name, name.rpartition(".")[2]}:
                self.literals[self.number[n]] += self.own[-1]
                self.edges[self.number[n]] += self.refs[-1]
        keys = list(self.number)
        at = names
        while at < len(keys):  # brackets within brackets are found as their holders are
            holder, place, looked_up = keys[at]
            self.literals[at] = holder.direct[place][1 if looked_up else 0 :]
            self.edges[at] = [self.node((holder, p, False)) for p in holder.children[place]]
            keys += list(self.number)[len(keys) :] if len(self.number) > len(keys) else []
            at += 1
        self.edges = [list(dict.fromkeys(e)) for e in self.edges]

    def node(self, key: object) -> int:
        if key not in self.number:
            self.number[key] = len(self.number)
            self.literals.append([])
            self.edges.append([])
        return self.number[key]


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that a sensitive name gets, directly or by constants."""
    pairs = Lexer(text).pairs
    weights = {name: sensitivity(name) for name, *_ in pairs}
    if not any(weights.values()):
        return []
    graph = Graph(pairs)
    groups = components(graph.edges)
    group_of = [0] * len(graph.edges)
    for g, members in enumerate(groups):
        for v in members:
            group_of[v] = g

    def summed(spans: list[tuple[int, int]], parts: list[int]) -> Summary:
        total = Summary()
        for span in dict.fromkeys(spans):
            total.add_literal(text, span)
        if total.n > 1:
            total.one = None
        for g in dict.fromkeys(parts):
            total.add(whole[g])
        return total

    whole: list[Summary] = []
    for g, members in enumerate(groups):
        children = [h for v in members for w in graph.edges[v] if (h := group_of[w]) != g]
        whole.append(summed([x for v in members for x in graph.literals[v]], children))

    found: set[tuple[int, int]] = set()
    reached: list[int] = []
    scores: dict[int, float] = {}
    for (name, *_), own, refs in zip(pairs, graph.own, graph.refs, strict=True):
        if not weights[name] or not (own or refs):
            continue
        if not refs:
            score = strength("".join(text[a:b] for a, b in own))
        elif own or len(refs) > 1:
            score = summed(own, [group_of[r] for r in refs]).strength()
        else:
            if (g := group_of[refs[0]]) not in scores:
                scores[g] = whole[g].strength()
            score = scores[g]
        if weights[name] * score >= MIN_SCORE:
            found.update(own)
            reached += refs
    seen = set(reached)
    reached = list(seen)
    while reached:  # all that these pairs refer to
        v = reached.pop()
        found.update(graph.literals[v])
        for w in graph.edges[v]:
            if w not in seen:
                seen.add(w)
                reached.append(w)
    return sorted((a, b) for a, b in found if b > a)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span in code points, ordered by start, then kind."""
    spans = []
    named = any(x in text for x in ("=", ":", "</", '("', "('", "\nset")) or text.startswith("set")
    if named:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if named:
        base = sorted(spans)
        starts, ends = [s for s, _, _ in base], list(accumulate((e for *_, e in base), max))
        spans += [(a, 3, b) for a, b in lexed(text) if not (i := bisect_right(starts, a)) or ends[i - 1] < b]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans as `kind:start:end`."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t.decode()) for t in column_bytes(batch, "text")]
        n = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in range(4)]
        sha = [hashlib.sha256(joined([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *n[:3], pa.array(sha, pa.string()), pa.array(map(joined, rows), pa.string()), n[3]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"],
        )

    return id_text(docs, id_col, text_col).mapInArrow(per_batch(lambda: step), SCHEMA)


def redacted(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in scan(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The table with secrets replaced in its texts (null stays null); `length_col` gets the new length, if named."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text_col)
        texts = [t if t is None else redacted(t) for t in batch.column(i).to_pylist()]
        return batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(per_batch(lambda: step), docs.schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(quoted(text_col)).cast(docs.schema[length_col].dataType))
    return out
