"""SQL (DuckDB's dialect) for the queries of plans.queries, over the same tables."""

from __future__ import annotations

from tersely.functions import fixed


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def replaced(column: str, steps: tuple) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, {literal(pattern)}, {literal(by.replace('$', chr(92)))}, 'g')"
    return column


def kinds(mapping: dict[str, str], otherwise: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items()) + f" ELSE {literal(otherwise)} END"


def split(text: str) -> str:
    return rf"CASE WHEN {text} = '' THEN [] ELSE regexp_split_to_array(regexp_replace({text}, '\r?\n$', ''), '\r?\n') END"


PLAIN = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || upper(event_type) || ' user=' || user_id || ' v=' || floor(value)::BIGINT"
DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents)"


def event_lines(line: str = PLAIN) -> str:
    return f"lines AS (SELECT user_id AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS n, {line} AS line FROM events)"


def text_lines(text: str = "text", docs: str = DOCS) -> str:
    return f"{docs}, arrays AS (SELECT doc_id, {split(text)} AS a FROM docs), lines AS (SELECT doc_id, (unnest(range(len(a)))) ::INT AS n, unnest(a) AS line FROM arrays)"


BLANK = r"regexp_matches(line, '^\s*$')"
MARKER = "(" + " OR ".join(f"starts_with(line, {literal(m)})" for m in fixed.MARKER_STARTS) + f" OR contains(line, {literal(fixed.MARKER_PART)}))"


def runs(key: str, alone: str) -> str:
    """Numbers runs of neighbours of one key."""
    return f"""keyed AS (SELECT *, {key} AS k, {alone} AS alone FROM lines),
starts AS (SELECT *, alone OR coalesce(lag(alone) OVER w, true) OR lag(k) OVER w IS DISTINCT FROM k AS s FROM keyed WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
numbered AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM starts)"""


def dedup(lines: str) -> str:
    return f"WITH {lines}, {runs(replaced('line', fixed.TEMPLATE_STEPS), f'({BLANK} OR {MARKER})')}, grouped AS (SELECT doc_id, min(n) AS n, arg_min(line, n) AS first, count(*) AS c FROM numbered GROUP BY doc_id, run)"


ASSEMBLED = "SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM {} GROUP BY doc_id"

RECORDS = """base AS (SELECT o_orderkey AS id, 'cmd' || (o_custkey % 12) || ' ' || o_orderstatus AS command, ['test','build','log','diff','generic'][(o_orderkey % 5 + 1)::INT] AS output_type,
  CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE floor(o_totalprice / 100)::BIGINT END AS original_tokens, (o_orderkey % 4)::INT AS layer_used, o_custkey % 700 AS latency_ms, o_orderkey % 7 = 0 AS pre_filtered, o_orderdate AS created_at FROM orders),
records AS (SELECT *, floor(original_tokens * (id % 11) / 8)::BIGINT AS compressed_tokens, CASE WHEN id % 3 <> 0 THEN floor(original_tokens * 9 / 10)::BIGINT END AS tokens_after_l1,
  CASE WHEN id % 3 <> 0 THEN floor(original_tokens * 8 / 10)::BIGINT END AS tokens_after_l2 FROM base)"""
RATIO = "CASE WHEN original_tokens = 0 THEN 0.0 ELSE greatest(original_tokens - compressed_tokens, 0) / original_tokens::DOUBLE END"
KEY = "sha256(doc_id || ':' || text || chr(31) || 'generic' || chr(31) || 'm' || chr(31) || '')"
CACHE = f"{DOCS}, cache AS (SELECT {KEY} AS hash, 'out ' || doc_id AS output, TIMESTAMP '2001-08-01' - to_days((doc_id % 14)::INT) AS created_at FROM docs)"
RATIOS = f"{RECORDS}, ratios AS (SELECT 's' || (id % 40) AS stem, round(avg({RATIO}), 9) AS ratio FROM records GROUP BY 1)"
META = "meta AS (SELECT 's' || p AS stem, 'c' || (p % 4) AS category, (p % 10) / 10.0::DOUBLE AS min_ratio, (p % 4)::INT AS expected_layer FROM range(40) t(p) WHERE p % 6 <> 0)"
RUNS = f"{RECORDS}, runs AS (SELECT ['prefix','xml','goal','json'][(id % 4 + 1)::INT] AS format, 's' || (id % 9) AS stem, id // 8 % 2 = 0 AS context, round({RATIO}, 6) AS ratio, layer_used, CASE WHEN id % 50 = 0 THEN 'timeout' END AS error FROM records)"
TURNS = """turns AS (SELECT conv_id AS session, turn AS place, role, length(text)::BIGINT AS input_tokens, CASE WHEN turn % 3 = 0 THEN length(text) * 2 END AS cache_creation_tokens, length(text) * 3 AS cache_read_tokens, length(text) // 2 AS output_tokens FROM conversations)"""
USAGE = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")
MESSAGES = r"""told AS (SELECT conv_id AS session, turn AS n, role, text, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS turns_ago FROM conversations),
cut AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM told WHERE role = 'user'),
messages AS (SELECT session, turns_ago, CASE WHEN length(t) > 500 THEN t[:500] || '...' ELSE t END AS intent, row_number() OVER (PARTITION BY session ORDER BY n DESC) - 1 AS age FROM cut WHERE t <> '')"""


def contains(*parts: str) -> str:
    return "(" + " AND ".join(f"contains(text, {literal(p)})" for p in parts) + ")"


LOG = r"""(len(a) > 3 AND (len(list_filter(a, lambda x: regexp_matches(ltrim(x), '^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}'))) * 10 > len(a) * 3
  OR len(list_filter(a, lambda x: regexp_matches(ltrim(x), '^(\[(INFO|ERROR|WARN|DEBUG)\]|(INFO|ERROR|WARN|DEBUG) )'))) * 10 > len(a) * 3))"""
DIFF = "(starts_with(text, 'diff --git') OR starts_with(text, '--- ') OR starts_with(text, '+++ ') OR len(list_filter(a, lambda x: starts_with(x, '@@ '))) >= 2)"
TEST = " OR ".join([contains("test result:"), contains("running 0 tests"), contains("FAILED", "passed"), contains("FAILED", "failed"), contains("✓", "✗"), contains("PASS", "FAIL", "Tests:"), contains("passed", "failed", "==="), contains("passed", "failed", "Playwright")])
BUILD = " OR ".join([*(contains(p) for p in ("error[E", "error TS", "warning TS", "warning[", "Compiling ", "Building ", "eslint", "Creating an optimized production build", "Route (app)")), contains("error", "warning", "problem")])


def folded(hit: str, least: int, summary: str, last: bool) -> str:
    """Runs of lines that hit, as text."""
    return f"""hits AS (SELECT *, {hit} AS hit FROM lines),
starts AS (SELECT *, NOT hit OR NOT coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY n), false) AS s FROM hits),
numbered AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM starts),
grouped AS (SELECT doc_id, min(n) AS n, count(*) AS c, bool_and(hit) AS hit, arg_min(line, n) AS first, arg_max(line, n) AS last, string_agg(line, chr(10) ORDER BY n) AS body FROM numbered GROUP BY doc_id, run),
shown AS (SELECT doc_id, n, CASE WHEN hit AND c >= {least} THEN first || chr(10) || {summary}{" || chr(10) || last" if last else ""} ELSE body END AS line FROM grouped)
{ASSEMBLED.format("shown")}"""


def blocks(lines: str, docs: str) -> str:
    """Repeated blocks. For each size, a place reaches as far as lines equal those one size on; a walk from line 0 takes the best size each time."""
    low, high = fixed.BLOCK_SIZES
    return f"""WITH RECURSIVE {lines}, keyed AS (SELECT *, {replaced("line", fixed.TEMPLATE_STEPS)} AS k, count(*) OVER (PARTITION BY doc_id) AS total,
  coalesce(min(CASE WHEN {MARKER} THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY doc_id)) - n AS clear FROM lines),
pairs AS (SELECT a.doc_id, a.n, a.clear, a.total, s.size, b.k IS NOT DISTINCT FROM a.k AND b.n IS NOT NULL AS same FROM keyed a CROSS JOIN (SELECT unnest(range({low}, {high + 1})) AS size) s LEFT JOIN keyed b ON b.doc_id = a.doc_id AND b.n = a.n + s.size),
reached AS (SELECT *, min(CASE WHEN NOT same THEN n END) OVER (PARTITION BY doc_id, size ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - n AS reach FROM pairs),
fits AS (SELECT doc_id, n, size, 1 + reach // size AS c FROM reached WHERE size <= clear AND reach // size >= {fixed.BLOCK_RUN - 1}),
best AS (SELECT * FROM fits WHERE (c - 1) * size - 1 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY (c - 1) * size DESC, size) = 1),
steps AS (SELECT l.doc_id, l.n, b.size, b.c, l.n + coalesce(b.size * b.c, 1) AS next FROM lines l LEFT JOIN best b USING (doc_id, n)),
walk AS (SELECT * FROM steps WHERE n = 0 UNION ALL SELECT s.* FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.n = w.next),
shown AS (SELECT w.doc_id, l.n * 2 AS n, l.line FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n >= w.n AND l.n < w.n + coalesce(w.size, 1)
  UNION ALL SELECT doc_id, (n + size - 1) * 2 + 1, {literal(fixed.BLOCK_HEADER)} || (c - 1) || ' more ' || size || '-line block(s) omitted ──' FROM walk WHERE size IS NOT NULL),
texts AS ({ASSEMBLED.format("shown")}) SELECT d.doc_id, coalesce(t.text, '') AS text FROM {docs} d LEFT JOIN texts t USING (doc_id)"""


def factored(reverse: bool) -> str:
    """Lines under headers with the prefixes (or suffixes, on reversed lines) that a round each picks, and its lines leave the next round."""
    turned = "reverse({})" if reverse else "{}"
    header, row = (fixed.SUFFIX_HEADER, fixed.SUFFIX_ROW) if reverse else (fixed.PREFIX_HEADER, fixed.PREFIX_ROW)
    width = fixed.CLUSTER_LINES - 1
    rounds = [f"u0 AS MATERIALIZED (SELECT doc_id, n, {turned.format('line')} AS line FROM lines WHERE NOT {BLANK} AND NOT {MARKER})"]
    for i in range(fixed.CLUSTERS):
        rounds.append(f"""p{i} AS MATERIALIZED (SELECT *, row_number() OVER w AS pos, lead(line, {width}) OVER w AS last FROM u{i} WINDOW w AS (PARTITION BY doc_id ORDER BY line, n)),
m{i} AS (SELECT doc_id, pos, line[:len(list_filter(range(1, least(length(line), length(last)) + 1), lambda i: line[:i] = last[:i]))] AS prefix FROM p{i} WHERE last IS NOT NULL),
s{i} AS (SELECT doc_id, prefix, min(pos) AS pos FROM m{i} WHERE strlen(prefix) >= {fixed.CLUSTER_BYTES} GROUP BY doc_id, prefix),
v{i} AS (SELECT s.doc_id, s.prefix, s.pos, strlen(s.prefix) * count(*) AS saved FROM s{i} s JOIN p{i} p ON p.doc_id = s.doc_id AND p.pos >= s.pos AND starts_with(p.line, s.prefix) GROUP BY s.doc_id, s.prefix, s.pos),
c{i} AS MATERIALIZED (SELECT doc_id, prefix, {i} AS round FROM v{i} WHERE saved > strlen(prefix) + {fixed.CLUSTER_OVERHEAD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved DESC, pos) = 1),
u{i + 1} AS MATERIALIZED (SELECT u.doc_id, u.n, u.line FROM u{i} u JOIN c{i} c ON u.doc_id = c.doc_id WHERE NOT starts_with(u.line, c.prefix))""")
    found = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(fixed.CLUSTERS))
    whole = "reverse(prefix)" if reverse else "prefix"
    rest = f"reverse(substr({turned.format('line')}, length(prefix) + 1))" if reverse else "substr(line, length(prefix) + 1)"
    return f"""WITH {event_lines()}, {", ".join(rounds)}, found AS ({found}),
own AS (SELECT l.doc_id, l.n, l.line, f.prefix FROM lines l LEFT JOIN found f ON l.doc_id = f.doc_id AND NOT {MARKER} AND starts_with({turned.format("l.line")}, f.prefix)
  QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.n ORDER BY strlen(f.prefix) DESC, f.round) = 1),
told AS (SELECT *, row_number() OVER (PARTITION BY doc_id, prefix ORDER BY n) = 1 AS leads FROM own),
shown AS (SELECT doc_id, n, CASE WHEN prefix IS NULL THEN line ELSE CASE WHEN leads THEN {literal(header + " ")} || {whole} || {literal(" ──")} || chr(10) ELSE '' END || {literal(row)} || {rest} END AS line FROM told)
{ASSEMBLED.format("shown")}"""


def rules_fold() -> str:
    """Frame runs, then runs of equal lines; the other rules find nothing in these lines, of which a document begins with two kinds at least."""
    from tersely.plans import queries as q

    signals = lambda t: f"len(regexp_extract_all({t}, {literal(fixed.ERROR_SIGNAL)}))"
    frames = folded("starts_with(ltrim(line), 'at org.springframework.')", 2, "'... [' || (c - 2) || ' frames omitted]'", True)
    return f"""WITH {event_lines(kinds(q.STACK, "ValueError: x"))}, before AS ({ASSEMBLED.format("lines")}),
{frames.split(ASSEMBLED.format("shown"))[0]}, framed AS ({ASSEMBLED.format("shown")}),
one AS (SELECT doc_id, b.text <> f.text AND {signals("f.text")} >= {signals("b.text")} AS fired, {signals("f.text")} < {signals("b.text")} AS lost, CASE WHEN lost THEN b.text ELSE f.text END AS text FROM before b JOIN framed f USING (doc_id)),
again AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM one),
keyed2 AS (SELECT *, regexp_replace(line, '[0-9]+', '§', 'g') AS k FROM again),
starts2 AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY n) <> k, true) AS s FROM keyed2),
numbered2 AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM starts2),
grouped2 AS (SELECT doc_id, min(n) AS n, CASE WHEN count(*) >= 3 THEN '[×' || count(*) || '] ' || arg_min(line, n) ELSE string_agg(line, chr(10) ORDER BY n) END AS line FROM numbered2 GROUP BY doc_id, run),
two AS ({ASSEMBLED.format("grouped2")})
SELECT o.doc_id, t.text AS output, concat_ws(',', CASE WHEN fired THEN 'frames' END, CASE WHEN t.text <> o.text THEN 'dedup' END) AS applied, CASE WHEN lost THEN 'frames' ELSE '' END AS rejected FROM one o JOIN two t USING (doc_id)"""


def sums(prefix: str, where: str) -> str:
    return f"{prefix} AS (SELECT count(*) AS turns, {', '.join(f'coalesce(sum({u}), 0)::BIGINT AS {u}' for u in USAGE)} FROM turns WHERE role = 'assistant' AND {where})"


def delta(name: str) -> str:
    difference = f"round(b.{name} - a.{name}, 9)" if name == "cost" else f"b.{name} - a.{name}"
    return f"{difference} AS d_{name}, round(CASE WHEN a.{name} <> 0 THEN (b.{name} - a.{name}) / a.{name}::DOUBLE END, 9) AS p_{name}"


def oracle() -> dict[str, str]:
    from tersely.plans import queries as q
    from tersely.plans import stores, traces

    stack = kinds(q.STACK, "plain")
    total = " + ".join(USAGE)
    extra = "text || ' eyJabcdefghij.klmnopqrstuv.wxyzabcdefghi ?a=1&b=2&c=3&d=4&e=5&f=6 ' || sha256(text)"
    frame = "(starts_with(ltrim(line), 'at org.springframework.') OR (starts_with(ltrim(line), 'at ') AND contains(line, 'node:internal/')))"
    short = r"regexp_replace(p, '((?::[0-9]+)*)$', '')"
    out = {
        "compact_logs": f"""{dedup(event_lines())}, before AS (SELECT doc_id, count(*) AS lines_before, sum(strlen(line))::BIGINT AS bytes_before FROM lines GROUP BY doc_id),
after AS (SELECT doc_id, count(*) AS lines_after, sum(strlen(CASE WHEN c > 1 THEN '[×' || c || '] ' || first ELSE first END))::BIGINT AS bytes_after FROM grouped GROUP BY doc_id)
SELECT *, round((bytes_before - bytes_after) / bytes_before::DOUBLE, 9) AS ratio FROM before JOIN after USING (doc_id)""",
        "line_split": f"WITH {text_lines()} SELECT * FROM lines",
        "lines_per_document": f"WITH {DOCS} SELECT doc_id, len({split('text')})::BIGINT AS lines FROM docs",
        "template_normalize": f"WITH {event_lines()} SELECT doc_id, n, {replaced('line', fixed.TEMPLATE_STEPS)} AS template FROM lines",
        "template_dedup": f"{dedup(event_lines())} SELECT doc_id, n, CASE WHEN c > 1 THEN '[×' || c || '] ' || first ELSE first END AS line FROM grouped",
        "template_dedup_documents": f"{dedup(text_lines())} SELECT doc_id, n, CASE WHEN c > 1 THEN '[×' || c || '] ' || first ELSE first END AS line FROM grouped",
        "opaque_normalize": f"WITH {DOCS} SELECT doc_id, {replaced(extra, fixed.OPAQUE_STEPS)} AS text FROM docs",
        "opaque_urls": f"""SELECT page_id, {replaced("url || '?utm_source=a&utm_medium=b&x=1'", fixed.OPAQUE_STEPS)} AS url FROM pages""",
        "whitespace_collapse": rf"""WITH {DOCS}, wide AS (SELECT doc_id, replace(replace(text, ', ', ',      '), chr(10), '  ' || chr(10) || '      ') AS t FROM docs)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r?\n$', ''), '(?m)^( {{4}}) +', '\1', 'g'), '([^ \n]) {{3,}}', '\1  ', 'g'), '(?m)[ \t]+$', '', 'g') AS text FROM wide""",
        "prefix_consolidate": f"""WITH {event_lines("upper(event_type) || ': user ' || user_id || ' v' || floor(value)::BIGINT")}, {runs("regexp_extract(line, '^(.*?: )', 1)", "false")}
SELECT doc_id, min(n) AS n, CASE WHEN count(*) > 1 THEN any_value(k) || string_agg(substr(line, length(k) + 1), ', ' ORDER BY n) ELSE min(line) END AS line FROM numbered GROUP BY doc_id, run""",
        "path_shorten": rf"""WITH t AS (SELECT page_id, 'at (' || url || ':12:7), /usr/lib/x.py' AS line FROM pages),
p AS (SELECT page_id, line, regexp_extract_all(line, '[^\s,()''"]+') AS tokens, regexp_split_to_array(line, '[^\s,()''"]+') AS gaps FROM t),
s AS (SELECT page_id, gaps, list_transform(tokens, lambda p: CASE WHEN len(regexp_extract_all({short}, '[/\\]')) >= 2 AND len(list_filter(regexp_split_to_array({short}, '[/\\]'), lambda y: y <> '')) >= 2
  THEN list_filter(regexp_split_to_array({short}, '[/\\]'), lambda y: y <> '')[-2] || '/' || list_filter(regexp_split_to_array({short}, '[/\\]'), lambda y: y <> '')[-1] || regexp_extract(p, '((?::[0-9]+)*)$', 1) ELSE p END) AS tokens FROM p)
SELECT page_id, array_to_string(list_transform(list_zip(gaps, tokens), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS line FROM s""",
        "progress_filter": f"""WITH {event_lines(kinds(q.PROGRESS, "plain"))} SELECT * FROM lines WHERE line NOT LIKE '%[####%' AND line NOT LIKE '%⠋%' AND line NOT LIKE ' %Compiling % v%'""",
        "diag_filter": rf"""WITH {event_lines(kinds(q.NOISE, "--- keep"))} SELECT * FROM lines WHERE NOT regexp_matches(line, '^[~^\s]+$') AND NOT regexp_matches(line, '^index .{{0,18}}\.\.') AND NOT regexp_matches(line, '^(--- a/|\+\+\+ b/)')""",
        "test_failures": rf"""WITH {event_lines(kinds(q.TESTS, "other"))}, t AS (SELECT *, bool_or(contains(line, 'test result:') OR contains(line, 'FAILED')) OVER (PARTITION BY doc_id) AS tests FROM lines)
SELECT doc_id, n, line FROM t WHERE NOT (tests AND regexp_matches(trim(line), '^test .* \.\.\. (ok|ignored)$'))""",
        "blank_collapse": f"""WITH {text_lines("text", "docs AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10) || '  ' || chr(10)) || chr(10) || chr(10) || ' ' || chr(10) AS text FROM documents)")},
b AS (SELECT *, {BLANK} AS blank FROM lines), t AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY n), false) AS before, max(CASE WHEN NOT blank THEN n END) OVER (PARTITION BY doc_id) AS last FROM b)
SELECT doc_id, n, line FROM t WHERE NOT (blank AND before) AND n <= last""",
        "ansi_strip": rf"WITH {DOCS} SELECT doc_id, regexp_replace(text, '[\x00-\x09\x0b-\x1f\x7f]', '', 'g') || '.' AS text FROM docs",
        "detect_class": f"""WITH {DOCS}, {event_lines()}, logs AS ({ASSEMBLED.format("lines")}), joint AS (SELECT doc_id, text FROM docs UNION ALL SELECT -doc_id - 1, text FROM logs), split AS (SELECT *, {split("text")} AS a FROM joint)
SELECT doc_id, CASE WHEN {TEST} THEN 'test' WHEN {BUILD} THEN 'build' WHEN {DIFF} THEN 'diff' WHEN {LOG} THEN 'log' ELSE 'generic' END AS class FROM split""",
        "log_share": f"WITH {event_lines()}, logs AS ({ASSEMBLED.format('lines')}), split AS (SELECT *, {split('text')} AS a FROM logs) SELECT doc_id, {LOG} AS is_log, {DIFF} AS is_diff FROM split",
        "request_route": f"WITH {DOCS} SELECT doc_id, CASE WHEN strlen(text) > 3000 THEN 'rejected' WHEN doc_id % 5 = 0 THEN 'bypassed' ELSE 'accepted' END AS route, true AS pre_filtered FROM docs",
        "stack_collapse": f"WITH {event_lines(stack)}, {folded(frame, 3, literal('') + ' || regexp_extract(first, ' + literal('^( *)') + ', 1) || ' + literal('... ') + ' || (c - 1) || ' + literal(' framework frames omitted'), False)}",
        "rule_frame_run": f"WITH {event_lines(stack)}, {folded(frame.split(' OR ')[0] + ')', 2, literal('... [') + ' || (c - 2) || ' + literal(' frames omitted]'), True)}",
        "rule_delete": f"WITH {event_lines()}, kept AS (SELECT * FROM lines WHERE NOT contains(line, ' VIEW ') AND NOT contains(line, ' CLICK ')) {ASSEMBLED.format('kept')}",
        "rule_rewrite": f"WITH {event_lines()}, new AS (SELECT doc_id, n, regexp_replace(regexp_replace(line, 'v=[0-9]+$', '#', 'g'), 'user=[0-9]+', '#', 'g') AS line FROM lines) {ASSEMBLED.format('new')}",
        "rule_dedup": f"""WITH {event_lines()}, {runs("regexp_replace(line, '[0-9]+', '§', 'g')", BLANK)}, grouped AS (SELECT doc_id, min(n) AS n, CASE WHEN count(*) >= 3 THEN '[×' || count(*) || '] ' || arg_min(line, n) ELSE string_agg(line, chr(10) ORDER BY n) END AS line FROM numbered GROUP BY doc_id, run)
{ASSEMBLED.format("grouped")}""",
        "rule_prefix": f"""WITH {event_lines()}, ends AS (SELECT doc_id, min(line) AS a, max(line) AS b, count(*) AS c FROM lines GROUP BY doc_id),
sized AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[:i] = b[:i])) AS k FROM ends)
SELECT doc_id, CASE WHEN any_value(c) >= 4 AND any_value(k) >= 2 THEN 'prefix: ' || any_value(a[:k]) || chr(10) || string_agg('  ' || substr(line, k + 1), chr(10) ORDER BY n) ELSE string_agg(line, chr(10) ORDER BY n) END AS text
FROM lines JOIN sized USING (doc_id) GROUP BY doc_id""",
        "error_signal_count": f"WITH {event_lines(kinds(q.SIGNALS, 'E0123: x'))}, t AS ({ASSEMBLED.format('lines')}) SELECT doc_id, len(regexp_extract_all(text, {literal(fixed.ERROR_SIGNAL)}))::BIGINT AS signals FROM t",
        "block_dedup": blocks(text_lines(), "docs"),
        "block_dedup_logs": blocks(event_lines(kinds(q.BLOCKS, "INFO idle")), "(SELECT DISTINCT doc_id FROM lines)"),
        "prefix_factor": factored(False),
        "suffix_factor": factored(True),
        "rules_fold": rules_fold(),
        "prefix_first_round": f"""WITH {event_lines()}, placed AS (SELECT *, row_number() OVER w AS pos, lead(line, 4) OVER w AS last FROM lines WHERE NOT {BLANK} AND NOT {MARKER} WINDOW w AS (PARTITION BY doc_id ORDER BY line, n)),
made AS (SELECT doc_id, pos, line[:len(list_filter(range(1, least(length(line), length(last)) + 1), lambda i: line[:i] = last[:i]))] AS prefix FROM placed WHERE last IS NOT NULL),
starts AS (SELECT doc_id, prefix, min(pos) AS pos FROM made WHERE strlen(prefix) >= 12 GROUP BY doc_id, prefix),
saved AS (SELECT s.doc_id, s.prefix, s.pos, strlen(s.prefix) * count(*) AS saved FROM starts s JOIN placed p ON p.doc_id = s.doc_id AND p.pos >= s.pos AND starts_with(p.line, s.prefix) GROUP BY s.doc_id, s.prefix, s.pos)
SELECT doc_id, prefix, saved FROM saved WHERE saved > strlen(prefix) + 22 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY saved DESC, pos) = 1""",
        "prose_tail": f"""WITH {event_lines(kinds({"error": "Note: see above", "view": "value not found"}, "done"))}, t AS (SELECT *, max(CASE WHEN line = 'done' THEN n END) OVER (PARTITION BY doc_id) AS real FROM lines)
SELECT doc_id, n, line FROM t WHERE real IS NULL OR n <= real""",
        "session_summary": f"""WITH {RECORDS}, s AS (SELECT *, greatest(original_tokens - compressed_tokens, 0) AS whole, tokens_after_l1 IS NOT NULL AND tokens_after_l2 IS NOT NULL AS known, CASE layer_used WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS own, least(greatest(layer_used, 1), 3) AS place FROM records)
SELECT count(*) AS total_compressions, sum(original_tokens)::BIGINT AS total_original_tokens, sum(compressed_tokens)::BIGINT AS total_compressed_tokens, sum(whole)::BIGINT AS total_tokens_saved,
  sum(CASE WHEN known THEN greatest(original_tokens - tokens_after_l1, 0) WHEN own = 1 THEN whole ELSE 0 END)::BIGINT AS total_saved_l1, sum(CASE WHEN known THEN greatest(tokens_after_l1 - tokens_after_l2, 0) WHEN own = 2 THEN whole ELSE 0 END)::BIGINT AS total_saved_l2,
  sum(CASE WHEN known THEN greatest(tokens_after_l2 - compressed_tokens, 0) WHEN own = 3 THEN whole ELSE 0 END)::BIGINT AS total_saved_l3, round(avg({RATIO}), 9) AS average_ratio,
  sum((place = 1)::INT)::BIGINT AS layer_1, sum((place = 2)::INT)::BIGINT AS layer_2, sum((place = 3)::INT)::BIGINT AS layer_3, sum(pre_filtered::INT)::BIGINT AS pre_filtered_count FROM s""",
        "summary_window": f"WITH {RECORDS} SELECT count(*) AS n, sum(original_tokens - compressed_tokens)::BIGINT AS tokens_saved, round(avg((original_tokens - compressed_tokens) / nullif(original_tokens, 0)::DOUBLE), 9) AS average_ratio FROM records WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY",
        "history_topk": f"WITH {RECORDS} SELECT id, command, original_tokens, round({RATIO}, 9) AS ratio FROM records ORDER BY id DESC LIMIT 50",
        "records_since": f"WITH {RECORDS} SELECT id, command FROM records WHERE id > 1000 AND (command = 'CMD3' OR command ILIKE 'CMD3 %') ORDER BY id LIMIT 500",
        "max_record_id": f"WITH {RECORDS} SELECT coalesce(max(id), 0) AS max_id FROM records",
        "prune_preview": f"WITH {RECORDS} SELECT count(*) FILTER (created_at < TIMESTAMP '2001-08-01' - INTERVAL 700 DAY) AS removed FROM records",
        "pruned": f"WITH {RECORDS} SELECT id, created_at FROM records WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY",
        "winning_layer": f"""WITH {RECORDS}, l AS (SELECT id, CASE WHEN id % 5 = 0 THEN tokens_after_l2 // 2 END AS l3, greatest(original_tokens - tokens_after_l1, 0) AS one, greatest(tokens_after_l1 - tokens_after_l2, 0) AS two, tokens_after_l2 FROM records)
SELECT id, CASE WHEN l3 IS NOT NULL AND greatest(tokens_after_l2 - l3, 0) >= one AND greatest(tokens_after_l2 - l3, 0) >= two THEN 3 WHEN one > two THEN 1 ELSE 2 END AS layer FROM l""",
        "command_top8": f"""WITH {RECORDS}, b AS (SELECT string_split(command, ' ')[1] AS name, sum(greatest(original_tokens - compressed_tokens, 0))::BIGINT AS tokens_saved, count(*) AS runs FROM records GROUP BY 1)
SELECT name, tokens_saved, runs, round(tokens_saved / sum(tokens_saved) OVER ()::DOUBLE, 9) AS share FROM b ORDER BY tokens_saved DESC, name LIMIT 8""",
        "layer_distribution": f"WITH {RECORDS}, b AS (SELECT least(greatest(layer_used, 1), 3) AS layer, count(*) AS runs FROM records GROUP BY 1), p AS (SELECT *, floor(runs * 100 / sum(runs) OVER () + 0.5)::BIGINT AS pct FROM b) SELECT *, pct // 2 AS bar FROM p",
        "weekly_series": f"""WITH {RECORDS}, b AS (SELECT created_at::DATE AS day, sum(greatest(original_tokens - compressed_tokens, 0))::BIGINT AS tokens_saved FROM records WHERE created_at::DATE <= DATE '2001-07-31' AND created_at::DATE > DATE '2001-07-24' GROUP BY 1)
SELECT day, tokens_saved, CASE WHEN max(tokens_saved) OVER () = 0 THEN 0 ELSE floor(tokens_saved * 7 / max(tokens_saved) OVER () + 0.5)::BIGINT END AS level FROM b""",
        "weighted_ratio": f"WITH {RECORDS} SELECT round((sum(original_tokens) - sum(compressed_tokens))::DOUBLE / sum(original_tokens)::DOUBLE, 9) AS weighted_ratio FROM records",
        "latency_stats": f"WITH {RECORDS} SELECT output_type, min(latency_ms) AS min_ms, floor(avg(latency_ms))::BIGINT AS avg_ms, max(latency_ms) AS max_ms, floor((sum(original_tokens) - sum(compressed_tokens)) * 100 / greatest(sum(original_tokens), 1))::BIGINT AS pct FROM records GROUP BY 1",
        "model_speed": f"WITH {RECORDS} SELECT min(latency_ms) AS min_ms, floor(avg(latency_ms))::BIGINT AS avg_ms, max(latency_ms) AS max_ms, floor(sum(compressed_tokens) * 100 / greatest(sum(original_tokens), 1))::BIGINT AS output_pct, round(sum(compressed_tokens) * 1000.0 / sum(latency_ms)::DOUBLE, 6) AS tokens_a_second FROM records",
        "cache_key": f"WITH {DOCS} SELECT doc_id, {KEY} AS hash FROM docs",
        "cache_lookup_ttl": f"WITH {CACHE} SELECT doc_id, {KEY} AS hash, c.output AS cached FROM docs LEFT JOIN cache c ON c.hash = {KEY} AND c.created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY",
        "cache_stale": f"WITH {CACHE} SELECT hash, output FROM cache WHERE created_at < TIMESTAMP '2001-08-01' - INTERVAL 7 DAY",
        "cache_upsert": f"WITH {CACHE} SELECT hash, CASE WHEN output LIKE '%3' THEN 'new' ELSE output END AS output FROM cache",
        "intent_recent": f"WITH {MESSAGES} SELECT session, intent, turns_ago::BIGINT AS turns_ago FROM messages WHERE age = 0",
        "intent_decay": f"""WITH {MESSAGES}, few AS (SELECT *, [300, 125, 50][age::INT + 1] AS budget, CASE WHEN age = 0 THEN 'Current:' ELSE 'Earlier (' || turns_ago || ' turns ago):' END AS label FROM messages WHERE age < 3),
part AS (SELECT *, label || ' ' || CASE WHEN length(intent) > budget THEN intent[:budget - 3] || '...' ELSE intent END AS p FROM few),
whole AS (SELECT session, count(*) AS n, string_agg(p, ' | ' ORDER BY age DESC) AS t, arg_min(intent, age) AS one, arg_min(turns_ago, age)::BIGINT AS turns_ago FROM part GROUP BY session)
SELECT session, CASE WHEN n = 1 THEN one WHEN length(t) > 500 THEN t[:497] || '...' ELSE t END AS intent, turns_ago FROM whole""",
        "intent_format": f"""WITH {MESSAGES} SELECT session, 'CONTEXT: The user''s most recent request was: "' || intent || '". Summarize the tool output focusing on information relevant to that request.' || chr(10) || chr(10) AS as_prefix,
  '<user_intent>' || intent || '</user_intent>' || chr(10) || chr(10) AS as_xml, 'User goal: ' || intent || ' — extract only information that advances this goal.' || chr(10) || chr(10) AS as_goal,
  '{{"user_intent": "' || replace(replace(intent, '"', '\\"'), chr(10), '\\n') || '"}}' || chr(10) || chr(10) AS as_json FROM messages WHERE age = 0""",
        "meta_gate": f"WITH {RATIOS}, {META} SELECT stem, ratio, min_ratio, ratio >= min_ratio AS passed FROM ratios JOIN meta USING (stem) WHERE expected_layer < 3 AND min_ratio > 0",
        "meta_missing": f"WITH {RATIOS}, {META} SELECT * FROM ratios WHERE stem NOT IN (SELECT stem FROM meta)",
        "meta_category": f"WITH {RATIOS}, {META} SELECT stem, ratio, coalesce(category, 'unknown') AS category FROM ratios LEFT JOIN meta USING (stem)",
        "usage_rollup": f"""WITH {TURNS}, r AS (SELECT session, {', '.join(f'coalesce({u}, 0)::BIGINT AS {u}' for u in USAGE)}, row_number() OVER (PARTITION BY session ORDER BY place) AS turn FROM turns WHERE role = 'assistant')
SELECT session, turn, {', '.join(f'sum({u})::BIGINT AS {u}' for u in USAGE)}, sum({total})::BIGINT AS total FROM r GROUP BY GROUPING SETS ((session, turn), (session))""",
        "flagged_runs": f"WITH {RUNS} SELECT 'low' AS reason, stem, format, layer_used, ratio, error FROM runs WHERE ratio < 0.2 AND stem <> 's0' UNION ALL SELECT 'high', stem, format, layer_used, ratio, error FROM runs WHERE ratio > 0.85 UNION ALL SELECT 'error', stem, format, layer_used, ratio, error FROM runs WHERE error <> ''",
        "gain": f"WITH {RECORDS}, s AS (SELECT count(*) AS runs, sum(original_tokens - compressed_tokens)::BIGINT AS tokens_saved, avg((original_tokens - compressed_tokens) / nullif(original_tokens, 0)::DOUBLE) AS ratio FROM records) SELECT tokens_saved, runs, floor(round(ratio, 9) * 100 + 0.5)::BIGINT AS pct, greatest(runs - 50, 0) AS not_shown, tokens_saved || ' tokens saved across ' || runs || ' compressions (' || floor(round(ratio, 9) * 100 + 0.5)::BIGINT || '% avg)' AS line FROM s",
        **{
            f"{name}_chart": f"WITH {RECORDS}, b AS (SELECT string_split(command, ' ')[1] AS name, sum(greatest(original_tokens - compressed_tokens, 0))::BIGINT AS tokens_saved, count(*) AS runs FROM (SELECT * FROM records ORDER BY id DESC LIMIT {n}) GROUP BY 1) SELECT name, tokens_saved, runs, round(coalesce(tokens_saved / nullif(sum(tokens_saved) OVER (), 0)::DOUBLE, 0), 9) AS share FROM b ORDER BY tokens_saved DESC, name LIMIT 8"
            for name, n in (("gain", 50), ("graph", 100))
        },
        "graph_summary": f"WITH {RECORDS} SELECT count(*) AS n, coalesce(sum(original_tokens - compressed_tokens), 0)::BIGINT AS tokens_saved, round(avg((original_tokens - compressed_tokens) / nullif(original_tokens, 0)::DOUBLE), 9) AS average_ratio FROM records WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY",
        "history_table": f"WITH {RECORDS} SELECT id, command, original_tokens, compressed_tokens, layer_used, floor({RATIO} * 100 + 0.5)::BIGINT AS pct FROM records ORDER BY id DESC LIMIT 50",
        "layer_steps": f"""WITH {RECORDS} SELECT id, 1 AS layer, original_tokens AS tokens_before, tokens_after_l1 AS tokens_after, original_tokens - tokens_after_l1 AS delta FROM records WHERE tokens_after_l1 IS NOT NULL
UNION ALL SELECT id, 2, coalesce(tokens_after_l1, original_tokens), coalesce(tokens_after_l2, compressed_tokens), coalesce(tokens_after_l1, original_tokens) - coalesce(tokens_after_l2, compressed_tokens) FROM records WHERE layer_used >= 2
UNION ALL SELECT id, 3, coalesce(tokens_after_l2, compressed_tokens), compressed_tokens, coalesce(tokens_after_l2, compressed_tokens) - compressed_tokens FROM records WHERE layer_used >= 3""",
        "state_view": f"WITH {RECORDS} SELECT count(*) AS total_compressions, sum(greatest(original_tokens - compressed_tokens, 0))::BIGINT AS total_tokens_saved, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM records ORDER BY id DESC LIMIT 3)) AS ids FROM records",
        "metrics_json": f"""WITH {RECORDS} SELECT '{{"max_id":' || max(id) || ',"kind":"report"}}' AS value FROM records""",
        "floor_check": f"""WITH {DOCS}, r AS (SELECT doc_id AS name, text || CASE WHEN doc_id % 2 = 0 THEN ' error' ELSE '' END AS before, text AS after, doc_id % 10 / 10.0::DOUBLE AS ratio FROM docs),
f AS (SELECT name, ratio, NOT regexp_matches(before, 'error|Error|ERROR|FAILED|panic') OR regexp_matches(after, 'error|Error|ERROR|FAILED|panic') AS error_kept, ratio >= 0.5 AS at_floor FROM r) SELECT *, error_kept AND at_floor AS passed FROM f""",
        "text_cap": f"WITH {DOCS}, c AS (SELECT doc_id, text, hex(text) AS h FROM docs), e AS (SELECT *, CASE WHEN substr(h, 203, 1) NOT IN ('8', '9', 'A', 'B') THEN 101 WHEN substr(h, 201, 1) NOT IN ('8', '9', 'A', 'B') THEN 100 WHEN substr(h, 199, 1) NOT IN ('8', '9', 'A', 'B') THEN 99 ELSE 98 END AS n FROM c) SELECT doc_id, CASE WHEN length(h) > 202 THEN decode(unhex(substr(h, 1, 2 * n))) ELSE text END AS text FROM e",
        "text_helpers": f"WITH {DOCS}, u AS (SELECT doc_id, source, doc_id * 97 AS s FROM docs) SELECT doc_id, chr(27) || '[1m' || substr(source, 1, 9) || chr(27) || '[0m' || repeat(' ', (12 - length(substr(source, 1, 9)))::BIGINT) AS padded, format('{{:,}}', doc_id * 1234) AS number, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS uptime FROM u",
        "layer_tally": f"WITH {RUNS} SELECT layer_used, count(*) AS runs, count(*) FILTER (ratio < 0.2 AND stem <> 's0') AS low, count(*) FILTER (ratio > 0.85) AS high, count(error) AS errors FROM runs GROUP BY 1",
        "ab_delta": f"""WITH {TURNS}, {sums("a0", "session % 2 = 0")}, {sums("b0", "session % 2 = 1")},
a AS (SELECT *, {total} AS total, round((input_tokens * 3.0::DOUBLE + cache_creation_tokens * 3.75::DOUBLE + cache_read_tokens * 0.3::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000, 9) AS cost FROM a0),
b AS (SELECT *, {total} AS total, round((input_tokens * 3.0::DOUBLE + cache_creation_tokens * 3.75::DOUBLE + cache_read_tokens * 0.3::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000, 9) AS cost FROM b0)
SELECT {', '.join(delta(n) for n in ("turns", *USAGE, "total", "cost"))}, CASE WHEN b.total = 0 THEN 'empty' WHEN b.total < a.total * 0.9 THEN 'net savings' WHEN b.total < a.total THEN 'marginal savings' WHEN b.total > a.total * 1.05 THEN 'overhead' ELSE 'neutral' END AS verdict FROM a, b""",
        "format_average": f"WITH {RUNS} SELECT format, context, round(avg(ratio), 3) AS avg_ratio, count(*) AS n FROM runs GROUP BY format, context",
        "format_pivot": f"WITH {RUNS}, p AS (SELECT format, stem, max(ratio) FILTER (context) AS with_context, max(ratio) FILTER (NOT context) AS without_context FROM runs GROUP BY ALL) SELECT *, round(with_context - without_context, 9) AS delta FROM p WHERE with_context IS NOT NULL AND without_context IS NOT NULL",
        "discover_top10": f"""WITH {DOCS}, t AS (SELECT source, ceil(length(text) / 4) AS tokens FROM docs WHERE strlen(text) >= 500 AND NOT contains(text, 'compressed:'))
SELECT CASE WHEN coalesce(source, '') = '' THEN 'unknown' ELSE source[:40] END AS command, floor(tokens * 0.7::DOUBLE + 0.5)::BIGINT AS estimated FROM t WHERE tokens > 100 ORDER BY estimated DESC, command LIMIT 10""",
        "tail_stream": f"WITH {RECORDS} SELECT id, command FROM records WHERE id > 100 AND (command = 'cmd3' OR command ILIKE 'cmd3 %')",
    }
    return out | traces.sql(out) | stores.sql(out)
