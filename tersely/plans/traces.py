"""Queries over stack traces and edited texts, and their SQL: frames of all families, units of several lines, line diffs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.functions.lines import assemble, joined, lines_of
from tersely.operators import diff, reports, windows
from tersely.operators.benchmarks import every_ruleset
from tersely.operators.rules import Rule, line_form, load_file
from tersely.plans import oracle
from tersely.plans.compaction import compact

#: For each family a frame, with a source line where the family has such; and frames of the user. Cases of our own.
FRAMES = (
    ("  at org.springframework.web.Dispatcher.run(D.java:1)", None), ("  at com.x.Y$$EnhancerBySpringCGLIB$$1a.run(<generated>)", None), ('  File "/srv/site-packages/celery/app.py", line 7, in run', "    return task(request)"),
    ("from /gems/actionpack-7.1/lib/x.rb:5:in `call'", None), ("    at next (/app/node_modules/express/lib/router.js:2:3)", None), ("runtime.goexit()", "\t/usr/local/go/src/runtime/asm.s.go:1650 +0x1"),
    ("/usr/local/go/src/runtime/proc.go:250 +0x2", None), ("#4 /var/www/vendor/symfony/http-kernel/Kernel.php(202)", None), ("at Illuminate\\Routing\\Router->run()", None), ("(/srv/vendor/laravel/framework/src/App.php:9)", None),
    ("   3: core::panicking::panic_fmt", None), ("   at Microsoft.AspNetCore.Mvc.Invoke()", None), ("    at render (webpack-internal:///./node_modules/react-dom/x.js:1:1)", None), ("    at flush (node_modules/react-native/Libraries/x.js:1)", None),
    ("  at androidx.fragment.app.Fragment.onCreate(F.kt:1)", None), ("/app/.bundle/activesupport/lib/cache.rb:12:in `fetch'", None), ('  File "/home/me/app.py", line 3, in main', "    run()"), ("  at com.example.Main.main(Main.java:3)", None),
)

UNITS = {
    f"rule_frame_units{unit}": Rule("units", {"kind": "frame-run", "classifier": "contains", "values": [" ERROR ", " CLICK ", " VIEW "], "unit": unit}, {"kind": "collapse-run", "min_run": 2, "replacement": "... {n} units of " + f"{unit} lines"})
    for unit in (2, 3)
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, n` and the event, of each user in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("n"), "event_type", "ts", "user_id", "value")


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a trace: six lines of a family's frames (and source lines), a plain line, one more frame; the next family."""
    family, place = (F.floor(F.col("n") / 8) + F.col("doc_id")) % len(FRAMES), F.col("n") % 8
    frames, sources = (F.array(*(F.lit(x[i] if x[i] is not None else x[0]) for x in FRAMES)) for i in (0, 1))
    line = F.when(place == 6, F.lit("request failed")).when((place < 6) & (place % 2 == 1), sources[family.cast("int")]).otherwise(frames[family.cast("int")])
    return events(spark, sf_dir).select("doc_id", "n", line.alias("line"))


def edited(lines: Column) -> Column:
    """Every fourth line gone, a new one behind every seventh."""

    def one(line: Column, i: Column) -> Column:
        new = F.concat(F.lit("new line "), i.cast("string"))
        return F.when(i % 7 == 3, F.array(line, new)).when(i % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(line))

    return F.flatten(F.transform(lines, one))


def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited form: what a shortest script deletes and inserts, and what its patch makes of the document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = docs.withColumn("after", joined(edited(lines_of(F.col("text"))))).withColumn("patch", diff.line_diff(F.col("text"), F.col("after")))
    signs = {name: F.regexp_count(F.col("patch"), F.lit(f"\n[{sign}]")).cast("long") for name, sign in (("deleted", "-"), ("inserted", "+"))}
    inserted = F.when(F.col("patch") == "", F.lit(0).cast("long")).otherwise(signs["inserted"] - 1)  # but for the header's
    return made.select("doc_id", signs["deleted"].alias("deleted"), inserted.alias("inserted"), F.sha2(diff.patched(F.col("text"), F.col("patch")), 256).alias("patched_sha256"))


def diff_of_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces before and after their frames are folded, as the rows of hunks with one line of context."""
    before = assemble(trace_lines(spark, sf_dir))
    after = assemble(windows.collapse_frames(trace_lines(spark, sf_dir))).withColumnRenamed("text", "after")
    rows = before.join(after, "doc_id", "left").select("doc_id", F.inline(diff.diff_rows(F.col("text"), F.col("after"), 1)))
    return rows.groupBy("doc_id", "tag").agg(F.count("*").alias("lines")).filter("tag <> 'equal'")


def rule_files() -> dict[str, Path]:
    return {f.stem: f for f in sorted((Path(__file__).parent.parent / "rulesets").rglob("*.yaml"))}


def shipped_rules() -> dict[str, list[Rule]]:
    """The rule files of the package, by name."""
    return {name: load_file(f) for name, f in rule_files().items()}


def ruleset_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule file against every user's trace: how many of its rules were rejected."""
    rows = every_ruleset(assemble(trace_lines(spark, sf_dir)).withColumnRenamed("doc_id", "stem"), shipped_rules())
    return rows.select("stem", "ruleset", F.size("rejected").cast("long").alias("rejected"))


def floor_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's trace through the whole pipeline, and whether it kept its errors and lost at least a quarter of its tokens."""
    traces = assemble(trace_lines(spark, sf_dir)).select("doc_id", F.concat(F.lit("java.lang.IllegalStateException: Error: no row\n"), "text").alias("output"), F.lit("run").alias("command"))
    done = compact(traces, list(shipped_rules().values()))
    return reports.floors(done.select(F.col("doc_id").alias("name"), F.col("output").alias("before"), F.col("compressed").alias("after"), "ratio", F.lit(0.25).alias("floor"))).drop("ratio")


QUERIES = {
    "floor_traces": floor_traces,
    "ruleset_matrix": ruleset_matrix,
    "prefix_factor_rounds": lambda spark, sf_dir: assemble(windows.factor_ends(plain_lines(spark, sf_dir))),
    "suffix_factor_rounds": lambda spark, sf_dir: assemble(windows.factor_ends(plain_lines(spark, sf_dir), reverse=True)),
    "line_diff": line_diffs,
    "stage_diff": diff_of_stages,
    "stack_collapse_families": lambda spark, sf_dir: assemble(windows.collapse_frames(trace_lines(spark, sf_dir))),
    **{name: lambda spark, sf_dir, rule=rule: assemble(line_form(plain_lines(spark, sf_dir), rule)) for name, rule in UNITS.items()},
}


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tersely.plans.queries import event_lines

    return event_lines(spark, sf_dir)


def frame_sql() -> str:
    """Whether a line is a framework frame, by the families' starts and parts."""

    def family(starts: tuple, parts: tuple) -> str:
        both = [f"({' OR '.join(f'{test}(t, {oracle.literal(v)})' for v in values)})" for test, values in (("starts_with", starts), ("contains", parts)) if values]
        return f"({' AND '.join(both)})"

    def any_of(families: tuple) -> str:
        return " OR ".join(family(starts, parts) for _, starts, parts in families)

    users = " OR ".join(f"starts_with(t, {oracle.literal(u)})" for u in fixed.USER_FRAMES)
    return f"(CASE WHEN {users} THEN {any_of(fixed.BEFORE_USER_FRAMES)} ELSE {any_of(fixed.FRAME_FAMILIES)} END OR {family(('',), fixed.RUBY_PARTS)} AND contains(t, '.rb:'))"


def walked_sql(lines: str, size: str, least: int, summary: str, keep_last: bool) -> str:
    """Units by a walk from line to line, their runs as text. `size` gives the lines of a unit from line, t, after and body."""
    return f"""{lines}, told AS (SELECT *, regexp_replace(line, '^\\s+', '') AS t, coalesce(lead(line) OVER w, '') AS after, regexp_replace(coalesce(lead(line) OVER w, ''), '^\\s+', '') AS body, count(*) OVER (PARTITION BY doc_id) - n AS left FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
sized AS MATERIALIZED (SELECT doc_id, n, line, {size} AS size FROM told),
walk(doc_id, n, size) AS (SELECT doc_id, n, size FROM sized WHERE n = 0 UNION ALL SELECT s.doc_id, s.n, s.size FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.n = w.n + greatest(w.size, 1)),
units AS (SELECT *, sum((size = 0)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS gaps FROM walk),
runs AS (SELECT *, count(*) OVER r AS c, row_number() OVER (PARTITION BY doc_id, gaps ORDER BY n) AS place, first_value(n) OVER (PARTITION BY doc_id, gaps ORDER BY n) AS begin FROM units WHERE size > 0 WINDOW r AS (PARTITION BY doc_id, gaps)),
kept AS (SELECT doc_id, n, 1 AS size FROM walk WHERE size = 0 UNION ALL SELECT doc_id, n, size FROM runs WHERE c < {least} OR place = 1{" OR place = c" if keep_last else ""}),
shown AS (SELECT k.doc_id, l.n * 2 AS n, l.line FROM kept k JOIN lines l ON l.doc_id = k.doc_id AND l.n >= k.n AND l.n < k.n + k.size
  UNION ALL SELECT r.doc_id, (r.n + r.size - 1) * 2 + 1, {summary} FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.n = r.begin WHERE r.place = 1 AND r.c >= {least})"""


def trace_sql() -> str:
    frames, sources = (f"[{', '.join(oracle.literal(x[i] if x[i] is not None else x[0]) for x in FRAMES)}]" for i in (0, 1))
    family = f"((n // 8 + user_id) % {len(FRAMES)} + 1)::INT"
    line = f"CASE WHEN n % 8 = 6 THEN 'request failed' WHEN n % 8 < 6 AND n % 2 = 1 THEN {sources}[{family}] ELSE {frames}[{family}] END"
    return f"lines AS (SELECT user_id AS doc_id, n, {line} AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"


def collapsed_sql() -> str:
    python = " AND ".join(["starts_with(t, 'File \"')", "starts_with(after, '    ')", "body <> ''", *(f"NOT starts_with(body, {oracle.literal(p)})" for p in ('File "', "at ", "from "))])
    go = "starts_with(t, 'runtime.') AND starts_with(after, chr(9)) AND contains(body, '.go:')"
    size = f"CASE WHEN NOT {frame_sql()} THEN 0 WHEN {python} OR {go} THEN 2 ELSE 1 END"
    return walked_sql(trace_sql(), size, fixed.FRAME_RUN, "regexp_extract(l.line, '^(\\s*)', 1) || '... ' || (r.c - 1) || ' framework frames omitted'", False)


def sql(plain: dict[str, str]) -> dict[str, str]:
    """`plain`: the SQL of the other queries; factoring by rounds has that of the kernels."""
    hit = " OR ".join(f"contains(line, {oracle.literal(v)})" for v in UNITS["rule_frame_units2"].pattern["values"])
    units = {
        name: f"WITH RECURSIVE {walked_sql(oracle.event_lines(), f'CASE WHEN ({hit}) AND "left" >= {unit} THEN {unit} ELSE 0 END', 2, f"'... ' || (r.c - 2) || ' units of {unit} lines'", True)} {oracle.ASSEMBLED.format('shown')}"
        for name, unit in (("rule_frame_units2", 2), ("rule_frame_units3", 3))
    }
    edit = "list_transform(range(len(a)), lambda i: CASE WHEN i % 7 = 3 THEN [a[i + 1], 'new line ' || i] WHEN i % 4 = 1 THEN [] ELSE [a[i + 1]] END)"
    names = ", ".join(map(oracle.literal, rule_files()))
    return {
        **units,
        # Rules that keep errors are made so that none is ever rejected.
        # Six frames of eight lines fold to two.
        "floor_traces": "SELECT DISTINCT user_id AS name, true AS error_kept, true AS at_floor, true AS passed FROM events",
        "ruleset_matrix": f"SELECT user_id AS stem, unnest([{names}]) AS ruleset, 0::BIGINT AS rejected FROM (SELECT DISTINCT user_id FROM events)",
        "prefix_factor_rounds": plain["prefix_factor"],
        "suffix_factor_rounds": plain["suffix_factor"],
        "stack_collapse_families": f"WITH RECURSIVE {collapsed_sql()} {oracle.ASSEMBLED.format('shown')}",
        # What is kept of the lines is a subsequence of both texts, and what is put in occurs in one of them only, so no script is shorter.
        "stage_diff": f"""WITH RECURSIVE {collapsed_sql()}, gone AS (SELECT r.doc_id, 'delete' AS tag, sum(size)::BIGINT AS lines FROM runs r WHERE c >= {fixed.FRAME_RUN} AND place > 1 GROUP BY 1),
put AS (SELECT doc_id, 'insert' AS tag, count(*) AS lines FROM runs WHERE c >= {fixed.FRAME_RUN} AND place = 1 GROUP BY 1) SELECT * FROM gone UNION ALL SELECT * FROM put""",
        "line_diff": f"""WITH {oracle.DOCS}, arrays AS (SELECT doc_id, {oracle.split("text")} AS a FROM docs), made AS (SELECT doc_id, a, array_to_string(flatten({edit}), chr(10)) AS after FROM arrays),
b AS (SELECT doc_id, a, {oracle.split("after")} AS b FROM made), counts AS (SELECT *, len(list_filter(b, lambda x: starts_with(x, 'new line '))) AS inserted FROM b)
SELECT doc_id, len(a) - (len(b) - inserted) AS deleted, inserted, sha256(array_to_string(b, chr(10))) AS patched_sha256 FROM counts""",
    }
