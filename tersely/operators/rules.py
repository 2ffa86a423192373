"""The rule engine: declarative patterns and transforms over a document's lines, each guarded by an error check.

A rule file is YAML or JSON: `spec_version` (beginning with "0."), `rules`, each with `id`, `pattern`, `transform`, `invariants`.
Patterns: frame-run, line-match, template-dedup, prefix-factor; transforms: collapse-run, delete, rewrite, dedup, factor-prefix.
`apply_rules` folds all rules over each text in one Arrow UDF; `line_form` compiles a rule to windows over exploded lines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions import text as expressions
from tersely.functions.lines import is_blank, islands, left_trimmed
from tersely.operators import kernels, windows

PLACEHOLDER = "§"
RESULT = "output string, applied array<string>, rejected array<string>"
#: Which transforms go with which patterns.
PAIRS = {("frame-run", "collapse-run"), ("line-match", "delete"), ("line-match", "rewrite"), ("template-dedup", "dedup"), ("prefix-factor", "factor-prefix")}


class RuleError(ValueError):
    """A rule file or a rule that cannot be used."""


@dataclass
class Rule:
    id: str
    pattern: dict
    transform: dict
    invariants: list = field(default_factory=list)

    @property
    def pair(self) -> tuple[str, str]:
        return self.pattern.get("kind"), self.transform.get("kind")


def parse(content: dict) -> list[Rule]:
    if not str(content.get("spec_version", "")).startswith("0."):
        raise RuleError(f"unsupported spec_version {content.get('spec_version')!r}")
    return [Rule(r["id"], dict(r["pattern"]), dict(r["transform"]), list(r.get("invariants") or [])) for r in content.get("rules", [])]


def load_file(path: str | Path) -> list[Rule]:
    """The rules of a .yaml, .yml or .json file."""
    path = Path(path)
    raw = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return parse(json.loads(raw))
    import yaml

    return parse(yaml.safe_load(raw))


def load_folder(path: str | Path, warn: Callable[[str], None] = lambda message: None) -> list[list[Rule]]:
    """The rules of each *.yaml file in a folder, or of one file, by path; unusable files are told to `warn` and left out."""
    path = Path(path)
    files = [path] if path.is_file() else sorted(path.rglob("*.yaml"))
    if not files:
        raise RuleError(f"no rule files in {path}")
    out = []
    for file in files:
        try:
            out.append(load_file(file))
        except (ValueError, KeyError, TypeError, OSError) as error:
            if path.is_file():
                raise
            warn(f"{file}: {error}")
    return out


def replacement(text: str) -> str:
    """Group references in the rule's syntax ($1, ${1}) as Python's."""
    return re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", text.replace("\\", "\\\\"))


def matcher(pattern: dict) -> Callable[[str], bool]:
    """A test of lines: any of the values; regular expressions that don't compile match nothing."""
    values, kind = [str(v) for v in pattern.get("values", [])], pattern.get("classifier", "contains")
    if kind == "contains":
        return lambda line: any(v in line for v in values)
    if kind == "starts_with":
        return lambda line: line.lstrip(kernels.WHITE).startswith(tuple(values))
    if kind == "equals":
        return lambda line: line in values
    compiled = []
    for v in values:
        try:
            compiled.append(re.compile(v))
        except re.error:
            continue
    return lambda line: any(c.search(line) for c in compiled)


def frame_run(rule: Rule) -> Callable[[list[str]], list[str] | None]:
    test, unit = matcher(rule.pattern), max(1, int(rule.pattern.get("unit", 1)))
    least, template = max(2, int(rule.transform.get("min_run", 3))), rule.transform["replacement"]

    def step(rows: list[str]) -> list[str] | None:
        hits = [test(r) for r in rows]
        out, i, fired = [], 0, False
        while i < len(rows):
            count = 0
            while i + (count + 1) * unit <= len(rows) and hits[i + count * unit]:
                count += 1
            end = i + max(1, count * unit)
            if count >= least:
                out += [*rows[i : i + unit], template.replace("{n}", str(count - 2)), *rows[end - unit : end]]
                fired = True
            else:
                out += rows[i:end]
            i = end
        return out if fired else None

    return step


def delete(rule: Rule) -> Callable[[list[str]], list[str] | None]:
    test = matcher(rule.pattern)

    def step(rows: list[str]) -> list[str] | None:
        kept = [r for r in rows if not test(r)]
        return kept if len(kept) < len(rows) else None

    return step


def rewrite(rule: Rule) -> Callable[[list[str]], list[str] | None]:
    test, by = matcher(rule.pattern), str(rule.transform.get("replacement", ""))
    if rule.pattern.get("classifier") == "regex":
        steps = [(re.compile(v), replacement(by)) for v in rule.pattern.get("values", [])]
        new = lambda row: kernels.replaced(row, steps)
    else:
        new = lambda row: by

    def step(rows: list[str]) -> list[str] | None:
        hits = [test(r) for r in rows]
        return [new(r) if h else r for r, h in zip(rows, hits, strict=True)] if any(hits) else None

    return step


def dedup(rule: Rule) -> Callable[[list[str]], list[str] | None]:
    steps = [(re.compile(n["regex"]), replacement(str(n.get("replacement", PLACEHOLDER)))) for n in rule.pattern.get("normalize", [])]
    least, form = max(2, int(rule.transform.get("min_run", 2))), rule.transform.get("format", "[×{n}] {exemplar}")

    def step(rows: list[str]) -> list[str] | None:
        keys = [None if kernels.blank(r) else kernels.replaced(r, steps) for r in rows]
        spans = kernels.runs(keys)
        if not any(b - a >= least for a, b in spans):
            return None
        return [x for a, b in spans for x in ([form.replace("{n}", str(b - a)).replace("{exemplar}", rows[a])] if b - a >= least else rows[a:b])]

    return step


def factor(rule: Rule) -> Callable[[list[str]], list[str] | None]:
    least, by = int(rule.pattern.get("min_lines", 4)), rule.transform["replacement"]

    def step(rows: list[str]) -> list[str] | None:
        size = kernels.shared(min(rows), max(rows)) if rows and len(rows) >= least else 0
        return [by.replace("{prefix}", rows[0][:size]), *("  " + r[size:] for r in rows)] if size >= 2 else None

    return step


STEPS = {"collapse-run": frame_run, "delete": delete, "rewrite": rewrite, "dedup": dedup, "factor-prefix": factor}


def compiled(rule: Rule) -> Callable[[list[str]], list[str] | None] | None:
    """The rule as a step on lines (None where it does nothing); None for rules that can't be used."""
    if rule.pair not in PAIRS:
        return None
    try:
        return STEPS[rule.transform["kind"]](rule)
    except (re.error, KeyError, ValueError):
        return None


def fold(text: str, rules: list[tuple[Rule, Callable | None]]) -> tuple[str, list[str], list[str]]:
    """All rules in order: the text, which fired, and which were rejected, being unusable or losing error lines."""
    applied, rejected = [], []
    for rule, step in rules:
        if step is None:
            rejected.append(rule.id)
            continue
        rows = step(kernels.lines(text))
        if rows is None:
            continue
        after = "\n".join(rows)
        if "preserve_errors" in rule.invariants and kernels.error_signals(after) < kernels.error_signals(text):
            rejected.append(rule.id)
        else:
            applied.append(rule.id)
            text = after
    return text, applied, rejected


def apply_rules(text: Column, files: list[list[Rule]]) -> Column:
    """Struct of `output, applied, rejected`: the rules of all files, in order. No shuffle; null stays null."""
    rules = [r for f in files for r in f]

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        steps = [(r, compiled(r)) for r in rules]
        return pd.DataFrame([(None, None, None) if t is None else fold(t, steps) for t in texts], columns=["output", "applied", "rejected"])

    return run(text)


def matches(line: Column, pattern: dict) -> Column:
    """`matcher` as an expression."""
    values, kind = [str(v) for v in pattern.get("values", [])], pattern.get("classifier", "contains")
    t = left_trimmed(line)
    tests = {"contains": line.contains, "starts_with": t.startswith, "equals": lambda v: line == v, "regex": line.rlike}
    return expressions.any_of([tests[kind](v) for v in values])


def line_form(lines: DataFrame, rule: Rule, key: str = "doc_id") -> DataFrame:
    """A rule over exploded lines: `key, n, line`, which any number of rules may follow. The error check is `veto`'s."""
    if rule.pair not in PAIRS:
        raise RuleError(f"{rule.id}: no transform {rule.pair[1]} for {rule.pair[0]}")
    kind = rule.transform["kind"]
    line = F.col("line")
    if kind == "delete":
        return windows.drop_lines(lines, matches(line, rule.pattern), key)
    if kind == "rewrite":
        by, hit = rule.transform.get("replacement", ""), matches(line, rule.pattern)
        new = F.lit(by)
        if rule.pattern.get("classifier") == "regex":
            new = line
            for v in rule.pattern["values"]:
                new = F.regexp_replace(new, v, by)
        return lines.select(key, "n", F.when(hit, new).otherwise(line).alias("line"))
    if kind == "collapse-run":
        unit, least = max(1, int(rule.pattern.get("unit", 1))), max(2, int(rule.transform.get("min_run", 3)))
        summary = F.replace(F.lit(rule.transform["replacement"]), F.lit("{n}"), (F.col("count") - 2).cast("string"))
        whole = F.lead("n", unit - 1).over(windows.ordered(key)).isNotNull()  # a unit that the text cuts is none
        size = F.when(matches(line, rule.pattern) & whole, unit).otherwise(0)
        return windows.collapse_units(lines.withColumn("unit_size", size), F.col("unit_size"), unit, least, summary, True, key)
    if kind == "dedup":
        tpl = line
        for n in rule.pattern.get("normalize", []):
            tpl = F.regexp_replace(tpl, n["regex"], n.get("replacement", PLACEHOLDER))
        made = lines.withColumn("alone", is_blank(line)).withColumn("tpl", tpl)
        runs = islands(made.withColumn("start", windows.starts_run("tpl", F.col("alone"), key)), F.col("start"), key)
        out = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows"))
        form = F.replace(F.replace(F.lit(rule.transform.get("format", "[×{n}] {exemplar}")), F.lit("{n}"), F.size("rows").cast("string")), F.lit("{exemplar}"), F.col("rows")[0]["line"])
        folded = F.when(F.size("rows") >= max(2, int(rule.transform.get("min_run", 2))), F.array(F.struct(F.col("rows")[0]["n"].alias("n"), form.alias("line")))).otherwise(F.col("rows"))
        return out.select(key, F.explode(folded).alias("x")).select(key, "x.n", "x.line")
    found = windows.common_prefix(lines, int(rule.pattern.get("min_lines", 4)), key).select(F.col(key).alias("k"), "prefix", "begin")
    told = lines.join(found, F.col(key) == F.col("k"), "left")
    header = F.replace(F.lit(rule.transform["replacement"]), F.lit("{prefix}"), F.col("prefix"))
    row = F.concat(F.lit("  "), F.substring("line", F.length("prefix") + 1, F.length("line")))
    rows = F.when(F.col("prefix").isNull(), F.array("line")).when(F.col("n") == F.col("begin"), F.array(header, row)).otherwise(F.array(row))
    return told.select(key, "n", F.posexplode(rows).alias("part", "line")).select(key, (F.col("n") * 2 + F.col("part")).alias("n"), "line")


def veto(before: Column, after: Column) -> Column:
    """The text after a rule, or the one before where it would lose error lines."""
    return F.when(expressions.error_signals(after) >= expressions.error_signals(before), after).otherwise(before)
