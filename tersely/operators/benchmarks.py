"""Relational forms of the benchmark harness: fixtures and their meta, usage tables, A/B differences, averages by format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USAGE = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")
#: Dollars a million tokens, as USAGE. Fixed values.
RATES = (3.0, 3.75, 0.30, 15.0)


def gate(ratios: DataFrame, meta: DataFrame) -> DataFrame:
    """Fixtures with a floor (`min_ratio` > 0, `expected_layer` < 3) and whether their ratio reaches it."""
    held = ratios.join(meta.filter("expected_layer < 3 AND min_ratio > 0"), "stem")
    return held.select("stem", "ratio", "min_ratio", (F.col("ratio") >= F.col("min_ratio")).alias("passed"))


def with_category(ratios: DataFrame, meta: DataFrame) -> DataFrame:
    return ratios.join(meta.select("stem", "category"), "stem", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def without_meta(ratios: DataFrame, meta: DataFrame) -> DataFrame:
    return ratios.join(meta, "stem", "left_anti")


def every_ruleset(fixtures: DataFrame, rulesets: dict) -> DataFrame:
    """Each stated rule set against each fixture: `stem, ruleset, applied, rejected`. One scan: a text crosses to Python once
    and meets all rule sets, which a task compiles once."""
    from tersely.operators.rules import compiled, fold

    @F.pandas_udf("array<struct<ruleset:string,applied:array<string>,rejected:array<string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = {name: [(r, compiled(r)) for r in rules] for name, rules in rulesets.items()}
        for texts in batches:
            yield pd.Series([[dict(zip(("ruleset", "applied", "rejected"), (name, *fold(t or "", own)[1:]), strict=True)) for name, own in steps.items()] for t in texts], dtype=object)

    return fixtures.select("stem", F.inline(run("text")))


def usage(turns: DataFrame, by: str = "session") -> DataFrame:
    """Usage by assistant turn, numbered by `at`, nulls as zero, and a total row (turn null) for each session."""
    rows = turns.filter("role = 'assistant'").select(by, "at", *(F.coalesce(F.col(u), F.lit(0)).cast("long").alias(u) for u in USAGE))
    numbered = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy("at")))
    total = sum((F.col(u) for u in USAGE[1:]), F.col(USAGE[0]))
    return numbered.rollup(by, "turn").agg(*(F.sum(u).alias(u) for u in USAGE)).filter(F.col(by).isNotNull()).withColumn("total", total)


def cost() -> Column:
    return sum((F.col(u) * r for u, r in zip(USAGE[1:], RATES[1:], strict=True)), F.col(USAGE[0]) * RATES[0]) / 1_000_000


def tally(runs: DataFrame, left_out: str = "") -> DataFrame:
    """Runs by layer, with how many saved little (below 0.2, one name left out) or much (above 0.85), and errors."""
    low = (F.col("ratio") < 0.20) & (F.col("stem") != left_out)
    return runs.groupBy("layer_used").agg(F.count("*").alias("runs"), F.count_if(low).alias("low"), F.count_if(F.col("ratio") > 0.85).alias("high"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row totals (USAGE and `turns`): deltas, percents (null from zero), costs and a verdict."""
    names = ("turns", *USAGE, "total")
    total = sum((F.col(u) for u in USAGE[1:]), F.col(USAGE[0]))
    one = a.withColumn("total", total).withColumn("cost", F.round(cost(), 9)).select(F.lit(1).alias("k"), *(F.col(n).alias(f"a_{n}") for n in (*names, "cost")))
    two = b.withColumn("total", total).withColumn("cost", F.round(cost(), 9)).select(F.lit(1).alias("k"), *(F.col(n).alias(f"b_{n}") for n in (*names, "cost")))
    deltas = [x for n in (*names, "cost") for x in (F.round(F.col(f"b_{n}") - F.col(f"a_{n}"), 9).alias(f"d_{n}"), F.round(F.try_divide((F.col(f"b_{n}") - F.col(f"a_{n}")).cast("double"), F.col(f"a_{n}").cast("double")), 9).alias(f"p_{n}"))]
    verdict = F.when(F.col("b_total") == 0, "empty").when(F.col("b_total") < F.col("a_total") * 0.9, "net savings").when(F.col("b_total") < F.col("a_total"), "marginal savings").when(F.col("b_total") > F.col("a_total") * 1.05, "overhead").otherwise("neutral")
    return one.join(two, "k").select(*deltas, verdict.alias("verdict"))


def by_format(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.round(F.avg("ratio"), 3).alias("avg_ratio"), F.count("*").alias("n")).orderBy(F.desc("avg_ratio"), *keys)


def context_gain(runs: DataFrame) -> DataFrame:
    """By format and stem, the ratio with context beside the one without, and their difference."""
    sides = runs.groupBy("format", "stem").pivot("context", [True, False]).agg(F.max("ratio")).withColumnsRenamed({"true": "with_context", "false": "without_context"})
    return sides.dropna(subset=["with_context", "without_context"]).withColumn("delta", F.round(F.col("with_context") - F.col("without_context"), 9))
