"""The whole pipeline over a table of requests: routing, layer 1, rules, layer 2, class, counts, record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.functions import text as expressions
from tersely.functions.tokens import TokenCounter, ranks, token_count, token_estimate
from tersely.operators import kernels
from tersely.operators.rules import Rule, compiled, fold, load_folder


def counter(path: str | None):
    return (lambda c: token_count(c, path)) if path else token_estimate


PASS = "output string, l1_rules array<string>, applied array<string>, rejected array<string>, tokens_before int, tokens_after_l1 int, tokens_after_l2 int"


def passed(text: Column, accepted: Column, rules: list[Rule], vocabulary: str | None, layers: tuple[bool, bool] = (True, True)) -> Column:
    """Layer 1, rules, layer 2 (those that are wanted) and the counts between them, in one crossing to Python; texts not
    accepted are only counted."""
    known = ranks(vocabulary) if vocabulary else None

    @F.pandas_udf(PASS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        steps = [(r, compiled(r)) for r in rules]
        tokens = TokenCounter(known) if known else None

        def count(t: str) -> int:
            return tokens.count(t) if tokens else -(-len(t) // 4)

        def row(t: str, ok: bool) -> tuple:
            before = count(t)
            if not ok:
                return None, [], [], [], before, None, None
            one, _, _, fired = kernels.layer1(t) if layers[0] else (t, False, 0, [])
            ruled, applied, rejected = fold(one, steps) if layers[0] else (one, [], [])
            two, rewritten = kernels.layer2(ruled) if layers[1] else (ruled, [])
            after_one = before if one == t else count(one)
            return two, fired, [*applied, *rewritten], rejected, before, after_one, after_one if two == one else count(two)

        for texts, oks in batches:
            out = pd.DataFrame([row(t, ok) for t, ok in zip(texts, oks, strict=True)], columns=[c.split()[0] for c in PASS.split(", ")])
            yield out.astype({c: "Int32" for c in out.columns if c.startswith("tokens")})

    return run(text, accepted)


def compact(
    requests: DataFrame, files: list[list[Rule]] | None = None, vocabulary: str | None = None, output: str = "output", command: str = "command",
    max_bytes: int = fixed.MAX_INPUT_BYTES, excluded: tuple[str, ...] = fixed.EXCLUDED_COMMANDS, layers: tuple[bool, bool] = (True, True),
) -> DataFrame:
    """Requests with `compressed, route, class, layer, pre_filtered, tokens_before, tokens_after_l1, tokens_after_l2, tokens_after,
    ratio, applied_rules`. One pass without a shuffle, and one Arrow UDF; routed-away requests keep their text (rejected ones lose it), on layer 0.

    Tokens after layer 1 are counted before the rules, so the rules' savings go to layer 2."""
    text = F.coalesce(F.col(output), F.lit(""))
    cmd: Column = F.col(command) if command in requests.columns else F.lit(None).cast("string")
    ok = F.col("route") == "accepted"
    done = requests.withColumn("route", expressions.route(text, cmd, max_bytes, excluded)).withColumn("pass", passed(text, ok, [r for f in files or [] for r in f], vocabulary, layers))
    before, after_one, after_two = (F.col(f"pass.tokens_{c}") for c in ("before", "after_l1", "after_l2"))
    after = F.coalesce(after_two, before)
    ratio = F.when(before > 0, F.greatest(before - after, F.lit(0)) / before).otherwise(0.0)
    layer = F.when(~ok, 0).when(before - after_one > F.greatest(after_one - after_two, F.lit(0)), 1).otherwise(2)
    return done.select(
        *requests.columns,
        F.when(F.col("route") == "bypassed", text).otherwise(F.col("pass.output")).alias("compressed"),
        "route",
        expressions.detect(text).alias("class"),
        layer.alias("layer"),
        expressions.is_prefiltered(text, cmd).alias("pre_filtered"),
        before.alias("tokens_before"), after_one.alias("tokens_after_l1"), after_two.alias("tokens_after_l2"), after.alias("tokens_after"),
        F.round(ratio, 9).alias("ratio"),
        F.concat("pass.l1_rules", "pass.applied").alias("applied_rules"),
        F.col("pass.rejected").alias("rejected_rules"),
    )


def configured(requests: DataFrame, config: dict, vocabulary: str | None = None) -> DataFrame:
    """`compact` by settings: which commands and sizes are left alone, which layers run, where rule files lie."""
    own = config["compression"]
    if not own["enabled"]:
        own = own | {"layer1_enabled": False, "layer2_enabled": False}
    files = load_folder(own["spec_rules_path"]) if own["spec_rules_path"] else None
    return compact(requests, files, vocabulary, max_bytes=own["max_input_chars"], excluded=tuple(config["exclusions"]["commands"]), layers=(own["layer1_enabled"], own["layer2_enabled"]))


def discover(events: DataFrame, vocabulary: str | None = None, n: int = 10) -> DataFrame:
    """Outputs (`command, output`) that compaction has missed: the n greatest estimated savings, 70 % of the tokens."""
    tokens = counter(vocabulary)
    long = events.filter((F.octet_length("output") >= 500) & ~F.col("output").contains("compressed:"))
    told = long.withColumn("tokens", tokens(F.col("output"))).filter("tokens > 100")
    name = F.when(F.coalesce(F.col("command"), F.lit("")) == "", "unknown").otherwise(F.substring("command", 1, 40))
    return told.select(name.alias("command"), F.floor(F.col("tokens") * 0.70 + 0.5).cast("long").alias("estimated")).orderBy(F.desc("estimated"), "command").limit(n)
