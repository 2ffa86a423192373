"""The metrics store: records of runs and what is asked of them.

A record has id, command, output_type, original_tokens, compressed_tokens, tokens_after_l1, tokens_after_l2 (null in
old records), layer_used, latency_ms, pre_filtered, created_at. Differences clamp at zero unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECORD = (
    "id long, command string, output_type string, original_tokens long, compressed_tokens long, layer_used int, latency_ms long, "
    "pre_filtered boolean, created_at timestamp, tokens_after_l1 long, tokens_after_l2 long"
)
TYPES = ("test", "build", "log", "diff", "generic")


def saved(before: str | Column, after: str | Column) -> Column:
    before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    return F.greatest(before - after, F.lit(0))


def ratio(before: str = "original_tokens", after: str = "compressed_tokens") -> Column:
    """Share of tokens saved; 0 where there were none."""
    return F.when(F.col(before) == 0, F.lit(0.0)).otherwise(saved(before, after) / F.col(before))


def migrated(records: DataFrame) -> DataFrame:
    """Records with the two later columns, null where a file lacks them; unknown types are generic."""
    for name in ("tokens_after_l1", "tokens_after_l2"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("long"))
    return records.withColumn("output_type", F.when(F.col("output_type").isin(*TYPES), F.col("output_type")).otherwise("generic"))


def summary_parts(records: DataFrame) -> DataFrame:
    """One row of sums; `joined_parts` adds up such rows, `finished_parts` makes the session summary of the last."""
    known = F.col("tokens_after_l1").isNotNull() & F.col("tokens_after_l2").isNotNull()
    whole, layer = saved("original_tokens", "compressed_tokens"), F.col("layer_used")
    own = F.when(layer == 1, 1).when(layer == 3, 3).otherwise(2)
    steps = [saved("original_tokens", "tokens_after_l1"), saved("tokens_after_l1", "tokens_after_l2"), saved("tokens_after_l2", "compressed_tokens")]
    place = F.least(F.greatest(layer, F.lit(1)), F.lit(3))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return records.agg(
        F.count("*").alias("total_compressions"),
        zero(F.sum("original_tokens")).alias("total_original_tokens"),
        zero(F.sum("compressed_tokens")).alias("total_compressed_tokens"),
        zero(F.sum(whole)).alias("total_tokens_saved"),
        *(zero(F.sum(F.when(known, step).when(own == i, whole).otherwise(0))).alias(f"total_saved_l{i}") for i, step in enumerate(steps, 1)),
        F.coalesce(F.sum(ratio()), F.lit(0.0)).alias("ratios"),
        F.count(ratio()).alias("rated"),
        *(zero(F.sum(F.when(place == i, 1).otherwise(0))).alias(f"layer_{i}") for i in (1, 2, 3)),
        zero(F.sum(F.col("pre_filtered").cast("int"))).alias("pre_filtered_count"),
    )


PARTS = ("total_compressions", "total_original_tokens", "total_compressed_tokens", "total_tokens_saved", "total_saved_l1", "total_saved_l2", "total_saved_l3", "ratios", "rated", "layer_1", "layer_2", "layer_3", "pre_filtered_count")


def joined_parts(parts: DataFrame) -> DataFrame:
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double" if c == "ratios" else "long").alias(c) for c in PARTS))


def finished_parts(parts: DataFrame) -> DataFrame:
    """Counts, sums, the mean of clamped ratios, savings by layer and runs by layer; other columns stay behind them."""
    mean = F.round(F.coalesce(F.try_divide(F.col("ratios"), F.col("rated").cast("double")), F.lit(0.0)), 9).alias("average_ratio")
    return parts.select(*(mean if c == "ratios" else F.col(c) for c in PARTS if c != "rated"), *(c for c in parts.columns if c not in PARTS))


def session_summary(records: DataFrame) -> DataFrame:
    """One row: counts, sums, the mean of clamped ratios, savings by layer and runs by layer (old records count by layer_used)."""
    return finished_parts(summary_parts(records))


def within(records: DataFrame, days: int, now: Column, column: str = "created_at") -> DataFrame:
    return records.filter(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def summary(records: DataFrame, days: int, now: Column) -> DataFrame:
    """One row for the last days: count, tokens saved (unclamped), mean ratio (unclamped, without records of no tokens)."""
    lost = F.col("original_tokens") - F.col("compressed_tokens")
    return within(records, days, now).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("tokens_saved"), F.round(F.avg(F.try_divide(lost.cast("double"), F.col("original_tokens").cast("double"))), 9).alias("average_ratio")
    )


def history(records: DataFrame, n: int) -> DataFrame:
    """The last n records, oldest first."""
    return records.orderBy(F.desc("id")).limit(n).orderBy("id")


recent = history


def records_since(records: DataFrame, after: int, limit: int, command: str | None = None) -> DataFrame:
    """Records after an id, of a command or beginning with it and a space; % and _ are wildcards and case doesn't matter there."""
    out = records.filter(F.col("id") > after)
    if command is not None:
        out = out.filter((F.col("command") == command) | F.col("command").ilike(f"{command} %"))
    return out.orderBy("id").limit(limit)


def max_record_id(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def size(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def prune(table: DataFrame, days: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, how many go) of a table with created_at; write the first over the table to prune it."""
    old = F.col("created_at") < now - F.make_dt_interval(F.lit(days))
    return table.filter(~F.coalesce(old, F.lit(False))), table.agg(F.count_if(old).alias("removed"))


def winning_layer(original: str = "original_tokens", l1: str = "tokens_after_l1", l2: str = "tokens_after_l2", l3: str = "tokens_after_l3") -> Column:
    """The layer that saved most: 3 where it ran and is level with both, 1 only where it beats 2, else 2."""
    one, two, three = saved(original, l1), saved(l1, l2), saved(l2, l3)
    return F.when(F.col(l3).isNotNull() & (three >= one) & (three >= two), 3).when(one > two, 1).otherwise(2)


def first_word(command: str = "command") -> Column:
    word = F.split(F.trim(F.coalesce(F.col(command), F.lit(""))), r"\s+")[0]
    return F.when(word == "", "?").otherwise(word)


def command_chart(records: DataFrame, n: int = 8) -> DataFrame:
    """The n commands that saved most (by name where level), with their share of all savings."""
    by = records.groupBy(first_word().alias("name")).agg(F.sum(saved("original_tokens", "compressed_tokens")).alias("tokens_saved"), F.count("*").alias("runs"))
    total = by.agg(F.sum("tokens_saved").alias("all_saved")).withColumn("k", F.lit(1))
    top = by.orderBy(F.desc("tokens_saved"), "name").limit(n).withColumn("k", F.lit(1)).join(total, "k")
    share = F.round(F.coalesce(F.try_divide(F.col("tokens_saved").cast("double"), F.col("all_saved").cast("double")), F.lit(0.0)), 9)
    return top.select("name", "tokens_saved", "runs", share.alias("share")).orderBy(F.desc("tokens_saved"), "name")


def layer_distribution(records: DataFrame) -> DataFrame:
    """Runs by layer with their rounded percent and a bar of half as many cells."""
    by = records.groupBy(F.least(F.greatest(F.col("layer_used"), F.lit(1)), F.lit(3)).alias("layer")).agg(F.count("*").alias("runs"))
    pct = F.floor(F.col("runs") * 100 / F.sum("runs").over(Window.partitionBy()) + 0.5)
    return by.withColumn("pct", pct.cast("long")).withColumn("bar", F.floor(F.col("pct") / 2).cast("long"))


def weighted_ratio(records: DataFrame) -> DataFrame:
    return records.agg(F.round(F.coalesce(F.try_divide((F.sum("original_tokens") - F.sum("compressed_tokens")).cast("double"), F.sum("original_tokens").cast("double")), F.lit(0.0)), 9).alias("weighted_ratio"))


def weekly(records: DataFrame, last_day: Column) -> DataFrame:
    """Savings of each of seven days with a level from 0 to 7 of the greatest."""
    by = records.groupBy(F.to_date("created_at").alias("day")).agg(F.sum(saved("original_tokens", "compressed_tokens")).alias("tokens_saved"))
    by = by.filter((F.col("day") <= last_day) & (F.col("day") > F.date_sub(last_day, 7)))
    most = F.max("tokens_saved").over(Window.partitionBy())
    return by.withColumn("level", F.when(most == 0, 0).otherwise(F.floor(F.col("tokens_saved") * 7 / most + 0.5)).cast("long"))


def colour_bucket(value: Column, low: float, high: float) -> Column:
    return F.when(value <= low, "low").when(value <= high, "medium").otherwise("high")


def abbreviated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def latency(records: DataFrame, *by: str) -> DataFrame:
    """Least, whole mean and greatest latency, and the whole percent saved."""
    pct = F.floor((F.sum("original_tokens") - F.sum("compressed_tokens")) * 100 / F.greatest(F.sum("original_tokens"), F.lit(1)))
    return records.groupBy(*by).agg(F.min("latency_ms").alias("min_ms"), F.floor(F.avg("latency_ms")).cast("long").alias("avg_ms"), F.max("latency_ms").alias("max_ms"), pct.cast("long").alias("pct"))


def model_speed(runs: DataFrame) -> DataFrame:
    """Of model runs (`ms, input_tokens, output_tokens`): latencies, percent of output to input, tokens a second."""
    rate = F.try_divide(F.sum("output_tokens") * F.lit(1000.0), F.sum("ms").cast("double"))
    return runs.agg(F.min("ms").alias("min_ms"), F.floor(F.avg("ms")).cast("long").alias("avg_ms"), F.max("ms").alias("max_ms"), F.floor(F.sum("output_tokens") * 100 / F.greatest(F.sum("input_tokens"), F.lit(1))).cast("long").alias("output_pct"), F.round(rate, 6).alias("tokens_a_second"))
