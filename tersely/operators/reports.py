"""Reports over the record table, as relations: summaries, charts, views, flagged runs, floors, and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.text import strip_ansi
from tersely.operators import metrics

#: Rows of the gain and graph charts, of a history, of a view's latest records; days that stand for all. Fixed values.
GAIN_ROWS, GRAPH_ROWS, HISTORY_ROWS, LATEST, ALL_DAYS = 50, 100, 50, 3, 36_500


def percent(ratio: Column) -> Column:
    """A share as a whole percent."""
    return F.floor(F.coalesce(ratio, F.lit(0.0)) * 100 + 0.5).cast("long")


def gain_line(saved: Column, runs: Column, ratio: Column) -> Column:
    return F.concat(saved.cast("string"), F.lit(" tokens saved across "), runs.cast("string"), F.lit(" compressions ("), percent(ratio).cast("string"), F.lit("% avg)"))


def gain(records: DataFrame, now: Column) -> DataFrame:
    """One row: savings and mean of the whole history as numbers and as a line, and how many records the chart leaves out."""
    whole = metrics.summary(records, ALL_DAYS, now)
    left_out = F.greatest(F.col("n") - GAIN_ROWS, F.lit(0))
    return whole.select("tokens_saved", F.col("n").alias("runs"), percent(F.col("average_ratio")).alias("pct"), left_out.alias("not_shown"), gain_line(F.col("tokens_saved"), F.col("n"), F.col("average_ratio")).alias("line"))


def gain_chart(records: DataFrame) -> DataFrame:
    return metrics.command_chart(metrics.history(records, GAIN_ROWS))


def graph_chart(records: DataFrame) -> DataFrame:
    return metrics.command_chart(metrics.history(records, GRAPH_ROWS))


def graph_summary(records: DataFrame, days: int, now: Column) -> DataFrame:
    return metrics.summary(records, days, now)


def history_table(records: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The last records with the rounded percent that each saved."""
    return metrics.history(records, n).select("id", "command", "original_tokens", "compressed_tokens", "layer_used", percent(metrics.ratio()).alias("pct"))


def layers(records: DataFrame) -> DataFrame:
    """A row for each record and layer that ran: tokens after it, and how many it took away."""
    after = [F.col("tokens_after_l1"), F.coalesce("tokens_after_l2", "compressed_tokens"), F.col("compressed_tokens")]
    before = [F.col("original_tokens"), F.coalesce("tokens_after_l1", "original_tokens"), F.coalesce("tokens_after_l2", "compressed_tokens")]
    ran = [F.col("tokens_after_l1").isNotNull(), F.col("layer_used") >= 2, F.col("layer_used") >= 3]
    steps = [F.when(r, F.struct(F.lit(i).alias("layer"), b.alias("tokens_before"), a.alias("tokens_after"), (b - a).alias("delta"))) for i, (r, b, a) in enumerate(zip(ran, before, after, strict=True), 1)]
    return records.select("id", F.explode(F.array_compact(F.array(*steps))).alias("step")).select("id", "step.*")


def entry(table: DataFrame, key: str) -> Column:
    return F.struct(key, *(c for c in table.columns if c != key))


def latest(table: DataFrame, key: str) -> DataFrame:
    """`of`: one row with the last rows of a table, in order. Each task keeps its last ones, so few rows move."""
    return table.orderBy(F.desc(key)).limit(LATEST).agg(F.array_sort(F.collect_list(entry(table, key))).alias("of"))


def latest_kind(table: DataFrame, key: str) -> str:
    """The type of `of`."""
    return table.select(F.array(entry(table, key)).alias("of")).schema["of"].dataType.simpleString()


def latest_of(parts: DataFrame, name: str, key: str) -> DataFrame:
    """The last entries of a few arrays of them."""
    entries = parts.select(F.explode(name).alias("x")).orderBy(F.desc(f"x.{key}")).limit(LATEST)
    return entries.agg(F.array_sort(F.collect_list("x")).alias(name))


def state(records: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row: the session summary, the last three records and, where given, the warnings (`at, message`, the last three)."""
    out = metrics.session_summary(records).withColumn("k", F.lit(1)).join(latest(records, "id").select(F.lit(1).alias("k"), F.col("of").alias("recent")), "k")
    if warnings is not None:
        out = out.join(latest(warnings, "at").select(F.lit(1).alias("k"), F.col("of").alias("warns")), "k")
    return out.drop("k")


def as_json(row: DataFrame, **extra: str) -> DataFrame:
    """Each row, with constants beside its columns, as JSON: the metrics view, and a benchmark report to hand in."""
    return row.select(F.to_json(F.struct("*", *(F.lit(v).alias(n) for n, v in extra.items()))).alias("value"))


def flagged(runs: DataFrame, left_out: str = "") -> DataFrame:
    """Runs that saved little (below 0.2, one name left out), much (above 0.85), or failed; a row for each reason."""
    reasons = [
        F.when((F.col("ratio") < 0.20) & (F.col("stem") != left_out), "low"), F.when(F.col("ratio") > 0.85, "high"), F.when(F.coalesce(F.col("error"), F.lit("")) != "", "error"),
    ]
    return runs.withColumn("reason", F.explode(F.array_compact(F.array(*reasons)))).select("reason", "stem", "format", "layer_used", "ratio", "error")


def floors(results: DataFrame, error_marks: tuple[str, ...] = ("error", "Error", "ERROR", "FAILED", "panic")) -> DataFrame:
    """Of results (`name, before, after, ratio, floor`): whether errors were kept and the ratio is at its floor, and both."""
    had = lambda c: F.exists(F.array(*map(F.lit, error_marks)), lambda m: F.contains(F.col(c), m))
    out = results.select("name", "ratio", (~had("before") | had("after")).alias("error_kept"), (F.col("ratio") >= F.col("floor")).alias("at_floor"))
    return out.withColumn("passed", F.col("error_kept") & F.col("at_floor"))


def width(text: Column) -> Column:
    """Characters that show: escapes don't count."""
    return F.length(strip_ansi(text))


def padded(text: Column, most: int) -> Column:
    """Filled with blanks to a width, by what shows."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(most) - width(text), F.lit(0)).cast("int")))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def uptime(seconds: Column) -> Column:
    """1h 02m 03s, without hours or minutes that are none."""
    s, two = seconds.cast("long"), lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    rest = F.pmod(s, F.lit(60))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m "), two(rest), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(rest), F.lit("s"))).otherwise(F.concat(rest.cast("string"), F.lit("s")))
