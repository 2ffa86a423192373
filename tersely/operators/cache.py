"""The result cache: content-addressed entries (`hash, output, model, created_at`) with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a unit separator; a null part counts as empty."""
    joined = [F.lit(SEPARATOR)] * (2 * len(parts) - 1)
    joined[::2] = [F.coalesce(p, F.lit("")) for p in parts]
    return F.sha2(F.concat(*joined), 256)


def fresh(cache: DataFrame, days: int, now: Column) -> DataFrame:
    return cache.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def lookup(requests: DataFrame, cache: DataFrame, days: int, now: Column) -> DataFrame:
    """Requests (with `hash`) with `cached`, the fresh entry's output or null."""
    return requests.join(fresh(cache, days, now).select("hash", F.col("output").alias("cached")), "hash", "left")


def stale(requests: DataFrame, cache: DataFrame, days: int, now: Column) -> DataFrame:
    """Entries that a lookup finds too old, to be removed."""
    return cache.join(fresh(cache, days, now).select("hash"), "hash", "left_anti").join(requests.select("hash").distinct(), "hash", "left_semi")


def upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries, which take the place of old ones of the same hash; the latest of equal ones stays."""
    columns = ["hash", "output", "model", "created_at"]
    both = cache.select(*columns, F.lit(0).alias("new")).unionByName(entries.select(*columns, F.lit(1).alias("new")))
    latest = Window.partitionBy("hash").orderBy(F.desc("new"), F.desc("created_at"), F.desc("output"))
    return both.withColumn("rank", F.row_number().over(latest)).filter("rank = 1").select(*columns)
