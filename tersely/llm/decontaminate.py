"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, in lower case. A mask selects some of the places of a window; the hash of the words
there ignores the others, so windows that differ by a substitution at an ignored place share a seed. Documents' seeds are
joined with the benchmark's; each hit gives a document, an item and their alignment, which is verified word by word: a
matching word scores 1, a substituted one -SUBSTITUTION, and the best segment must score MIN_SCORE or more. Items that are too
short for that with some words substituted are taken whole: it is enough that MIN_SHARE percent of an item's words match.

Items of fewer than LEAST_WORDS words have no window and never match; null texts count as empty; null ids are
carried; repeated rows give the same result once; empty tables give an empty one; other columns are left alone.
Built-in functions only. The benchmark is broadcast up to BROADCAST_SEEDS and BROADCAST_BYTES of words, beyond that joined by
shuffle. Seeds travel without words; hits bring the words of their documents back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import durable, keyed, quoted

#: Places of each mask that count, from 0.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 4, 6, 8, 9))
SUBSTITUTION = 2
MIN_SCORE, MIN_SHARE = 12, 75
LEAST_WORDS = min(m[-1] for m in MASKS) + 1
BROADCAST_SEEDS, BROADCAST_BYTES = 500_000, 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds_of(hashes: Column, mask: int) -> Column:
    """Seeds of a mask by the place of their window."""
    span = MASKS[mask][-1] + 1
    windows = F.sequence(F.lit(0), F.size(hashes) - span)
    seeds = F.transform(windows, lambda i: F.xxhash64(F.lit(mask), *(hashes[i + o] for o in MASKS[mask])))
    return F.when(F.size(hashes) >= span, seeds).otherwise(F.array().cast("array<long>"))


def seeded(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep, mask, p, seed`: each window's seed and place; words stay behind."""
    hashed = table.select(*keep, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    both = hashed.select(*keep, F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), seeds_of(F.col("h"), m).alias("seeds")) for m in range(len(MASKS))))).alias("of"))
    return both.select(*keep, F.col("of.mask").alias("mask"), F.posexplode("of.seeds").alias("p", "seed"))


def score(pairs: Column) -> Column:
    """`(best, matched)`: the greatest score of a segment of word matches, and its matching words."""
    zero = F.struct(*(F.lit(0).alias(n) for n in ("now", "same", "best", "matched")))

    def step(s: Column, equal: Column) -> Column:
        now = F.greatest(s["now"] + F.when(equal, 1).otherwise(-SUBSTITUTION), F.lit(0))
        same = F.when(now == 0, 0).otherwise(s["same"] + F.when(equal, 1).otherwise(0))
        better = now > s["best"]
        return F.struct(now.alias("now"), same.alias("same"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, same).otherwise(s["matched"]).alias("matched"))

    return F.aggregate(pairs, zero, step, lambda s: F.struct(s["best"].alias("best"), s["matched"].alias("matched")))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`doc_id, rk, item_id, score, n_matched`: the best overlap of each document with each item it contains."""
    items = benchmark.select(quoted(item_col).cast("long").alias("item_id"), F.coalesce(quoted(item_text_col).cast("string"), F.lit("")).alias("item_text"))
    items = items.withColumn("item_key", F.xxhash64("item_id", "item_text")).distinct()
    items = items.withColumn("item_words", words_of(F.col("item_text"))).filter(F.size("item_words") >= LEAST_WORDS).drop("item_text")
    known = seeded(items.select("item_key", F.size("item_words").alias("length"), F.array_join("item_words", " ").alias("t")), "t", "item_key", "length")
    known = known.select("item_key", "length", "mask", F.col("p").alias("at"), "seed")
    n_seeds, n_bytes = known.agg(F.count("*")).first()[0], items.agg(F.sum(F.octet_length(F.array_join("item_words", " ")).cast("long"))).first()[0] or 0
    few = (lambda table: F.broadcast(table)) if n_seeds <= BROADCAST_SEEDS and n_bytes <= BROADCAST_BYTES else (lambda table: table)
    rows = keyed(docs, id_col, text_col)
    hits = seeded(rows, "text", "doc_id", "rk").join(few(known), ["mask", "seed"])
    once = hits.select("doc_id", "rk", "item_key", "length", (F.col("p") - F.col("at")).alias("shift")).distinct()
    # The words come back for the rows with hits only. Rows that are equal in id and text are taken once.
    found = durable(once.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("item_key", "length", "shift")).alias("hits")), "hits")
    own = found.select(F.col("doc_id").alias("id"), F.col("rk").alias("key"), "hits")
    texts = rows.join(own, (F.col("rk") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("doc_id", "rk").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    worded = texts.select("doc_id", "rk", words_of(F.col("text")).alias("words"), "hits")
    # The document's words beside the item's; where the item runs out of the document, only those that are there.
    beside = lambda h: F.slice(F.col("words"), F.greatest(h["shift"], F.lit(0)) + 1, h["length"] + F.least(h["shift"], F.lit(0)))
    parts = worded.select("doc_id", "rk", F.explode(F.transform("hits", lambda h: F.struct(h["item_key"].alias("item_key"), h["shift"].alias("shift"), beside(h).alias("part")))).alias("hit"))
    compared = parts.select("doc_id", "rk", "hit.item_key", "hit.shift", "hit.part").join(few(items), "item_key")
    own = F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("part"))
    compared = compared.select("doc_id", "rk", "item_id", F.size("item_words").alias("length"), F.zip_with("part", own, lambda a, b: a == b).alias("same"))
    compared = compared.select("doc_id", "rk", "item_id", "length", F.size(F.filter("same", lambda x: x)).alias("all"), score(F.col("same")).alias("found"))
    whole = 100 * F.col("all") >= MIN_SHARE * F.col("length")
    return compared.filter((F.col("found.best") >= MIN_SCORE) | whole).groupBy("doc_id", "rk", "item_id").agg(F.max("found.best").cast("long").alias("score"), F.max("found.matched").cast("long").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The table without the documents that contain an item."""
    found = contaminated(docs, benchmark, id_col, text_col, **columns).select("doc_id", "rk").distinct()
    own = quoted(id_col).cast("long")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(own.alias("own_id"), F.xxhash64(own, text).alias("own_rk"), F.struct("*").alias("row"))
    return rows.join(found, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_rk") == F.col("rk")), "left_anti").select("row.*")
