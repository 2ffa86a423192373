"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is bisected in
[0, 1]: it is the largest whose weights have the target entropy (a share of the greatest possible), or, where small sources would
then repeat beyond the limit, the smallest that keeps to the limit. A source's budget is its weight's part of the whole budget,
and never more than the limit times its tokens.

Each epoch of a source is a permutation of blocks and of the documents in a block, both by MD5 of seed, epoch and
doc_id. Whole epochs take all documents; the last takes documents in order while they fit the rest of the budget, by sums
over blocks first, so a source with a third of all rows is spread over many tasks. `position` runs from 0 to 1 within each
source: a reader in the order of (position, key) meets the sources at their weights throughout.

Tokens are bytes / 4, rounded up, at least 1 a document (a null text counts as empty). A null source is a source of its
own, a null doc_id hashes as the empty string; documents equal in doc_id, source and size tie and take the same block.
An empty table gives an empty one. Other columns are left alone. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import durable, quoted

#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
BLOCK_TOKENS = 1 << 18
#: Levels of bisection in all, and in one pass over the sources.
LEVELS, LEVELS_A_PASS = 45, 5


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def bisect(sources: DataFrame, total: int, n: int, entropy_share: float, repeats: float, budget: int) -> float:
    """The exponent. Each pass evaluates the midpoints of the next levels at once, over the sources' table."""
    low, width, left = 0.0, 1.0, LEVELS
    p = F.col("tokens") / F.lit(float(total))
    target = F.lit(entropy_share) * F.log(F.lit(float(n)))

    def evaluate(points: list[float]) -> dict[float, tuple[bool, bool]]:
        at = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        z = at.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l"), F.min("p").alias("low"))
        entropy = F.log("z") - F.col("a") * F.col("l") / F.col("z")
        most = F.pow("low", F.col("a") - 1) / F.col("z") * F.lit(budget / total)
        return {r.a: (r.even, r.within) for r in z.select("a", (entropy >= target).alias("even"), (most <= F.lit(repeats)).alias("within")).collect()}

    ends = evaluate([0.0, 1.0])
    # Entropy falls and repetition falls as the exponent grows: the limit, where it binds, decides.
    lows = {"even": 0.0, "within": 0.0}
    for name, k, wanted in (("even", 0, True), ("within", 1, False)):
        if ends[1.0][0] and k == 0 or k == 1 and not ends[1.0][1]:
            lows[name] = 1.0
            continue
        if k == 1 and ends[0.0][1]:
            continue
        low, width, left = 0.0, 1.0, LEVELS
        while left > 0:
            step = min(LEVELS_A_PASS, left)
            cells = 1 << step
            points = [low + width * i / cells for i in range(1, cells)]
            told = evaluate(points)
            lo, hi = 0, cells
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if told[points[mid - 1]][k] == wanted else (lo, mid)
            low, width, left = low + width * lo / cells, width / cells, left - step
        lows[name] = low if k == 0 else low + width
    return max(lows["even"], lows["within"])


def budgets(docs: DataFrame, entropy_share: float, repeats: float, budget_share: float) -> DataFrame:
    """`source, tokens, exponent, weight, budget` of each source."""
    sources = durable(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return sources.select("source", "tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    budget = int(total * budget_share)
    exponent = bisect(sources, total, n, entropy_share, repeats, budget)
    raised = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    whole = sources.agg(F.sum(raised)).first()[0]
    out = sources.select("source", "tokens", F.lit(exponent).alias("exponent"), (raised / F.lit(whole)).alias("weight"))
    return out.withColumn("budget", F.least(F.floor(F.col("weight") * budget + 1e-6), F.floor(F.col("tokens") * repeats)).cast("long"))


def mix_sources(
    docs: DataFrame,
    entropy_share: float = 0.95,
    repeats: float = 4.0,
    budget_share: float = 1.0,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per taken copy of a document: `doc_id, source, tokens, epoch, block, position, key`, and the columns to `carry`."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"), tokens_of(quoted(text_col).cast("string")).alias("tokens"), *carry)
    sources = budgets(rows, entropy_share, repeats, budget_share).select(
        F.col("source").alias("of"),
        F.col("tokens").alias("all_tokens"),
        "budget",
        F.ceil(F.col("tokens") / block_tokens).cast("long").alias("blocks"),
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"),
    )
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    joined = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("all_tokens"))
    copies = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.greatest(F.col("whole") - 1, F.lit(0))))))
    copies = copies.filter("budget > 0").withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    copies = copies.withColumn("block", F.pmod(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), F.col("blocks")))
    full = copies.filter("epoch < whole")
    last = copies.filter("epoch >= whole")
    sums = last.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "tokens", *carry).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = last.withColumn("upto", F.sum("tokens").over(within))
    taken = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).filter(F.col("start") + F.col("upto") <= F.col("rest"))
    # Of a source's run of blocks over all its epochs, the last cut off where the budget ends.
    position = F.least(F.lit(1.0), (F.col("epoch") * F.col("all_tokens") + F.col("block") * F.col("all_tokens") / F.col("blocks")) / F.col("budget"))
    return full.unionByName(taken.select(*full.columns)).select("doc_id", "source", "tokens", "epoch", "block", F.round(position, 9).alias("position"), "key", *carry)
