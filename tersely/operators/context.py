"""Intents from session transcripts: the last user messages, with a budget that decays with their age.

Transcripts are tables of events: `session, n` (place) and the event's JSON, or parsed `type, is_meta, role, content`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.functions import fixed
from tersely.functions.lines import trimmed

FORMATS = ("prefix", "xml", "goal", "json")


def flatten_content(content: Column) -> Column:
    """The text of a variant: a string as it is, or the text blocks of an array, joined by line ends; else null."""
    blocks = F.filter(F.try_variant_get(content, "$", "array<struct<type:string,text:string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    texts = F.transform(blocks, lambda b: b["text"])
    whole = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.coalesce(whole, F.when(F.size(texts) > 0, F.array_join(texts, "\n")))


def parse_events(lines: DataFrame, session: str = "session", n: str = "n", value: str = "value") -> DataFrame:
    """`session, n, type, is_meta, role, text` of JSON lines; lines that aren't objects of the right types are left out."""
    event = F.try_parse_json(F.col(value))
    told = lines.select(session, n, event.alias("e")).filter("e is not null")
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    message = F.try_variant_get("e", "$.message", "variant")
    role = F.coalesce(get("$.message.role", "string"), F.lit(""))
    own = F.when(message.isNotNull(), F.when(role.isin("", "user"), flatten_content(F.try_variant_get("e", "$.message.content", "variant")))).otherwise(get("$.content", "string"))
    out = told.select(session, n, get("$.type", "string").alias("type"), F.coalesce(get("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), role.alias("role"), own.alias("text"))
    return out.filter("type is not null")


def clean_intent(text: Column) -> Column:
    """Trimmed and without command blocks; null if nothing is left; cut after 500 characters."""
    out = trimmed(text)
    for tag in fixed.INTENT_TAGS:
        out = F.regexp_replace(out, f"(?s)<{tag}>.*?</{tag}>", "")
    out = trimmed(out)
    cut = F.when(F.length(out) > fixed.INTENT_CHARS, F.concat(F.substring(out, 1, fixed.INTENT_CHARS), F.lit("..."))).otherwise(out)
    return F.when(out != "", cut)


def truncated(text: Column, most: int | Column) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.greatest(most - 3, F.lit(1))), F.lit("...")))


def user_messages(events: DataFrame, session: str = "session") -> DataFrame:
    """`session, age, turns_ago, intent`: user messages from the newest (age 0), and the assistant's turns after each."""
    newest = Window.partitionBy(session).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = events.filter("NOT is_meta").withColumn("turns_ago", F.sum(F.when(F.col("type") == "assistant", 1).otherwise(0)).over(newest))
    users = told.filter("type = 'user'").withColumn("intent", clean_intent(F.col("text"))).filter("intent is not null")
    return users.select(session, "n", "turns_ago", "intent", (F.row_number().over(Window.partitionBy(session).orderBy(F.desc("n"))) - 1).alias("age")).drop("n")


def newest_messages(events: DataFrame, most: int, session: str = "session") -> DataFrame:
    """The rows of `user_messages` of age below `most`, for sessions of any length.

    Each task keeps its newest messages of a session, and counts the assistant's turns by how many of the session's newest
    messages they follow, so no task sorts a whole session."""
    own = events.filter("NOT is_meta")
    users = own.filter("type = 'user'").select(session, "n", clean_intent(F.col("text")).alias("intent")).filter("intent is not null")
    top = users.withColumn("age", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("n"))) - 1).filter(F.col("age") < most)
    asked = top.groupBy(session).agg(F.collect_list("n").alias("asked")).withColumnRenamed(session, "of")
    turns = own.filter("type = 'assistant'").select(F.col(session).alias("s"), F.col("n").alias("at")).join(asked, F.col("s").eqNullSafe(F.col("of")))
    # A turn after m of the newest messages comes after those of age m - 1 and more, counted from the oldest of them.
    passed = turns.select("of", (F.size("asked") - F.size(F.filter("asked", lambda n: n < F.col("at")))).alias("youngest")).groupBy("of", "youngest").agg(F.count("*").alias("turns"))
    counts = passed.groupBy("of").agg(F.collect_list(F.struct("youngest", "turns")).alias("counts"))
    told = top.join(counts, F.col(session).eqNullSafe(F.col("of")), "left")
    later = F.aggregate(F.filter("counts", lambda c: c["youngest"] <= F.col("age")), F.lit(0).cast("long"), lambda total, c: total + c["turns"])
    return told.select(session, F.coalesce(later, F.lit(0).cast("long")).alias("turns_ago"), "intent", "age")


def intent(events: DataFrame, most: int = 3, session: str = "session") -> DataFrame:
    """`session, intent, turns_ago`: the newest message, or up to five with budgets, the oldest first."""
    messages = newest_messages(events, max(1, min(most, len(fixed.INTENT_BUDGETS))), session)
    if most <= 1:
        return messages.filter("age = 0").select(session, "intent", "turns_ago")
    few = messages.filter(F.col("age") < min(most, len(fixed.INTENT_BUDGETS)))
    budget = F.array(*(F.lit(max(int(fixed.INTENT_CHARS * b), fixed.INTENT_LEAST)) for b in fixed.INTENT_BUDGETS))
    label = F.when(F.col("age") == 0, "Current:").otherwise(F.concat(F.lit("Earlier ("), "turns_ago", F.lit(" turns ago):")))
    part = F.concat(label, F.lit(" "), truncated(F.col("intent"), budget[F.col("age")]))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("o"), part.alias("v")))), lambda x: x["v"])
    out = few.groupBy(session).agg(F.count("*").alias("n"), F.array_join(ordered, " | ").alias("all"), F.min_by("intent", "age").alias("one"), F.min_by("turns_ago", "age").alias("turns_ago"))
    return out.select(session, F.when(F.col("n") == 1, F.col("one")).otherwise(truncated(F.col("all"), fixed.INTENT_CHARS)).alias("intent"), "turns_ago")


def format_context(text: Column, form: str) -> Column:
    """The intent as the beginning of a prompt."""
    before, after = fixed.CONTEXT_FORMS.get(form, fixed.CONTEXT_FORMS["prefix"])
    shown = F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")) if form == "json" else text
    return F.concat(F.lit(before), shown, F.lit(after))


def chosen_context(explicit: Column, found: Column, enabled: bool = True) -> Column:
    """An explicit context that isn't blank, else the transcript's, else none."""
    if not enabled:
        return F.lit("")
    return F.coalesce(F.when(trimmed(explicit) != "", explicit), found, F.lit(""))
