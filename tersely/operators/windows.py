"""Line operators as ordered windows over exploded lines (`key, n, line`). One exchange by key serves any chain of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.functions import fixed, text
from tersely.functions.lines import is_blank, islands, left_trimmed, ordered
from tersely.session import checkpointed


def starts_run(name: str, alone: Column, key: str) -> Column:
    """Whether a line starts a run: it stands alone, the one before does, or their values differ."""
    w = ordered(key)
    before = F.lag(name).over(w)
    return alone | F.coalesce(F.lag("alone").over(w), F.lit(True)) | before.isNull() | (F.col(name) != before)


def template_dedup(lines: DataFrame, key: str = "doc_id", unicode: bool = True) -> DataFrame:
    """`key, n, line, count`: runs of lines of one template as their first line, with a count where it is over one."""
    made = lines.withColumn("alone", is_blank(F.col("line")) | text.is_marker(F.col("line"))).withColumn("tpl", text.template(F.col("line"), unicode))
    runs = islands(made.withColumn("start", starts_run("tpl", F.col("alone"), key)), F.col("start"), key)
    out = runs.groupBy(key, "run").agg(F.min("n").alias("n"), F.min_by("line", "n").alias("first"), F.count("*").alias("count"))
    shown = F.when(F.col("count") > 1, F.concat(F.lit(fixed.RUN_MARK), F.col("count"), F.lit("] "), F.col("first"))).otherwise(F.col("first"))
    return out.select(key, "n", shown.alias("line"), "count")


def collapse_blanks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each run of blank lines; none at the end."""
    marked = lines.withColumn("blank", is_blank(F.col("line")))
    whole = Window.partitionBy(key)
    last = F.max(F.when(~F.col("blank"), F.col("n"))).over(whole)
    told = marked.withColumn("again", F.col("blank") & F.coalesce(F.lag("blank").over(ordered(key)), F.lit(False))).withColumn("last", last)
    return told.filter(~F.col("again") & (F.col("n") <= F.col("last"))).select(key, "n", "line")


def drop_passing_tests(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without passing tests, in the documents that are test output."""
    told = lines.withColumn("tests", F.max(text.is_test_output(F.col("line"))).over(Window.partitionBy(key)))
    return told.filter(~(F.col("tests") & text.is_passing_test(F.col("line")))).select(key, "n", "line")


def unit_starts(lines: DataFrame, size: Column, most: int, key: str = "doc_id") -> DataFrame:
    """The lines with `size` (of the unit that a line would begin, 0 for none, at most `most`) and `first`: whether a unit or a
    line of its own begins here, going on from the document's first line and from the end of each unit.

    Going on is a machine whose state is how many lines of a unit are still to come, so each line is a function from state to
    state. Functions of neighbours are joined in pairs, of those pairs, and so on: after t rounds a line holds what the
    2^t lines up to it do together, by a lag over the same partitions and order, so all rounds share one exchange. Rounds are
    only needed for the longest stretch in which the state depends on what was before: a line that no unit can reach ends it."""
    w = ordered(key)
    told = lines.withColumn("size", size)
    if most < 2:
        return told.withColumn("first", F.lit(True))
    place = F.row_number().over(w)
    reach = F.max(F.when(F.col("size") > 1, F.col("place") + F.col("size") - 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("place", place)
    sure = F.coalesce(reach < F.col("place"), F.lit(True))  # no unit that might begin before reaches this line
    stretches = islands(told.withColumn("sure", sure), F.col("sure"), key)
    longest = stretches.groupBy(key, "run").agg(F.count("*").alias("lines")).agg(F.max("lines")).first()[0] or 1
    step = F.array(F.greatest(F.col("size"), F.lit(1)) - 1, *(F.lit(s - 1) for s in range(1, most)))
    told = told.withColumn("then", step)
    for t in range(max(0, longest - 2).bit_length()):
        before = F.lag("then", 1 << t).over(w)
        told = told.withColumn("then", F.when(before.isNull(), F.col("then")).otherwise(F.transform(before, lambda s: F.col("then")[s])))
    # A sure line's state is 0 whatever was before; others follow from the line before, whose function covers its stretch.
    return told.withColumn("first", F.coalesce(F.lag("then").over(w)[0] == 0, F.lit(True))).drop("then", "place")


def collapse_units(lines: DataFrame, size: Column, most: int, least: int, summary: Column, keep_last: bool, key: str = "doc_id") -> DataFrame:
    """Runs of at least `least` units that follow one another as the first unit, `summary` (of `count` units and the `head`
    line of the first), and maybe the last unit. `size`: lines of the unit that begins at a line, 0 for none, at most `most`."""
    w = ordered(key)
    told = unit_starts(lines, size, most, key).withColumn("unit", F.col("first") & (F.col("size") > 0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # The unit that holds a line: the last that begins up to it; lines of their own hold themselves.
    told = told.withColumn("holder", F.last(F.when(F.col("first"), F.struct("n", "unit")), True).over(upto))
    inside = F.col("holder.unit")
    told = told.withColumn("inside", inside)
    runs = islands(told, ~F.col("inside") | ~F.coalesce(F.lag("inside").over(w), F.lit(False)), key)
    within = Window.partitionBy(key, "run")
    count = F.count(F.when(F.col("unit"), 1)).over(within)
    last = F.max(F.when(F.col("unit"), F.col("n"))).over(within)
    sized = runs.withColumn("count", count).withColumn("head", F.min_by("line", "n").over(within)).withColumn("begin", F.min("n").over(within)).withColumn("last", last)
    folded = F.col("inside") & (F.col("count") >= least)
    in_first, in_last = F.col("holder.n") == F.col("begin"), F.col("holder.n") == F.col("last")
    # The last line of a folded run's first unit carries the summary with it.
    ends = folded & in_first & (F.col("n") == F.max(F.when(in_first, F.col("n"))).over(within))
    kept = sized.withColumn("ends", ends).filter(~folded | in_first | (F.lit(keep_last) & in_last))
    rows = F.when(F.col("ends"), F.array("line", summary)).otherwise(F.array("line"))
    return kept.select(key, "n", F.posexplode(rows).alias("part", "line")).select(key, (F.col("n") * 2 + F.col("part")).alias("n"), "line")


def frame_size(key: str = "doc_id") -> Column:
    """Lines of the framework frame that would begin at a line: 0 for none, 2 where a source line belongs to it."""
    line, after = F.col("line"), F.lead("line").over(ordered(key))
    t, body = left_trimmed(line), left_trimmed(after)
    python = t.startswith('File "') & after.startswith("    ") & (body != "") & ~text.any_of([body.startswith(p) for p in ('File "', "at ", "from ")])
    go = t.startswith("runtime.") & after.startswith("\t") & body.contains(".go:")
    return F.when(~text.is_framework_frame(line), 0).when(F.coalesce(python | go, F.lit(False)), 2).otherwise(1)


def collapse_frames(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of three framework frames or more as the first, then how many were left out."""
    indent = F.regexp_extract("head", r"(?U)^(\s*)", 1)
    summary = F.concat(indent, F.lit("... "), (F.col("count") - 1).cast("string"), F.lit(f" {fixed.OMITTED}"))
    return collapse_units(lines.withColumn("frame", frame_size(key)), F.col("frame"), 2, fixed.FRAME_RUN, summary, False, key)


def merge_prefixes(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Neighbouring lines of one prefix as the prefix and the rests, joined by commas."""
    made = lines.withColumn("prefix", text.line_prefix(F.col("line")))
    made = made.withColumn("alone", F.octet_length("prefix") < 4)
    runs = islands(made.withColumn("start", starts_run("prefix", F.col("alone"), key)), F.col("start"), key)
    rest = F.substring(F.col("line"), F.length("prefix") + 1, F.length("line"))
    rests = F.transform(F.array_sort(F.collect_list(F.struct("n", rest.alias("v")))), lambda x: x["v"])
    out = runs.groupBy(key, "run").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("count"), F.min("line").alias("only"), rests.alias("rests"))
    merged = F.when(F.col("count") > 1, F.concat("prefix", F.array_join("rests", ", "))).otherwise(F.col("only"))
    return out.select(key, "n", merged.alias("line"))


def shared(a: Column, b: Column) -> Column:
    """Characters of the common prefix of two strings, bit by bit from the highest: as many comparisons as the length has bits."""
    most = F.least(F.length(a), F.length(b))
    bits = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def longer(size: Column, bit: Column) -> Column:
        more = size + F.pow(F.lit(2), bit).cast("int")
        return F.when((more <= most) & (F.substring(a, F.lit(1), more) == F.substring(b, F.lit(1), more)), more).otherwise(size)

    return F.aggregate(bits, F.lit(0), longer)


def common_prefix(lines: DataFrame, least_lines: int = 4, key: str = "doc_id") -> DataFrame:
    """`key, lines, begin, prefix`: what all lines of a document, the first numbered `begin`, begin with, if there are enough
    lines and two characters of it.

    Of strings in order, the common prefix of all is that of the least and the greatest."""
    ends = lines.groupBy(key).agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("lines"), F.min("n").alias("begin"))
    out = ends.withColumn("size", shared(F.col("a"), F.col("b")))
    return out.filter((F.col("lines") >= least_lines) & (F.col("size") >= 2)).select(key, "lines", "begin", F.substring("a", F.lit(1), F.col("size")).alias("prefix"))


def best_prefix(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, prefix, saved`: the prefix that the first round of prefix factoring picks: neighbours in order, least common prefixes.

    It is `kernels.clusters` cut to one round, as windows: lines are sorted within their document and never joined with prefixes.
    A prefix's lines end where its bytes followed by FF, which no text holds, would stand among them."""
    usable = lines.filter(~is_blank(F.col("line")) & ~text.is_marker(F.col("line"))).select(key, "n", "line", F.encode("line", "UTF-8").alias("bytes"))
    w = Window.partitionBy(key).orderBy("bytes", "n")
    ahead = usable.withColumn("at", F.row_number().over(w)).withColumn("last", F.lead("line", fixed.CLUSTER_LINES - 1).over(w)).filter("last is not null")
    made = ahead.withColumn("prefix", F.substring("line", F.lit(1), shared(F.col("line"), F.col("last")))).filter(F.octet_length("prefix") >= fixed.CLUSTER_BYTES)
    starts = made.groupBy(key, "prefix").agg(F.min("at").alias("at"))
    ends = starts.select(key, F.concat(F.encode("prefix", "UTF-8"), F.unhex(F.lit("FF"))).alias("bytes"), "prefix", "at")
    both = usable.select(key, "bytes").unionByName(ends, allowMissingColumns=True)
    upto = F.count(F.when(F.col("prefix").isNull(), 1)).over(Window.partitionBy(key).orderBy("bytes").rowsBetween(Window.unboundedPreceding, 0))
    saved = both.withColumn("upto", upto).filter("prefix is not null").withColumn("saved", (F.octet_length("prefix") * (F.col("upto") - F.col("at") + 1)).cast("long"))
    worth = saved.filter(F.col("saved") > F.octet_length("prefix") + fixed.CLUSTER_OVERHEAD)
    first = worth.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("saved"), "at"))).filter("rank = 1")
    return first.select(key, "prefix", "saved")


def factor_ends(lines: DataFrame, reverse: bool = False, key: str = "doc_id") -> DataFrame:
    """All rounds of prefix factoring (of suffixes, on lines read backwards): each round picks a prefix a document, and its lines
    leave the next one. Lines of a picked prefix, the longest one first, come under a header that stands before the first.

    A round only looks at documents in which the last one found something; what rounds find is a row a document, checkpointed."""
    line = F.reverse("line") if reverse else F.col("line")
    base = lines.filter(~text.is_marker(F.col("line"))).select(key, "n", line.alias("line")) if reverse else lines.select(key, "n", "line")
    rounds: list[DataFrame] = []
    usable = base
    while len(rounds) < fixed.CLUSTERS:
        found = checkpointed(best_prefix(usable, key).select(F.col(key).alias("of"), "prefix", F.lit(len(rounds)).alias("round")))
        if found.isEmpty():
            break
        rounds.append(found)
        known = reduce(DataFrame.unionByName, rounds).groupBy("of").agg(F.collect_list("prefix").alias("gone"), F.max("round").alias("last")).filter(F.col("last") == len(rounds) - 1)
        usable = base.join(known, F.col(key).eqNullSafe(F.col("of"))).filter(~F.exists("gone", lambda p: F.col("line").startswith(p))).select(key, "n", "line")
    if not rounds:
        return lines.select(key, "n", "line")
    picked = F.transform(F.array_sort(F.collect_list(F.struct((-F.octet_length("prefix")).alias("o"), "round", "prefix"))), lambda x: x["prefix"])
    own = reduce(DataFrame.unionByName, rounds).groupBy("of").agg(picked.alias("picked"))
    told = lines.select(key, "n", "line", line.alias("turned")).join(own, F.col(key).eqNullSafe(F.col("of")), "left")
    mine = F.when(~text.is_marker(F.col("line")), F.get(F.filter("picked", lambda p: F.col("turned").startswith(p)), F.lit(0)))
    told = told.withColumn("mine", mine).withColumn("begin", F.min("n").over(Window.partitionBy(key, "mine")))
    header, mark = (fixed.SUFFIX_HEADER, fixed.SUFFIX_ROW) if reverse else (fixed.PREFIX_HEADER, fixed.PREFIX_ROW)
    rest = F.substring("turned", F.length("mine") + 1, F.length("turned"))
    turn = F.reverse if reverse else lambda c: c
    row = F.concat(F.lit(mark), turn(rest))
    rows = F.when(F.col("mine").isNull(), F.array("line")).when(F.col("n") == F.col("begin"), F.array(F.concat(F.lit(f"{header} "), turn(F.col("mine")), F.lit(" ──")), row)).otherwise(F.array(row))
    return told.select(key, "n", F.posexplode(rows).alias("part", "line")).select(key, (F.col("n") * 2 + F.col("part")).alias("n"), "line")


def drop_lines(lines: DataFrame, test: Column, key: str = "doc_id") -> DataFrame:
    return lines.filter(~test).select(key, "n", "line")


def tail_without(lines: DataFrame, unwanted: Column, key: str = "doc_id") -> DataFrame:
    """Without the lines after the last that is neither blank nor unwanted; documents of no other lines stay whole."""
    real = F.max(F.when(~unwanted & ~is_blank(F.col("line")), F.col("n"))).over(Window.partitionBy(key))
    return lines.withColumn("real", real).filter(F.col("real").isNull() | (F.col("n") <= F.col("real"))).select(key, "n", "line")


def is_prose(line: Column) -> Column:
    t = F.lower(left_trimmed(line))
    return text.any_of([t.startswith(p) for p in fixed.PROSE_STARTS]) | text.any_of([t.contains(p) for p in fixed.PROSE_PARTS])
