"""Mixing sources to target weights by hash-threshold histograms, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.tables import if_small, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Bits of the hash that a histogram resolves, and how many histograms follow each other.
BITS, LEVELS = 16, 3
#: How often the largest row that fits is taken of what a source's threshold leaves of its budget.
FILLS = 4
#: What may be left of a source's target, as a share of it, before a row is taken that goes beyond the budget.
SLACK = 0.01
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def position(*columns: Column) -> Column:
    """The place of a row in the order that thresholds cut: its hash, without the bits no histogram resolves."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS * LEVELS)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with the long-run ``target`` of each.

    Sources by code point, null last, weigh ``weights`` in turn and share the whole size. What would
    exceed ``max_repeats`` times a source's size is reshared by weight until nothing does: with
    sources ordered by size per weight, those capped come first, and the level of the others is what
    the capped leave by the weight that remains. One row per source goes through these windows.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights)) + 1).cast("double"))
    cap = F.col("source_size") * float(max_repeats)
    order = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn("n", F.row_number().over(order))
    free = F.min(F.when(F.col("level") * F.col("w") <= cap, F.struct("n", "level"))).over(whole)["level"]
    return levels.withColumn("target", F.least(cap, free * F.col("w"))).select("source", "source_size", "target")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, whole, threshold, left): take each row ``whole`` times, and once more below the threshold, which leaves ``left`` of the budget.

    ``rows``: source, size, pos. The histogram of the leading bits gives, per source, the bucket in
    which the budget ends; only the rows of that bucket are counted again by the next bits. All
    buckets before are inside the threshold, so thresholds of larger budgets hold those of smaller
    ones. A source has at most ``2 ** BITS`` buckets in a window.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    state = wanted.withColumn("whole", whole).select(
        "source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")
    )
    step = 1 << BITS
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        named = state.select(F.col("source").alias("of"), F.col("prefix").alias("within"))
        inside = rows if level == 0 else rows.join(
            named, F.col("source").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("pos", shift + BITS) == F.col("within")), "left_semi"
        )
        counts = inside.groupBy("source", F.shiftrightunsigned("pos", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = counts.withColumn("upto", F.sum("n").over(upto))
        at = summed.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        ends = at.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
        inner = at.groupBy("source").agg(F.sum("n").alias("all"))
        joined = state.join(ends.select(F.col("source").alias("of"), "b"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        joined = joined.join(inner.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        # No bucket lies past the budget: all of them are inside.
        prefix = F.coalesce(F.col("b.bucket"), (F.col("prefix") + 1) * step)
        rest = F.col("left") - F.coalesce(F.col("b.upto") - F.col("b.n"), F.col("all"), F.lit(0))
        state = written(joined.select("source", "whole", rest.alias("left"), prefix.alias("prefix")), "level")
    return state.select("source", "whole", F.col("prefix").alias("threshold"), "left")


def fills(rows: DataFrame, plan: DataFrame, times: int = FILLS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, pos, n): of the rows at ``pos``, ``n`` are taken once more than the threshold has it.

    At the threshold itself stand a row or copies of it, of which as many as fit are taken. Then, a
    few times, the largest row past it that fits into what is left: one row per source each time,
    found by a maximum. A budget is kept while at most ``SLACK`` of the target is left. Where more is, at
    last the smallest row that does not fit is taken, if the mix ends nearer to the budget with it than
    without: one not yet taken this way, below the threshold only if that leaves it within
    ``max_repeats``.
    """
    same = F.col("source").eqNullSafe(F.col("of"))
    named = if_small(plan.select(F.col("source").alias("of"), "threshold", "left"))
    there = rows.join(named, same).where((F.col("pos") == F.col("threshold")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
    first = there.groupBy("source", "pos").agg(F.max("size").alias("size"), F.count("*").alias("count"), F.first("left").alias("left"))
    n = F.least(F.col("count"), F.floor(F.col("left") / F.col("size")))
    taken = written(first.select("source", "pos", n.cast("long").alias("n"), (n * F.col("size")).cast("long").alias("words")), "fill")
    for _ in range(times):
        used = taken.groupBy("source").agg(F.sum("words").alias("used"))
        left = plan.join(used.withColumnRenamed("source", "of"), same, "left").select(F.col("source").alias("of"), "threshold", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
        before = taken.select(F.col("source").alias("s"), F.col("pos").alias("p"))
        fit = rows.join(if_small(written(left.where("left >= 1"), "left")), same).where((F.col("pos") > F.col("threshold")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
        fit = fit.join(if_small(written(before, "before")), F.col("source").eqNullSafe(F.col("s")) & (F.col("pos") == F.col("p")), "left_anti")
        best = fit.groupBy("source").agg(F.max(F.struct("size", (-F.col("pos")).alias("back"))).alias("b"))
        more = written(best.select("source", (-F.col("b.back")).alias("pos"), F.lit(1).cast("long").alias("n"), F.col("b.size").alias("words")), "fill")
        if not more.head(1):
            break
        taken = taken.unionByName(more)
    used = taken.groupBy("source").agg(F.sum("words").alias("used"))
    left = plan.join(used.withColumnRenamed("source", "of"), same, "left").select(F.col("source").alias("of"), "threshold", "whole", "target", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    over = rows.join(if_small(written(left.where(F.col("left") > SLACK * F.col("target")).drop("target"), "left")), same).where((F.col("size") > F.col("left")) & (F.col("size") < 2 * F.col("left")))
    over = over.where((F.col("pos") >= F.col("threshold")) | (F.col("whole") + 2 <= max_repeats))
    before = if_small(written(taken.select(F.col("source").alias("s"), F.col("pos").alias("p")), "before"))
    over = over.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("pos") == F.col("p")), "left_anti")
    nearest = over.groupBy("source").agg(F.min(F.struct("size", "pos")).alias("b"))
    taken = taken.unionByName(nearest.select("source", F.col("b.pos").alias("pos"), F.lit(1).cast("long").alias("n"), F.col("b.size").alias("words")))
    return written(taken.select("source", "pos", "n"), "fills")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS):
    """(rows, plan, fills): doc_id, source, size and pos of each row; what to take of each source; and of single rows."""
    rows = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), position(F.col(doc_id), F.col(text)).alias("pos")),
        "sizes",
    )
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    wanted = written(wanted, "targets")
    plan = wanted.join(thresholds(rows, wanted).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = written(plan, "plan")
    return rows, plan, fills(rows, plan, max_repeats=max_repeats)


def _planned(rows: DataFrame, plan: DataFrame, single: DataFrame) -> DataFrame:
    """``rows`` (__source, __pos, ..) with ``__times``; of rows at a place of ``single``, copies of each other, the first so many are taken once more.

    Those few rows are a table of their own, numbered within their part of it after the counts of
    the parts before, so that no task gets all copies.
    """
    named = if_small(plan.select(F.col("source").alias("__of"), F.col("whole").alias("__whole"), F.col("threshold").alias("__threshold")))
    known = rows.join(named, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    spots = if_small(single.select(F.col("source").alias("__s"), F.col("pos").alias("__p"), F.col("n").alias("__n")))
    marked = known.join(spots, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__pos") == F.col("__p")), "left")
    plain = marked.where("__n is null").withColumn("__times", F.col("__whole") + (F.col("__pos") < F.col("__threshold")).cast("int"))
    own = written(marked.where("__n is not null").withColumn("__row", F.monotonically_increasing_id()), "single")
    part = F.shiftrightunsigned("__row", 33)
    counts = own.groupBy("__s", "__p", part.alias("__part")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__s", "__p").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__s").alias("__s2"), F.col("__p").alias("__p2"), F.col("__part").alias("__part2"), before.alias("__before"))
    here = own.withColumn("__part", part).join(if_small(written(offsets, "offsets")), F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__p") == F.col("__p2")) & (F.col("__part") == F.col("__part2")))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__s", "__p", "__part").orderBy("__row"))
    return plain.unionByName(here.withColumn("__times", F.col("__whole") + (F.col("__pos") < F.col("__threshold")).cast("int") + (number <= F.col("__n")).cast("int")).select(*plain.columns))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    taken is a multiple of size, at most ``max_repeats`` times it. Rows are taken by the hash of
    their doc_id and text: reruns agree, and of copies of a row as many as fit are taken. Null texts
    have size zero, null sources are a source; an empty table gives no rows.
    """
    rows, plan, single = mix_plan(docs, **options)
    sizes = if_small(plan.select(F.col("source").alias("of"), "source_size", "target"))
    judged = _planned(rows.select("doc_id", "size", F.col("source").alias("__source"), F.col("pos").alias("__pos")), plan, single)
    return judged.join(sizes, F.col("__source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    _, plan, single = mix_plan(docs, doc_id, text, source, **options)
    named = docs.withColumn("__source", F.col(source)).withColumn("__pos", position(F.col(doc_id), F.col(text)))
    return _planned(named, plan, single).withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select(*docs.columns)
