"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Every source is a flow. Its documents are served in a shuffled order that only
depends on their ids and texts, up to ``max_repeats`` times over. A served document's
virtual finish time is the flow's cumulative number of words divided by the
flow's target. Serving in the order of finish times and stopping at the total
budget takes from each source about its target, and the order itself interleaves
the sources evenly.

Nothing here depends on the number of documents of one source: the running sums
are taken within slices of the shuffled order, over slices that were summed
before, and the global order is cut in the same way. Only tables of one row for
each source or slice meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.llm.common import SPACE
from trialloom.staging import stage

#: Weights of the sources in code-point order, repeating; the null source comes last.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slices of each source's shuffled order: the first hex digits of its key.
SLICE_DIGITS = 3
#: Cells of the finish times; the one that holds the end of the budget is sorted.
CELLS = 4096


def document_size(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A pseudo-random key that reruns agree on, of id and text; a null id counts as ``null``, a null text as empty."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def place(key: Column, number: Column) -> Column:
    """The place in the shuffled order of the ``number``-th (from 0) of the equal rows with one key."""
    return F.when(number == 0, key).otherwise(F.md5(F.concat(key, F.lit(":"), number.cast("string"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each source: source, source_size, target.

    Targets share the total size by weight. A target stops at ``max_repeats``
    times its source's size; the excess is shared again by weight among the
    others until none is above. That is a common level: target = min(limit,
    level * weight). Sources reach their limits in the order of limit / weight,
    so running sums in that order give the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit(list(weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", weight.alias("weight")).withColumn("limit", max_repeats * F.col("source_size"))
    every = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(W.unboundedPreceding, -1)
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(
        "*",
        F.sum("source_size").over(whole).alias("_total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("_below"),
        F.sum("weight").over(every.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
    )
    level = (F.col("_total") - F.col("_below")) / F.col("_open")
    per = per.withColumn("_level", level.cast("double"))
    # The first source, in limit order, that the level does not fill fixes the level for all after it.
    fills = F.col("limit") > F.col("_level") * F.col("weight")
    fixed = F.min(F.when(fills, F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("_level").alias("level")))).over(whole)
    per = per.withColumn("_fixed", fixed["level"])
    target = F.when(F.col("_fixed").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("_fixed") * F.col("weight")))
    return per.select("source", "source_size", F.col("_total").alias("budget"), target.alias("target"))


OWN = ("size", "source_size", "target", "served", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``served`` and ``taken``.

    ``served`` is how many times the document is taken (0 to ``max_repeats``),
    ``taken`` the words this gives. Columns of the input with one of these names
    are replaced. Rows are documents of their own, also where they repeat an id or
    have none: each has a place in the order. Of rows equal in id, source and text
    any may be the one that is served once more. Texts without words have size 0 and
    serve nothing; a null source is a source; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in OWN]
    return _mix(docs, weights, max_repeats).select(*[F.col(f"_in{docs.columns.index(c)}").alias(c) for c in kept], *OWN)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs`` as they are, each row as often as it is served."""
    out = _mix(docs, WEIGHTS, MAX_REPEATS).filter("served > 0")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("served"))))
    return out.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])


def _mix(docs: DataFrame, weights, max_repeats: int) -> DataFrame:
    """The columns of ``docs`` as _in0, _in1, ... and those of ``OWN``."""
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[F.col(c).alias(name) for c, name in at.items()])
    sized = given.withColumns(
        {
            "size": document_size(F.col(at["text"])),
            "source": F.col(at["source"]),
            "_key": shuffle_key(F.col(at["doc_id"]), F.col(at["text"])),
        }
    )
    equal = stage(sized.groupBy("source", "_key").agg(F.max("size").alias("size"), F.count("*").alias("_n")), "mix-rows")
    targets = stage(source_targets(equal.select("source", (F.col("size") * F.col("_n")).alias("size")), weights, max_repeats), "mix-targets")
    cuts = stage(_cuts(_entries(equal.filter("size > 0")), targets, max_repeats), "mix-cuts")
    about = targets.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    # Spark knows a written table's size, not a join's: the texts need no shuffle where the sources are few.
    about = stage(about, "mix-sources")

    # Which of equal rows is which: as a rule there are none.
    repeated = equal.filter("_n > 1 and size > 0").select(F.col("source").alias("_r"), F.col("_key").alias("_k"))
    same = F.col("source").eqNullSafe(F.col("_r")) & (F.col("_key") == F.col("_k"))
    if repeated.isEmpty():
        placed = sized.withColumn("_place", F.col("_key"))
    else:
        alone = sized.join(repeated, same, "left_anti").withColumn("_place", F.col("_key"))
        placed = alone.unionByName(_numbered(sized.join(repeated, same, "left_semi")))
    out = placed.join(about, F.col("source").eqNullSafe(F.col("_s")), "left")
    partial = F.when(F.col("_place") <= F.col("key"), 1).otherwise(0)
    served = F.when(F.col("size") > 0, F.coalesce(F.col("round") + partial, F.lit(0))).otherwise(0)
    return out.select(*at.values(), "size", "source_size", "target", served.cast("int").alias("served"), (F.col("size") * served).cast("long").alias("taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the place of each among those that equal it.

    Numbers run within parts of the table and start where the parts before end, so a
    row that a third of the table repeats does not meet in one task.
    """
    rows = stage(rows.withColumn("_part", F.spark_partition_id()), "mix-repeated")
    parts = rows.groupBy("source", "_key", "_part").agg(F.count("*").alias("_rows"))
    earlier = W.partitionBy("source", "_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_r"), F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("source").eqNullSafe(F.col("_r")) & (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p"))
    inside = F.row_number().over(W.partitionBy("source", "_key", "_part").orderBy("_part"))
    columns = [c for c in rows.columns if c != "_part"]
    placed = rows.withColumn("_inside", inside).join(parts, same)
    return placed.select(*columns, place(F.col("_key"), F.col("_before") + F.col("_inside") - 1).alias("_place"))


#: Equal rows that one task makes entries of.
CHUNK = 4096


def _entries(equal: DataFrame) -> DataFrame:
    """source, _key (its place) and size of every row, from the counts of equal rows."""
    once = equal.filter("_n = 1").select("source", "_key", "size")
    chunks = equal.filter("_n > 1").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / CHUNK))))
    chunks = chunks.repartition("_key", "_chunk")
    first = F.col("_chunk") * CHUNK
    more = chunks.withColumn("_number", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("_n")) - 1)))
    return once.unionByName(more.select("source", place(F.col("_key"), F.col("_number")).alias("_key"), "size"))


def _cuts(keyed: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """One row for each source that serves: full rounds and the last key of the next one."""
    keyed = keyed.withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    slices = keyed.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("_source"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    placed = keyed.join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_s")))
    inside = W.partitionBy("source", "_slice").orderBy("_key")
    placed = placed.select("source", "_key", "size", (F.col("_before") + F.sum("size").over(inside)).alias("_upto"))
    known = targets.filter("target > 0").select(F.col("source").alias("_source"), "source_size", "target", "budget")
    rounds = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("round", F.explode(F.lit(list(range(max_repeats)))))
    finish = (F.col("_upto") + F.col("round") * F.col("source_size")).cast("double") / F.col("target")
    queue = rounds.select("source", "_key", "size", "round", "budget", finish.alias("_finish"))
    # No finish time within the budget lies far above 1: targets sum up to the budget.
    queue = queue.withColumn("_cell", F.least(F.floor(F.col("_finish") * (CELLS // 2)), F.lit(CELLS)))
    cells = queue.groupBy("_cell").agg(F.sum("size").alias("_words"), F.max("budget").alias("budget"))
    upto = F.sum("_words").over(W.orderBy("_cell"))
    cells = cells.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_words") < F.col("budget"))
    cells = cells.select(F.col("_cell").alias("_c"), (F.col("_upto") - F.col("_words")).alias("_before"), (F.col("_upto") <= F.col("budget")).alias("_whole"))
    queue = queue.join(F.broadcast(cells), F.col("_cell") == F.col("_c"))
    order = W.partitionBy("_cell").orderBy("_finish", "_key", F.col("source").asc_nulls_last(), "round")
    edge = queue.filter(~F.col("_whole")).withColumn("_upto", F.col("_before") + F.sum("size").over(order)).filter("_upto <= budget")
    served = queue.filter("_whole").select("source", "round", "_key").unionByName(edge.select("source", "round", "_key"))
    last = F.max(F.struct("round", F.col("_key").alias("key")))
    return served.groupBy("source").agg(last.alias("_last")).select("source", "_last.round", "_last.key")
