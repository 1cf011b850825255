"""Mixing sources to target weights (operator 8): a time-varying curriculum, in DataFrame operations.

Each source's weight schedule is integrated to a cumulative demand of words, the demand is inverted to
give every document its training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import work

#: Rows of one source that a bucket of the running sums holds on average, and the most hex digits of
#: the order key that name a bucket.
BUCKET_ROWS, MOST_DIGITS = 256, 5
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most_times: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size).

    Sources take ``weights`` in turn by code point, null last, and share ``share`` of all words.  A
    target stops at ``most_times`` its source's size and the excess is shared again by weight until
    none is above: the level L with sum(min(cap, L * weight)) = all words, found in one pass over the
    sources sorted by cap / weight.  One row per source, so the unpartitioned windows stay small.
    """
    w = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("*", w.cast("long").alias("w"), (F.col("source_size") * most_times).alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    left = (total * F.lit(share) if share != 1.0 else total) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    by = F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = ranked.select("cap", "w", F.row_number().over(filling).alias("i"), left.alias("left"), by.alias("by"))
    level = steps.where(F.col("left") / F.col("by") <= F.col("cap") / F.col("w")).agg(F.min_by(F.struct("left", "by"), "i").alias("level"))
    target = F.least(F.col("cap").cast("double"), F.col("level.left") * F.col("w") / F.col("level.by"))
    return ranked.crossJoin(F.broadcast(level)).select("source", "source_size", "place", F.coalesce(target, F.lit(0.0)).alias("target"))


def _placed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), ramps: Sequence[float] = (0.5, 0.0, -0.5), most_times: int = 3) -> DataFrame:
    """(id, size, source_size, target, passes), ``passes`` being an array of (taken, position)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    sized = work.written(sized, "sized")
    rows, digits = sized.count(), 1
    while digits < MOST_DIGITS and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))

    per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    per = work.written(per, "buckets")
    plan = targets(per.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most_times)
    ramp = F.element_at(F.lit(list(map(float, ramps))), (F.col("place") % len(ramps) + 1).cast("int"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = per.select("source", "bucket", offset.alias("offset")).alias("p").join(plan.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")))
    at = at.select(F.col("p.source").alias("b_source"), F.col("bucket").alias("b_bucket"), "offset", "source_size", "target", ramp.alias("ramp"))

    running = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
    placed = placed.join(at.hint("merge"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    start = F.col("offset") + F.col("inside")
    due = F.round("target").cast("long")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), due - start - F.col("source_size") * p)) for p in range(most_times)]
    a = F.col("ramp")

    def time(p: int):  # when the middle of what pass p takes is due, by the share of the demand met by then
        x = (start + F.col("source_size") * p + passes[p] / 2) / F.col("target")
        at = F.when(a == 0, x).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * a))
        return F.when(passes[p] > 0, at)

    taken = F.array(*[F.struct(passes[p].alias("taken"), time(p).alias("position")) for p in range(most_times)])
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("passes"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), ramps: Sequence[float] = (0.5, 0.0, -0.5), most_times: int = 3) -> DataFrame:
    """One row per row of ``docs``, sorted by training position: id, size, source_size, target, taken,
    position, and position_2, position_3, ... of the document's repeats.

    ``size``: words of the text (null: 0).  ``taken``: words the mix takes, repeats counted.  A source
    is a stream of its documents in the order of a hash of id and text, begun again when it ends; the
    mix takes the first round(target) words of the stream, so only the last document taken can be
    taken in part.  ``ramps``: a source's weight at time t of 0 to 1 is its target times
    1 + ramp * (2t - 1), ramps taken in turn as the weights are; a position is the time at which the
    middle of what that pass takes of the document is due, null if it takes nothing.

    A null source is a source; a null id orders as empty text; repeated rows are documents of their
    own; an empty table gives no rows; other columns are not read.
    """
    rows = _placed(docs, id_col, source_col, text_col, weights, ramps, most_times)
    nth = lambda p: F.get("passes", F.lit(p))
    taken = sum((nth(p)["taken"] for p in range(1, most_times)), nth(0)["taken"])
    positions = [nth(p)["position"].alias(f"position_{p + 1}" if p else "position") for p in range(most_times)]
    out = rows.select(id_col, "size", "source_size", "target", taken.alias("taken"), *positions)
    return out.orderBy("position", id_col)  # the id deals out rows that are not taken


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3), ramps: Sequence[float] = (0.5, 0.0, -0.5), most_times: int = 3) -> DataFrame:
    """The order of training itself: (id, pass, taken, position), one row for every time that a document
    is taken, range-sorted by position.  ``mix`` says what the columns mean and how rows are treated."""
    rows = _placed(docs, id_col, source_col, text_col, weights, ramps, most_times)
    each = rows.select(id_col, F.posexplode("passes").alias("p", "x")).where(F.col("x.taken") > 0)
    return each.select(id_col, (F.col("p") + 1).alias("pass"), "x.taken", "x.position").orderBy("position", id_col, "pass")
