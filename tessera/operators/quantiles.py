"""Exact quantiles of groups of any size, by refining histograms.

A quantile is the value at a rank.  All values between the least and the greatest of a group fall into a
fixed number of cells; the counts of the cells tell in which one a rank lies, and that cell's own least
and greatest values are the next bounds.  Every round is one aggregation by (group, cell), combined
before the shuffle, so a task holds cells and never a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import shared

#: Cells of a round; targets that are broadcast; rows up to which a task may as well hold all values.
CELLS, SENT_TARGETS, HELD_ROWS, SALTS = 1024, 100_000, 1 << 22, 16


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """Ascending in v, 0 for the least value and the last cell for the greatest, so that every round splits
    them; infinite values have the outer cells to themselves."""
    share = (v / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))  # halves, as a difference may overflow
    inner = F.least(F.lit(cells - 1), F.coalesce(F.floor(share * cells), F.when(v > low, cells - 1).otherwise(0)).cast("int"))
    endless = lambda x: F.abs(x) == float("inf")
    outer = F.when(v == low, 0).when(v == high, cells - 1).otherwise(1)
    return F.when(endless(low) | endless(high), outer).otherwise(inner)


def group_quantiles(rows: DataFrame, by: str | None, value: str, shares: Sequence[float], cells: int = CELLS) -> DataFrame:
    """(g, n, q): each group's number of values and its quantiles at ``shares``, between ranks in proportion.

    Nulls and NaN are left out; a group without values is not listed; a null group is a group; without
    ``by`` all rows are one.  Equal values are counted once, in a table in the shared folder that every
    round reads; the rounds grow with the logarithm of a group's distinct values.
    """
    g = F.col(by) if by else F.lit(0)
    v = F.col(value).cast("double")
    counted = rows.select(g.alias("g"), (v + 0.0).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("g", "v").agg(F.count("*").alias("c"))
    counted = shared.kept(counted.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")), "values")
    groups = shared.kept(counted.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "groups")
    places = F.array(*[F.lit(float(s)) * (F.col("n") - 1) for s in shares])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    sought = shared.kept(groups.select("g", "low", "high", F.lit(0).cast("long").alias("below"), ranks.alias("ranks")), "ranks")
    found = sought.where("low = high")
    while True:
        sought = sought.where("low < high")
        n = sought.count()
        if not n:
            break
        aim = sought.select(F.col("g").alias("t"), "low", "high", "below")
        if n <= SENT_TARGETS:
            met = counted.join(F.broadcast(aim), F.col("g").eqNullSafe(F.col("t")) & F.col("v").between(F.col("low"), F.col("high")))
        else:
            aim = aim.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = counted.join(aim, F.col("g").eqNullSafe(F.col("t")) & (F.col("salt") == F.col("part")) & F.col("v").between(F.col("low"), F.col("high")))
        per = met.groupBy("g", "low", "below", _cell(F.col("v"), F.col("low"), F.col("high"), cells).alias("cell")).agg(F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy("g", "low").orderBy("cell"))
        per = per.select(F.col("g").alias("t"), F.col("low").alias("from"), "least", "most", (F.col("below") + upto - F.col("c")).alias("first"), (F.col("below") + upto).alias("end"))
        each = sought.select("g", "low", F.explode("ranks").alias("rank"))
        inside = F.col("g").eqNullSafe(F.col("t")) & (F.col("low") == F.col("from")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
        sought = each.join(per, inside).groupBy("g", F.col("least").alias("low"), F.col("most").alias("high"), F.col("first").alias("below")).agg(F.collect_list("rank").alias("ranks"))
        sought = shared.kept(sought, "ranks")
        found = found.unionByName(sought.where("low = high"))
    values = found.groupBy("g").agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("ranks", lambda r: F.struct(r, F.col("low")))))).alias("at"))
    def between(p: Column) -> Column:
        a, b = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    out = groups.select(F.col("g").alias("_g"), "n").join(values, F.col("_g").eqNullSafe(F.col("g")))
    return out.select("g", "n", F.transform(places, between).alias("q"))


def quantiles(rows: DataFrame, by: str | None, value: str, shares: Sequence[float], held_rows: int | None = None) -> DataFrame:
    """``group_quantiles``; up to ``held_rows`` rows, counted before, by one aggregation that holds a group's
    distinct values in a task."""
    if rows.count() > (HELD_ROWS if held_rows is None else held_rows):
        return group_quantiles(rows, by, value, shares)
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    q = F.array(*[F.percentile(v, F.lit(float(s))) for s in shares])
    out = rows.groupBy((F.col(by) if by else F.lit(0)).alias("g")).agg(F.count(v).alias("n"), q.alias("q"))
    return out.where("n > 0")
