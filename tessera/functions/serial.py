"""Serial numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import shared


def numbered(rows: DataFrame, *order: str | Column, name: str = "serial") -> DataFrame:
    """Adds 1, 2, ... in ``order``.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes
    of the partitions before, of which there is one small row each.  The sorted rows are kept as a
    table in the shared folder, as both steps must see the same partitions.
    """
    ranged = rows.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    ranged = shared.kept(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    place = F.col("_id") - F.shiftleft("_part", 33)
    out = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return out.select((F.col("_before") + place + 1).alias(name), *rows.columns)
