"""Positions in an order without a task that holds a whole group: range partitions and their offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.sources.storage import in_turns, stored

#: Items that one row holds at most.
PART = 1 << 16


def running(cells: DataFrame, keys: list[str], order: str, count: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``count`` over the rows of the same keys that stand before in ``order``, which are unique.

    Of the offsets only those of keys that a partition border cuts are sent to all tasks: fewer than there are partitions.
    """
    n = partitions or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(cells.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_part").agg(F.sum(count).alias("_s")).withColumn("_before", F.sum("_s").over(before)).drop("_s")
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = ranged.withColumn("_own", F.coalesce(F.sum(count).over(within), zero))
    out = out.join(F.broadcast(offsets.filter("_before > 0")), [*keys, "_part"], "left")
    return out.withColumn(name, F.coalesce("_before", zero) + F.col("_own")).drop("_part", "_before", "_own")


def positions(rows: DataFrame, order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Number the rows from 0 in ``order``, which must tell them apart: range partitions, and an offset for each.

    The sorted rows are stored once, so that both passes see the same partitions.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    place = (F.col("_before") + F.col("_rn") - 1).cast("bigint")
    return ranged.withColumn("_rn", within).join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_rn", "_before")


def parted(rows: DataFrame, order: list[str], size: int = PART) -> DataFrame:
    """Add ``part``: entities of more than ``size`` rows are cut into runs of as many in ``order``, numbered from 0; the others are part 0.

    Grouping by (entity, part) then gives rows of a bounded length.  Runs jobs: rows are counted, and those of large
    entities placed by range partitions.
    """
    large = stored(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select("entity"), "large")
    if large.isEmpty():
        return rows.withColumn("part", F.lit(0))
    keyed = rows.join(large, "entity", "left_semi").withColumn("_o", F.struct(*order, F.monotonically_increasing_id())).withColumn("_one", F.lit(1))
    cut = running(keyed, ["entity"], "_o", "_one", "_place").select(*rows.columns, F.floor(F.col("_place") / size).cast("int").alias("part"))
    return rows.join(large, "entity", "left_anti").withColumn("part", F.lit(0)).unionByName(cut)


def each_entity(rows: DataFrame, run: Callable[[DataFrame, bool], DataFrame], name: str, size: int = PART, turns: int | None = None) -> DataFrame:
    """``run(rows, True)`` of entities of up to ``size`` rows, which are dealt by entity and come in shares; ``run(rows, False)`` of the others as they lie.

    What ``run`` adds to dealt rows, such as vectors, no later grouping by entity shuffles; groups of the others are few, so
    that they combine map-side.  ``rows`` are stored.  Runs jobs and stores what ``run`` gives.
    """
    large = stored(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select("entity"), "large")
    none = large.isEmpty()
    deal = lambda share: run((share if none else share.join(large, "entity", "left_anti")).repartition("entity"), True)
    out = in_turns(rows, "entity", deal, name, turns)
    return out if none else out.unionByName(stored(run(rows.join(large, "entity", "left_semi"), False), name))
