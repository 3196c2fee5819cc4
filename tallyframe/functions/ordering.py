"""Dense positions in a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut, fewer

_LOCAL = (1 << 33) - 1


def placed(df: DataFrame, *keys: Column | str, parts: int | None = None) -> DataFrame:
    """``df`` dealt by range of ``keys`` and sorted, with ``_part`` and the place in it, ``_at``; cut in the shared folder.

    The sort's partitions are written before anything counts them, so that their borders can't
    move between the two passes that positions need.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut(fewer(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))})))


def with_position(df: DataFrame, *keys: Column | str, name: str = "position", parts: int | None = None) -> DataFrame:
    """Adds the row's place from 0 in the order of ``keys``, over all partitions."""
    rows = placed(df, *keys, parts=parts)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (  # a row a partition
        rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_group_rank(df: DataFrame, group: str, *keys: Column | str, rank: str = "rank", size: str = "size", parts: int | None = None) -> DataFrame:
    """Adds the row's rank from 0 within its ``group`` by ``keys``, and the group's size; a hot group spans partitions."""
    rows = placed(df, group, *keys, parts=parts)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (  # a group's rows in a partition lie side by side
        rows.groupBy("_part", group)
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        .select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias(size))
    )
    joined = rows.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_p", "_g", "_first", "_before")
