"""Proportional stratified interleaving into shards.

The rows of each source are shuffled (by a seeded hash) and get the fractional rank
(rank + 1/2) / rows of the source. Sorted by fractional rank, the sources interleave in
proportion: any stretch of that order holds nearly the mixture of the whole. The order is cut
into shards whose row counts are at most one apart.

Ranks and positions come from range-partitioned sorts with offsets by partition, so that a
source with most rows is no single task's work. Rows go through two such sorts: select few
columns, no texts.

Defined results: null is a source of its own. Rows equal in source, hash and tie-breakers may
swap places, which shows only if other columns differ. With fewer rows than shards some shards
are empty; an empty table gives an empty one. ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.names import quoted
from tallyframe.functions.ordering import with_group_rank, with_position
from tallyframe.llm.arrowtools import table

SHARDS = 24
SEED = 5


def interleave(df: DataFrame, source: str, ties: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 in it); ``ties``: the columns that tell rows apart."""
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)])
    name = {c: f"c{i}" for i, c in enumerate(own)}
    tied = [name[t] for t in ties]
    shuffled = rows.withColumn("_h", F.xxhash64(F.lit(seed), *tied))
    ranked = with_group_rank(shuffled, name[source], "_h", *tied, rank="_rank", size="_size")
    in_order = with_position(ranked.withColumn("_share", (F.col("_rank") + 0.5) / F.col("_size")), "_share", name[source], "_h", *tied, name="_at_all")
    n = in_order.count()
    shard = F.expr(f"_at_all * {shards} div {max(n, 1)}")
    return in_order.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)],
        shard.cast("int").alias("shard"),
        (F.col("_at_all") - F.expr(f"(_at_all * {shards} div {max(n, 1)} * {n} + {shards - 1}) div {shards}")).alias("slot"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return interleave(rows, "source", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
