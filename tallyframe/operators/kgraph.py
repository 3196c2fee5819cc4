"""Entity graphs of tables: nodes are values, edges count rows in which two values meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.names import GRAPH_ENTITY, key, quoted, strings, visible
from tallyframe.functions.scalars import graph_id, label_of, type_of
from tallyframe.operators.cleaning import ROW, with_row_id
from tallyframe.operators.stats import value_counts
from tallyframe.session import cut

MOST_VALUES = 40
MOST_ROWS = 800
MOST_NODES = 60
NODE = "id string, label string, node_type string, first_seen long, is_anomaly boolean, centrality double, metadata map<string,string>"
EDGE = "source string, target string, relation string, weight double"


def entity_columns(df: DataFrame) -> list[str]:
    """Columns named like entities with 2 to MOST_VALUES values, else the first 12 text columns with so many."""
    named = [c for c in visible(df) if GRAPH_ENTITY.search(key(c))]
    counts = value_counts(df, list(dict.fromkeys([*named, *strings(df)])), MOST_VALUES)
    fits = lambda c: counts.get(c, 0) >= 2
    return [c for c in named if fits(c)] or [c for c in strings(df) if fits(c)][:12]


def sample(df: DataFrame, rows: int | None = MOST_ROWS, seed: int = 42) -> DataFrame:
    """A fixed sample: the rows of smallest seeded hash of their ids; None: all rows."""
    return df if rows is None else with_row_id(df).orderBy(F.xxhash64(ROW, F.lit(seed)), ROW).limit(rows)


def extract(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Pairs are made within a row and counted before the shuffle; a self-pair counts too."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    text = lambda c: F.col(quoted(c)).cast("string")
    ids = F.filter(F.array(*[F.when(F.trim(text(c)) != "", graph_id(c, text(c))) for c in columns]), lambda x: x.isNotNull())
    rows = with_row_id(df).select(ROW, ids.alias("ids"))
    seen = rows.select(ROW, F.posexplode("ids").alias("at", "id")).groupBy("id").agg(F.min(F.struct(ROW, "at")).alias("_first"))
    nodes = seen.select(
        "id", label_of(F.col("id")).alias("label"), type_of(F.col("id")).alias("node_type"), (F.col(f"_first.{ROW}") * 64 + F.col("_first.at")).alias("first_seen"),
        F.lit(False).alias("is_anomaly"), F.lit(0.0).alias("centrality"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target")))))
    edges = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    return nodes, edges.select("source", "target", F.concat(type_of(F.col("source")), F.lit("_"), type_of(F.col("target"))).alias("relation"), "weight")


def merge_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right's labels and types where they aren't blank, both sides' metadata."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    newer = lambda c: F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.col(f"l.{c}")).alias(c)
    empty = F.create_map().cast("map<string,string>")
    old = F.map_filter(F.coalesce("l.metadata", empty), lambda k, _: ~F.map_contains_key(F.coalesce("r.metadata", empty), k))
    return l.join(r, F.col("l.id") == F.col("r.id"), "full").select(
        F.coalesce("l.id", "r.id").alias("id"), newer("label"), newer("node_type"), F.coalesce("l.first_seen", F.col("r.first_seen") + (1 << 60)).alias("first_seen"),
        (F.coalesce("l.is_anomaly", F.lit(False)) | F.coalesce("r.is_anomaly", F.lit(False))).alias("is_anomaly"),
        F.coalesce("l.centrality", "r.centrality").alias("centrality"), F.map_concat(old, F.coalesce("r.metadata", empty)).alias("metadata"),
    )


def merge_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.unionByName(right)
    return both.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "relation").agg(F.sum("weight").alias("weight"))


def flag(nodes: DataFrame, anomaly_ids: DataFrame, column: str = "graph_entity_id") -> DataFrame:
    """Marks the nodes whose ids are in ``anomaly_ids``."""
    ids = anomaly_ids.select(F.col(column).alias("id")).filter("id is not null").distinct().withColumn("_hit", F.lit(True))
    return nodes.join(ids, "id", "left").withColumns(
        {
            "is_anomaly": F.col("is_anomaly") | F.coalesce("_hit", F.lit(False)),
            "metadata": F.when(F.col("_hit"), F.map_concat(F.map_filter("metadata", lambda k, _: k != "anomaly"), F.create_map(F.lit("anomaly"), F.lit("true")))).otherwise(F.col("metadata")),
        }
    ).drop("_hit")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) in the simple graph: parallel relations are one edge, a loop counts twice."""
    simple = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over the number of other nodes; a lone node has 1."""
    n = nodes.agg(F.count("*").alias("_n"))
    scored = nodes.drop("centrality").join(degrees(edges), "id", "left").crossJoin(F.broadcast(n))
    value = F.when(F.col("_n") <= 1, 1.0).otherwise(F.coalesce("degree", F.lit(0)).cast("double") / (F.col("_n") - 1))
    return scored.withColumn("centrality", F.round(value, 4)).drop("degree", "_n")


def hubs(nodes: DataFrame, top: int = 5) -> DataFrame:
    return nodes.orderBy(F.col("centrality").desc(), "first_seen").limit(top)


def prune(nodes: DataFrame, edges: DataFrame, most: int = MOST_NODES, by_centrality: bool = True) -> tuple[DataFrame, DataFrame]:
    """Anomalous nodes, all of them, and the most central others up to ``most``; edges between what stays.

    ``by_centrality=False`` ranks by first appearance.
    """
    rank = [F.col("centrality").desc()] if by_centrality else []
    bad = nodes.filter("is_anomaly")
    room = max(0, most - bad.count())
    kept = bad.unionByName(nodes.filter("not is_anomaly").orderBy(*rank, "first_seen", "id").limit(room))
    ids = kept.select("id")
    inner = edges.join(ids, edges.source == ids.id, "left_semi")
    return kept, inner.join(ids, inner.target == ids.id, "left_semi")


def neighbourhood(edges: DataFrame, start: str | None, hops: int = 2) -> DataFrame:
    """(id, hop) of the nodes within ``hops`` edges of ``start``, itself at 0; nothing without a start."""
    spark = edges.sparkSession
    if start is None:
        return spark.createDataFrame([], "id string, hop int")
    near = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = frontier = spark.createDataFrame([(start, 0)], "id string, hop int")
    for h in range(1, hops + 1):
        reached = frontier.join(both, frontier.id == both.a).select(F.col("b").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


def build(df: DataFrame, anomalies: DataFrame | None = None, rows: int | None = MOST_ROWS, most_nodes: int = MOST_NODES, more: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): extracted, merged with ``more``, flagged, pruned by centrality, and scored again as pruned."""
    nodes, edges = extract(sample(df, rows), entity_columns(df))
    if more:
        nodes, edges = merge_nodes(nodes, more[0]), merge_edges(edges, more[1])
    if anomalies is not None:
        nodes = flag(nodes, anomalies)
    nodes, edges = cut(nodes), cut(edges)
    kept, inner = prune(centrality(nodes, edges), edges, most_nodes)
    kept, inner = cut(kept), cut(inner)
    return centrality(kept, inner), inner
