"""Traversals as loops over DataFrames; each round is a written table, so lineage stays short."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_own: str | None = None


def written(df: DataFrame) -> DataFrame:
    """Write df to the folder of spark.checkpoint.dir and read it back. In local mode a temporary folder will do."""
    global _own
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="plexframe-")
        root = _own
    path = f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._round = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._round)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, way: str = "both") -> DataFrame:
    """(id, distance) of what is within `depth` steps of the start ids (a DataFrame with id)."""
    arcs = {"out": edges.select("src_id", "dst_id"), "in": edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))}
    arcs = arcs["out"].union(arcs["in"]) if way == "both" else arcs[way]
    seen = start.select("id").distinct().withColumn("distance", F.lit(0))
    front = seen.select("id")
    for d in range(1, depth + 1):
        near = arcs.join(front.withColumnRenamed("id", "src_id"), "src_id").select(F.col("dst_id").alias("id")).distinct()
        front = written(near.join(seen, "id", "left_anti"))
        seen = seen.union(front.withColumn("distance", F.lit(d)))
    return seen


def levels(links: DataFrame, start: DataFrame) -> DataFrame:
    """(id, distance): hops along links (src_id, dst_id) from the start ids to all that they reach."""
    seen = written(start.select("id").distinct().withColumn("distance", F.lit(0)))
    front, d = seen.select("id"), 0
    while True:
        d += 1
        near = links.join(front.withColumnRenamed("id", "src_id"), "src_id").select(F.col("dst_id").alias("id")).distinct()
        front = written(near.join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = written(seen.union(front.withColumn("distance", F.lit(d))))


def incident_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """The edges (id, ...) of a neighbourhood: those at a node that was expanded, so at a distance below depth."""
    inner = written(reached.filter(F.col("distance") < depth).select(F.col("id").alias("__n")))
    a = edges.join(inner, F.col("src_id") == F.col("__n"), "left_semi")
    b = edges.join(inner, F.col("dst_id") == F.col("__n"), "left_semi").join(inner, F.col("src_id") == F.col("__n"), "left_anti")
    return a.unionByName(b)


def marked(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, id): the distinct neighbours of each start id, itself left out."""
    ends = edges.select("src_id", "dst_id").union(edges.select("dst_id", "src_id")).filter("src_id != dst_id")
    return start.select(F.col("id").alias("src_id")).join(ends, "src_id").select(F.col("src_id").alias("start"), F.col("dst_id").alias("id")).distinct()


def local_graph(edges: DataFrame, root: DataFrame, depth: int, way: str = "both") -> DataFrame:
    """As neighbourhood, for a depth of 1 to 5; any other depth shows nothing."""
    if not 1 <= depth <= 5:
        return root.select("id").limit(0).withColumn("distance", F.lit(0))
    return neighbourhood(edges, root, depth, way)


def least_labels(nodes: DataFrame, links: DataFrame, out: str = "component") -> DataFrame:
    """(id, out): of a node and what leads to it along links (src_id, dst_id), the smallest id.

    Each round takes the least label of the neighbours, then the label of that label, so long paths take few rounds.
    """
    labels = written(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = links.join(labels.withColumnRenamed("id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = written(nearer.join(jump, "near").select("id", F.col("label").alias("old"), F.least("near", "far").alias("label")))
        changed = new.filter("old != label").limit(1).count()
        forget(labels)
        labels = new.select("id", "label")
        labels._round = new._round
        if not changed:
            return labels.withColumnRenamed("label", out)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable whatever the direction."""
    both = written(edges.select("src_id", "dst_id").union(edges.select("dst_id", "src_id")).filter("src_id != dst_id").distinct())
    return least_labels(nodes, both)


def shortest_paths(nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """(id, distance) along arcs, with strength as length; null where nothing leads. Only what came nearer is relaxed.

    Rounds go on until nothing comes nearer. Strengths may not be negative; see analysis.bellman_ford for those.
    """
    arcs = edges.select("src_id", "dst_id", "strength").union(edges.filter("not directed").select("dst_id", "src_id", "strength"))
    arcs = written(arcs)
    if arcs.filter("strength < 0").limit(1).count():
        raise ValueError("shortest_paths takes no negative strengths")
    best = nodes.select("id").filter(F.col("id") == source).withColumn("distance", F.lit(0.0))
    front = best
    while True:
        step = arcs.join(front.withColumnRenamed("id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.min(F.col("distance") + F.col("strength")).alias("nearer"))
        front = written(step.join(best, "id", "left").filter("distance is null or nearer < distance").select("id", F.col("nearer").alias("distance")))
        if not front.limit(1).count():
            return nodes.select("id").join(best, "id", "left")
        best = written(best.join(front.select("id"), "id", "left_anti").union(front))


def _placed(edges: DataFrame) -> str:
    """What orders edges: their place in the document if they have one, else their id."""
    return "place" if "place" in edges.columns else "id"


def parents(edges: DataFrame) -> DataFrame:
    """(child, parent, edge): of a child's hierarchy edges the first wins; loops are ignored."""
    ups = edges.filter("kind = 'hierarchy' and src_id != dst_id")
    return ups.groupBy(F.col("dst_id").alias("child")).agg(F.min_by(F.struct("src_id", "id"), _placed(edges)).alias("e")).select("child", F.col("e.src_id").alias("parent"), F.col("e.id").alias("edge"))


def on_cycles(tree: DataFrame) -> DataFrame:
    """(child, parent, least) of the children that lie on a cycle, with the least child of each cycle.

    After as many doublings as the log of the rows, whoever still leads somewhere leads onto a cycle, and the least
    name on the way is, for those on it, the cycle's.
    """
    hop = written(tree.select("child", "parent", F.col("child").alias("least")))
    for _ in range(max(1, (hop.count() + 1).bit_length())):
        far = hop.select(F.col("child").alias("parent"), F.col("parent").alias("far"), F.col("least").alias("low"))
        new = written(hop.join(far, "parent").select("child", F.col("far").alias("parent"), F.least("least", "low").alias("least")))
        forget(hop)
        hop = new
        if not hop.limit(1).count():
            break
    on = hop.select(F.col("parent").alias("child")).distinct()
    return tree.join(on, "child", "left_semi").select("child", "parent").join(hop.select("child", "least"), "child")


def hierarchy(nodes: DataFrame, edges: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """((child, parent, edge), (code, edge)): a forest of the hierarchy edges, and a note for each edge left out.

    A child keeps its first parent's edge; the others get code 2. A cycle is cut at the node that `order`, a column of
    nodes, puts first, and its edge gets code 1.
    """
    first = written(parents(edges))
    extra = edges.filter("kind = 'hierarchy' and src_id != dst_id").select(F.col("id").alias("edge")).join(first, "edge", "left_anti")
    rank = nodes.select(F.col("id").alias("child"), F.struct(F.col(order).alias("o"), "id").alias("rank"))
    up = first.select("child", "parent").join(rank, "child").join(rank.select(F.col("child").alias("parent"), F.col("rank").alias("up")), "parent")
    cut = on_cycles(up.select(F.col("rank").alias("child"), F.col("up").alias("parent"))).filter("child = least").select(F.col("child.id").alias("child"))
    cut = written(first.join(cut, "child", "left_semi"))
    kept = written(first.join(cut, "child", "left_anti"))
    return kept, cut.select(F.lit(1).alias("code"), "edge").union(extra.select(F.lit(2), "edge"))


def depths(nodes: DataFrame, tree: DataFrame, virtual_root: bool = False) -> DataFrame:
    """(id, depth) in a forest (child, parent), by pointer doubling: the rounds are the log of the depth.

    With virtual_root, two or more roots stand under one, at depth 1. Nodes on or under a cycle have a null depth;
    hierarchy() leaves no cycle.
    """
    up = written(nodes.select("id").join(tree.select(F.col("child").alias("id"), F.col("parent").alias("up")), "id", "left").withColumn("d", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    roots = up.filter("up is null").limit(2).count()
    for _ in range(max(1, (up.count() + 1).bit_length())):
        far = up.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        new = written(up.join(far, "up", "left").select("id", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        forget(up)
        up = new
        if not up.filter("up is not null").limit(1).count():
            break
    shift = 1 if virtual_root and roots > 1 else 0
    return up.select("id", F.when(F.col("up").isNull(), F.col("d") + shift).alias("depth"))


def canonical(labels: DataFrame, label: str, order: str, out: str = "label") -> DataFrame:
    """labels with their label numbered from 0 by first appearance in the order of a column."""
    from plexframe.sources.tables import dense

    first = dense(labels.groupBy(F.col(label).alias("__l")).agg(F.min(order).alias("__first")), "__first", "__n")
    return labels.join(first.select("__l", "__n"), F.col(label) == F.col("__l")).drop("__l", label).withColumnRenamed("__n", out)
