"""Sinks: canonical JSON lines, readable listings, drawings as SVG lines, and columnar folders.

A large graph is written by ranges of its order, each file a stretch of the whole; only the parts' number grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexframe.functions import scalars
from plexframe.operators import drawing
from plexframe.sources.tables import dense


def json_text(v: Column) -> Column:
    """A text as a JSON string; null stays the word null."""
    return F.when(v.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def json_number(v: Column) -> Column:
    """A number without a fraction that says nothing; what is not finite, and null, is the word null."""
    v = v.cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), "null").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def json_flag(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit("null"))


def json_object(members: dict[str, Column]) -> Column:
    """Members (JSON texts) in the byte order of their names, without blanks."""
    parts = []
    for name in sorted(members, key=str.encode):
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), members[name]]
    return F.concat(*parts, F.lit("}"))


def _has(df: DataFrame, name: str, other) -> Column:
    return F.col(name) if name in df.columns else F.lit(other)


def node_json(nodes: DataFrame) -> Column:
    t, n = json_text, json_number
    return json_object({
        "id": t(F.col("id")), "kind": t(F.col("kind")), "database_id": t(F.col("database_id")), "source": t(F.col("source")), "label": t(F.col("label")), "group": t(F.col("group_label")),
        "weight": n(F.col("weight")), "version": n(F.col("version")), "has_note": json_flag(_has(nodes, "has_note", False)), "icon": t(_has(nodes, "icon", None).cast("string")),
    })


def edge_json(edges: DataFrame) -> Column:
    t = json_text
    return json_object({
        "id": t(F.col("id")), "source": t(F.col("src_id")), "target": t(F.col("dst_id")), "kind": t(F.col("kind")), "label": t(F.col("label")), "strength": json_number(F.col("strength")),
        "directed": json_flag(F.col("directed")), "record_id": t(_has(edges, "record_id", None).cast("string")), "child_first": json_flag(_has(edges, "child_first", False)),
    })


def canonical_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, line): the graph's identity, a JSON object a node and an edge. Equal graphs have equal lines in order."""
    a = nodes.select(F.lit(0).alias("part"), F.to_json(F.struct("place")).alias("place"), node_json(nodes).alias("line"))
    return a.union(edges.select(F.lit(1).alias("part"), F.to_json(F.struct("place")).alias("place"), edge_json(edges).alias("line")))


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, digest): sizes, and one hash of all lines whatever their order, to tell graphs apart."""
    lines = canonical_lines(nodes, edges)
    folded = F.lower(F.hex(F.bit_xor(F.xxhash64(F.sha2("line", 256)))))
    return lines.agg(F.count_if(F.col("part") == 0).alias("nodes"), F.count_if(F.col("part") == 1).alias("edges"), folded.alias("digest"))


def listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the graph as a reader would have it."""
    n = F.format_string("node %s %s label=%s group=%s weight=%s version=%s", "id", "kind", json_text(F.col("label")), json_text(F.col("group_label")), json_number(F.col("weight")), json_number(F.col("version")))
    e = F.format_string("edge %s %s -> %s %s label=%s strength=%s directed=%s", "id", "src_id", "dst_id", "kind", json_text(F.col("label")), json_number(F.col("strength")), json_flag(F.col("directed")))
    return nodes.select(F.lit(0).alias("part"), n.alias("line")).union(edges.select(F.lit(1), e))


def write_lines(lines: DataFrame, order: list[str], folder: str) -> None:
    """Write the column `line` so that the files, by name, hold the lines in order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(folder)


def svg_lines(points: DataFrame, drawn: DataFrame, pad: float = 48, background: str = "#15140f", strokes: tuple = ("#8a7f72", "#b45309", "#cc785c", "#e0937a")) -> DataFrame:
    """(part, ord, line) of a drawing: points (id, ord, x, y, r, fill, kind, visible), stretched edges (ord, kind, strength,
    x0..y1) between visible ones. Coordinates have one decimal, widths and radii two. Tags are rings."""
    c = points.filter("visible")
    x0, y0, x1, y1 = drawing.bounds(points).first()
    if x0 is None:
        return points.sparkSession.createDataFrame([(0, 0, '<svg xmlns="http://www.w3.org/2000/svg" width="1" height="1"></svg>')], "part int, ord long, line string")
    x, y, w, h = x0 - pad, y0 - pad, x1 - x0 + 2 * pad, y1 - y0 + 2 * pad
    head = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{round(w)}" height="{round(h)}" viewBox="{x:.1f} {y:.1f} {w:.1f} {h:.1f}">',
        f'<rect x="{x:.1f}" y="{y:.1f}" width="{w:.1f}" height="{h:.1f}" fill="{background}"/>', '<g opacity="0.85">',
    ]
    one = lambda v: F.format_string("%.1f", v.cast("double"))
    two = lambda v: F.format_string("%.2f", v.cast("double"))
    bucket = scalars.edge_bucket(F.col("kind"))
    stroke = F.get(F.array(*map(F.lit, strokes)), bucket)
    edge = F.concat(F.lit('<line x1="'), one(F.col("x0")), F.lit('" y1="'), one(F.col("y0")), F.lit('" x2="'), one(F.col("x1")), F.lit('" y2="'), one(F.col("y1")), F.lit('" stroke="'), stroke, F.lit('" stroke-width="'), two(scalars.edge_width(bucket, F.col("strength"))), F.lit('" stroke-linecap="round"/>'))
    circle = F.concat(F.lit('<circle cx="'), one(F.col("x")), F.lit('" cy="'), one(F.col("y")), F.lit('" r="'))
    ring = F.concat(circle, two(F.col("r") * 0.78), F.lit('" fill="none" stroke="'), "fill", F.lit('" stroke-width="'), two(F.col("r") * 0.5), F.lit('"/>'))
    disc = F.concat(circle, two(F.col("r")), F.lit('" fill="'), "fill", F.lit('"/>'))
    rows = [(0, i, line) for i, line in enumerate(head)] + [(2, 0, "</g><g>"), (4, 0, "</g></svg>")]
    frame = points.sparkSession.createDataFrame(rows, "part int, ord long, line string")
    lines = drawn.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), edge.alias("line"))
    return frame.union(lines).union(c.select(F.lit(3), F.col("ord").cast("long"), F.when(F.col("kind") == "tag", ring).otherwise(disc)))


def write_columns(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write a graph as columns: nodes with their row numbers, edges with the row numbers of their ends."""
    numbered = dense(nodes, "place", "ord")
    numbered.drop("place").write.parquet(f"{folder}/nodes")
    have = nodes.sparkSession.read.parquet(f"{folder}/nodes").select("id", "ord")
    both = edges.join(have.select(F.col("id").alias("src_id"), F.col("ord").alias("src")), "src_id").join(have.select(F.col("id").alias("dst_id"), F.col("ord").alias("dst")), "dst_id")
    dense(both, "place", "ord").drop("place", "src_id", "dst_id").write.parquet(f"{folder}/edges")


def read_columns(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder of columns; ord orders both."""
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    at = lambda c, i: nodes.select(F.col("ord").alias(c), F.col("id").alias(i))
    return nodes, edges.join(at("src", "src_id"), "src").join(at("dst", "dst_id"), "dst").drop("src", "dst")


def column_refusals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id) for which columns are no graph: ids that stand twice, ends that are no row (nodes ord; edges src, dst)."""
    twice = lambda df, rule: df.groupBy("id").count().filter("count > 1").select(F.lit(rule).alias("rule"), "id")
    ends = edges.select("id", F.explode(F.array("src", "dst")).alias("ord")).join(nodes.select("ord"), "ord", "left_anti")
    return twice(nodes, "duplicate_node").union(twice(edges, "duplicate_edge")).union(ends.select(F.lit("no_row"), "id").distinct())
