"""The identity grammar of nodes and edges, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strength by edge kind.
STRENGTH = {"hierarchy": 2.0, "relation": 1.0, "tag": 0.75, "note_link": 0.625, "note_of": 0.5}


def record_id(source: Column, collection: Column, record: Column) -> Column:
    return F.concat_ws(":", source, collection, record)


def note_id(of: Column) -> Column:
    return F.concat(F.lit("note:"), of)


def tag_id(value: Column) -> Column:
    return F.concat(F.lit("tag:"), value)


def parse_node_id(node: Column) -> Column:
    """struct<source, collection, record>, or null for notes, tags and ids of fewer than three parts."""
    parts = F.split(node, ":", 3)
    named = F.struct(parts[0].alias("source"), F.get(parts, F.lit(1)).alias("collection"), F.get(parts, F.lit(2)).alias("record"))
    return F.when(~node.startswith("note:") & ~node.startswith("tag:") & (F.size(parts) == 3), named)


def edge_id(src: Column, dst: Column, kind: Column, label: Column, directed: Column) -> Column:
    """Directed ids keep the direction; others name the lower end (in byte order) first."""
    ends = F.when(directed, F.concat(src, F.lit("->"), dst)).otherwise(F.concat(F.least(src, dst), F.lit("--"), F.greatest(src, dst)))
    return F.concat_ws(":", ends, kind, label)


def edge_kind(wire: Column) -> Column:
    t = F.lower(wire)
    return (
        F.when(t.isin("parent", "parent_of", "child_of") | t.contains("hierarchy"), "hierarchy")
        .when(t.contains("note_link") | (t == "links_to"), "note_link")
        .when(t.contains("note_of") | (t == "annotates"), "note_of")
        .when(t.isin("tagged", "tag"), "tag")
        .otherwise("relation")
    )


def child_first(wire: Column) -> Column:
    return F.lower(wire) == "child_of"


def edge_strength(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in STRENGTH.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def degree_weight(degree: Column) -> Column:
    """0.2 + 0.8 log1p(degree) / log1p(8), kept within 0.2 and 1."""
    w = F.lit(0.2) + F.lit(0.8) * F.log1p(degree.cast("double")) / F.log1p(F.lit(8.0))
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), w))
