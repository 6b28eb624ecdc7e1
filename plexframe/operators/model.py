"""The indexed graph: resolved endpoints, degrees, groups, legends, simple graphs, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexframe.functions import ids
from plexframe.operators.traverse import written
from plexframe.sources.tables import dense, prefixes


def index_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist. Ends are resolved first, so a dangling edge claims no id; then the first of an id stays.

    Ends that no node has, and hashes of ids that stand twice, are looked for in narrow tables of their own. Only edges
    with such a hash are grouped; the others are not shuffled.
    """
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("end")).distinct()
    lost = written(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti"))
    both = edges.filter("src_id is not null and dst_id is not null")
    if lost.limit(1).count():
        both = both.join(lost.withColumnRenamed("end", "src_id"), "src_id", "left_anti").join(lost.withColumnRenamed("end", "dst_id"), "dst_id", "left_anti")
    rest = [c for c in edges.columns if c != "id"]
    both = both.select("id", *rest)
    twice = written(both.groupBy(F.xxhash64("id").alias("__hash")).count().filter("count > 1").select("__hash"))
    if not twice.limit(1).count():
        return both
    hashed = both.withColumn("__hash", F.xxhash64("id"))
    first = hashed.join(twice, "__hash", "left_semi").groupBy("id").agg(F.min_by(F.struct(*rest), "place").alias("e")).select("id", "e.*")
    return hashed.join(twice, "__hash", "left_anti").select("id", *rest).union(first)


def index_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each id."""
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "id"]), "place").alias("n"))
    return first.select("id", "n.*")


def degrees(nodes: DataFrame, edges: DataFrame, loops_once: bool = False) -> DataFrame:
    """(id, degree) of every node. A loop counts twice, or once if asked."""
    ends = F.array("src_id", "dst_id")
    count = edges.select(F.explode(F.array_distinct(ends) if loops_once else ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(count, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, weight) from edges counted by the ids they state, whether or not they resolve."""
    return degrees(nodes, edges).withColumn("weight", ids.degree_weight(F.col("degree")))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("database_id").alias("databases"), F.count_if(F.col("kind") == "note").alias("notes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))


def legend_databases(nodes: DataFrame) -> DataFrame:
    """(label, n, place of the first), for ordering by n descending, then place."""
    return nodes.filter("database_id is not null").groupBy(F.col("database_id").alias("label")).agg(F.count("*").alias("n"), F.min("place").alias("first"))


def legend_tags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    hubs = nodes.filter("kind = 'tag'")
    return degrees(hubs, edges.filter("kind = 'tag'")).join(hubs.select("id", "label"), "id").select("label", F.col("degree").alias("n"))


def legend_kinds(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def ordered_legend(legend: DataFrame, first: str) -> DataFrame:
    """A legend (label, n, ...) with its rows' places: the largest n first, of equal ones what comes first by a column."""
    return dense(legend.withColumn("__by", F.struct((-F.col("n")).alias("n"), F.col(first).alias("first"))), "__by", "place_in_legend").drop("__by")


def by_database(nodes: DataFrame) -> DataFrame:
    """(database_id, rank, slot, id): databases in the order they are first seen, and in each its nodes by place."""
    own = nodes.filter("database_id is not null").select("database_id", "place", "id").withColumn("one", F.lit(1))
    rank = dense(own.groupBy("database_id").agg(F.min("place").alias("first")), "first", "rank").select("database_id", "rank")
    return prefixes(own, "database_id", "place", {"n": "one"}).join(rank, "database_id").select("database_id", "rank", (F.col("n") - 1).alias("slot"), "id")


def ends(edges: DataFrame) -> DataFrame:
    """edges with parent and child: the ends of a hierarchy edge, turned where it names the child first."""
    turned = F.coalesce("child_first", F.lit(False)) if "child_first" in edges.columns else F.lit(False)
    up = F.when(F.col("kind") == "hierarchy", F.when(turned, F.col("dst_id")).otherwise(F.col("src_id")))
    return edges.withColumn("parent", up).withColumn("child", F.when(F.col("kind") == "hierarchy", F.when(turned, F.col("src_id")).otherwise(F.col("dst_id"))))


def lookup(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes or edges whose ids a table (id) names."""
    return rows.join(wanted.select("id"), "id", "left_semi")


def adjacency(edges: DataFrame, order: str = "id") -> DataFrame:
    """(id, slot, edge, other): the edges at each node, numbered in the order of a column; a loop stands once.

    A row for each, not a list a node, so a hub's edges may lie in many tasks.
    """
    out = edges.select(F.col("src_id").alias("id"), F.col(order).alias("__by"), F.col("id").alias("edge"), F.col("dst_id").alias("other"))
    into = edges.filter("src_id != dst_id").select(F.col("dst_id").alias("id"), F.col(order).alias("__by"), F.col("id").alias("edge"), F.col("src_id").alias("other"))
    return prefixes(out.union(into).withColumn("one", F.lit(1)), "id", "__by", {"n": "one"}).select("id", (F.col("n") - 1).alias("slot"), "edge", "other")


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(low, high): the distinct pairs of different nodes that an edge joins."""
    return edges.filter("src_id != dst_id").select(F.least("src_id", "dst_id").alias("low"), F.greatest("src_id", "dst_id").alias("high")).distinct()


def hidden_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges (visible) are not drawn."""
    return nodes.agg(F.count_if(~F.col("visible")).alias("nodes")).crossJoin(edges.agg(F.count_if(~F.col("visible")).alias("edges")))


def ranked(nodes: DataFrame, score: Column, order: str, out: str = "rank") -> DataFrame:
    """nodes with their rank from 0 by falling score: of equal ones the first by order; what is no number comes last."""
    none = score.isNull() | F.isnan(score.cast("double"))
    by = F.struct(none.alias("none"), F.when(~none, -score.cast("double")).alias("s"), F.col(order).alias("o"))
    return dense(nodes.withColumn("__by", by), "__by", out).drop("__by")


def by_weight(nodes: DataFrame, order: str) -> DataFrame:
    """As ranked by weight, where what is no number, and a negative zero, weigh 0."""
    w = F.col("weight").cast("double")
    return ranked(nodes, F.when(w.isNull() | F.isnan(w), 0.0).otherwise(w) + 0.0, order)


def carried(previous: DataFrame, following: DataFrame, most: int = 262_144) -> DataFrame:
    """following (id) with x and y of the nodes that a previous drawing (id, x, y) placed; none beyond `most` of them."""
    if following.limit(most + 1).count() > most:
        return following.withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double"))
    return following.join(previous.select("id", "x", "y"), "id", "left")


def growth(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule, collection, field) of what keeps a manifest's fields (collection, field, role, target) from following older ones.

    Collections and fields may be added; those that were there stay, with the meaning they had.
    """
    gone = old.select("collection").distinct().join(new.select("collection").distinct(), "collection", "left_anti")
    null = F.lit(None).cast("string")
    there = old.join(new.select("collection").distinct(), "collection", "left_semi")
    was = there.select("collection", "field", F.struct("role", "target").alias("was"))
    met = was.join(new.select("collection", "field", F.struct("role", "target").alias("now"), F.lit(True).alias("has")), ["collection", "field"], "left")
    rule = F.when(F.col("has").isNull(), "field_removed").when(~F.col("was").eqNullSafe(F.col("now")), "field_changed")
    return gone.select(F.lit("collection_removed").alias("rule"), "collection", null.alias("field")).union(met.select(rule.alias("rule"), "collection", "field").filter("rule is not null"))


def cell_refusals(cells: DataFrame) -> DataFrame:
    """(collection, id, field, rule) of cells (collection, id, field, role, many, value variant) that do not fit their role.

    Null always fits. Titles, labels and groups are texts, weights numbers, tags lists of texts without a colon, links
    one text or a list of them, parents a text or a list of one; a field that is not declared (null role) never fits.
    """
    kind = F.schema_of_variant("value")
    text, null = kind == "STRING", kind.isin("VOID") | F.col("value").isNull()
    items = F.try_variant_get("value", "$", "array<variant>")
    listed = items.isNotNull() & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    colon = F.exists(items, lambda x: F.try_variant_get(x, "$", "string").contains(":"))
    role = F.col("role")
    fits = (
        F.when(role.isNull(), F.lit(False)).when(null | (role == "scalar"), F.lit(True)).when(role.isin("title", "label", "group"), text)
        .when(role == "weight", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).when(role == "tags", listed & ~colon)
        .when(role == "link", F.when(F.col("many"), listed).otherwise(text)).when(role == "parent", text | (listed & (F.size(items) <= 1)))
    )
    bad = cells.filter(~F.coalesce(fits, F.lit(False)))
    return bad.select("collection", "id", "field", F.when(role.isNull(), "no_field").otherwise(F.concat(F.lit("not_"), role)).alias("rule"))


def undeclared_links(fields: DataFrame) -> DataFrame:
    """fields (collection, field, role, target) less link fields whose target no table declares."""
    known = fields.select(F.col("collection").alias("target")).distinct()
    return fields.filter("role != 'link'").unionByName(fields.filter("role = 'link'").join(known, "target", "left_semi").select(fields.columns))


def simple_graph(edges: DataFrame) -> DataFrame:
    """(low, high, strength): no loops, parallels collapsed to the first strength."""
    pairs = edges.filter("src_id != dst_id").withColumn("low", F.least("src_id", "dst_id")).withColumn("high", F.greatest("src_id", "dst_id"))
    return pairs.groupBy("low", "high").agg(F.min_by("strength", "place").alias("strength"))


def diff(previous: DataFrame, following: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(key, change): added, removed or updated. NaN differs from NaN, and null from any value."""
    old = previous.select(F.col(key).alias("__k"), F.struct(*fields).alias("__old"))
    new = following.select(key, F.struct(*fields).alias("__new"))
    kinds = dict(following.dtypes)
    same = F.lit(True)
    for f in fields:
        eq = F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}"))
        if kinds[f] in ("double", "float"):
            eq = eq & ~F.coalesce(F.isnan(f"__old.{f}"), F.lit(False))
        same = same & eq
    met = old.join(new, F.col("__k") == F.col(key), "full_outer")
    change = F.when(F.col("__k").isNull(), "added").when(F.col(key).isNull(), "removed").when(~same, "updated")
    return met.select(F.coalesce(F.col(key), F.col("__k")).alias(key), change.alias("change")).filter("change is not null")


def extend_refusals(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(rule, id) for which an append is refused as a whole: ids that exist, ends that do not."""
    taken = new_nodes.join(nodes.select("id"), "id", "left_semi").select(F.lit("node_exists").alias("rule"), "id")
    taken_edges = new_edges.join(edges.select("id"), "id", "left_semi").select(F.lit("edge_exists").alias("rule"), "id")
    have = nodes.select("id").union(new_nodes.select("id"))
    ends = new_edges.select("id", F.explode(F.array("src_id", "dst_id")).alias("end"))
    loose = ends.join(have.withColumnRenamed("id", "end"), "end", "left_anti").select(F.lit("no_endpoint").alias("rule"), "id").distinct()
    return taken.union(taken_edges).union(loose)


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row, q, for an undirected weighted graph and (id, community)."""
    m = membership.select(F.col("id").alias("src_id"), F.col("community").alias("cs")), membership.select(F.col("id").alias("dst_id"), F.col("community").alias("cd"))
    both = edges.select("src_id", "dst_id", "strength").join(m[0], "src_id").join(m[1], "dst_id")
    total = both.agg(F.sum("strength").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("strength")).otherwise(0.0)).alias("inside"))
    halves = both.select("cs", "strength").union(both.select("cd", "strength")).groupBy("cs").agg(F.sum("strength").alias("d"))
    spread = halves.agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    q = F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("sq") / (4 * F.col("m") * F.col("m"))).otherwise(F.lit(0.0))
    return total.crossJoin(spread).select(q.alias("q"))
