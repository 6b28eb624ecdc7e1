"""Queries over a shop graph that the test tables derive, each beside its SQL.

Nodes are regions, nations, customers, suppliers and orders; links lead from each to the one it belongs to;
customers are tagged with their segment, orders with their status.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexframe.functions import ids, scalars
from plexframe.operators import drawing, model, predicates, traverse
from plexframe.sources.tables import Link, Table, dense, edges, records, refusals, tag_hubs
from plexframe.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shop(spark: SparkSession, d: str) -> list[Table]:
    customer = _t(spark, d, "customer").withColumn("tags", F.array("c_mktsegment"))
    orders = _t(spark, d, "orders").withColumn("tags", F.array("o_orderstatus")).withColumn("version", F.unix_timestamp("o_orderdate"))
    return [
        Table("region", _t(spark, d, "region"), "r_regionkey", title="r_name"),
        Table("nation", _t(spark, d, "nation"), "n_nationkey", title="n_name", links=[Link("n_regionkey", "region")]),
        Table("customer", customer, "c_custkey", title="c_name", group="c_mktsegment", weight="c_acctbal", tags="tags", links=[Link("c_nationkey", "nation")]),
        Table("supplier", _t(spark, d, "supplier"), "s_suppkey", title="s_name", weight="s_acctbal", links=[Link("s_nationkey", "nation")]),
        Table("orders", orders, "o_orderkey", group="o_orderpriority", weight="o_totalprice", version="version", tags="tags", links=[Link("o_custkey", "customer")]),
    ]


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    tables = shop(spark, d)
    return records("shop", tables).unionByName(tag_hubs(tables))


def edges_of(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Edges of these kinds, or of all."""
    return edges("shop", shop(spark, d), *[kinds] * bool(kinds))


NODES = """
rec AS (
  SELECT 'shop:region:' || r_regionkey AS id, 'region' AS database_id, r_name AS label, NULL::VARCHAR AS group_label, 0.5::DOUBLE AS weight, 0::DOUBLE AS version, NULL::VARCHAR AS tag FROM region
  UNION ALL SELECT 'shop:nation:' || n_nationkey, 'nation', n_name, NULL, 0.5, 0, NULL FROM nation
  UNION ALL SELECT 'shop:customer:' || c_custkey, 'customer', c_name, c_mktsegment, c_acctbal, 0, c_mktsegment FROM customer
  UNION ALL SELECT 'shop:supplier:' || s_suppkey, 'supplier', s_name, NULL, s_acctbal, 0, NULL FROM supplier
  UNION ALL SELECT 'shop:orders:' || o_orderkey, 'orders', o_orderkey::VARCHAR, o_orderpriority, o_totalprice, floor(epoch(o_orderdate))::DOUBLE, o_orderstatus FROM orders
), nodes AS (
  SELECT id, 'record' AS kind, database_id, 'shop' AS source, label, group_label, weight, version FROM rec
  UNION ALL SELECT DISTINCT 'tag:' || tag, 'tag', NULL, 'tag', tag, NULL, 0.5::DOUBLE, 0::DOUBLE FROM rec WHERE tag IS NOT NULL
)"""
EDGES = """
link AS (
  SELECT 'shop:nation:' || n_nationkey AS s, 'shop:region:' || n_regionkey AS t, 'n_regionkey' AS label FROM nation
  UNION ALL SELECT 'shop:customer:' || c_custkey, 'shop:nation:' || c_nationkey, 'c_nationkey' FROM customer
  UNION ALL SELECT 'shop:supplier:' || s_suppkey, 'shop:nation:' || s_nationkey, 's_nationkey' FROM supplier
  UNION ALL SELECT 'shop:orders:' || o_orderkey, 'shop:customer:' || o_custkey, 'o_custkey' FROM orders
), edges AS (
  SELECT s || '->' || t || ':relation:' || label AS id, s AS src_id, t AS dst_id, 'relation' AS kind, label, 1.0::DOUBLE AS strength, TRUE AS directed FROM link
  UNION ALL SELECT least(id, 'tag:' || tag) || '--' || greatest(id, 'tag:' || tag) || ':tag:' || tag, id, 'tag:' || tag, 'tag', tag, 0.75::DOUBLE, FALSE FROM rec WHERE tag IS NOT NULL
), good AS (SELECT * FROM edges WHERE src_id IN (SELECT id FROM nodes) AND dst_id IN (SELECT id FROM nodes)
), deg AS (
  SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src_id AS id FROM good UNION ALL SELECT dst_id FROM good) e ON n.id = e.id GROUP BY n.id
), meta AS (SELECT n.*, d.degree, r.tag FROM nodes n JOIN deg d USING (id) LEFT JOIN rec r USING (id))"""
GRAPH = f"WITH RECURSIVE {NODES.strip()}, {EDGES.strip()}"


def query(sql: str | None = None, graph: bool = True):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{GRAPH} {sql}" if graph else sql
        return f

    return put


NODE_COLUMNS = ["id", "kind", "database_id", "source", "label", "group_label", "weight", "version"]
EDGE_COLUMNS = ["id", "src_id", "dst_id", "kind", "label", "strength", "directed"]


@query("SELECT * FROM nodes")
def derive_nodes(spark, d):
    return nodes_of(spark, d).select(NODE_COLUMNS)


@query("SELECT * FROM edges")
def derive_edges(spark, d):
    return edges_of(spark, d).select(EDGE_COLUMNS)


@query("SELECT id, label FROM nodes WHERE kind = 'tag'")
def derive_tag_hubs(spark, d):
    return tag_hubs(shop(spark, d)).select("id", "label")


@query("SELECT 'duplicate_record' AS rule, 'region' AS collection, r_regionkey::VARCHAR AS id FROM region UNION ALL SELECT 'colon_in_tag', 'customer', c_custkey::VARCHAR FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 97 = 1 UNION ALL SELECT 'no_record', 'orders', o_orderkey::VARCHAR FROM orders WHERE o_custkey % 10 = 0", graph=False)
def derive_refusals(spark, d):
    """The shop with regions stated twice, a tenth of the customers gone, and some tags that hold a colon."""
    tables = {t.name: t for t in shop(spark, d)}
    tables["region"].rows = tables["region"].rows.union(tables["region"].rows)
    some = tables["customer"].rows.filter("c_custkey % 10 != 0")
    tables["customer"].rows = some.withColumn("tags", F.when(F.col("c_custkey") % 97 == 1, F.array(F.lit("a:b"))).otherwise(F.col("tags")))
    return refusals(list(tables.values()))


@query("SELECT 'shop:part:' || p_partkey AS id, p_name AS label, p_brand AS group_label FROM part WHERE p_size > 10 OR p_size IS NULL")
def derive_live(spark, d):
    """Parts of a small size are deleted; the label role goes before the group, and a number is no title."""
    rows = _t(spark, d, "part").withColumn("gone", F.col("p_size") <= 10)
    t = Table("part", rows, "p_partkey", title="p_name", label="p_brand", group="p_type", deleted="gone")
    return records("shop", [t]).select("id", "label", "group_label")


@query("SELECT CASE WHEN p % 2 = 0 THEN least(a, b) || '--' || greatest(a, b) || ':relation:near' ELSE a || '->' || b || ':relation:far' END AS id, a AS src_id, b AS dst_id, p % 2 = 1 AS directed, 'relation' AS kind FROM (SELECT p_partkey AS p, 'shop:part:' || p_partkey AS a, 'shop:part:' || unnest([p_partkey + 1, p_partkey + 2]) AS b FROM part) UNION ALL SELECT least(a, b) || '--' || greatest(a, b) || ':hierarchy:', b, a, FALSE, 'hierarchy' FROM (SELECT 'shop:part:' || p_partkey AS a, 'shop:part:' || p_size AS b FROM part WHERE p_size IS NOT NULL)", graph=False)
def derive_links(spark, d):
    """Links of many references, symmetric and directed, and parents, all within one table."""
    k = F.col("p_partkey")
    refs = F.array(k + 1, k + 2)
    rows = _t(spark, d, "part").withColumns({"near": F.when(k % 2 == 0, refs), "far": F.when(k % 2 == 1, refs)})
    t = Table("part", rows, "p_partkey", parent="p_size", links=[Link("near", "part", many=True, symmetric=True), Link("far", "part", many=True)])
    return edges("shop", [t]).select("id", "src_id", "dst_id", "directed", "kind")


@query("SELECT * FROM nodes")
def index_nodes(spark, d):
    n = nodes_of(spark, d)
    return model.index_nodes(n.unionByName(n)).select(NODE_COLUMNS)


@query("SELECT * FROM good")
def index_edges(spark, d):
    e = edges_of(spark, d)
    loose = e.filter("kind = 'relation'").withColumn("dst_id", F.lit("shop:nation:none"))
    return model.index_edges(nodes_of(spark, d), e.unionByName(loose)).select(EDGE_COLUMNS)


@query("SELECT id, row_number() OVER (ORDER BY database_id, id) - 1 AS ord FROM nodes WHERE kind = 'record'")
def dense_order(spark, d):
    n = nodes_of(spark, d).filter("kind = 'record'").withColumn("by", F.struct("database_id", "id"))
    return dense(n, "by").select("id", "ord")


@query("SELECT id, split_part(id, ':', 1) AS src, split_part(id, ':', 2) AS collection, split_part(id, ':', 3) AS record FROM nodes WHERE kind = 'record'")
def parse_ids(spark, d):
    p = ids.parse_node_id(F.col("id"))
    out = nodes_of(spark, d).select("id", p.alias("p")).filter("p is not null")
    return out.select("id", F.col("p.source").alias("src"), F.col("p.collection").alias("collection"), F.col("p.record").alias("record"))


#: Names of links as sources state them, one for each branch of the rule and some that fall through.
WIRE = ["parent", "Child_Of", "x_hierarchy_y", "links_to", "my_note_link", "annotates", "note_of", "Tagged", "tag"]


@query(
    "WITH t AS (SELECT event_type AS name FROM events UNION SELECT unnest(" + repr(WIRE) + ")), k AS (SELECT name, lower(name) AS l FROM t), r AS (SELECT name, l, CASE WHEN l IN ('parent', 'parent_of', 'child_of') OR contains(l, 'hierarchy') THEN 'hierarchy' WHEN contains(l, 'note_link') OR l = 'links_to' THEN 'note_link' "
    "WHEN contains(l, 'note_of') OR l = 'annotates' THEN 'note_of' WHEN l IN ('tagged', 'tag') THEN 'tag' ELSE 'relation' END AS kind FROM k) SELECT name, kind, CASE kind WHEN 'hierarchy' THEN 2.0 WHEN 'relation' THEN 1.0 WHEN 'tag' THEN 0.75 WHEN 'note_link' THEN 0.625 ELSE 0.5 END::DOUBLE AS strength, l = 'child_of' AS child_first FROM r",
    graph=False,
)
def edge_kinds(spark, d):
    names = _t(spark, d, "events").select(F.col("event_type").alias("name")).union(spark.createDataFrame([(w,) for w in WIRE], "name string")).distinct()
    k = ids.edge_kind(F.col("name"))
    return names.select("name", k.alias("kind"), ids.edge_strength(k).alias("strength"), ids.child_first(F.col("name")).alias("child_first"))


@query("SELECT * FROM deg")
def degree(spark, d):
    return model.degrees(nodes_of(spark, d), edges_of(spark, d))


@query("SELECT id, degree, round(greatest(0.2, least(1.0, 0.2 + 0.8 * ln(1 + degree) / ln(9.0))), 6) AS weight FROM deg")
def degree_weight(spark, d):
    return model.degree_weights(nodes_of(spark, d), edges_of(spark, d)).withColumn("weight", F.round("weight", 6))


@query("SELECT count(*) AS nodes, count(DISTINCT database_id) AS databases, count(*) FILTER (kind = 'note') AS notes, (SELECT count(*) FROM good) AS edges FROM nodes")
def graph_stats(spark, d):
    return model.stats(nodes_of(spark, d), edges_of(spark, d))


@query("SELECT database_id AS label, count(*) AS n FROM nodes WHERE database_id IS NOT NULL GROUP BY 1")
def legend_databases(spark, d):
    return model.legend_databases(nodes_of(spark, d)).select("label", "n")


@query("SELECT label, count(*) AS n FROM edges WHERE kind = 'tag' GROUP BY 1")
def legend_tags(spark, d):
    return model.legend_tags(nodes_of(spark, d), edges_of(spark, d, "tag"))


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def legend_kinds(spark, d):
    return model.legend_kinds(nodes_of(spark, d))


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Part to supplier edges of line items, with parallels; place and id by line."""
    key = F.struct("l_orderkey", "l_linenumber")
    out = _t(spark, d, "lineitem").filter("l_quantity is not null")
    return out.select(key.alias("place"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("src_id"), F.concat(F.lit("s"), "l_suppkey").alias("dst_id"), F.col("l_quantity").alias("strength"))


SALES = "WITH sales AS (SELECT l_orderkey AS o, l_linenumber AS l, l_orderkey || '-' || l_linenumber AS id, 'p' || l_partkey AS src_id, 's' || l_suppkey AS dst_id, l_quantity AS strength FROM lineitem WHERE l_quantity IS NOT NULL)"


@query(f"{SALES} SELECT src_id AS low, dst_id AS high, first(strength ORDER BY o, l, strength) AS strength FROM sales GROUP BY 1, 2", graph=False)
def simple_graph(spark, d):
    e = sales(spark, d).withColumn("place", F.struct("place", "strength"))
    return model.simple_graph(e)


@query(f"{SALES} SELECT id, src_id, dst_id, round(2.0 * (row_number() OVER w - 1 - (count(*) OVER (PARTITION BY src_id, dst_id) - 1) / 2.0), 6) AS offset_at FROM sales WINDOW w AS (PARTITION BY src_id, dst_id ORDER BY id)", graph=False)
def parallel_fan(spark, d):
    return drawing.fans(sales(spark, d), 2.0).select("id", "src_id", "dst_id", F.round("offset", 6).alias("offset_at"))


@query("SELECT id, CASE WHEN database_id = 'supplier' THEN 'removed' WHEN database_id = 'region' THEN 'added' ELSE 'updated' END AS change FROM nodes WHERE database_id IN ('supplier', 'region') OR version > 0")
def diff_nodes(spark, d):
    n = nodes_of(spark, d)
    after = n.filter("database_id is null or database_id != 'supplier'").withColumn("version", F.col("version") * 2)
    return model.diff(n.filter("database_id is null or database_id != 'region'"), after, ["kind", "database_id", "source", "label", "group_label", "weight", "version"])


@query("SELECT 'node_exists' AS rule, id FROM nodes WHERE database_id = 'region' UNION ALL SELECT 'no_endpoint', id || 'x' FROM edges WHERE label = 'n_regionkey'")
def extend_refusals(spark, d):
    n, e = nodes_of(spark, d), edges_of(spark, d)
    new = e.filter("label = 'n_regionkey'").select(F.concat("id", F.lit("x")).alias("id"), "src_id", F.lit("shop:region:none").alias("dst_id"))
    return model.extend_refusals(n, e, n.filter("database_id = 'region'"), new)


@query("SELECT round(sum(CASE WHEN a = b THEN s ELSE 0 END) / sum(s) - (SELECT sum(d * d) FROM (SELECT a, sum(s) AS d FROM (SELECT a, s FROM e UNION ALL SELECT b, s FROM e) GROUP BY a)) / (4 * sum(s) * sum(s)), 9) AS q FROM e".replace("FROM e", "FROM com").replace("SELECT round", ", com AS (SELECT x.database_id AS a, y.database_id AS b, g.strength AS s FROM good g JOIN nodes x ON g.src_id = x.id JOIN nodes y ON g.dst_id = y.id WHERE g.kind = 'relation') SELECT round", 1))
def modularity(spark, d):
    member = nodes_of(spark, d).select("id", F.col("database_id").alias("community"))
    return model.modularity(edges_of(spark, d, "relation"), member).select(F.round("q", 9).alias("q"))


START = "shop:nation:3"
FROM = "shop:customer:7"


def _neighbours(depth: int) -> str:
    return f""", walk(id, distance) AS (
      SELECT '{START}', 0 UNION
      SELECT CASE WHEN g.src_id = w.id THEN g.dst_id ELSE g.src_id END, w.distance + 1 FROM walk w JOIN good g ON g.src_id = w.id OR g.dst_id = w.id WHERE w.distance < {depth} AND g.kind = 'relation'
    ) SELECT id, min(distance)::INTEGER AS distance FROM walk GROUP BY id"""


def _near(spark, d, depth):
    return traverse.neighbourhood(edges_of(spark, d, "relation"), spark.createDataFrame([(START,)], "id string"), depth)


@query(_neighbours(1))
def neighborhood_d1(spark, d):
    return _near(spark, d, 1)


@query(_neighbours(2))
def neighborhood_d2(spark, d):
    return _near(spark, d, 2)


CONV = "WITH RECURSIVE n AS (SELECT DISTINCT conv_id || '/' || turn AS id, conv_id, turn FROM conversations), e AS (SELECT a.id AS src_id, b.id AS dst_id FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _t(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "turn").distinct()
    a, b = n.alias("a"), n.alias("b")
    e = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    e = e.select(F.col("a.id").alias("src_id"), F.col("b.id").alias("dst_id"), F.lit("hierarchy").alias("kind"), F.lit(2.0).alias("strength"), F.lit(True).alias("directed"))
    return n, e.withColumn("id", F.concat_ws("->", "src_id", "dst_id"))


@query(f"{CONV}, r AS (SELECT id, id AS o FROM n UNION SELECT r.id, CASE WHEN e.src_id = r.o THEN e.dst_id ELSE e.src_id END FROM r JOIN e ON r.o = e.src_id OR r.o = e.dst_id) SELECT id, min(o) AS component FROM r GROUP BY id", graph=False)
def weak_components(spark, d):
    return traverse.weak_components(*turns(spark, d))


@query(f"{CONV} SELECT dst_id AS child, min(src_id) AS parent FROM e GROUP BY 1", graph=False)
def hierarchy_parent(spark, d):
    return traverse.parents(turns(spark, d)[1]).select("child", "parent")


@query(f"{CONV}, w AS (SELECT id, 0::BIGINT AS depth FROM n WHERE id NOT IN (SELECT dst_id FROM e) UNION ALL SELECT e.dst_id, w.depth + 1 FROM w JOIN e ON e.src_id = w.id) SELECT * FROM w", graph=False)
def bfs_depth(spark, d):
    n, e = turns(spark, d)
    return traverse.depths(n, traverse.parents(e))


@query(", a AS (SELECT src_id AS s, dst_id AS t, strength FROM good UNION ALL SELECT dst_id, src_id, strength FROM good WHERE NOT directed), w AS (SELECT '" + FROM + "' AS id, 0.0::DOUBLE AS distance UNION SELECT a.t, w.distance + a.strength FROM w JOIN a ON a.s = w.id WHERE w.distance < 4) SELECT n.id, min(w.distance) AS distance FROM nodes n LEFT JOIN w USING (id) GROUP BY n.id")
def shortest_paths(spark, d):
    """From one order, along its links and back over its tags' edges: no node that is reached is further than 5."""
    return traverse.shortest_paths(nodes_of(spark, d), edges_of(spark, d), FROM)


def meta(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes_of(spark, d), edges_of(spark, d)
    tags = edges_of(spark, d, "tag").groupBy(F.col("src_id").alias("id")).agg(F.collect_set("label").alias("tags"))
    return n.join(model.degrees(n, e), "id").join(tags, "id", "left")


FILTERS = {
    "filter_query_text": ("customer#00000000", "lower(label) LIKE '%customer#00000000%'"),
    "filter_query_fields": ("db:orders AND degree:>=2 AND NOT group:1-URGENT", "lower(database_id) = 'orders' AND degree >= 2 AND NOT coalesce(lower(group_label) = '1-urgent', FALSE)"),
    "filter_query_tags": ("(tag:#BUILDING OR tag:f) AND NOT kind:tag", "coalesce(lower(tag) IN ('building', 'f'), FALSE) AND kind <> 'tag'"),
    "filter_query_version": ("version:>800000000 OR kind:tag", "version > 800000000 OR kind = 'tag'"),
}


def _filtered(text: str) -> Query:
    return lambda spark, d: meta(spark, d).filter(predicates.matches(predicates.parse(text))).select("id", "label", "degree")


for _name, (_text, _where) in FILTERS.items():
    QUERIES[_name] = _filtered(_text)
    SQL[_name] = f"{GRAPH} SELECT id, label, degree FROM meta WHERE {_where}"


@query("SELECT id, (kind = 'tag' OR coalesce(group_label = 'BUILDING', FALSE) OR degree < 2) AS hidden FROM meta")
def hidden_mask(spark, d):
    return meta(spark, d).select("id", predicates.hidden(groups=["BUILDING"], kinds=["tag"], min_degree=2).alias("hidden"))


@query("SELECT id, CASE WHEN degree >= 20 THEN 'hub' WHEN database_id = 'orders' THEN 'order' END AS rule FROM meta")
def group_rules(spark, d):
    return meta(spark, d).select("id", predicates.first_match([("hub", "degree:>=20"), ("order", "db:orders")]).alias("rule"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"), F.lit(0.5).alias("r"))


POINTS = "WITH p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, 0.5 AS r FROM embeddings)"


@query(f"{POINTS} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 1", graph=False)
def overlap_pairs(spark, d):
    return drawing.overlaps(points(spark, d), 0.5)


@query(f"{POINTS} SELECT id FROM p WHERE x BETWEEN -5 AND 5 AND y BETWEEN 0 AND 10", graph=False)
def box_select(spark, d):
    return points(spark, d).filter("x between -5 and 5 and y between 0 and 10").select("id")


@query(f"{POINTS} SELECT label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n, round(sqrt(var_pop(x) + var_pop(y)), 6) AS spread FROM p GROUP BY 1", graph=False)
def centroid_blobs(spark, d):
    out = points(spark, d).groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))
    return out.select("label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n", F.round("spread", 6).alias("spread"))


CUST = "SELECT c_custkey AS id, c_nationkey AS v, c_acctbal AS w FROM customer"


def _values(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("v"), F.col("c_acctbal").alias("w"))


def _normal(spark, d, value, **options):
    return scalars.normalise(_values(spark, d), value, **options).select("id", F.round("t", 6).alias("t"))


@query(f"SELECT id, round((w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()), 6) AS t FROM ({CUST})", graph=False)
def normalise_linear(spark, d):
    return _normal(spark, d, "w")


@query(f"WITH c AS ({CUST}), b AS (SELECT quantile_cont(w, 0.05) AS lo, quantile_cont(w, 0.9) AS hi FROM c) SELECT id, round(sqrt((least(hi, greatest(lo, w)) - lo) / (hi - lo)), 6) AS t FROM c, b", graph=False)
def normalise_clipped(spark, d):
    return _normal(spark, d, "w", clip_low=90, clip_high=5, gamma=2.0)


@query(f"WITH c AS ({CUST}), b AS (SELECT min(w) AS lo, max(w) AS hi, min(w) FILTER (w > 0) AS pos FROM c), e AS (SELECT *, greatest(pos * 10 ** -greatest((log10(hi) - log10(pos)) * 0.1 / 0.9, 0.05), 1e-30) AS eps FROM b) SELECT id, round(greatest(0, (log10(greatest(w, eps)) - log10(greatest(lo, eps))) / (log10(hi) - log10(greatest(lo, eps)))), 6) AS t FROM c, e", graph=False)
def normalise_log(spark, d):
    return _normal(spark, d, "w", mode="LOG")


@query(f"SELECT id, round((rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(*) OVER () - 1), 6) AS t FROM ({CUST})", graph=False)
def normalise_rank(spark, d):
    return _normal(spark, d, "v", mode="RANK")


@query(f"SELECT id, round((dense_rank() OVER (ORDER BY v) - 1)::DOUBLE / ((SELECT count(DISTINCT v) FROM ({CUST})) - 1), 6) AS t FROM ({CUST})", graph=False)
def normalise_quantile(spark, d):
    return _normal(spark, d, "v", mode="QUANTILE")


@query(f"SELECT 5.0::DOUBLE AS p, quantile_cont(w, 0.05) AS value FROM ({CUST}) UNION ALL SELECT 50.0, quantile_cont(w, 0.5) FROM ({CUST}) UNION ALL SELECT 99.0, quantile_cont(w, 0.99) FROM ({CUST})".replace("AS value", "AS v").replace("SELECT 5.0", "SELECT p, round(v, 6) AS value FROM (SELECT 5.0") + ")", graph=False)
def percentile_values(spark, d):
    found = scalars.percentiles(_values(spark, d), "w", [5.0, 50.0, 99.0])
    return spark.createDataFrame(list(zip([5.0, 50.0, 99.0], found, strict=True)), "p double, value double").withColumn("value", F.round("value", 6))


@query("WITH f AS (SELECT c_mktsegment AS k, min(c_custkey) AS o FROM customer GROUP BY 1), s AS (SELECT k, (row_number() OVER (ORDER BY o) - 1)::INTEGER AS slot FROM f) SELECT c_custkey AS id, slot FROM customer JOIN s ON c_mktsegment = k", graph=False)
def categorical_slots(spark, d):
    return scalars.slots(_t(spark, d, "customer"), "c_mktsegment", "c_custkey").select(F.col("c_custkey").alias("id"), "slot")


@query("SELECT n, CASE WHEN n <= 2000 THEN 'full' WHEN n <= 20000 THEN 'no_labels' WHEN n <= 200000 THEN 'decimated' ELSE 'clustered' END AS tier FROM (SELECT o_orderkey AS n FROM orders)", graph=False)
def lod_tier(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("n")).select("n", scalars.tier(F.col("n")).alias("tier"))


def _numbered(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("depth"))
    return dense(c, "id"), c.count()


ORD = "WITH o AS (SELECT c_custkey AS id, c_nationkey AS depth, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, count(*) OVER () AS n FROM customer)"
XY = ["round(x, 6) AS x", "round(y, 6) AS y"]
RESCALE = "c AS (SELECT id, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM q), m AS (SELECT max(greatest(abs(x), abs(y))) AS m FROM c) SELECT id, round(x / m, 6) AS x, round(y / m, 6) AS y FROM c, m"


@query(f"{ORD}, s AS (SELECT *, ceil(sqrt(n))::BIGINT AS k FROM o) SELECT id, round(ord % k - (k - 1) / 2.0, 6)::DOUBLE AS x, round(ord // k - (ceil(n / k::DOUBLE) - 1) / 2.0, 6)::DOUBLE AS y FROM s", graph=False)
def layout_grid(spark, d):
    o, n = _numbered(spark, d)
    return drawing.grid(o, n).selectExpr("id", *XY)


@query(f"{ORD}, q AS (SELECT id, cos(ord * 2 * pi() / n) AS x, sin(ord * 2 * pi() / n) AS y FROM o), {RESCALE}", graph=False)
def layout_ring(spark, d):
    return drawing.ring(*_numbered(spark, d)).selectExpr("id", *XY)


@query(f"{ORD}, q AS (SELECT id, ord * cos(ord * 0.35) AS x, ord * sin(ord * 0.35) AS y FROM o), {RESCALE}", graph=False)
def layout_spiral(spark, d):
    return drawing.spiral(_numbered(spark, d)[0]).selectExpr("id", *XY)


@query(f"{ORD} SELECT id, round(depth * cos((row_number() OVER (PARTITION BY depth ORDER BY ord) - 1) * 2 * pi() / count(*) OVER (PARTITION BY depth)), 6) AS x, round(depth * sin((row_number() OVER (PARTITION BY depth ORDER BY ord) - 1) * 2 * pi() / count(*) OVER (PARTITION BY depth)), 6) AS y FROM o", graph=False)
def layout_radial(spark, d):
    return drawing.radial(_numbered(spark, d)[0]).selectExpr("id", *XY)


def ops(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("upsert")
    return e.select(F.pmod("user_id", F.lit(3)).alias("ws"), F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), kind.alias("op"), F.col("props").alias("text"))


OPS = "WITH ops AS (SELECT user_id % 3 AS ws, event_type AS collection, user_id::VARCHAR AS id, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, props AS text FROM events), h AS (SELECT ws, seq, strlen(text)::BIGINT AS bytes FROM ops)"


def heads(spark, d):
    return ops(spark, d).select("ws", "seq", F.octet_length("text").cast("long").alias("bytes"))


@query(f"{OPS} SELECT ws, collection, id, text, seq FROM (SELECT *, row_number() OVER (PARTITION BY ws, collection, id ORDER BY seq DESC) AS k FROM ops) WHERE k = 1 AND op <> 'delete'", graph=False)
def latest_records(spark, d):
    return changes.latest(ops(spark, d))


@query(f"{OPS}, r AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS b FROM h WINDOW w AS (PARTITION BY ws ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)) SELECT ws, max(seq) AS cut FROM r WHERE n > 500 OR b > 9000 GROUP BY 1", graph=False)
def retention_cut(spark, d):
    return changes.retention_cut(heads(spark, d), 500, 9000)


@query(f"{OPS}, r AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS b FROM h WHERE seq > 100 WINDOW w AS (PARTITION BY ws ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT ws, seq, bytes FROM r WHERE n = 1 OR (n <= 50 AND b <= 900)", graph=False)
def change_page(spark, d):
    return changes.change_page(heads(spark, d), 100, 50, 900)


@query(f"{OPS}, b AS (SELECT ws, min(seq) AS low, max(seq) AS head FROM h GROUP BY 1) SELECT ops.ws, seq, CASE WHEN seq % 2 = 0 AND seq + 40 + 1 >= low AND seq + 40 <= head THEN 'valid' ELSE 'gone' END AS state FROM ops JOIN b ON ops.ws = b.ws", graph=False)
def cursor_state(spark, d):
    h = heads(spark, d)
    bounds = h.groupBy("ws").agg(F.min("seq").alias("low"), F.max("seq").alias("head"))
    state = changes.cursor_state(F.col("seq") % 2, F.col("seq") + 40, F.lit(0), F.col("low"), F.col("head"))
    return h.join(bounds, "ws").select("ws", "seq", state.alias("state"))
