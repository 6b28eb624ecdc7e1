"""More queries over the test tables: analyses, folding, sync, layouts and measures of drawings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexframe.functions import scalars
from plexframe.operators import analysis, drawing, model, traverse
from plexframe.plans.queries import CONV, GRAPH, ORD, POINTS, START, Query, _numbered, _t, edges_of, nodes_of, points, turns
from plexframe.sources.tables import dense, present_only, running, to_delete

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{GRAPH} {sql}" if graph else sql
        return f

    return put


def _belongs(spark, d):
    """Records and the relations between them."""
    return nodes_of(spark, d).filter("kind = 'record'"), model.index_edges(nodes_of(spark, d), edges_of(spark, d, "relation"))


@query(
    f"{CONV}, a AS (SELECT src_id, dst_id FROM e UNION SELECT e.dst_id, e.src_id FROM e JOIN n ON n.id = e.dst_id WHERE n.turn % 3 = 0), r AS (SELECT id, id AS o FROM n UNION SELECT r.id, a.dst_id FROM r JOIN a ON r.o = a.src_id) SELECT x.id, min(x.o) AS component FROM r x JOIN r y ON x.id = y.o AND x.o = y.id GROUP BY 1",
    graph=False,
)
def strong_components(spark, d):
    n, e = turns(spark, d)
    back = e.join(n.filter("turn % 3 = 0").select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    back = back.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "strength", "directed")
    return analysis.strong_components(n, e.select("src_id", "dst_id", "strength", "directed").union(back))


WALK = "walk(s, id, distance) AS (SELECT id, id, 0.0::DOUBLE FROM nodes WHERE kind = 'record' UNION ALL SELECT w.s, g.dst_id, w.distance + g.strength FROM walk w JOIN good g ON g.src_id = w.id WHERE g.kind = 'relation')"


@query(f", {WALK} SELECT s AS id, round(CASE WHEN sum(distance) > 0 THEN (count(*) - 1) / sum(distance) * (count(*) - 1) / ((SELECT count(*) FROM rec) - 1) ELSE 0 END, 12) AS value FROM walk GROUP BY 1")
def closeness(spark, d):
    return analysis.closeness(*_belongs(spark, d)).select("id", F.round("value", 12).alias("value"))


@query(f", {WALK}, i AS (SELECT id, count(*) - 1 AS c FROM walk GROUP BY 1), o AS (SELECT s AS id, count(*) - 1 AS c FROM walk GROUP BY 1) SELECT id, round((i.c * o.c)::DOUBLE, 3) AS value FROM i JOIN o USING (id)")
def betweenness(spark, d):
    return analysis.betweenness(*_belongs(spark, d)).select("id", F.round("value", 3).alias("value"))


@query(", w AS (SELECT '" + START + "' AS id, 0.0::DOUBLE AS distance UNION ALL SELECT g.dst_id, w.distance - g.strength FROM w JOIN good g ON g.src_id = w.id WHERE g.directed) SELECT n.id, min(w.distance) AS distance FROM nodes n LEFT JOIN w USING (id) WHERE n.kind = 'record' GROUP BY n.id")
def bellman_ford(spark, d):
    n, e = _belongs(spark, d)
    return analysis.bellman_ford(n, e.withColumn("strength", -F.col("strength")), START)[0]


_ROUND = "x{i} AS (SELECT n.id, coalesce(sum(a.w * x.v), 0) AS v FROM nodes n LEFT JOIN arcs a ON a.t = n.id LEFT JOIN x{j} x ON x.id = a.s GROUP BY 1)"


@query(
    ", both_ways AS (SELECT src_id AS s, dst_id AS t, strength FROM good UNION ALL SELECT dst_id, src_id, strength FROM good), arcs AS (SELECT s, t, sum(strength) AS w FROM both_ways GROUP BY 1, 2), "
    "x0 AS (SELECT id, 1.0::DOUBLE AS v FROM nodes), " + ", ".join(_ROUND.format(i=i, j=i - 1) for i in range(1, 5)) + " SELECT id, round(v / (SELECT sqrt(sum(v * v)) FROM x4), 9) AS value FROM x4"
)
def eigenvector(spark, d):
    """Four rounds over the whole graph, its edges taken both ways."""
    e = model.index_edges(nodes_of(spark, d), edges_of(spark, d)).withColumn("directed", F.lit(False))
    return analysis.eigenvector(nodes_of(spark, d), e, rounds=4)[0].select("id", F.round("value", 9).alias("value"))


FOLD = ", p AS (SELECT src_id AS id, dst_id AS o FROM good WHERE kind = 'relation' UNION SELECT dst_id, src_id FROM good WHERE kind = 'relation'), k AS (SELECT id, count(*) AS n, min(o) AS o FROM p GROUP BY 1), f AS (SELECT k.id, k.o FROM k JOIN k m ON k.o = m.id WHERE k.n = 1 AND (m.n > 1 OR m.id < k.id))"


def _folded(spark, d):
    n, e = _belongs(spark, d)
    return analysis.fold_leaves(n.withColumn("ord", F.col("id")), e)


@query(f"{FOLD} SELECT rec.id, f.o IS NULL AS visible, coalesce(f.o, rec.id) AS representative FROM rec LEFT JOIN f USING (id)")
def leaf_fold(spark, d):
    return _folded(spark, d)[0].drop("ord")


@query(f"{FOLD} SELECT id, src_id NOT IN (SELECT id FROM f) AND dst_id NOT IN (SELECT id FROM f) AS visible FROM good WHERE kind = 'relation'")
def leaf_fold_edges(spark, d):
    return _folded(spark, d)[1].select("id", "visible")


@query(f", w(id, distance) AS (SELECT '{START}', 0 UNION SELECT g.src_id, w.distance + 1 FROM w JOIN good g ON g.dst_id = w.id WHERE w.distance < 2 AND g.kind = 'relation') SELECT id, min(distance)::INTEGER AS distance FROM w GROUP BY 1")
def local_graph_in(spark, d):
    return traverse.neighbourhood(_belongs(spark, d)[1], spark.createDataFrame([(START,)], "id string"), 2, "in")


@query("WITH e AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), x AS (SELECT a AS id FROM e WHERE a IS NOT NULL UNION ALL SELECT b FROM e WHERE b IS NOT NULL AND b IS DISTINCT FROM a) SELECT id, count(*) AS degree FROM x GROUP BY 1", graph=False)
def degree_distinct(spark, d):
    e = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"))
    n = e.select(F.col("src_id").alias("id")).union(e.select("dst_id")).filter("id is not null").distinct()
    return model.degrees(n, e, loops_once=True)


@query("SELECT id, CASE source WHEN 'shop' THEN 0 ELSE 1 END AS cluster FROM nodes")
def source_groups(spark, d):
    return scalars.slots(nodes_of(spark, d), "source", "place", most=4096, out="cluster").select("id", "cluster")


@query("WITH x AS (SELECT r_regionkey AS id, unnest([0, 1, 2]) AS pos, unnest([r_regionkey, r_regionkey + 3, r_regionkey + 9]) AS ref FROM region) SELECT id, string_agg(ref::VARCHAR, ',' ORDER BY pos) FILTER (ref IN (SELECT r_regionkey FROM region)) AS refs FROM x GROUP BY 1", graph=False)
def dangling_cells(spark, d):
    r = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"))
    rows = r.withColumn("refs", F.array(F.col("id"), F.col("id") + 3, F.col("id") + 9))
    out = present_only(rows, "id", "refs", r)
    return out.select("id", F.when(F.col("refs").isNotNull(), F.array_join(F.col("refs").cast("array<string>"), ",")).alias("refs"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)", graph=False)
def sync_deletes(spark, d):
    return to_delete(_t(spark, d, "customer"), _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey AS id, sum(strlen(o_orderpriority)) OVER (ORDER BY o_orderkey)::BIGINT AS cost FROM orders", graph=False)
def page_by_cost(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.octet_length("o_orderpriority").cast("long").alias("bytes"))
    return running(o, "id", "bytes", "cost").select("id", "cost")


@query(f"{POINTS}, c AS (SELECT label AS probe, avg(x) AS px, avg(y) AS py FROM p GROUP BY 1), m AS (SELECT probe, id, sqrt((x - px) ** 2 + (y - py) ** 2) AS away FROM c JOIN p ON abs(x - px) <= 4 AND abs(y - py) <= 4) SELECT probe, arg_min(id, away) AS id, round(min(away), 6) AS away FROM m WHERE away <= 4 GROUP BY 1", graph=False)
def nearest_node(spark, d):
    p = points(spark, d)
    probes = p.groupBy(F.col("label").alias("probe")).agg(F.avg("x").alias("px"), F.avg("y").alias("py"))
    return drawing.nearest(p, probes, 4.0).withColumn("away", F.round("away", 6))


@query("WITH g AS (SELECT o_orderkey AS n, o_custkey AS m FROM orders UNION SELECT o_orderkey % 40, o_custkey % 9 FROM orders UNION SELECT o_orderkey * 3, o_custkey FROM orders), s AS (SELECT n, m, 6e6 / nullif(n * log2(n + 1) + m, 0) AS s FROM g) SELECT n, m, CASE WHEN n <= 0 OR s <= 8 THEN 8 WHEN s >= 112 THEN 112 WHEN s >= 64 THEN 64 WHEN s >= 32 THEN 32 WHEN s >= 16 THEN 16 ELSE 8 END AS ticks FROM s", graph=False)
def tick_budget(spark, d):
    """Sizes from none to 45,000 at sf0.01, so that every step of the ladder is met."""
    o = _t(spark, d, "orders")
    sizes = o.select("o_orderkey", "o_custkey").union(o.selectExpr("o_orderkey % 40", "o_custkey % 9")).union(o.selectExpr("o_orderkey * 3", "o_custkey")).distinct().toDF("n", "m")
    return sizes.select("n", "m", scalars.tick_budget(F.col("n"), F.col("m")).alias("ticks"))


@query("SELECT id, ord FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord FROM edges) WHERE ord % 4 = 0")
def lod_edges(spark, d):
    return drawing.decimate(dense(edges_of(spark, d).select("id"), "id"), 4)


def _mix32(t: str) -> str:
    return f"(({t}) % 4294967296)::BIGINT"


_SPREAD = (
    ", s AS (SELECT id, ord, unnest([0, 1]) AS j FROM o), a AS (SELECT id, j, " + _mix32("24301 + (ord * 2 + j + 1)::HUGEINT * 1831565813") + " AS a FROM s), "
    "b AS (SELECT id, j, " + _mix32("xor(a, a >> 15)::HUGEINT * (a | 1)") + " AS t FROM a), "
    "c AS (SELECT id, j, xor(" + _mix32("t + xor(t, t >> 7)::HUGEINT * (t | 61)") + ", t) AS u FROM b), "
    "v AS (SELECT id, j, xor(u, u >> 14) / 4294967296.0::DOUBLE AS v FROM c)"
)


@query(f"{ORD}{_SPREAD} SELECT id, round(max(v) FILTER (j = 0), 6) AS x, round(max(v) FILTER (j = 1), 6) AS y FROM v GROUP BY 1", graph=False)
def layout_random(spark, d):
    return drawing.scatter(_numbered(spark, d)[0]).selectExpr("id", "round(x, 6) AS x", "round(y, 6) AS y")


XYZ = ["id", *(f"round({c}, 6) + 0D AS {c}" for c in "xyz")]  # no negative zeros


@query(f"{ORD}, t AS (SELECT id, ord, (ord // 2)::DOUBLE / ((n + 1) // 2 - 1) AS t FROM o) SELECT id, round(1.5 * cos(4 * pi() * t + ord % 2 * pi()), 6) + 0.0::DOUBLE AS x, round(1.5 * sin(4 * pi() * t + ord % 2 * pi()), 6) + 0.0::DOUBLE AS y, round(10 * t - 5, 6) + 0.0::DOUBLE AS z FROM t", graph=False)
def layout_helix(spark, d):
    return drawing.helix(*_numbered(spark, d)).selectExpr(*XYZ)


@query(f"{ORD}, t AS (SELECT id, ord * (pi() * (3 - sqrt(5))) AS a, 1 - 2 * (ord + 0.5::DOUBLE) / n AS z FROM o) SELECT id, round(5 * sqrt(1 - z * z) * cos(a), 6) + 0.0::DOUBLE AS x, round(5 * sqrt(1 - z * z) * sin(a), 6) + 0.0::DOUBLE AS y, round(5 * z, 6) + 0.0::DOUBLE AS z FROM t", graph=False)
def layout_sphere(spark, d):
    return drawing.sphere(*_numbered(spark, d)).selectExpr(*XYZ)


def _chain(spark, d):
    """Each embedding's point linked with the next id's."""
    p = points(spark, d)
    return drawing.stretched(p.select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("dst_id")), p)


CHAIN = f"{POINTS}, g AS (SELECT a.id AS src_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON b.id = a.id + 1)"


@query(f"{CHAIN} SELECT src_id, round((x0 + x1) / 2, 6) AS elbow_x, round(y0, 6) AS first_y, round(y1, 6) AS second_y FROM g", graph=False)
def edge_style_orthogonal(spark, d):
    b = drawing.elbows(_chain(spark, d))
    return b.select("src_id", F.round(F.col("bends")[0]["x"], 6).alias("elbow_x"), F.round(F.col("bends")[0]["y"], 6).alias("first_y"), F.round(F.col("bends")[1]["y"], 6).alias("second_y"))


@query(f"{CHAIN}, l AS (SELECT sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS length FROM g) SELECT count(*) AS edges, round(sum(length), 4) AS length, round(1 / avg(length), 9) AS stress_ratio FROM l", graph=False)
def ink_length(spark, d):
    return drawing.ink(_chain(spark, d)).select("edges", F.round("length", 4).alias("length"), F.round("stress_ratio", 9).alias("stress_ratio"))


@query(f"{POINTS} SELECT round(avg(sqrt((x - (x * 0.5 + 1)) ** 2 + (y - y * 0.25) ** 2)), 6) AS moved FROM p", graph=False)
def mean_displacement(spark, d):
    p = points(spark, d)
    return drawing.displacement(p, p.selectExpr("id", "x * 0.5 + 1 AS x", "y * 0.25 AS y")).select(F.round("moved", 6).alias("moved"))
