"""Geometry as columns: closed-form layouts, spatial joins by cell, level of detail, edge fans and ink."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexframe.operators.traverse import levels, written
from plexframe.sources.tables import prefixes

GOLDEN = math.pi * (3 - math.sqrt(5))


def grid(nodes: DataFrame, n: int, spacing: float = 1.0) -> DataFrame:
    """A row-major lattice over ord, centred; the square root rounded up gives its columns."""
    cols = math.isqrt(max(n - 1, 0)) + 1
    rows = max(1, -(-n // cols))
    x = (F.col("ord") % cols - (cols - 1) / 2) * spacing
    return nodes.withColumn("x", x).withColumn("y", (F.floor(F.col("ord") / cols) - (rows - 1) / 2) * spacing)


def rescaled(points: DataFrame) -> DataFrame:
    """Moved to the centroid and divided by the largest coordinate."""
    centre = points.agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    moved = points.crossJoin(F.broadcast(centre)).withColumn("x", F.col("x") - F.col("__cx")).withColumn("y", F.col("y") - F.col("__cy")).drop("__cx", "__cy")
    most = moved.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("__m"))
    by = F.when(F.col("__m") > 0, F.col("__m")).otherwise(1.0)
    return moved.crossJoin(F.broadcast(most)).withColumn("x", F.col("x") / by).withColumn("y", F.col("y") / by).drop("__m")


def ring(nodes: DataFrame, n: int) -> DataFrame:
    a = F.col("ord") * (2 * math.pi / max(n, 1))
    return rescaled(nodes.withColumn("x", F.cos(a)).withColumn("y", F.sin(a)))


def spiral(nodes: DataFrame) -> DataFrame:
    a = F.col("ord") * 0.35
    return rescaled(nodes.withColumn("x", F.col("ord") * F.cos(a)).withColumn("y", F.col("ord") * F.sin(a)))


def sphere(nodes: DataFrame, n: int, scale: float = 5.0) -> DataFrame:
    """A Fibonacci sphere."""
    z = 1 - 2 * (F.col("ord") + 0.5) / max(n, 1)
    r, a = F.sqrt(1 - z * z), F.col("ord") * GOLDEN
    return nodes.withColumn("x", scale * r * F.cos(a)).withColumn("y", scale * r * F.sin(a)).withColumn("z", scale * z)


def helix(nodes: DataFrame, n: int, scale: float = 5.0) -> DataFrame:
    """A double helix: two turns up, even and odd places on opposite strands."""
    levels = -(-n // 2)
    t = F.floor(F.col("ord") / 2) / (levels - 1) if levels > 1 else F.lit(0.5)
    a = t * (4 * math.pi) + (F.col("ord") % 2) * math.pi
    return nodes.withColumn("x", 0.3 * scale * F.cos(a)).withColumn("y", 0.3 * scale * F.sin(a)).withColumn("z", t * scale * 2 - scale)


# The seed of the random layout and the step of its generator.
RANDOM_SEED, RANDOM_STEP = 0x5EED, 0x6D2B79F5
_LOW32 = 0xFFFFFFFF


def _times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves of a so that no long overflows."""
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_LOW32))


def draw(k: Column) -> Column:
    """Draw number k (from 0) of the mulberry32 stream, in 0 to 1: its state is the seed and k + 1 steps."""
    a = ((k + 1).bitwiseAND(F.lit(_LOW32)) * F.lit(RANDOM_STEP) + RANDOM_SEED).bitwiseAND(F.lit(_LOW32))
    t = _times32(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = (t + _times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_LOW32)).bitwiseXOR(t)
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)


def scatter(nodes: DataFrame) -> DataFrame:
    """Uniform over the unit square; a node takes two draws by its ord."""
    k = F.col("ord").cast("long") * 2
    return nodes.withColumn("x", draw(k)).withColumn("y", draw(k + 1))


def radial(nodes: DataFrame) -> DataFrame:
    """Rings by depth; the places of a ring are its nodes in order of ord."""
    w = Window.partitionBy("depth")
    a = (F.row_number().over(w.orderBy("ord")) - 1) * 2 * math.pi / F.count("*").over(w)
    return nodes.withColumn("x", F.col("depth") * F.cos(a)).withColumn("y", F.col("depth") * F.sin(a))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def overlaps(points: DataFrame, most_radius: float, margin: float = 0.0) -> DataFrame:
    """(a, b) of discs (id, x, y, r) that overlap, a < b: an equi-join on cells as wide as two of the largest radii."""
    size = 2 * most_radius + margin
    p = points.select("id", "x", "y", "r", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    around = F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i as cx, cy + j as cy))))")
    q = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("r").alias("br"), F.inline(around))
    near = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) < F.pow(F.col("r") + F.col("br") + margin, 2)
    return p.join(q, ["cx", "cy"]).filter((F.col("id") < F.col("b")) & near).select(F.col("id").alias("a"), "b")


def level_of_detail(nodes: DataFrame, edges: DataFrame, n: int, budget: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with labelled, edges with drawn) of a graph of n nodes, whose nodes have degree, ord and visible.

    Labels go to the `budget` visible nodes of largest degree (ties by ord; 0 is no limit), to none from 2,001 to 20,000
    nodes. Edges between visible nodes are all drawn up to 2,000 nodes, every stride-th by ord up to 200,000, else none.
    """
    seen = nodes.filter("visible")
    if 2000 < n <= 20_000:
        labelled = nodes.withColumn("labelled", F.lit(False))
    elif not budget:
        labelled = nodes.withColumn("labelled", F.col("visible"))
    else:
        top = seen.orderBy(F.desc("degree"), "ord").limit(budget).select("ord", F.lit(True).alias("labelled"))
        labelled = nodes.join(top, "ord", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    ends = lambda c: seen.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}"))
    kept = F.lit(n <= 200_000) & F.col("__src_id").isNotNull() & F.col("__dst_id").isNotNull()
    kept = kept if n <= 2000 else kept & (F.col("ord") % max(stride, 1) == 0)
    return labelled, edges.join(ends("src_id"), "src_id", "left").join(ends("dst_id"), "dst_id", "left").withColumn("drawn", kept).drop("__src_id", "__dst_id")


def scatter_3d(nodes: DataFrame) -> DataFrame:
    """Uniform over the unit cube; a node takes three draws by its ord."""
    k = F.col("ord").cast("long") * 3
    return nodes.withColumn("x", draw(k)).withColumn("y", draw(k + 1)).withColumn("z", draw(k + 2))


def bounds(points: DataFrame) -> DataFrame:
    """One row: the corners of the box around the places that are visible (all, without such a column)."""
    some = points.filter("visible") if "visible" in points.columns else points
    return some.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def blobs(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, n, spread): centre, number and root mean square distance from the centre of each group's points."""
    out = points.filter("visible") if "visible" in points.columns else points
    return out.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))


def curves(drawn: DataFrame, bend: float = 0.5, cubic: bool = False) -> DataFrame:
    """stretched edges with control points: beside the chord's middle, or its thirds, by bend times half the chord.

    The side turns with the direction, so an edge and its way back part. Chords of no length have none.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.when(F.col("x0") + F.col("y0") > F.col("x1") + F.col("y1"), 1).otherwise(-1) * bend / 2
    at = lambda t: F.struct((F.col("x0") + dx * t - dy * side).alias("x"), (F.col("y0") + dy * t + dx * side).alias("y"))
    points = F.array(at(1 / 3), at(2 / 3)) if cubic else F.array(at(0.5))
    return drawn.withColumn("controls", F.when(F.col("length") >= 1e-10, points).otherwise(F.array().cast(points_type())))


def points_type() -> str:
    return "array<struct<x:double,y:double>>"


def ink_cells(drawn: DataFrame, resolution: int = 128) -> DataFrame:
    """One row: cells of a raster over the ends' box that the chords cross, walked in half cells, and the chords' length."""
    low, high = F.least, F.greatest
    box = drawn.agg(F.min(low("x0", "x1")), F.min(low("y0", "y1")), F.max(high("x0", "x1")), F.max(high("y0", "y1"))).first()
    if box[0] is None:
        return drawn.agg(F.lit(0).cast("long").alias("cells"), F.lit(0.0).alias("length"))
    (a, b), (c, d) = box[:2], box[2:]
    kx, ky = (resolution / (hi - lo) if hi > lo else 1.0 for lo, hi in ((a, c), (b, d)))
    gx, gy = (lambda v: (v - a) * kx), (lambda v: (v - b) * ky)
    steps = high(F.lit(1), F.ceil(2 * high(F.abs(gx(F.col("x1")) - gx(F.col("x0"))), F.abs(gy(F.col("y1")) - gy(F.col("y0")))))).cast("int")
    walk = drawn.select("x0", "y0", "x1", "y1", steps.alias("n"), F.explode(F.sequence(F.lit(0), steps)).alias("i"))
    at = lambda p, q: F.col(p) + (F.col(q) - F.col(p)) * F.col("i") / F.col("n")
    cell_of = lambda g: low(F.floor(g), F.lit(resolution - 1)).cast("int")
    cells = walk.select(cell_of(gx(at("x0", "x1"))).alias("cx"), cell_of(gy(at("y0", "y1"))).alias("cy")).distinct()
    return cells.agg(F.count("*").alias("cells")).crossJoin(drawn.agg(F.sum("length").alias("length")))


def occupancy(points: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """(cx, cy, id): every cell of a grid that a disc (id, x, y, r) and a margin around it reach into, by its box."""
    reach = F.col("r") + margin
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    return points.select("id", "x", "y", "r", spread("x").alias("cx")).select("cx", spread("y").alias("cy"), "id")


def in_rectangle(points: DataFrame, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """Points of a table with cells (cx, cy of that size) within a rectangle: whole cells are chosen first, so they prune."""
    c = lambda v: math.floor(v / size)
    near = points.filter(F.col("cx").between(c(x0), c(x1)) & F.col("cy").between(c(y0), c(y1)))
    return near.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def overlap_count(points: DataFrame, most_radius: float, margin: float = 0.0) -> DataFrame:
    """One row: pairs of discs closer than their radii and two margins."""
    return overlaps(points, most_radius, 2 * margin).agg(F.count("*").alias("pairs"))


def nearest_gap(points: DataFrame) -> DataFrame:
    """One row: the mean distance of each point from its nearest other one; 1 with fewer than two points.

    Cells that hold about two points each are looked at with their neighbours; where nothing lies within a cell's width,
    the width doubles for the points that are left.
    """
    n = points.count()
    if n < 2:
        return points.agg(F.lit(1.0).alias("gap"))
    x0, y0, x1, y1 = bounds(points).first()
    size = max(math.sqrt(max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) * 2 / n), max(x1 - x0, y1 - y0) / 1e6, 1e-9)
    left, found = points.select("id", "x", "y"), None
    while True:
        probes = left.select(F.col("id").alias("probe"), F.col("x").alias("px"), F.col("y").alias("py"))
        p = points.select("id", "x", "y", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
        q = probes.select("*", cell(F.col("px"), size).alias("cx"), cell(F.col("py"), size).alias("cy"))
        around = F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i as cx, cy + j as cy))))")
        met = q.select("probe", "px", "py", F.inline(around)).join(p, ["cx", "cy"]).filter("id != probe")
        near = met.groupBy("probe").agg(F.min(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("gap")).filter(F.col("gap") <= size)
        near = written(near)
        found = near if found is None else found.union(near)
        left = written(left.join(near.select(F.col("probe").alias("id")), "id", "left_anti"))
        if not left.limit(1).count():
            return found.agg(F.greatest(F.avg("gap"), F.lit(1e-9)).alias("gap"))
        size *= 2


def stress_correlation(points: DataFrame, edges: DataFrame, pivots: int = 16) -> DataFrame:
    """One row: Pearson's r between hops and drawn distances from pivots; null where either has no spread.

    The first pivot is the least id; each further one is the node farthest from its nearest pivot, of equal ones the
    least id; what no pivot reaches is farthest of all.
    """
    both = written(edges.select("src_id", "dst_id").union(edges.select("dst_id", "src_id")).filter("src_id != dst_id").distinct())
    ids = written(points.select("id", "x", "y"))
    nearest, chosen, hops = None, [], None
    for _ in range(min(pivots, ids.count())):
        if nearest is None:
            pivot = ids.agg(F.min("id")).first()[0]
        else:
            rest = ids.select("id").join(nearest, "id", "left").filter(~F.col("id").isin(chosen))
            pivot = rest.orderBy(F.desc(F.coalesce("near", F.lit(math.inf).cast("double"))), "id").first()["id"]
        chosen.append(pivot)
        walk = written(levels(both, ids.filter(F.col("id") == pivot).select("id")).withColumn("pivot", F.lit(pivot)))
        hops = walk if hops is None else hops.union(walk)
        near = walk.select("id", F.col("distance").cast("double").alias("near"))
        nearest = written(near if nearest is None else nearest.union(near).groupBy("id").agg(F.min("near").alias("near")))
    if hops is None:
        return points.agg(F.lit(None).cast("double").alias("r"))
    at = hops.filter("id != pivot").join(ids, "id").join(ids.select(F.col("id").alias("pivot"), F.col("x").alias("px"), F.col("y").alias("py")), "pivot")
    away = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    hop = F.col("distance").cast("double")
    return at.agg(F.try_divide(F.covar_pop(hop, away), F.nullif(F.sqrt(F.var_pop(hop) * F.var_pop(away)), F.lit(0.0))).alias("r"))


def crossings(edges: DataFrame) -> DataFrame:
    """One row: pairs of edges (layer, u, v) between the same two layers that cross: u rises and v falls.

    Counted by merging: blocks of the places of v are halved until one place is left, and at each level every edge
    counts those before it whose v lies in the right half while its own lies in the left; work is edges times levels.
    """
    top = edges.agg(F.max("v")).first()[0]
    total = None
    for level in range(max(1, int(top or 0).bit_length())):
        half = F.shiftright(F.col("v").cast("long"), level)
        rows = edges.select("layer", F.shiftright(half, 1).alias("block"), (half % 2 == 1).cast("long").alias("right"), "u", F.lit(level).alias("level"))
        total = rows if total is None else total.union(rows)
    by_u = total.groupBy("layer", "level", "block", "u").agg(F.sum("right").alias("r"), F.sum(1 - F.col("right")).alias("l"))
    keyed = by_u.withColumn("__key", F.struct("layer", "level", "block"))
    run = prefixes(keyed, "__key", "u", {"before": "r"})
    return run.agg(F.coalesce(F.sum((F.col("before") - F.col("r")) * F.col("l")), F.lit(0)).cast("long").alias("crossings"))


def procrustes_gap(drawn: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: gap, the largest absolute difference of coordinates, and disparity, what is left of two drawings (id, x, y)
    when both are centred, scaled to length one and turned (or mirrored) onto each other as well as they can be."""
    both = drawn.select("id", "x", "y").join(reference.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id")
    c = lambda a, b: F.covar_pop(a, b)
    m = both.agg(F.max(F.greatest(F.abs(F.col("x") - F.col("u")), F.abs(F.col("y") - F.col("v")))).alias("gap"), (F.var_pop("x") + F.var_pop("y")).alias("a"), (F.var_pop("u") + F.var_pop("v")).alias("b"), c("x", "u").alias("xu"), c("x", "v").alias("xv"), c("y", "u").alias("yu"), c("y", "v").alias("yv"))
    # the singular values of a 2 x 2 matrix add up to the root of its squares and twice its determinant
    square = F.col("xu") ** 2 + F.col("xv") ** 2 + F.col("yu") ** 2 + F.col("yv") ** 2
    spread = F.sqrt(square + 2 * F.abs(F.col("xu") * F.col("yv") - F.col("xv") * F.col("yu")))
    return m.select("gap", F.greatest(F.lit(0.0), 1 - spread * spread / (F.col("a") * F.col("b"))).alias("disparity"))


def fans(edges: DataFrame, base: float) -> DataFrame:
    """offset of each edge from its pair's line: base (i - (k - 1) / 2) over the pair's k edges in order of id."""
    pair = [F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")]
    w = Window.partitionBy(*pair)
    return edges.withColumn("offset", base * (F.row_number().over(w.orderBy("id")) - 1 - (F.count("*").over(w) - 1) / 2))


def stretched(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with the centres of their ends and the length of the chord."""
    end = lambda c, i: points.select(F.col("id").alias(c), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    both = edges.join(end("src_id", 0), "src_id").join(end("dst_id", 1), "dst_id")
    return both.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def elbows(drawn: DataFrame, shape: str = "z") -> DataFrame:
    """Right-angled bends of stretched edges: one at the target's x, or two at the chord's middle."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mid = (F.col("x0") + F.col("x1")) / 2
    bends = F.array(at(F.col("x1"), F.col("y0"))) if shape == "l" else F.array(at(mid, F.col("y0")), at(mid, F.col("y1")))
    return drawn.withColumn("bends", bends)


def ink(drawn: DataFrame) -> DataFrame:
    """One row: how many edges are drawn, their length, and steps over mean length (1 without edges)."""
    mean = F.avg("length")
    ratio = F.when(F.count("*") == 0, 1.0).when(mean == 0, F.lit(float("inf"))).otherwise(1 / mean)
    return drawn.agg(F.count("*").alias("edges"), F.sum("length").alias("length"), ratio.alias("stress_ratio"))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the mean way that the nodes of both drawings moved."""
    old = before.select("id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return old.join(after, "id").agg(F.avg(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).alias("moved"))


def nearest(points: DataFrame, probes: DataFrame, reach: float) -> DataFrame:
    """(probe, id, away) of the nearest point within reach of each probe (probe, px, py); of equal ones the smallest id."""
    p = points.select("id", "x", "y", cell(F.col("x"), reach).alias("cx"), cell(F.col("y"), reach).alias("cy"))
    c = probes.select("probe", "px", "py", cell(F.col("px"), reach).alias("cx"), cell(F.col("py"), reach).alias("cy"))
    around = F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cx + i as cx, cy + j as cy))))")
    met = p.join(c.select("probe", "px", "py", F.inline(around)), ["cx", "cy"]).withColumn("away", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    best = met.filter(F.col("away") <= reach).groupBy("probe").agg(F.min(F.struct("away", "id")).alias("b"))
    return best.select("probe", "b.id", "b.away")


def decimate(edges: DataFrame, stride: int) -> DataFrame:
    """Every stride-th edge by ord."""
    return edges.filter(F.col("ord") % max(stride, 1) == 0)
