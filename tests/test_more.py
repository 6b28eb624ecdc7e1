"""Simplification, drawings' measures, sinks, repaired hierarchies, ranks, hashes and checks, against plain Python."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plexframe.functions import scalars
from plexframe.operators import analysis, drawing, model, predicates, traverse
from plexframe.operators import simplify as simplification
from plexframe.operators.simplify import counts, restore, simplify
from plexframe.plans import more
from plexframe.sources import sinks
from plexframe.sources.tables import prefixes
from plexframe.streaming import changes


def graph(spark, text):
    """Nodes and edges of "a-b b-c ...", in the order in which they are named."""
    pairs = [p.split("-") for p in text.split()]
    ids = list(dict.fromkeys(x for p in pairs for x in p))
    nodes = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, ord long")
    edges = spark.createDataFrame([(f"e{k}", a, b, k) for k, (a, b) in enumerate(pairs)], "id string, src_id string, dst_id string, place long")
    return nodes, edges.withColumn("strength", F.lit(1.0)).withColumn("directed", F.lit(True)).withColumn("kind", F.lit("hierarchy"))


def test_simplify(spark):
    # a triangle x y z, a chain x p q r y, a leaf on z, a ring k l m, a pendant path y s t, a loop on q and on p
    nodes, edges = graph(spark, "x-y y-z z-x x-p p-q q-r r-y z-leaf k-l l-m m-k y-s s-t q-q p-p p-q")
    s = simplify(nodes, edges)
    hidden = {r.id: r.representative for r in s.nodes.filter("not visible").collect()}
    assert hidden == {"leaf": "z", "t": "s", "p": "x", "q": "x", "r": "x"}
    assert {r.id for r in s.edges.filter("not visible").collect()} == {"e3", "e4", "e5", "e6", "e7", "e12", "e13", "e15"}  # e14, the loop on the chain's first node, stays
    assert [(r.low, r.high, r.step) for r in s.links.collect()] == [("x", "y", "chain:p")]
    assert tuple(counts(s).first()) == (5, 8) and tuple(counts(restore(s)).first()) == (0, 0)
    only = simplify(nodes, edges, leaves=False)
    assert {r.id for r in only.nodes.filter("not visible").collect()} == {"p", "q", "r", "s"}


def test_simplify_pinned(spark):
    # q, with two neighbours, and the leaf stay; of the pair u v, where v is pinned, u folds
    nodes, edges = graph(spark, "x-y y-z z-x x-p p-q q-r r-y z-leaf u-v")
    s = simplify(nodes.withColumn("pinned", F.col("id").isin("q", "leaf", "v")), edges)
    assert {r.id: r.representative for r in s.nodes.filter("not visible").collect()} == {"p": "x", "r": "y", "u": "v"}
    assert {(r.low, r.high, r.step) for r in s.links.collect()} == {("x", "q", "chain:p"), ("y", "q", "chain:r")}


@pytest.mark.parametrize("name", ["simplify_chains", "simplify_links", "simplify_counts"])
def test_simplify_of_few_lines(spark, tmp_path, name):
    """Parts and suppliers that one or two lines name, held against the SQL."""
    import duckdb

    rows = [(k, n, p, s) for k, n, p, s in ((1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 2, 1), (3, 1, 3, 3), (4, 1, 4, 1), (4, 1, 4, 2), (5, 1, 5, 1), (5, 2, 5, 2), (5, 3, 5, 2))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = more.QUERIES[name](spark, str(tmp_path))
    want = duckdb.sql(more.SQL[name])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def plainly(nodes, edges):
    """simplify, one graph at a time in plain Python: (node, representative, step), (edge, step) and links of what goes."""
    ord_, held = {i: o for i, o, _ in nodes}, {i for i, _, p in nodes if p}
    near = {}
    for _, a, b in edges:
        if a != b and a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, links = {}, set()
    for i, n in near.items():
        if i in ord_ and i not in held and len(n) == 1:
            (to,) = n
            if len(near[to]) > 1 or to not in ord_ or to in held or ord_[to] < ord_[i]:
                out[i] = (to, f"leaf:{i}", False)
    inner, folded, seen = {i for i, n in near.items() if len(n) == 2 and i not in held}, set(out), set()
    for i in sorted(inner):
        if i in seen:
            continue
        run, todo = set(), [i]
        while todo:
            run.add(x := todo.pop())
            todo += [y for y in near[x] & inner if y not in run]
        seen |= run
        ends = sorted((ord_.get(y, -1), y) for x in run for y in near[x] - inner)
        if len(ends) == 2 and ends[0] != ends[1] and all(y in ord_ and y not in folded for _, y in ends):
            links.add((ends[0][1], ends[1][1], f"chain:{i}"))
            out |= {x: (ends[0][1], f"chain:{i}", bool(near[x] - inner)) for x in run}
    steps = {e: next((out[x][1] for x in (a, b) if x in out and not (a == b and out[x][2])), None) for e, a, b in edges}
    return {(i, *out[i][:2]) for i in ord_ if i in out}, {(e, s) for e, s in steps.items() if s}, links


def tangles(seed, most):
    """Small graphs side by side: paths, rings, parallel edges, loops, pinned nodes, ends that no node has, edges without an end."""
    r, nodes, edges = random.Random(seed), [], []
    for g in range(most):
        own = [f"g{g}n{i}" for i in range(r.randint(2, 9))]
        nodes += [(i, g * 10 + k, g % 2 == 1 and r.random() < 0.2) for k, i in enumerate(r.sample(own, len(own)))]
        pick = lambda own=own, g=g: r.choice([f"g{g}x", None]) if g % 5 == 0 and r.random() < 0.1 else r.choice(own)
        walk = r.sample(own, len(own)) if g % 3 else []
        ring = list(zip(walk, walk[1:] + walk[:1], strict=True))
        pairs = [*ring[: len(ring) - (r.random() < 0.7)], *[(pick(), pick()) for _ in range(r.randint(1, 4 if walk else 11))]]
        a, b = r.choice(pairs)
        edges += [(f"g{g}e{k}", *p) for k, p in enumerate([*pairs, (b, a), (a, b)][: len(pairs) + 2 * (g % 4 == 0)])]
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_simplify_tangles(spark, seed):
    nodes, edges = tangles(seed, 150)
    gone, cut, links = plainly(nodes, edges)
    s = simplify(spark.createDataFrame(nodes, "id string, ord long, pinned boolean"), spark.createDataFrame(edges, "id string, src_id string, dst_id string"))
    assert s.nodes.count() == len(nodes) and s.edges.count() == len(edges)
    assert {(r.id, r.representative, r.step) for r in s.nodes.filter("not visible").collect()} == gone
    assert {(r.id, r.step) for r in s.edges.filter("not visible").collect()} == cut
    assert {tuple(r) for r in s.links.select("low", "high", "step").collect()} == links
    assert tuple(counts(s).first()) == (len(gone), len(cut))


@pytest.mark.parametrize("what", ["nodes", "links"])
def test_simplify_writes_little(spark, tmp_path, monkeypatch, what):
    """Where each line is a chain of its own four tables are written, and what is asked for comes from them without a shuffle."""
    calls = []
    for m in (simplification, analysis, traverse):
        monkeypatch.setattr(m, "written", lambda df, f=m.written: calls.append(df) or f(df))
    lines = spark.range(20000).selectExpr("id div 4 as l_orderkey", "cast(id % 4 as int) as l_linenumber", "id * 7 % 900 as l_partkey", "id * 13 % 70 as l_suppkey")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = getattr(simplify(*more._deals(spark, str(tmp_path))), what)
    assert len(calls) == 4
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("step is not null").count() == 20000


def test_simplify_counts_at_the_ends(spark):
    """Edges that go are counted with the ends that go, so no edge meets a node again; only chains of several look for edges between them."""
    nodes, edges = graph(spark, "a-x x-b a-y y-b b-c a-c c-d")
    s = simplify(nodes, edges)
    assert "Join" not in counts(s)._jdf.queryExecution().executedPlan().toString()
    assert tuple(counts(s).first()) == (3, 5) and tuple(counts(restore(s)).first()) == (0, 0)
    assert counts(s).dtypes == model.hidden_counts(s.nodes, s.edges).dtypes and counts(s).collect() == model.hidden_counts(s.nodes, s.edges).collect()


def test_hierarchy(spark):
    # b and c on a cycle with d; e below it; f has two parents; a loop
    nodes, edges = graph(spark, "d-b b-c c-d c-e a-f d-f g-g")
    tree, notes = traverse.hierarchy(nodes, edges, "ord")
    assert {(r.child, r.parent) for r in tree.collect()} == {("b", "d"), ("c", "b"), ("e", "c"), ("f", "a")}  # cut at d, the first
    assert {(r.code, r.edge) for r in notes.collect()} == {(1, "e2"), (2, "e5")}
    depth = {r.id: r.depth for r in traverse.depths(nodes, tree, virtual_root=True).collect()}
    assert depth == {"d": 1, "b": 2, "c": 3, "e": 4, "a": 1, "f": 2, "g": 1}
    one, links = graph(spark, "a-b b-c")
    assert {r.depth for r in traverse.depths(one, traverse.hierarchy(one, links)[0], virtual_root=True).collect()} == {0, 1, 2}
    nodes, edges = graph(spark, " ".join(f"n{i}-n{i + 1}" for i in range(40)))
    assert traverse.depths(nodes, traverse.parents(edges)).agg(F.max("depth")).first()[0] == 40


def test_canonical(spark):
    df = spark.createDataFrame([("p", "z", 3), ("q", "y", 1), ("r", "z", 2)], "id string, component string, ord long")
    assert {r.id: r.component for r in traverse.canonical(df, "component", "ord", "component").collect()} == {"p": 1, "q": 0, "r": 1}


def test_neighbourhood_edges(spark):
    nodes, edges = graph(spark, "a-b b-c c-d c-e b-e b-b")
    start = nodes.filter("id = 'a'")
    near = traverse.neighbourhood(edges, start, 2)
    assert {r.id for r in traverse.incident_edges(edges, near, 2).collect()} == {"e0", "e1", "e4", "e5"}
    assert traverse.local_graph(edges, start, 6).count() == 0 and traverse.local_graph(edges, start, 5).count() == 5
    assert {r.id for r in traverse.marked(edges, nodes.filter("id = 'b'")).collect()} == {"a", "c", "e"}
    slots = {(r.id, r.slot, r.edge, r.other) for r in model.adjacency(edges, "place").filter("id = 'b'").collect()}
    assert slots == {("b", 0, "e0", "a"), ("b", 1, "e1", "c"), ("b", 2, "e4", "e"), ("b", 3, "e5", "b")}


def points(spark, n=60, seed=3):
    rng = random.Random(seed)
    return [(f"p{i:03}", rng.uniform(0, 10), rng.uniform(0, 3), 0.2) for i in range(n)]


def test_measures(spark):
    rows = points(spark)
    df = spark.createDataFrame(rows, "id string, x double, y double, r double").repartition(4)
    gaps = [min(math.dist(a[1:3], b[1:3]) for b in rows if b != a) for a in rows]
    assert drawing.nearest_gap(df).first().gap == pytest.approx(sum(gaps) / len(gaps))
    pairs = sum(math.dist(a[1:3], b[1:3]) < 0.4 + 0.2 for a, b in itertools.combinations(rows, 2))
    assert drawing.overlap_count(df, 0.2, 0.1).first().pairs == pairs
    turned = [(i, 3 - 2 * y, 2 * x, r) for i, x, y, r in rows]
    same = drawing.procrustes_gap(df, spark.createDataFrame(turned, "id string, x double, y double, r double")).first()
    assert same.disparity == pytest.approx(0, abs=1e-9) and same.gap > 1


def test_crossings(spark):
    rng = random.Random(5)
    edges = [(layer, rng.randint(0, 9), rng.randint(0, 12)) for layer in (0, 1) for _ in range(40)]
    want = sum(a[0] == b[0] and (a[1] - b[1]) * (a[2] - b[2]) < 0 for a, b in itertools.combinations(edges, 2))
    assert drawing.crossings(spark.createDataFrame(edges, "layer long, u long, v long").repartition(3)).first().crossings == want


def test_stress_correlation(spark):
    nodes, edges = graph(spark, " ".join(f"n{i}-n{i + 1}" for i in range(6)))
    at = nodes.select("id", F.col("ord").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert drawing.stress_correlation(at, edges, 3).first().r == pytest.approx(1.0)
    assert drawing.stress_correlation(at.withColumn("x", F.lit(0.0)), edges, 3).first().r is None


def test_ink_cells(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 128.0, 128.0), ("c", 128.0, 0.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src_id string, dst_id string")
    got = drawing.ink_cells(drawing.stretched(edges, pts)).first()
    assert got.cells == 255 and got.length == pytest.approx(128 + 128 * math.sqrt(2))


def hash_of(text):
    h, raw = 0, text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        unit = int.from_bytes(raw[i : i + 2])
        if 0xD800 <= unit < 0xDC00:
            unit = ord(raw[i : i + 4].decode("utf-16-be"))
        low = h * 31 & 0xFFFFFFFF
        h = (low - (1 << 32) if low >> 31 else low) + unit
    return abs(h)


def test_hash_string(spark):
    texts = ["", "a", "task", "xfjfxtf", "ünï", "a😀b", "long " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(scalars.hash_string(F.col("t")).alias("h")).collect()] == [hash_of(t) for t in texts]


def test_scalars(spark):
    got = spark.range(1).select(
        scalars.radius_for(F.lit(0.25)).alias("r"), scalars.radius_for(F.lit(float("nan"))).alias("n"), scalars.lod_mix(F.lit(2.25), F.lit(True)).alias("m"), scalars.is_slug(F.lit("a-b9")).alias("s"), scalars.is_slug(F.lit("-a")).alias("t"),
        scalars.parse_cursor(F.lit("12.7")).alias("c"), scalars.wire_time(F.timestamp_micros(F.lit(1_700_000_000_123_456))).alias("w"), scalars.edge_bucket(F.lit("hierarchy")).alias("b"), scalars.strength_tier(F.lit(1.2)).alias("tier"),
        scalars.sample_ramp(F.lit(0.75), [(0, 0, 0), (1, 0, 0), (1, 1, 0)]).alias("ramp"), scalars.tick_budget(F.lit(0), F.lit(5)).alias("none"), scalars.tick_budget(F.lit(10), F.lit(5), F.lit(0)).alias("own"),
        scalars.curve(F.lit(0.0), F.lit(0.0), F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), F.lit(2.0), F.lit(0.0), 2).alias("curve"),
    ).first()
    assert (got.r, got.n, got.s, got.t, tuple(got.c), got.w, got.b, got.tier, got.none, got.own) == (4 * 2.25, 4.0, True, False, (12, 7), "2023-11-14T22:13:20.123Z", 3, 2, 8, 0)
    assert got.m.card == pytest.approx(0.5) and got.m.icon == 1 and tuple(got.ramp) == (1.0, 0.5, 0.0) and tuple(got.curve[1]) == (1.0, 1.0)


def test_normalise_odd(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, float("inf")), (5, 1.0)], "id long, v double")
    for mode in ("LINEAR", "LOG", "RANK", "QUANTILE"):
        got = {r.id: r.t for r in scalars.normalise(df, "v", mode).collect()}
        assert all(math.isnan(got[i]) for i in (2, 3, 4)) and not math.isnan(got[1])
    assert math.isnan(scalars.normalise(df.filter("id = 2"), "v").first().t)


def test_ranks(spark):
    df = spark.createDataFrame([(0, 0.5), (1, float("nan")), (2, None), (3, 0.9), (4, 0.5), (5, -0.0)], "ord long, weight double")
    assert {r.ord: r["rank"] for r in model.ranked(df, F.col("weight"), "ord").collect()} == {3: 0, 0: 1, 4: 2, 5: 3, 1: 4, 2: 5}
    assert {r.ord: r["rank"] for r in model.by_weight(df, "ord").collect()} == {3: 0, 0: 1, 4: 2, 1: 3, 2: 4, 5: 5}


def test_masks(spark):
    rows = [("a", None, "record", "db", None, 0, None, []), ("b", "Big Thing", "record", None, "g", 2, 3.0, ["x"]), ("c", "tag x", "tag", None, None, 1, 1.0, [])]
    df = spark.createDataFrame(rows, "id string, label string, kind string, database_id string, group_label string, degree int, version double, tags array<string>")
    hid = lambda **k: {r.id for r in df.filter(predicates.hidden(**k)).collect()}
    assert hid() == set() and hid(orphans=True) == {"a"} and hid(text=" big ") == {"a", "c"} and hid(query="version:>=1") == {"a"} and hid(query="kind:tag AND") == set()
    assert df.select(predicates.hidden(text="x", groups=["g"], kinds=["tag"]).alias("h")).filter("h is null").count() == 0
    assert {r.id for r in df.filter(predicates.highlight("x", "degree:>=1")).collect()} == {"b", "c"} and predicates.highlight(" ") is None
    assert {r.id for r in df.filter(predicates.console_filter(["db"], [], ["tag x"])).collect()} == {"b"}
    assert predicates.search(df, " THING", "id").first().id == "b" and predicates.search(df, "", "id").count() == 0
    for text in ("degree:3", "degree:!=3", "version:x", 'degree:"3"', "kind:!x", "db:~x"):
        with pytest.raises(predicates.QueryError):
            predicates.parse(text)
    view = spark.createDataFrame([(5.0, 5.0), (11.0, 5.0), (float("nan"), 5.0), (None, 1.0)], "x double, y double")
    assert [r.v for r in view.select(predicates.meets_view(F.col("x"), F.col("y"), F.lit(2.0), 0, 0, 10, float("nan")).alias("v")).collect()] == [True, True, False, False]


def test_prefixes(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(1, 9)) for g in ("hot",) * 40 + ("cold", None) for i in [rng.random()]]
    got = prefixes(spark.createDataFrame(rows, "g string, at double, n long").repartition(5), "g", "at", {"run": "n"}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["run"] == sum(n for g, at, n in rows if g == r.g and at <= r["at"])


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", 0, 'say "hi"\n', None, 1.0), ("n2", 1, "é", "g", 0.25)], "id string, place long, label string, group_label string, weight double")
    nodes = nodes.selectExpr("*", "'record' AS kind", "'db' AS database_id", "'s' AS source", "double(3) AS version")
    edges = spark.createDataFrame([("e1", 0, "n1", "n2")], "id string, place long, src_id string, dst_id string").selectExpr("*", "'tag' AS kind", "'l' AS label", "double(0.75) AS strength", "false AS directed")
    lines = [r.line for r in sinks.canonical_lines(nodes, edges).orderBy("part", "place").collect()]
    want = {"id": "n1", "kind": "record", "database_id": "db", "source": "s", "label": 'say "hi"\n', "group": None, "weight": 1, "version": 3, "has_note": False, "icon": None}
    assert lines[0] == json.dumps(want, sort_keys=True, separators=(",", ":")) and json.loads(lines[1])["label"] == "é" and json.loads(lines[2])["strength"] == 0.75
    assert sinks.graph_digest(nodes, edges).first() == sinks.graph_digest(nodes.repartition(3), edges).first()
    assert sinks.listing(nodes, edges).filter("part = 1").first().line == 'edge e1 n1 -> n2 tag label="l" strength=0.75 directed=false'
    sinks.write_lines(sinks.canonical_lines(nodes, edges), ["part", "place"], f"file://{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == sorted(lines)
    sinks.write_columns(nodes, edges, f"file://{tmp_path}/cols")
    back, links = sinks.read_columns(spark, f"file://{tmp_path}/cols")
    assert {(r.src_id, r.dst_id) for r in links.collect()} == {("n1", "n2")} and sinks.graph_digest(back.withColumnRenamed("ord", "place"), links.withColumnRenamed("ord", "place")).first() == sinks.graph_digest(nodes, edges).first()
    raw = [spark.read.parquet(f"{tmp_path}/cols/{t}") for t in ("nodes", "edges")]
    assert sinks.column_refusals(*raw).count() == 0 and {r["rule"] for r in sinks.column_refusals(raw[0].filter("ord = 0"), raw[1].union(raw[1])).collect()} == {"duplicate_edge", "no_row"}
    pts = spark.createDataFrame([("a", 0, 0.0, 0.0, 4.0, "#fff", "record", True), ("b", 1, 10.0, 4.0, 2.0, "#000", "tag", True), ("c", 2, 99.0, 0.0, 1.0, "#111", "tag", False)], "id string, ord long, x double, y double, r double, fill string, kind string, visible boolean")
    drawn = drawing.stretched(spark.createDataFrame([("a", "b", 0, "tag", 2.0)], "src_id string, dst_id string, ord long, kind string, strength double"), pts)
    svg = [r.line for r in sinks.svg_lines(pts, drawn).orderBy("part", "ord").collect()]
    assert svg[0].endswith('width="106" height="100" viewBox="-48.0 -48.0 106.0 100.0">') and svg[3].startswith('<line x1="0.0" y1="0.0" x2="10.0" y2="4.0" stroke="#b45309" stroke-width="2.65"')
    assert svg[5] == '<circle cx="0.0" cy="0.0" r="4.00" fill="#fff"/>' and 'r="1.56" fill="none"' in svg[6] and len(svg) == 8


def test_checks(spark):
    old = spark.createDataFrame([("a", "x", "title", None), ("a", "y", "link", "b"), ("b", "z", "title", None), ("c", "q", "title", None)], "collection string, field string, role string, target string")
    new = spark.createDataFrame([("a", "x", "label", None), ("b", "z", "title", None), ("b", "more", "tags", None)], old.schema)
    assert {tuple(r) for r in model.growth(old, new).collect()} == {("collection_removed", "c", None), ("field_changed", "a", "x"), ("field_removed", "a", "y")}
    assert model.growth(old, old).count() == 0 and model.undeclared_links(new.union(spark.createDataFrame([("a", "y", "link", "zz")], old.schema))).count() == 3
    cells = [("f0", "title", False, '"t"'), ("f1", "title", False, "1"), ("f2", "weight", False, "1.5"), ("f3", "weight", False, '"x"'), ("f4", "tags", False, '["a"]'), ("f5", "tags", False, '["a:b"]'), ("f6", "link", True, '["a"]'), ("f7", "link", False, '["a"]'), ("f8", "parent", False, '["a","b"]'), ("f9", None, False, "1"), ("g0", "title", False, "null"), ("g1", "scalar", False, "{}")]
    df = spark.createDataFrame(cells, "field string, role string, many boolean, v string").select(F.lit("c").alias("collection"), F.lit("i").alias("id"), "field", "role", "many", F.parse_json("v").alias("value"))
    assert {(r.field, r["rule"]) for r in model.cell_refusals(df).collect()} == {("f1", "not_title"), ("f3", "not_weight"), ("f5", "not_tags"), ("f7", "not_link"), ("f8", "not_parent"), ("f9", "no_field")}


def test_sync(spark):
    stored = spark.createDataFrame([("c", "a", "1", 4), ("c", "b", "2", 1), ("c", "d", "3", 2)], "collection string, id string, text string, rev long")
    wanted = spark.createDataFrame([("c", "a", "1"), ("c", "b", "two"), ("c", "e", "5")], "collection string, id string, text string")
    ops = changes.sync_ops(stored, wanted)
    assert {(r.id, r.op, r.rev) for r in ops.collect()} == {("b", "upsert", 2), ("d", "delete", 3), ("e", "upsert", 1)}
    assert {(r.id, r.batch) for r in changes.chunked(ops, 2).collect()} == {("b", 0), ("d", 0), ("e", 1)}
    assert {r["rule"] for r in changes.batch_refusals(ops.union(ops), 5).collect()} == {"named_twice", "too_many"} and changes.batch_refusals(ops, 5).count() == 0
    assert [r.id for r in changes.record_page(stored, ("c", "a"), 1).collect()] == ["b"]
    log = spark.createDataFrame([(0, "c", "a", s, op, t) for s, (op, t) in enumerate([("upsert", "x"), ("upsert", "x"), ("delete", None), ("delete", None), ("upsert", "x")])], "ws long, collection string, id string, seq long, op string, text string")
    assert {(r.seq, r.rev) for r in changes.revisions(log).collect()} == {(0, 1), (2, 2), (4, 3)}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "c", "a", 1, "upsert", "x")], "ws long, collection string, id string, seq long, op string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # started again, it repeats nothing
        changes.apply_stream(stream, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert changes.latest(spark.read.parquet(f"{tmp_path}/out").drop("batch")).count() == 1
