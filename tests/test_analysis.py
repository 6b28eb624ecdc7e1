import itertools

import numpy as np
import pytest

from plexframe.operators import analysis, drawing
from plexframe.sources.tables import present_only, running, to_delete

EDGES = "src_id string, dst_id string, strength double, directed boolean"


def graph(spark, text, directed=True):
    rows = [(a, b, float(w), directed) for a, b, w in (t.split() for t in text.split(";"))]
    nodes = sorted({r[0] for r in rows} | {r[1] for r in rows} | {"z"})
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(rows, EDGES), nodes, rows


def shortest(nodes, rows):
    d = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, w, one_way in rows:
        for p in [(a, b)] if one_way else [(a, b), (b, a)]:
            d[p] = min(d[p], w)
    for k, i, j in itertools.product(nodes, repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


CYCLES = "b a 1;a c 1;c b 1;c d 1;d e 2;e d 1;e e 1;f b 1"


def test_strong_components(spark):
    n, e, _, _ = graph(spark, CYCLES)
    assert {r.id: r.component for r in analysis.strong_components(n, e).collect()} == dict(a="a", b="a", c="a", d="d", e="d", f="f", z="z")
    assert analysis.strong_components(n.limit(0), e.limit(0)).count() == 0


def test_bellman_ford(spark):
    n, e, nodes, rows = graph(spark, "a b 4;a c 2;c b -3;b d 1;f a 1")
    got, cycle = analysis.bellman_ford(n, e, "a")
    assert cycle is None
    assert {r.id: r.distance for r in got.collect()} == dict(a=0.0, b=-1.0, c=2.0, d=0.0, f=None, z=None)
    n, e, _, _ = graph(spark, "a b 1;b c 1;c d -3;d b 1;d x 1;x y 1")
    got, cycle = analysis.bellman_ford(n, e, "a")
    assert got is None
    assert {(r.before, r.id) for r in cycle.collect()} == {("b", "c"), ("c", "d"), ("d", "b")}


@pytest.mark.parametrize("directed", [True, False])
def test_paths(spark, directed):
    n, e, nodes, rows = graph(spark, "a b 1;b d 1;a c 1;c d 1;d e 2;a e 9;b e 3", directed)
    d, total = shortest(nodes, rows), len(nodes)
    close = {}
    for v in nodes:
        far = [d[v, w] for w in nodes if w != v and d[v, w] < float("inf")]
        close[v] = len(far) / sum(far) * len(far) / (total - 1) if far else 0.0
    assert {r.id: r.value for r in analysis.closeness(n, e).collect()} == pytest.approx(close)
    step = {}
    for a, b, w, one_way in rows:
        for p in [(a, b)] if one_way else [(a, b), (b, a)]:
            step.setdefault(p[0], []).append((p[1], w))

    def walks(s, t, left):
        if s == t and not left:
            return [[s]]
        return [[s, *rest] for v, w in step.get(s, []) if w <= left for rest in walks(v, t, left - w)]

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        ways = walks(s, t, d[s, t]) if d[s, t] < float("inf") else []
        for way in ways:
            for v in way[1:-1]:
                want[v] += 1 / len(ways)
    assert {r.id: r.value for r in analysis.betweenness(n, e).collect()} == pytest.approx(want)


def test_taken_off(spark):
    # 12 leaves behind p, p and two leaves behind q, q and r (two ways out) lead into a cycle; two arcs to one node, a loop
    text = ";".join([*(f"l{i} p {i + 1}" for i in range(12)), "p q 2;p q 3;m q 1;n q 1;q s 1;r s 1;r t 1;s t 1;t u 1;u s 1;l0 l0 1;v w 0"])
    n, e, nodes, rows = graph(spark, text)
    core, steps, rounds = analysis._peeled(e)
    assert [r.count() for r in rounds] == [14, 1, 1] and {r.id for r in core.collect()} == set("rstuvw")
    d, total = shortest(nodes, rows), len(nodes)
    sums = {v: [d[v, w] for w in nodes if w != v and d[v, w] < float("inf")] for v in nodes}
    close = {v: len(x) / sum(x) * len(x) / (total - 1) if sum(x) > 0 else 0.0 for v, x in sums.items()}
    assert {r.id: r.value for r in analysis.closeness(n, e).collect()} == pytest.approx(close)
    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        for x in set(nodes) - {s, t}:  # shortest paths are single here, but for two arcs from p to q
            want[x] += d[s, t] < float("inf") and d[s, x] + d[x, t] == d[s, t]
    assert {r.id: r.value for r in analysis.betweenness(n, e).collect()} == pytest.approx(want)


def test_negative_strengths_have_no_centrality(spark):
    n, e, _, _ = graph(spark, "a b -1")
    for out in (analysis.closeness(n, e), analysis.betweenness(n, e), analysis.eigenvector(n, e)[0]):
        assert all(np.isnan(r.value) for r in out.collect())


def test_eigenvector(spark):
    n, e, nodes, rows = graph(spark, "a b 1;b c 2;c a 1;c d 1", directed=False)
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w, _ in rows:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    got, converged = analysis.eigenvector(n, e, tolerance=1e-3)
    vector = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert converged
    assert [r.value for r in got.orderBy("id").collect()] == pytest.approx(list(vector), abs=5e-3)
    assert analysis.eigenvector(*graph(spark, "a b 1;b c 1")[:2])[1] is False


def test_fold_leaves(spark):
    n, e, _, _ = graph(spark, "a b 1;b c 1;c a 1;c d 1;d d 1;x y 1;y x 1")
    nodes, edges = analysis.fold_leaves(n.selectExpr("id", "id AS ord"), e)
    assert {r.id: r.representative for r in nodes.collect() if not r.visible} == dict(d="c", y="x")
    assert {(r.src_id, r.dst_id) for r in edges.collect() if not r.visible} == {("c", "d"), ("d", "d"), ("x", "y"), ("y", "x")}


def test_references(spark):
    rows = spark.createDataFrame([(1, [1, 7, 2, 1]), (2, [7]), (3, []), (4, None)], "id int, refs array<int>")
    assert {r.id: r.refs for r in present_only(rows, "id", "refs", rows).collect()} == {1: [1, 2, 1], 2: None, 3: [], 4: None}
    assert [r.id for r in to_delete(rows, rows.filter("id < 4"), ["id"]).collect()] == [4]


def test_running(spark):
    df = spark.range(3000).selectExpr("id * 7 % 3000 AS v")
    assert all(r.c == r.v * (r.v + 1) // 2 for r in running(df, "v", "v", "c").collect())


def test_random_draws(spark):
    def stream(state):
        while True:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            t = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
            t = (t + (t ^ t >> 7) * (61 | t) & 0xFFFFFFFF) ^ t
            yield (t ^ t >> 14) / 4294967296

    want = list(itertools.islice(stream(0x5EED), 200))
    got = drawing.scatter(spark.range(100).selectExpr("id AS ord")).orderBy("ord").collect()
    assert [v for r in got for v in (r.x, r.y)] == want


def test_nearest_and_ink(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 0.0)], "id int, x double, y double")
    probes = spark.createDataFrame([("m", 0.5, 0.0), ("far", 99.0, 0.0)], "probe string, px double, py double")
    assert [tuple(r) for r in drawing.nearest(p, probes, 2.0).collect()] == [("m", 1, 0.5)]
    drawn = drawing.stretched(spark.createDataFrame([(1, 2)], "src_id int, dst_id int"), p)
    assert tuple(drawing.ink(drawn).first()) == (1, 5.0, 0.2)
    assert drawing.ink(drawn.limit(0)).first().stress_ratio == 1.0
