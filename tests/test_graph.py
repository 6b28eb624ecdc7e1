import pytest
from pyspark.sql import functions as F

from plexframe.functions import ids
from plexframe.operators import model, predicates, traverse
from plexframe.sources.tables import Link, Table, dense, edges, records, refusals, tag_hubs


def tables(spark):
    person = spark.createDataFrame([(1, "Ann", ["a", "b", "a"]), (2, None, ["b"]), (3, "Cy", None)], "k int, name string, tags array<string>")
    task = spark.createDataFrame([(1, [1, 2, 1], None), (2, [9], 1)], "k int, who array<int>, up int")
    return [Table("person", person, "k", title="name", tags="tags"), Table("task", task, "k", parent="up", links=[Link("who", "person", many=True)])]


def test_derive(spark):
    t = tables(spark)
    assert {(r.id, r.label) for r in records("x", t).collect()} == {("x:person:1", "Ann"), ("x:person:2", "2"), ("x:person:3", "Cy"), ("x:task:1", "1"), ("x:task:2", "2")}
    assert [r.label for r in tag_hubs(t).orderBy("place").collect()] == ["a", "b"]
    e = edges("x", t)
    assert {r.id for r in e.collect()} == {
        "tag:a--x:person:1:tag:a", "tag:b--x:person:1:tag:b", "tag:b--x:person:2:tag:b", "x:task:1->x:person:1:relation:who", "x:task:1->x:person:2:relation:who",
        "x:task:2->x:person:9:relation:who", "x:task:1--x:task:2:hierarchy:",
    }
    nodes = records("x", t).unionByName(tag_hubs(t))
    assert model.index_edges(nodes, e).count() == 6
    # the link to person 9 dangles: derived as stated, left out by the index, and refused
    assert [tuple(r) for r in refusals(t).collect()] == [("no_record", "task", "2")]
    assert refusals(t[:1]).count() == 0


def test_refusals(spark):
    bad = Table("t", spark.createDataFrame([(1, ["a:b"]), (1, [])], "k int, tags array<string>"), "k", tags="tags")
    assert {r.rule for r in refusals([bad]).collect()} == {"duplicate_record", "colon_in_tag"}


def test_ids(spark):
    df = spark.createDataFrame([("a:b:c:d",), ("note:a:b:c",), ("a:b",)], "id string")
    assert [r.p and tuple(r.p) for r in df.select(ids.parse_node_id(F.col("id")).alias("p")).collect()] == [("a", "b", "c:d"), None, None]
    kinds = {"PARENT": "hierarchy", "my_note_link": "note_link", "annotates": "note_of", "tagged": "tag", "x": "relation", "child_of": "hierarchy"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", ids.edge_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == kinds


def test_loops_and_diff(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "id string, weight double")
    e = spark.createDataFrame([("e", "a", "a")], "id string, src_id string, dst_id string")
    assert {r.id: r.degree for r in model.degrees(nodes, e).collect()} == {"a": 2, "b": 0}
    assert {r.id: r.degree for r in model.degrees(nodes, e, loops_once=True).collect()} == {"a": 1, "b": 0}
    assert [tuple(r) for r in model.diff(nodes, nodes, ["weight"]).collect()] == [("b", "updated")]


def test_two_cliques(spark):
    pairs = [("a0", "a1"), ("a1", "a2"), ("a0", "a2"), ("b0", "b1"), ("b1", "b2"), ("b0", "b2"), ("a0", "b0")]
    e = spark.createDataFrame([(x, y, 1.0) for x, y in pairs], "src_id string, dst_id string, strength double")
    member = spark.createDataFrame([(x, x[0]) for x in sorted({p for q in pairs for p in q})], "id string, community string")
    assert model.modularity(e, member).first().q == pytest.approx(0.3571428571428571)


def test_traverse(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    e = spark.createDataFrame([("e1", "a", "b", 2.0, True), ("e2", "b", "c", 1.0, False), ("e3", "a", "c", 9.0, True), ("e4", "d", "e", 1.0, True)], "id string, src_id string, dst_id string, strength double, directed boolean")
    assert {r.id: r.component for r in traverse.weak_components(nodes, e).collect()} == dict(a="a", b="a", c="a", d="d", e="d", f="f")
    assert {r.id: r.distance for r in traverse.shortest_paths(nodes, e, "c").collect()} == dict(a=None, b=1.0, c=0.0, d=None, e=None, f=None)
    assert {r.id: r.distance for r in traverse.shortest_paths(nodes, e, "a").collect()} == dict(a=0.0, b=2.0, c=3.0, d=None, e=None, f=None)
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "f"), ("f", "e")], "child string, parent string")
    assert {r.id: r.depth for r in traverse.depths(nodes, tree).collect()} == dict(a=0, b=1, c=2, d=0, e=None, f=None)


@pytest.mark.parametrize("text", ['a AND (b OR "c d") AND NOT tag:#x', "degree:>=2 OR kind:tag", "'AND'", 'id:"a b"', "NOT (a OR b)"])
def test_query_round_trip(text):
    q = predicates.parse(text)
    assert predicates.parse(predicates.show(q)) == q


@pytest.mark.parametrize("text", ["a b", "(a", "a AND", "degree:x", "OR a", '"open', "a)"])
def test_query_errors(text):
    with pytest.raises(predicates.QueryError):
        predicates.parse(text)


def test_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.v == r.ord for r in dense(df, "v").collect())


def test_queries_have_sql():
    from plexframe.plans import queries

    assert set(queries.SQL) == set(queries.QUERIES)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_plain_links_are_told_apart_by_numbers(spark):
    rows = spark.createDataFrame([(1, 2), (1, 2), (1, None), (3, 2), (4, 9)], "k long, to long")
    e = edges("x", [Table("t", rows, "k", links=[Link("to", "t")])])
    assert sorted(r.id for r in e.collect()) == [f"x:t:{k}->x:t:{to}:relation:to" for k, to in ((1, 2), (3, 2), (4, 9))]
    assert "min_by" not in _plan(e)


def test_index_edges_moves_only_what_is_lost_or_twice(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    rows = [(1, "e1", "a", "b"), (2, "e1", "b", "c"), (3, "e2", "b", "c"), (0, "e1", "z", "a"), (4, "e3", "a", "z"), (5, "e4", None, "a")]
    e = spark.createDataFrame(rows, "place int, id string, src_id string, dst_id string")
    got = model.index_edges(nodes, e)
    assert sorted((r.id, r.src_id, r.place) for r in got.collect()) == [("e1", "a", 1), ("e2", "b", 3)]
    clean = model.index_edges(nodes, e.filter("place in (1, 3)"))
    assert clean.count() == 2 and "Exchange" not in _plan(clean)
