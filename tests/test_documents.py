"""Graph documents: strict and lenient readers, derivation, commit logs and pages."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plexframe.sources import documents


def field(i, role, link=None):
    return {"id": i, "name": i.title(), "role": role, "link": link}


def record(i, collection="job", at=1, deleted=False, **values):
    return {"id": i, "collection": collection, "deleted": deleted, "updatedAt": at, "values": values}


def document(records, fields=None, **changes):
    fields = fields or [
        field("what", "title"), field("state", "group"), field("size", "weight"), field("up", "parent"), field("marks", "tags"), field("note", "scalar"),
        field("needs", "link", {"collection": "job", "cardinality": "many", "symmetric": False}), field("twin", "link", {"collection": "job", "cardinality": "one", "symmetric": True}),
    ]
    return {"version": 1, "source": "own", "collections": [{"id": "job", "name": "Jobs", "titleField": "what", "fields": fields}], "records": records} | changes


GOOD = document([
    record("a", at=10, what="First", state="open", size=3, marks=["red", "blue", "red", 7], note={"any": [1]}),
    record("b", at=11, what=5, size="no number", up=["a"], needs=["a", "c"], marks=["blue"]),
    record("c", at=12, what="Third", up="b", twin="a", needs=["a"]),
    record("a2", at=13, what="Gone", deleted=True, needs=["nobody"]),
])


def texts(spark, *docs):
    return spark.createDataFrame([(f"d{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "name string, text string").repartition(3)


def test_derive(spark):
    c, r, shapes = documents.read_records(texts(spark, GOOD))
    assert documents.refusals(c, r, shapes).collect() == []
    nodes, edges = documents.derive(c, r)
    got = [(n.id, n.kind, n.label, n.group_label, n.weight, n.version) for n in nodes.orderBy("place").collect()]
    assert got == [
        ("own:job:a", "record", "First", "open", 3.0, 10.0), ("own:job:b", "record", "b", None, 0.5, 11.0), ("own:job:c", "record", "Third", None, 0.5, 12.0),
        ("tag:red", "tag", "red", None, 0.5, 0.0), ("tag:blue", "tag", "blue", None, 0.5, 0.0),
    ]
    got = [(e.id, e.src_id, e.dst_id, e.strength, e.directed) for e in edges.orderBy("place").collect()]
    assert got == [
        ("own:job:a--tag:red:tag:red", "own:job:a", "tag:red", 0.75, False), ("own:job:a--tag:blue:tag:blue", "own:job:a", "tag:blue", 0.75, False),
        ("own:job:a--own:job:b:hierarchy:", "own:job:a", "own:job:b", 2.0, False),
        ("own:job:b->own:job:a:relation:needs", "own:job:b", "own:job:a", 1.0, True), ("own:job:b->own:job:c:relation:needs", "own:job:b", "own:job:c", 1.0, True),
        ("own:job:b--tag:blue:tag:blue", "own:job:b", "tag:blue", 0.75, False),
        ("own:job:b--own:job:c:hierarchy:", "own:job:b", "own:job:c", 2.0, False), ("own:job:c->own:job:a:relation:needs", "own:job:c", "own:job:a", 1.0, True),
        ("own:job:a--own:job:c:relation:twin", "own:job:c", "own:job:a", 1.0, False),
    ]
    tagged = documents.decorate(nodes, r, "marks").filter("tags is not null").collect()
    assert {n.id: n.tags for n in tagged} == {"own:job:a": ["red", "blue", "red"], "own:job:b": ["blue"]}


BAD = {
    "no_document": "{no json", "members": GOOD | {"more": 1}, "version": GOOD | {"version": 2}, "id_grammar": GOOD | {"source": "a:b"}, "duplicate_record": document([record("a"), record("a")]),
    "unknown_collection": document([record("a", "other")]), "no_record": document([record("a", needs=["zz"])]), "duplicate_field": document([], [field("what", "title"), field("what", "group")]),
    "title_field": document([], [field("other", "title")]), "link_target": document([], [field("what", "title"), field("x", "link", {"collection": "none", "cardinality": "one", "symmetric": False})]),
    "duplicate_collection": GOOD | {"collections": GOOD["collections"] * 2, "records": []},
}


def test_refusals(spark):
    found = documents.refusals(*documents.read_records(texts(spark, *BAD.values(), '{"version": 1, "version": 1}', GOOD)))
    first = {r["name"]: r.b.rule for r in found.groupBy("name").agg(F.min(F.struct("rank", "rule")).alias("b")).collect()}
    assert first == {f"d{i}": rule for i, rule in enumerate([*BAD, "no_document"])}
    # a deleted record is there to be named
    assert documents.refusals(*documents.read_records(texts(spark, document([record("a", deleted=True), record("b", needs=["a"])])))).count() == 0


def test_read_graph(spark):
    node = {"id": "n1", "kind": "record", "database_id": None, "source": "s", "label": "N", "group": None, "weight": 1, "version": 2, "has_note": False, "icon": None}
    edge = {"id": "e1", "source": "n1", "target": "n2", "kind": "tag", "label": "l", "strength": 1, "directed": False, "record_id": None, "child_first": False}
    strict = {"version": 1, "nodes": [node, node | {"id": "n2"}], "edges": [edge]}
    loose = {"nodes": ["n1", {"id": "n2", "shine": 1, "tags": ["t"]}], "edges": [{"id": "e1", "source": "n1", "target": "n2", "type": "Parent"}]}
    dangling = strict | {"edges": [edge | {"target": "n3"}]}
    frames = texts(spark, strict, loose, dangling, strict | {"nodes": [node, node]})
    _, _, _, refused = documents.read_graph(frames)
    assert {(r["name"], r.rule) for r in refused.collect()} == {("d1", "members"), ("d1", "version"), ("d2", "no_end"), ("d3", "no_end"), ("d3", "duplicate_node")}
    nodes, edges, notes, refused = documents.read_graph(frames, lenient=True)
    assert {r["name"] for r in refused.collect()} == {"d2", "d3"}
    assert {(n.id, n.label, n.weight, n.source) for n in nodes.filter("name = 'd1'").collect()} == {("n1", "n1", 0.5, "file"), ("n2", "n2", 0.5, "file")}
    assert [(e.kind, e.directed, e.label) for e in edges.filter("name = 'd1'").collect()] == [("hierarchy", True, "hierarchy")]
    assert {(n.at, n.note) for n in notes.filter("name = 'd1'").collect()} == {("nodes[0]", "bare_id"), ("nodes[1]", "defaulted 9"), ("nodes[1]", "dropped shine"), ("edges[0]", "defaulted 6")}
    assert notes.filter("name = 'd0'").count() == 0


def test_read_log(spark):
    a, b, c = ("a" * 40, "b" * 40, "c" * 40)
    rows = [f"{a}\x1f\x1fAnn\x1f100\x1fHEAD -> main, tag: v1\x1fStart", f"{b}\x1f{a}\x1f\x1f101\x1f\x1f" + "x" * 130, f"{c}\x1f{b} {a} {'d' * 40}\x1fCy\x1f102\x1f\x1f", "", f"{a}\x1f\x1fAnn\x1f103\x1f\x1fAgain", "broken", f"{'e' * 40}\x1f\x1f\x1f99999999999\x1f\x1f", "zz\x1f\x1f\x1f1\x1f\x1f"]
    lines = spark.createDataFrame(list(enumerate(rows, 1)), "line long, text string")
    _, bad = documents.read_log(lines)
    assert {(r.line, r.rule) for r in bad.collect()} == {(5, "twice"), (6, "fields"), (7, "time"), (8, "hash")}
    got = {r.hash[0]: r for r in documents.read_log(lines.filter("line < 4"))[0].collect()}
    assert got["a"].refs == ["main", "v1", "root"] and got["b"].author is None and len(got["b"].subject) == 120
    assert got["c"].parents == [b, a] and got["c"].dropped == 1 and got["c"].refs == ["merge"] and got["c"].subject is None
    drawn = spark.createDataFrame([("* x",), ("| | * y",), ("|/",)], "text string")
    assert documents.graph_width(drawn).first().width == 3


def test_read_pages(spark):
    db = {"id": "db", "properties": {"Name": {"id": "t", "name": "Name", "type": "title"}, "State": {"id": "s", "name": "State", "type": "status"}, "Tags": {"id": "g", "name": "Tags", "type": "multi_select"}, "Size": {"id": "w", "name": "Size", "type": "number"}, "Up": {"id": "u", "name": "Up", "type": "relation", "relation": {"database_id": "db"}}, "Ref": {"id": "r", "name": "Ref", "type": "relation", "relation": {"database_id": "db"}}}}
    page = lambda i, **p: {"id": i, "parent": {"database_id": "db"}, "last_edited_time": "2024-01-02T03:04:05.000Z", "properties": {k: v | {"id": n} for k, (n, v) in p.items()}}
    pages = [
        page("p1", Name=("t", {"type": "title", "title": [{"plain_text": "One "}, {"plain_text": "more"}]}), State=("s", {"type": "status", "status": {"name": "open"}}), Tags=("g", {"type": "multi_select", "multi_select": [{"name": "x"}]}), Size=("w", {"type": "number", "number": 4})),
        page("p2", Name=("t", {"type": "title", "title": []}), Up=("u", {"type": "relation", "relation": [{"id": "p1"}]}), Ref=("r", {"type": "relation", "relation": [{"id": "p1"}]})),
    ]
    frame = lambda rows: spark.createDataFrame([("d", json.dumps(x)) for x in rows], "name string, text string").select("name", F.parse_json("text").alias("doc"))
    c, r = documents.read_pages(frame([db]), frame(pages), "own", {"db.u": "parent"})
    nodes, edges = documents.derive(c, r)
    assert {(n.id, n.label, n.group_label, n.weight, n.version) for n in nodes.collect()} == {("own:db:p1", "One more", "open", 4.0, 1704164645.0), ("own:db:p2", "", None, 0.5, 1704164645.0), ("tag:x", "x", None, 0.5, 0.0)}
    assert {e.id for e in edges.collect()} == {"own:db:p1--own:db:p2:hierarchy:", "own:db:p2->own:db:p1:relation:r", "own:db:p1--tag:x:tag:x"}


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    c, r, shapes = documents.read_records(texts(spark, GOOD).limit(n))
    assert documents.refusals(c, r, shapes).count() == 0 and all(x.count() == 0 for x in documents.derive(c, r))


def test_parts(spark):
    """A document in parts reads as the whole one; references lead from part to part, and heads that differ are refused."""
    halves = [GOOD | {"records": GOOD["records"][:1]}, GOOD | {"records": GOOD["records"][1:]}]
    parts = lambda *docs: spark.createDataFrame([("d0", n, json.dumps(d)) for n, d in enumerate(docs)], "name string, part long, text string")
    c, r, shapes = documents.read_records(parts(*halves))
    assert documents.refusals(c, r, shapes).collect() == []
    whole = documents.derive(*documents.read_records(texts(spark, GOOD))[:2])
    for got, want in zip(documents.derive(c, r), whole, strict=True):
        assert [x.id for x in got.orderBy("place").collect()] == [x.id for x in want.orderBy("place").collect()]
    odd = halves[1] | {"collections": [GOOD["collections"][0] | {"titleField": "note"}]}
    assert [x.rule for x in documents.refusals(*documents.read_records(parts(halves[0], odd))).collect()] == ["duplicate_collection"]


def test_texts_are_parsed_once(spark):
    c, r, shapes = documents.read_records(texts(spark, GOOD))
    assert "parse_json" not in documents.refusals(c, r, shapes)._jdf.queryExecution().executedPlan().toString()


def test_ids_of_records_are_not_broadcast(spark):
    """References meet the records' ids, which are as many as the records, in a join by shuffle."""
    plan = documents.refusals(*documents.read_records(texts(spark, GOOD)))._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+) \[name#\d+, \w+#\d+, id#\d+\], \[name#\d+, collection#\d+, id#\d+\], LeftAnti", plan)
    assert joins and set(joins) == {"SortMergeJoin"}
