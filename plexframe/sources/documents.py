"""Graph documents: JSON texts with declared collections and records, or with nodes and edges, read many at a time.

A table (name, text) holds a document a row, of at most 2**28 characters. A longer document comes in parts: rows of one
name with a column `part`, each a document of the same head with its share of the records; parts are what is dealt out.
Members are read from VARIANT, whose parser refuses a key that stands twice. Faults become rows
of a table of refusals, in the order of the checks; nothing is given a value it does not state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexframe.functions import ids
from plexframe.operators.traverse import written

# Members of each object, the version, the roles, the kinds and the sizes that are taken.
DOCUMENT, COLLECTION, RECORD = ("version", "source", "collections", "records"), ("id", "name", "titleField", "fields"), ("id", "collection", "deleted", "updatedAt", "values")
FIELD, LINK = ("id", "name", "role", "link"), ("collection", "cardinality", "symmetric")
NODE = ("id", "kind", "database_id", "source", "label", "group", "weight", "version", "has_note", "icon")
EDGE = ("id", "source", "target", "kind", "label", "strength", "directed", "record_id", "child_first")
NODE_KINDS, EDGE_KINDS = ("record", "note", "database", "tag"), ("relation", "tag", "note_of", "note_link", "hierarchy")
VERSION, MOST_CHARS, MOST_LINKS = 1, 1 << 28, 2_000_000
ROLES = ("title", "label", "group", "weight", "parent", "link", "tags", "scalar")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_of(v: Column) -> Column:
    """A cell's text, if it is a text."""
    return F.when(_kind(v) == "STRING", _get(v, "$", "string"))


def number_of(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _get(v, "$", "double"))


def texts_of(v: Column) -> Column:
    """The texts of a list, in its order; null if the cell is no list."""
    items = F.filter(_get(v, "$", "array<variant>"), lambda x: _kind(x) == "STRING")
    return F.transform(items, lambda x: _get(x, "$", "string"))


def _unknown(v: Column, members: tuple) -> Column:
    """Members that are not expected, and expected ones that are missing, by name; null if v is no object."""
    keys = F.map_keys(_get(v, "$", "map<string,variant>"))
    named = F.array(*map(F.lit, members))
    return F.concat(F.array_except(keys, named), F.array_except(named, keys))


def parsed(texts: DataFrame) -> DataFrame:
    """(name, text, doc): doc is null if the text is no JSON, states a key twice, or is too long."""
    return texts.select("name", *[c for c in ("part",) if c in texts.columns], "text", F.when(F.char_length("text") <= MOST_CHARS, F.try_parse_json("text")).alias("doc"))


def read_records(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, records, shapes) of documents with declared roles.

    collections: name, source, collection, place, title_field, declared (array of field, role, link), and the field that
    each role goes by: of several the first by id. records: name, source, collection, id, place, deleted, updated_at,
    values. shapes: refusals (name, rank 0, rule, at) for what is not of the documents' form. Heads that the parts of one
    document share count once, ones that differ as collections stated twice; a record's place is its part times 2**32 and
    its index. Texts are parsed once for the heads and once for the records, which are written.
    """
    docs, d = parsed(texts), F.col("doc")
    parts = "part" in docs.columns
    top = docs.select("name", _get(d, "$.source", "string").alias("source"), _get(d, "$.collections", "array<variant>").alias("cs"), d.isNull().alias("lost"),
        (F.coalesce(F.size(_unknown(d, DOCUMENT)), F.lit(1)) > 0).alias("odd"), F.coalesce(_get(d, "$.version", "double") == VERSION, F.lit(False)).alias("known"))
    top = written(top)
    fields = F.transform(
        _get(F.col("c"), "$.fields", "array<variant>"),
        lambda f: F.struct(
            _get(f, "$.id", "string").alias("field"), _get(f, "$.role", "string").alias("role"), _get(f, "$.link.collection", "string").alias("target"),
            (_get(f, "$.link.cardinality", "string") == "many").alias("many"), F.coalesce(_get(f, "$.link.symmetric", "boolean"), F.lit(False)).alias("symmetric"), _unknown(f, FIELD).alias("odd"),
        ),
    )
    each = top.select("name", "source", F.posexplode("cs").alias("place", "c"))
    collections = each.select("name", "source", "place", _get(F.col("c"), "$.id", "string").alias("collection"), _get(F.col("c"), "$.titleField", "string").alias("title_field"), F.array_sort(fields).alias("declared"), _unknown(F.col("c"), COLLECTION).alias("odd"))
    collections = written(collections.distinct() if parts else collections)
    of = lambda role: F.get(F.filter("declared", lambda f: f["role"] == role), F.lit(0))["field"]
    collections = collections.withColumns({"group_field": F.coalesce(of("label"), of("group")), "weight_field": of("weight"), "parent_field": of("parent"), "tags_field": of("tags")})
    r = F.col("r")
    at = (F.col("part").cast("long") * (1 << 32) + F.col("pos")) if parts else F.col("pos")
    every = docs.select("*", F.posexplode(_get(d, "$.records", "array<variant>")).alias("pos", "r"))
    records = every.select(
        "name", _get(d, "$.source", "string").alias("source"), at.alias("place"), _get(r, "$.collection", "string").alias("collection"), _get(r, "$.id", "string").alias("id"), _get(r, "$.deleted", "boolean").alias("deleted"),
        _get(r, "$.updatedAt", "double").alias("updated_at"), _get(r, "$.values", "map<string,variant>").alias("values"), _unknown(r, RECORD).alias("odd"),
    )
    records = written(records)
    wrong = lambda df, rule, at: df.select("name", F.lit(0).alias("rank"), F.lit(rule).alias("rule"), at.alias("at"))
    shapes = [
        wrong(top.filter("lost"), "no_document", F.lit("")),
        wrong(top.filter("not lost and odd"), "members", F.lit("")),
        wrong(top.filter("not lost and not known"), "version", F.lit("version")),
        wrong(collections.filter("size(odd) > 0 or odd is null or collection is null or declared is null"), "members", F.format_string("collections[%d]", "place")),
        wrong(collections.filter(F.exists("declared", lambda f: (F.coalesce(F.size(f["odd"]), F.lit(1)) > 0) | ~F.coalesce(f["role"].isin(*ROLES), F.lit(False)))), "members", F.format_string("collections[%d].fields", "place")),
        wrong(records.filter("size(odd) > 0 or odd is null or id is null or collection is null or deleted is null or updated_at is null or values is null"), "members", F.format_string("records[%d]", "place")),
    ]
    return collections.drop("odd"), records.drop("odd"), reduce(DataFrame.union, shapes)


def _cells(collections: DataFrame, records: DataFrame) -> DataFrame:
    """Records beside what their collection declares."""
    return records.join(collections.drop("source", "place"), ["name", "collection"])


def _links(cells: DataFrame) -> DataFrame:
    """A row for each reference that a link field's cell states: cells' columns, link, pos, ref."""
    each = cells.withColumn("link", F.explode(F.filter("declared", lambda f: f["role"] == "link"))).withColumn("cell", F.col("values")[F.col("link.field")])
    refs = F.when(F.col("link.many"), texts_of(F.col("cell"))).otherwise(F.array_compact(F.array(text_of(F.col("cell")))))
    return each.select("*", F.posexplode(refs).alias("pos", "ref"))


def _parent() -> Column:
    cell = F.col("values")[F.col("parent_field")]
    many = texts_of(cell)
    return F.coalesce(text_of(cell), F.when(F.size(many) == 1, F.get(many, F.lit(0))))


def refusals(collections: DataFrame, records: DataFrame, shapes: DataFrame) -> DataFrame:
    """(name, rank, rule, at): all that keeps a document from being read. Its refusal is the first by rank.

    Ids: not empty, no colon in a source or collection. Collections, fields and records stated twice, title fields and
    link targets that are not declared, records of no collection, references to no record. A deleted record exists.
    """
    wrong = lambda df, rank, rule, at: df.select("name", F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), at.alias("at"))
    bad = lambda c: (F.col(c) == "") | F.col(c).contains(":")
    known = collections.select("name", "collection").distinct()
    targets = collections.select("name", F.inline("declared")).filter("role = 'link'")
    cells = _cells(collections, records)
    refs = _links(cells.filter("not deleted")).select("name", F.col("link.target").alias("collection"), F.col("ref").alias("id"), "place")
    ups = cells.filter("not deleted").select("name", "collection", _parent().alias("id"), "place").filter("id is not null")
    # beside the width of their values the ids seem few; they are as many as the records, and no table for one machine
    there = records.select("name", "collection", "id").hint("merge")
    found = [
        wrong(collections.select("name", "source").union(records.select("name", "source")).distinct().filter(bad("source")), 1, "id_grammar", F.col("source")),
        wrong(collections.filter(bad("collection")), 1, "id_grammar", F.col("collection")),
        wrong(collections.filter(F.exists("declared", lambda f: f["field"] == "")), 1, "id_grammar", F.col("collection")),
        wrong(records.filter("id = ''"), 1, "id_grammar", F.format_string("records[%d]", "place")),
        wrong(collections.groupBy("name", "collection").count().filter("count > 1"), 2, "duplicate_collection", F.col("collection")),
        wrong(collections.filter("size(array_distinct(transform(declared, f -> f.field))) < size(declared)"), 2, "duplicate_field", F.col("collection")),
        wrong(collections.filter("title_field is not null and not array_contains(transform(declared, f -> f.field), title_field)"), 2, "title_field", F.col("collection")),
        wrong(targets.select("name", F.col("target").alias("collection")).distinct().join(known, ["name", "collection"], "left_anti"), 2, "link_target", F.coalesce("collection", F.lit(""))),
        wrong(records.groupBy("name", "collection", "id").count().filter("count > 1"), 3, "duplicate_record", F.concat_ws(":", "collection", "id")),
        wrong(records.join(known, ["name", "collection"], "left_anti"), 4, "unknown_collection", F.format_string("records[%d]", "place")),
        wrong(refs.union(ups.select("name", "collection", "id", "place")).join(there, ["name", "collection", "id"], "left_anti"), 5, "no_record", F.format_string("records[%d]", "place")),
    ]
    return reduce(DataFrame.union, [shapes, *found])


def derive(collections: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents that have no refusal; each row names its document, and `place` orders them.

    A record is a node by its title's text or its id; tags become hubs behind all records. Edges: the parent's first,
    then references by field, then tags. Of relations with one id in a document the first stays.
    """
    cells = _cells(collections, records).filter("not deleted")
    value = lambda c: F.col("values")[F.col(c)]
    null = F.lit(None).cast("string")
    cells = cells.withColumn("me", ids.record_id(F.col("source"), F.col("collection"), F.col("id"))).withColumn("tags", F.array_distinct(texts_of(value("tags_field"))))
    nodes = cells.select(
        "name", F.struct(F.lit(0).alias("hub"), F.col("place").alias("record"), F.lit(0).alias("pos")).alias("place"), F.col("me").alias("id"), F.lit("record").alias("kind"), F.col("collection").alias("database_id"),
        "source", F.coalesce(text_of(value("title_field")), "id").alias("label"), text_of(value("group_field")).alias("group_label"),
        F.coalesce(number_of(value("weight_field")), F.lit(0.5)).alias("weight"), F.col("updated_at").alias("version"),
    )
    tagged = cells.select("name", "place", "me", F.posexplode("tags").alias("pos", "tag"))
    hubs = tagged.groupBy("name", "tag").agg(F.min(F.struct(F.lit(1).alias("hub"), F.col("place").alias("record"), "pos")).alias("place"))
    hubs = hubs.select("name", "place", ids.tag_id(F.col("tag")).alias("id"), F.lit("tag").alias("kind"), null.alias("database_id"), F.lit("tag").alias("source"), F.col("tag").alias("label"), null.alias("group_label"), F.lit(0.5).alias("weight"), F.lit(0.0).alias("version"))

    def row(df, src, dst, kind, label, directed, phase, field, pos):
        place = F.struct(F.col("place").alias("record"), F.lit(phase).alias("phase"), field.alias("field"), pos.alias("pos"))
        return df.select("name", place.alias("place"), ids.edge_id(src, dst, F.lit(kind), label, directed).alias("id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(ids.STRENGTH[kind]).alias("strength"), directed.alias("directed"))

    me, no = F.col("me"), F.lit("")
    ups = cells.withColumn("up", _parent()).filter("up is not null")
    trees = row(ups, ids.record_id(F.col("source"), F.col("collection"), F.col("up")), me, "hierarchy", no, F.lit(False), 0, no, F.lit(0))
    refs = _links(cells)
    related = row(refs, me, ids.record_id(F.col("source"), F.col("link.target"), F.col("ref")), "relation", F.col("link.field"), ~F.col("link.symmetric"), 1, F.col("link.field"), F.col("pos"))
    first = related.groupBy("name", "id").agg(F.min_by(F.struct(*[c for c in related.columns if c not in ("name", "id")]), "place").alias("e"))
    related = first.select(*[F.col(c) if c in ("name", "id") else F.col(f"e.{c}") for c in related.columns])
    tags = row(tagged, me, ids.tag_id(F.col("tag")), "tag", F.col("tag"), F.lit(False), 2, no, F.col("pos"))
    return nodes.union(hubs), trees.union(related).union(tags)


def read_graph(texts: DataFrame, lenient: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, notes, refusals) of documents that state nodes and edges.

    Strictly, every member has to be there and no other. A lenient reading takes nodes given as bare ids, gives missing
    members their defaults and drops unknown ones, with a note (name, at, note) for each; ids that are missing or stand
    twice, kinds that do not exist and edges without ends are refused either way.
    """
    docs = parsed(texts)
    d = F.col("doc")
    each = lambda member: docs.select("name", F.posexplode(_get(d, f"$.{member}", "array<variant>")).alias("place", "v"))
    v = F.col("v")
    bare = _kind(v) == "STRING"
    s, num, yes = (lambda m: text_of(_get(v, f"$.{m}", "variant"))), (lambda m: number_of(_get(v, f"$.{m}", "variant"))), (lambda m: F.when(_kind(_get(v, f"$.{m}", "variant")) == "BOOLEAN", _get(v, f"$.{m}", "boolean")))
    given = F.map_keys(_get(v, "$", "map<string,variant>"))
    stated = lambda names: F.array_intersect(F.array(*map(F.lit, names)), F.coalesce(given, F.array().cast("array<string>")))
    kind = F.coalesce(s("kind"), F.lit("record"))
    nodes = each("nodes").select(
        "name", "place", F.when(bare, text_of(v)).otherwise(s("id")).alias("id"), kind.alias("kind"), s("database_id").alias("database_id"), F.coalesce(s("source"), F.lit("file")).alias("source"),
        F.coalesce(s("label"), F.when(bare, text_of(v)).otherwise(s("id"))).alias("label"), s("group").alias("group_label"), F.coalesce(num("weight"), F.lit(0.5)).alias("weight"), F.coalesce(num("version"), F.lit(0.0)).alias("version"),
        F.coalesce(yes("has_note"), kind == "note").alias("has_note"), s("icon").alias("icon"), F.coalesce(texts_of(_get(v, "$.tags", "variant")), F.array().cast("array<string>")).alias("tags"), F.coalesce(s("path"), F.lit("")).alias("path"),
        bare.alias("bare"), F.array_except(given, F.array(*map(F.lit, (*NODE, "tags", "path")))).alias("extra"), (F.lit(len(NODE)) - F.size(stated(NODE))).alias("filled"),
    )
    wire = F.lower(s("type"))
    kind = F.coalesce(s("kind"), F.when(wire.isin("parent", "parent_of", "child_of", "hierarchy"), "hierarchy"), F.lit("relation"))
    edges = each("edges").select(
        "name", "place", s("id").alias("id"), s("source").alias("src_id"), s("target").alias("dst_id"), kind.alias("kind"), F.coalesce(s("label"), kind).alias("label"), F.coalesce(num("strength"), F.lit(0.5)).alias("strength"),
        F.coalesce(yes("directed"), kind == "hierarchy").alias("directed"), s("record_id").alias("record_id"), F.coalesce(yes("child_first"), F.lit(False)).alias("child_first"),
        F.array_except(given, F.array(*map(F.lit, (*EDGE, "type")))).alias("extra"), (F.lit(len(EDGE)) - F.size(stated(EDGE))).alias("filled"),
    )
    at = lambda what: F.format_string(f"{what}[%d]", "place")
    said = lambda df, at, note: df.select("name", at.alias("at"), note.alias("note"))
    notes = [
        said(nodes.filter("bare"), at("nodes"), F.lit("bare_id")),
        *[said(df.filter("filled > 0" + (" and not bare" if what == "nodes" else "")), at(what), F.format_string("defaulted %d", "filled")) for df, what in ((nodes, "nodes"), (edges, "edges"))],
        *[said(df.select("*", F.explode("extra").alias("member")), at(what), F.concat(F.lit("dropped "), "member")) for df, what in ((nodes, "nodes"), (edges, "edges"))],
    ]
    have = nodes.select("name", "id")
    ends = edges.select("name", "place", F.explode(F.array("src_id", "dst_id")).alias("id"))
    wrong = lambda df, rule, at: df.select("name", F.lit(rule).alias("rule"), at.alias("at"))
    refused = [
        wrong(docs.filter("doc is null"), "no_document", F.lit("")),
        wrong(docs.filter(d.isNotNull() & ~F.coalesce(_get(d, "$.version", "double") == VERSION, F.lit(lenient))), "version", F.lit("")),
        *[wrong(df.filter("id is null"), "no_id", at(what)) for df, what in ((nodes, "nodes"), (edges, "edges"))],
        *[wrong(df.groupBy("name", "id").count().filter("count > 1"), f"duplicate_{what}", F.coalesce("id", F.lit(""))) for df, what in ((nodes, "node"), (edges, "edge"))],
        wrong(nodes.filter(~F.col("kind").isin(*NODE_KINDS)), "kind", at("nodes")), wrong(edges.filter(~F.col("kind").isin(*EDGE_KINDS)), "kind", at("edges")),
        wrong(ends.join(have, ["name", "id"], "left_anti").distinct(), "no_end", at("edges")),
    ]
    if not lenient:
        refused += [wrong(df.filter("filled > 0 or size(extra) > 0"), "members", at(what)) for df, what in ((nodes.withColumn("extra", F.coalesce("extra", F.array(F.lit("bare")))), "nodes"), (edges, "edges"))]
    drop = ("bare", "extra", "filled")
    return nodes.drop(*drop), edges.drop(*drop), reduce(DataFrame.union, notes), reduce(DataFrame.union, refused)


def size_refusals(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, rule): documents of too many characters, and graphs of too many links."""
    long = texts.filter(F.char_length("text") > MOST_CHARS).select("name", F.lit("too_long").alias("rule"))
    return long.union(edges.groupBy("name").count().filter(F.col("count") > MOST_LINKS).select("name", F.lit("too_many_links")))


# What a commit line holds, how long a subject may be, roles by the type of a page's property.
SEPARATOR, HASH, SECONDS, SUBJECT = "\x1f", "^([0-9a-f]{40}|[0-9a-f]{64})$", "^[0-9]{1,10}$", 120
PROPERTY_ROLES = {"title": "title", "rich_text": "label", "select": "group", "status": "group", "multi_select": "tags", "relation": "link", "number": "weight"}


def read_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((hash, parents, author, time, refs, subject, dropped), (line, rule)) of commit lines (line, text).

    Six fields: hash, parents, author, committer's seconds, decoration, subject. Parents that the log does not hold are
    left out and counted. refs are the decoration's names, with `merge` for two or more parents and `root` for none.
    """
    f = F.split("text", SEPARATOR, -1)
    rows = lines.filter("text != ''").select("line", f.alias("f"))
    hashes = F.array_union(F.array(F.get("f", F.lit(0))), F.filter(F.split(F.coalesce(F.get("f", F.lit(1)), F.lit("")), " "), lambda p: p != ""))
    rows = rows.select("line", "f", F.filter(F.split(F.coalesce(F.get("f", F.lit(1)), F.lit("")), " "), lambda p: p != "").alias("parents"), hashes.alias("hashes"))
    time = F.coalesce(F.get("f", F.lit(3)), F.lit(""))
    fields = F.size("f") == 6
    grammar = F.forall("hashes", lambda h: h.rlike(HASH))
    whole = time.rlike(SECONDS) & (F.try_to_number(time, F.lit("9999999999")) <= 0xFFFFFFFF)
    good = rows.filter(fields & grammar & F.coalesce(whole, F.lit(False)))
    rule = F.when(~fields, "fields").when(~grammar, "hash").when(~F.coalesce(whole, F.lit(False)), "time")
    named = good.select("line", F.get("f", F.lit(0)).alias("hash"))
    again = named.join(named.groupBy("hash").agg(F.min("line").alias("first"), F.count("*").alias("n")).filter("n > 1"), "hash").filter("line > first")
    bad = rows.select("line", rule.alias("rule")).filter("rule is not null").union(again.select("line", F.lit("twice")))
    names = F.transform(F.filter(F.split(F.get("f", F.lit(4)), ", "), lambda r: r != ""), lambda r: F.regexp_replace(r, "^(HEAD -> |tag: )", ""))
    marks = F.when(F.size("parents") >= 2, F.array(F.lit("merge"))).when(F.size("parents") == 0, F.array(F.lit("root"))).otherwise(F.array().cast("array<string>"))
    blank = lambda c: F.when(c != "", c)
    commits = good.select(F.get("f", F.lit(0)).alias("hash"), "parents", blank(F.get("f", F.lit(2))).alias("author"), F.get("f", F.lit(3)).cast("long").alias("time"), F.array_distinct(F.concat(names, marks)).alias("refs"), blank(F.substring(F.get("f", F.lit(5)), 1, SUBJECT)).alias("subject"))
    each = commits.select("hash", F.posexplode("parents").alias("pos", "parent")).join(commits.select(F.col("hash").alias("parent")), "parent", "left_semi")
    kept = each.groupBy("hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda p: p["parent"]).alias("kept"))
    out = commits.join(kept, "hash", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    return out.select("hash", F.col("kept").alias("parents"), "author", "time", "refs", "subject", (F.size("parents") - F.size("kept")).alias("dropped")), bad


def graph_width(lines: DataFrame) -> DataFrame:
    """(width): the most columns of a drawn log, from the place of each line's star."""
    at = F.instr("text", "*") - 1
    return lines.filter(at >= 0).agg(F.coalesce(F.max(F.floor(at / 2) + 1), F.lit(0)).cast("long").alias("width"))


def decorate(nodes: DataFrame, records: DataFrame, field: str) -> DataFrame:
    """nodes with tags: the texts of a list cell of their record (name, source, collection, id, deleted, values)."""
    cell = records.filter("not deleted").select("name", ids.record_id(F.col("source"), F.col("collection"), F.col("id")).alias("id"), texts_of(F.col("values")[field]).alias("tags")).filter("tags is not null")
    return nodes.join(cell, ["name", "id"], "left")


def read_pages(databases: DataFrame, pages: DataFrame, source: str, roles: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(collections, records), as read_records gives them, of workspace databases and pages (name, doc variant).

    A property's type chooses its role, unless roles names it as "database.property"; a type of no role is scalar. Field
    ids are the properties' own ids, so a renamed property stays the same field.
    """
    d = F.col("doc")
    properties = lambda v: F.map_values(_get(v, "$.properties", "map<string,variant>"))
    known = F.create_map(*[F.lit(x) for kv in PROPERTY_ROLES.items() for x in kv])
    own = F.create_map(*[F.lit(x) for kv in (roles or {"": ""}).items() for x in kv])
    base = _get(d, "$.id", "string")

    def field(p):
        i = _get(p, "$.id", "string")
        role = F.coalesce(own[F.concat_ws(".", base, i)], known[_get(p, "$.type", "string")], F.lit("scalar"))
        return F.struct(i.alias("field"), role.alias("role"), _get(p, "$.relation.database_id", "string").alias("target"), F.lit(True).alias("many"), F.lit(False).alias("symmetric"))

    c = databases.select("name", F.lit(source).alias("source"), F.lit(0).alias("place"), base.alias("collection"), F.array_sort(F.transform(properties(d), field)).alias("declared"))
    of = lambda role: F.get(F.filter("declared", lambda f: f["role"] == role), F.lit(0))["field"]
    c = c.withColumns({"title_field": of("title"), "group_field": F.coalesce(of("label"), of("group")), "weight_field": of("weight"), "parent_field": of("parent"), "tags_field": of("tags")})

    def plain(p, kind):
        return F.array_join(F.transform(_get(p, f"$.{kind}", "array<variant>"), lambda t: _get(t, "$.plain_text", "string")), "")

    def listed(p, kind, member):
        return F.transform(_get(p, f"$.{kind}", "array<variant>"), lambda t: _get(t, f"$.{member}", "string"))

    def cell(p):
        kind = _get(p, "$.type", "string")
        json = lambda x: F.to_json(F.struct(x.alias("v")))
        wrapped = (
            F.when(kind.isin("title"), json(plain(p, "title"))).when(kind == "rich_text", json(plain(p, "rich_text")))
            .when(kind == "select", json(_get(p, "$.select.name", "string"))).when(kind == "status", json(_get(p, "$.status.name", "string")))
            .when(kind == "multi_select", json(listed(p, "multi_select", "name"))).when(kind == "relation", json(listed(p, "relation", "id"))).when(kind == "number", json(_get(p, "$.number", "double")))
        )
        return F.struct(_get(p, "$.id", "string").alias("key"), _get(F.try_parse_json(wrapped), "$.v", "variant").alias("value"))

    values = F.map_from_entries(F.filter(F.transform(properties(d), cell), lambda e: e["key"].isNotNull()))
    edited = F.unix_timestamp(F.to_timestamp(_get(d, "$.last_edited_time", "string")))
    r = pages.select("name", F.lit(source).alias("source"), F.lit(0).alias("place"), _get(d, "$.parent.database_id", "string").alias("collection"), base.alias("id"), F.coalesce(_get(d, "$.deleted", "boolean"), F.lit(False)).alias("deleted"), F.coalesce(edited, F.lit(0)).cast("double").alias("updated_at"), values.alias("values"))
    return c, r
