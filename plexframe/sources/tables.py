"""Tables with declared column roles become records, and records one graph of nodes and edges.

Roles are declared, never guessed: title, group, weight, version, parent, links, tags. Every column stays an
ordinary column, so pruning and pushdown reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexframe.functions import ids
from plexframe.operators.traverse import written


@dataclass
class Link:
    """A column that holds the key of a record in another table; many: an array of keys."""

    column: str
    target: str
    many: bool = False
    symmetric: bool = False


@dataclass
class Table:
    name: str
    rows: DataFrame
    key: str
    title: str | None = None
    label: str | None = None
    group: str | None = None
    weight: str | None = None
    version: str | None = None
    parent: str | None = None
    deleted: str | None = None
    tags: str | None = None
    links: Sequence[Link] = field(default_factory=list)

    def live(self) -> DataFrame:
        return self.rows.filter(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else self.rows


def refusals(tables: Sequence[Table]) -> DataFrame:
    """(rule, collection, id): duplicate record keys, tags with a colon, links to no record. Empty if the tables can be derived.

    A deleted record can be named. A link whose target is no table is an error of the declaration, and raised.
    """
    found, by_name = [], {t.name: t for t in tables}
    for t in tables:
        key = F.col(t.key).cast("string").alias("id")
        again = t.rows.groupBy(key).count().filter("count > 1")
        found.append(again.select(F.lit("duplicate_record").alias("rule"), F.lit(t.name).alias("collection"), "id"))
        if t.tags:
            bad = t.live().filter(F.exists(t.tags, lambda x: x.contains(":")))
            found.append(bad.select(F.lit("colon_in_tag").alias("rule"), F.lit(t.name).alias("collection"), key))
        for link in t.links:
            if link.target not in by_name:
                raise ValueError(f"{t.name}.{link.column} names no table: {link.target}")
            to = by_name[link.target]
            ref = F.explode(link.column) if link.many else F.col(link.column)
            refs = t.live().select(key, ref.alias("__ref")).filter("__ref is not null").withColumn("__ref", F.col("__ref").cast("string"))
            lost = refs.join(to.rows.select(F.col(to.key).cast("string").alias("__ref")), "__ref", "left_anti")
            found.append(lost.select(F.lit("no_record").alias("rule"), F.lit(t.name).alias("collection"), "id").distinct())
    return reduce(DataFrame.unionByName, found)


def _record(source: str, t: Table):
    return ids.record_id(F.lit(source), F.lit(t.name), F.col(t.key).cast("string"))


def records(source: str, tables: Sequence[Table]) -> DataFrame:
    """Record nodes. place orders them: the table's rank, then the key."""
    null = F.lit(None).cast("string")
    out = []
    for rank, t in enumerate(tables):
        key, kinds = F.col(t.key).cast("string"), dict(t.rows.dtypes)
        # a title, label or group is a text; a column of another type names nothing
        title, group = (c if c and kinds[c] == "string" else None for c in (t.title, t.label or t.group))
        out.append(
            t.live().select(
                F.struct(F.lit(rank).alias("table"), key.alias("key")).alias("place"), _record(source, t).alias("id"), F.lit("record").alias("kind"),
                F.lit(t.name).alias("database_id"), F.lit(source).alias("source"), (F.coalesce(title, key) if title else key).alias("label"),
                (F.col(group) if group else null).alias("group_label"), (F.coalesce(F.col(t.weight).cast("double"), F.lit(0.5)) if t.weight else F.lit(0.5)).alias("weight"),
                (F.coalesce(F.col(t.version).cast("double"), F.lit(0.0)) if t.version else F.lit(0.0)).alias("version"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def tag_hubs(tables: Sequence[Table]) -> DataFrame:
    """One node a tag, after all records, ordered by the first record that has it and its place there."""
    seen = []
    for rank, t in enumerate(tables):
        if t.tags:
            each = t.live().select(F.col(t.key).cast("string").alias("key"), F.posexplode(F.array_distinct(t.tags)).alias("pos", "tag"))
            seen.append(each.select(F.struct(F.lit(rank).alias("table"), "key", "pos").alias("place"), "tag"))
    first = reduce(DataFrame.unionByName, seen).filter("tag is not null").groupBy("tag").agg(F.min("place").alias("first"))
    null = F.lit(None).cast("string")
    return first.select(
        F.struct(F.lit(len(tables)).alias("table"), F.concat(F.format_string("%06d:", "first.table"), F.col("first.key"), F.format_string("\x00%06d", "first.pos")).alias("key")).alias("place"),
        ids.tag_id(F.col("tag")).alias("id"), F.lit("tag").alias("kind"), null.alias("database_id"), F.lit("tag").alias("source"), F.col("tag").alias("label"),
        null.alias("group_label"), F.lit(0.5).alias("weight"), F.lit(0.0).alias("version"),
    )


def _apart(t: Table, link: Link, tables: Sequence[Table]) -> bool:
    """Whether edges of a link have one id only if they have one key and one reference: both are whole numbers, and no other link has its name."""
    kinds, whole = dict(t.rows.dtypes), ("tinyint", "smallint", "int", "bigint")
    named = [(x.name, y.column) for x in tables for y in x.links]
    plain = not link.many and not link.symmetric and kinds[t.key] in whole and kinds[link.column] in whole
    return plain and named.count((t.name, link.column)) == 1 and not any(":" in x for x in (*(x.name for x in tables), *(y for _, y in named)))


def edges(source: str, tables: Sequence[Table], kinds: Sequence[str] = ("hierarchy", "relation", "tag")) -> DataFrame:
    """Hierarchy, relation and tag edges, of these kinds; of relations with one id the first stays. No node need exist yet.

    Only relations can share an id (hierarchy and tag edges have an end of their own record), so only they are grouped;
    where key and reference decide, by these two numbers, before an edge is made of them.
    """
    out: dict[str, list[DataFrame]] = {"hierarchy": [], "relation": [], "tag": [], "apart": []}
    for rank, t in enumerate(tables):
        rows, me = t.live(), _record(source, t)

        def row(rows, src, dst, kind, label, directed, phase, pos=None, t=t, rank=rank):
            place = F.struct(F.lit(rank).alias("table"), F.col(t.key).cast("string").alias("key"), F.lit(phase).alias("phase"), (F.lit(0) if pos is None else pos).alias("pos"))
            return rows.select(
                place.alias("place"), ids.edge_id(src, dst, F.lit(kind), label, F.lit(directed)).alias("id"), src.alias("src_id"), dst.alias("dst_id"), F.lit(kind).alias("kind"),
                label.alias("label"), F.lit(ids.STRENGTH[kind]).alias("strength"), F.lit(directed).alias("directed"),
            )

        if t.parent and "hierarchy" in kinds:
            up = ids.record_id(F.lit(source), F.lit(t.name), F.col(t.parent).cast("string"))
            out["hierarchy"].append(row(rows.filter(F.col(t.parent).isNotNull()), up, me, "hierarchy", F.lit(""), False, 0))
        for n, link in enumerate(sorted(t.links, key=lambda x: x.column.encode()) if "relation" in kinds else ()):
            here, apart = rows.filter(F.col(link.column).isNotNull()), _apart(t, link, tables)
            if apart:
                here = here.select(*dict.fromkeys((t.key, link.column))).distinct()
            if link.many:
                here = here.select("*", F.posexplode(link.column).alias("__pos", "__to"))
                to, pos = F.col("__to"), F.col("__pos")
            else:
                to, pos = F.col(link.column), None
            end = ids.record_id(F.lit(source), F.lit(link.target), to.cast("string"))
            out["apart" if apart else "relation"].append(row(here, me, end, "relation", F.lit(link.column), not link.symmetric, 1 + n, pos))
        if t.tags and "tag" in kinds:
            here = rows.select("*", F.posexplode(F.array_distinct(t.tags)).alias("__pos", "__tag")).filter("__tag is not null")
            out["tag"].append(row(here, me, ids.tag_id(F.col("__tag")), "tag", F.col("__tag"), False, 1000, F.col("__pos")))
    parts = out["hierarchy"] + out["tag"] + out["apart"]
    if out["relation"]:
        every = reduce(DataFrame.unionByName, out["relation"])
        first = every.groupBy("id").agg(F.min_by(F.struct(*[c for c in every.columns if c != "id"]), "place").alias("e"))
        parts.append(first.select(*[F.col("id") if c == "id" else F.col(f"e.{c}") for c in every.columns]))
    if not parts:
        raise ValueError("no table states a parent, a link or tags of the wanted kinds")
    return reduce(DataFrame.unionByName, parts)


def _ranged(df: DataFrame, by: str, each) -> tuple[DataFrame, DataFrame]:
    """df with the range of each row by `by`, and for each range what `each` sums up to before it.

    The ranges come from a sample, so they are written once: rows and sums see the same ones, also after a lost executor.
    """
    rows = written(df.repartitionByRange(F.col(by)).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__range").agg(each.alias("n"))
    return rows, sums.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))


def dense(df: DataFrame, by: str, out: str = "ord") -> DataFrame:
    """Number the rows from 0 in the order of `by`, in parallel: ranges, places in them, and the ranges' offsets."""
    rows, bases = _ranged(df, by, F.count("*"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return rows.withColumn("__at", at).join(F.broadcast(bases), "__range").withColumn(out, (F.col("__at") + F.col("__base")).cast("long")).drop("__range", "__at", "__base")


def running(df: DataFrame, by: str, cost: str, out: str = "running") -> DataFrame:
    """The sum of cost up to each row in the order of `by`, in parallel like dense."""
    rows, bases = _ranged(df, by, F.sum(cost))
    here = F.sum(cost).over(Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__at", here).join(F.broadcast(bases), "__range").withColumn(out, F.col("__at") + F.col("__base")).drop("__range", "__at", "__base")


def prefixes(df: DataFrame, group: str, by: str, sums: dict[str, str]) -> DataFrame:
    """df with running sums (name: column) inside each group in the order of `by`; a hot group is spread over ranges.

    Rows that tie are summed in any order, as in a running sum by rows.
    """
    rows = written(df.repartitionByRange(group, by).withColumn("__range", F.spark_partition_id()))
    here = Window.partitionBy(group, "__range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__part")).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__group", "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in sums])
    rows = rows.select("*", *[F.sum(c).over(here).alias(n) for n, c in sums.items()])
    out = rows.join(total, rows[group].eqNullSafe(total["__group"]) & (rows["__range"] == total["__part"]))
    return out.select(*df.columns, *[(F.col(n) + F.col(f"__base_{n}")).alias(n) for n in sums])


def present_only(rows: DataFrame, key: str, refs: str, targets: DataFrame) -> DataFrame:
    """rows with the array column refs less what is not in targets (id). A list that loses all is null; empty ones stay."""
    each = rows.select(key, F.posexplode(refs).alias("__pos", "__ref")).join(targets.select(F.col("id").alias("__ref")), "__ref", "left_semi")
    kept = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pos", "__ref"))).alias("__kept"))
    left = F.when(F.size(refs) == 0, F.col(refs)).otherwise(F.col("__kept.__ref"))
    return rows.join(kept, key, "left").withColumn(refs, left).drop("__kept")


def to_delete(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are stored but no longer wanted."""
    return stored.select(key).join(wanted.select(key), key, "left_anti")
