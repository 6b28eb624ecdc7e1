"""Simplification of a drawing that can be undone: leaves fold into their neighbour, chains contract to one link.

Both passes read one table of ends, built once. What a pass takes out is named in a journal, so it can be put back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexframe.operators import model
from plexframe.operators.analysis import folding
from plexframe.operators.traverse import forget, least_labels, written


@dataclass
class Simplified:
    """nodes (id, ord, visible, representative, step), edges (..., visible, step), links (low, high, step).

    A step is `leaf:` and the leaf, or `chain:` and the chain's least id; null for what is still drawn. links are drawn
    in place of chains. out (id, here, step, tip, edges) are the ends that go, each with how many edges it takes along,
    and shared (edges) counts the edges between two of them; None if nothing went.
    """

    nodes: DataFrame
    edges: DataFrame
    links: DataFrame
    out: DataFrame | None = None
    shared: DataFrame | None = None


def simplify(nodes: DataFrame, edges: DataFrame, leaves: bool = True, chains: bool = True) -> Simplified:
    """Simplify a graph of nodes (id, ord) and edges (id, src_id, dst_id). Nodes that a column `pinned` marks stay drawn.

    Nodes and the ends of edges meet once, in a row for each id. Whether an end of a chain is drawn is looked up from
    there, so a chain of one node needs no more; only longer ones are labelled.
    """
    known = _surveyed(nodes, edges, chains)
    odd, ended = known.agg(F.max(F.col("inner") & (F.col("edges") > 2)), F.max(F.expr("here and not pinned and low = high"))).first()
    if odd:
        known = _checked(known, edges)
    rest = known.filter("not inner")
    if leaves and ended:
        ends = written(known.filter("here and low = high").select("id", F.col("low").alias("to"), "ord", "pinned"))
        rest = rest.join(folding(ends), "id", "left")
    else:
        rest = rest.withColumn("to", F.lit(None).cast("string"))
    rest = written(rest.select("id", "ord", "here", "to", (F.col("here") & F.col("to").isNull()).alias("drawn"), "edges", "loops"))
    spans = written(_spans(known.filter("inner"), rest))
    forget(known)
    leaf, chain = F.concat(F.lit("leaf:"), "id"), F.concat(F.lit("chain:"), "run")
    one = spans.filter("alone").withColumn("run", F.when(F.col("first").isNotNull(), F.col("id"))).withColumn("tip", F.lit(True))
    links, long, shared = one.filter("run is not null").select(F.col("first").alias("low"), F.col("last").alias("high"), chain.alias("step")), None, None
    if spans.filter("not alone").limit(1).count():
        long, runs = _contract(spans.filter("not alone"))
        links = links.union(runs.select("low", "high", chain.alias("step")))
        one = one.select(long.columns).union(long)
        gone = long.filter("run is not null")
        a, b = (gone.select(F.col("id").alias(c)) for c in ("src_id", "dst_id"))
        shared = edges.filter("src_id != dst_id").join(a, "src_id", "left_semi").join(b, "dst_id", "left_semi").agg(F.count("*").alias("shared"))
    loops = F.when(F.col("tip"), 0).otherwise(F.col("loops"))  # a loop at a chain's first or last node stays in its place
    out = rest.filter("to is not null").select("id", "here", leaf.alias("step"), F.lit(False).alias("tip"), (F.col("edges") + F.col("loops")).alias("edges"))
    out = out.union(one.filter("run is not null").select("id", "here", chain.alias("step"), "tip", (F.col("edges") + loops).alias("edges")))
    seen = rest.filter("here").select("id", "ord", F.col("drawn").alias("visible"), F.coalesce("to", "id").alias("representative"), F.when(~F.col("drawn"), leaf).alias("step"))
    seen = seen.union(one.filter("here").select("id", "ord", F.col("run").isNull().alias("visible"), F.coalesce("first", "id").alias("representative"), chain.alias("step")))
    return Simplified(seen, _marked(edges, out), links, out, shared)


def _ends(edges: DataFrame) -> DataFrame:
    """(id, other): the edges as they stand at each of their ends; a loop stands once."""
    there = edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"))
    back = edges.select(F.col("dst_id").alias("id"), F.col("src_id").alias("other")).filter("not (id <=> other)")
    return there.union(back).filter("id is not null")


def _surveyed(nodes: DataFrame, edges: DataFrame, chains: bool) -> DataFrame:
    """(id, ord, here, pinned, low, high, edges, loops, inner): a row for each node and each id that an edge states.

    low and high are the least and the greatest neighbour, edges the number without loops. inner marks what has two
    neighbours and is not pinned; where it has more than two edges a third neighbour is left to be looked for, unless
    its hash already tells.
    """
    pinned = F.coalesce("pinned", F.lit(False)) if "pinned" in nodes.columns else F.lit(False)
    own = nodes.select("id", "ord", pinned.alias("pinned"), F.lit(True).alias("here"))
    loop = F.coalesce(F.col("id") == F.col("other"), F.lit(False))
    ends = _ends(edges).select("id", F.when(~loop, F.col("other")).alias("other"), loop.alias("loop"))
    spot = F.expr("shiftleft(1L, cast(pmod(xxhash64(other), 64) as int))")
    each = own.unionByName(ends, allowMissingColumns=True).groupBy("id").agg(
        F.max("ord").alias("ord"), F.coalesce(F.max("here"), F.lit(False)).alias("here"), F.coalesce(F.max("pinned"), F.lit(False)).alias("pinned"), F.min("other").alias("low"), F.max("other").alias("high"),
        F.count_if(~F.col("loop")).alias("edges"), F.count_if("loop").alias("loops"), F.bit_or(F.when(F.col("other").isNotNull(), spot)).alias("spots"),
    )
    two = F.coalesce(~F.col("pinned") & (F.col("low") != F.col("high")) & (F.bit_count("spots") < 3), F.lit(False)) if chains else F.lit(False)
    return written(each.withColumn("inner", two).drop("spots"))


def _checked(known: DataFrame, edges: DataFrame) -> DataFrame:
    """known, where inner holds only for what has no third neighbour."""
    maybe = known.filter("inner and edges > 2").select("id", "low", "high")
    third = _ends(edges).join(maybe, "id").filter("other != id and other != low and other != high").select("id").distinct()
    out = written(known.join(third.withColumn("third", F.lit(True)), "id", "left").withColumn("inner", F.col("inner") & F.col("third").isNull()).drop("third"))
    forget(known)
    return out


def _spans(inner: DataFrame, rest: DataFrame) -> DataFrame:
    """(id, ord, here, edges, loops, alone, first, last, ends) of what has two neighbours.

    alone: neither is of its kind. Then first and last are the two, by ord, if both are drawn; else ends names them
    (other, ord, drawn), without the last two for those of its kind.
    """
    at = lambda c: rest.select(F.col("id").alias(c), F.col("ord").alias(f"{c}_ord"), F.col("drawn").alias(f"{c}_drawn")).hint("merge")
    met = inner.join(at("low"), "low", "left").join(at("high"), "high", "left")
    a, b = (F.struct(F.col(f"{c}_ord").alias("ord"), F.col(c).alias("other"), F.col(f"{c}_drawn").alias("drawn")) for c in ("low", "high"))
    alone = F.col("low_drawn").isNotNull() & F.col("high_drawn").isNotNull()
    good = alone & F.col("low_drawn") & F.col("high_drawn")
    side = lambda x, y: F.when(good, F.when(a < b, F.col(x)).otherwise(F.col(y)))
    return met.select("id", "ord", "here", "edges", "loops", alone.alias("alone"), side("low", "high").alias("first"), side("high", "low").alias("last"), F.when(~alone, F.array(a, b)).alias("ends"))


def _contract(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with run, tip and first, runs (run, low, high)): runs between two different drawn nodes; of others run is null.

    Rings, runs to a folded leaf and runs back to where they began stay.
    """
    hops = written(spans.select("id", F.inline("ends")))
    within = written(hops.filter("drawn is null").select(F.col("id").alias("src_id"), F.col("other").alias("dst_id")))
    run = least_labels(spans.select("id"), within, "run")
    out = hops.filter("drawn is not null")
    ends = out.join(run, "id").groupBy("run").agg(F.min(F.struct("ord", "other")).alias("a"), F.max(F.struct("ord", "other")).alias("b"), F.min("drawn").alias("drawn"), F.count("*").alias("n"))
    runs = written(ends.filter("drawn and n = 2 and a.other != b.other").select("run", F.col("a.other").alias("low"), F.col("b.other").alias("high")))
    tips = out.select("id").distinct().withColumn("tip", F.lit(True))
    gone = run.join(runs, "run").join(tips, "id", "left").select("id", "run", F.coalesce("tip", F.lit(False)).alias("tip"), F.col("low").alias("first"))
    return written(spans.drop("first", "last", "ends", "alone").join(gone, "id", "left")), runs


def _marked(edges: DataFrame, out: DataFrame) -> DataFrame:
    """edges with visible and step: those at an end that goes, by its source's step before its target's."""
    a, b = (out.select(F.col("id").alias(c), F.col("step").alias(f"__{c}"), F.col("tip").alias(f"__tip_{c}")) for c in ("src_id", "dst_id"))
    stays = (F.col("src_id") == F.col("dst_id")) & F.col("__tip_src_id")
    step = F.when(stays, F.lit(None).cast("string")).otherwise(F.coalesce("__src_id", "__dst_id"))
    own = [c for c in edges.columns if c not in ("visible", "step")]
    return edges.select(own).join(a, "src_id", "left").join(b, "dst_id", "left").select(*own, step.isNull().alias("visible"), step.alias("step"))


def restore(s: Simplified) -> Simplified:
    """The graph before its simplification."""
    back = lambda df: df.withColumn("visible", F.lit(True)).withColumn("step", F.lit(None).cast("string"))
    return Simplified(back(s.nodes).withColumn("representative", F.col("id")), back(s.edges), s.links.limit(0))


def counts(s: Simplified) -> DataFrame:
    """One row: how many nodes and edges are out. Edges are counted at the ends that go, those between two once."""
    if s.out is None:
        return model.hidden_counts(s.nodes, s.edges)
    found = s.out.agg(F.count_if("here").alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    if s.shared is not None:
        found = found.crossJoin(s.shared).select("nodes", (F.col("edges") - F.col("shared")).alias("edges"))
    return found
