"""Small column functions and normalisations: level of detail, work budgets, colours by slot, sizes, hashes, ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexframe.sources.tables import prefixes

# Node counts up to which labels, all edges and single nodes are drawn.
TIERS = (("full", 2000), ("no_labels", 20_000), ("decimated", 200_000))
# Steps that a layout may cost, ticks at most without and with a limit, ticks at least.
WORK, MAX_TICKS, TOP_TICKS, MIN_TICKS = 6e6, 112, 64, 8


def tier(n: Column) -> Column:
    out = F.lit("clustered")
    for name, most in reversed(TIERS):
        out = F.when(n <= most, name).otherwise(out)
    return out


def strength_tier(s: Column) -> Column:
    return F.when(s >= 2, 3).when(s >= 1.2, 2).when(s >= 0.6, 1).otherwise(0)


def tick_budget(n: Column, m: Column, override: Column | None = None) -> Column:
    """Ticks that about six million steps allow, as a power of two from 8 to 64; 112 for graphs that need no limit.

    Without nodes there is nothing to lay out: 8. An override is taken as it is, 0 as well.
    """
    n, m = n.cast("double"), m.cast("double")
    share = F.try_divide(F.lit(WORK), n * F.log2(n + 1) + m)
    power = F.pow(F.lit(2.0), F.floor(F.log2(share)))
    earned = F.when((n <= 0) | (share <= MIN_TICKS), MIN_TICKS).when(share >= MAX_TICKS, MAX_TICKS).otherwise(F.least(F.lit(float(TOP_TICKS)), power).cast("int"))
    return F.coalesce(override, earned).cast("int") if override is not None else earned.cast("int")


def smoothstep(t: Column) -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t.cast("double")))
    return x * x * (3 - 2 * x)


def lod_mix(scale: Column, semantic: Column) -> Column:
    """struct<icon, card, sprite>: how far icons and cards have come in at a camera scale, and what is left of dots."""
    icon, card = smoothstep((scale - 0.45) / 0.35), smoothstep((scale - 1.9) / 0.7)  # fixed values: start and width of each
    some = lambda c, otherwise: F.when(semantic, c).otherwise(F.lit(otherwise))
    return F.struct(some(icon, 0.0).alias("icon"), some(card, 0.0).alias("card"), some(1 - card, 1.0).alias("sprite"))


def weight_to_radius(weight: Column, low: float, high: float) -> Column:
    return low + F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight)) * (high - low)


def radius_for(weight: Column, base: float = 4.0, gain: float = 2.5, low: float = 0.0, high: float = math.inf) -> Column:
    """The area grows in proportion to the weight, taken within 0 and 1; what is no number weighs nothing."""
    finite = F.when(weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < F.lit(math.inf)), weight).otherwise(F.lit(0.0))
    r = base * (1 + gain * F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), finite))))
    return F.least(F.lit(high), F.greatest(F.lit(low), r))


def hash_string(text: Column) -> Column:
    """A 31-fold hash of the UTF-16 units, a pair's first unit counted as the whole code point; kept as a long from 0.

    Each step multiplies in 32 bits and adds without wrapping, so the last sum may pass 2**31.
    """
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("c")))
    unit = lambda c, at: F.conv(F.hex(F.substring(F.encode(c, "UTF-16BE"), at, 2)), 16, 10).cast("long")

    def parts(p):
        c = p["c"]
        high, low = unit(c, 1), unit(c, 3)
        return F.when(F.octet_length(F.encode(c, "UTF-16BE")) == 4, F.array((high - 0xD800) * 0x400 + (low - 0xDC00) + 0x10000, low)).otherwise(F.array(high))

    def step(h, p):
        product = F.pmod(F.pmod(h, F.lit(1 << 32)) * 31, F.lit(1 << 32))
        return F.when(product >= 1 << 31, product - (1 << 32)).otherwise(product) + p

    return F.abs(F.aggregate(F.flatten(F.transform(points, parts)), F.lit(0).cast("long"), step))


def palette_of(key: Column, palette: list[str]) -> Column:
    """The colour of a key by its hash."""
    return F.get(F.array(*map(F.lit, palette)), F.pmod(hash_string(key), F.lit(len(palette))).cast("int"))


def edge_bucket(kind: Column) -> Column:
    """The drawing group of an edge: relations, tags, notes, hierarchy."""
    return F.when(kind == "tag", 1).when(kind.isin("note_of", "note_link"), 2).when(kind == "hierarchy", 3).otherwise(0)


def edge_width(bucket: Column, strength: Column, scale: float = 1.0) -> Column:
    base = F.get(F.array(*map(F.lit, (1.1, 0.7, 1.0, 2.0))), bucket)  # fixed values: width by bucket, then a step a tier
    return (base + strength_tier(strength) * 0.65) * scale


# The grammar of names.
SLUG, COLLECTION, RECORD = "^[a-z0-9][a-z0-9-]{0,62}$", "^[A-Za-z0-9_-]{1,64}$", "^[^:]+$"


def is_slug(name: Column) -> Column:
    return F.coalesce(name.rlike(SLUG), F.lit(False))


def is_collection(name: Column) -> Column:
    return F.coalesce(name.rlike(COLLECTION), F.lit(False))


def is_record_id(name: Column) -> Column:
    return F.coalesce(name.rlike(RECORD), F.lit(False))


def qualified(plugin: Column, collection: Column) -> Column:
    return F.concat_ws(".", plugin, collection)


def cursor(epoch: Column, seq: Column) -> Column:
    return F.concat_ws(".", epoch.cast("string"), seq.cast("string"))


def parse_cursor(text: Column) -> Column:
    """struct<epoch, seq>, or null if the text is no cursor."""
    parts = F.split(text, "[.]")
    return F.when(text.rlike("^[0-9]+[.][0-9]+$"), F.struct(parts[0].cast("long").alias("epoch"), parts[1].cast("long").alias("seq")))


def wire_time(at: Column) -> Column:
    """A timestamp in UTC to the millisecond, as it is sent (the session's time zone is UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def control_point(x0: Column, y0: Column, x1: Column, y1: Column, bend: float) -> Column:
    """struct<x, y>: off the chord's middle by bend times the chord, to its left."""
    return F.struct(((x0 + x1) / 2 - (y1 - y0) * bend).alias("x"), ((y0 + y1) / 2 + (x1 - x0) * bend).alias("y"))


def curve(x0: Column, y0: Column, control: Column, x1: Column, y1: Column, steps: int = 16) -> Column:
    """array<struct<x, y>> of steps + 1 points on a quadratic curve."""
    at = lambda t, a, b, c: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * b + t * t * c
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(at(i / steps, x0, control["x"], x1).alias("x"), at(i / steps, y0, control["y"], y1).alias("y")))


# What a range without width is widened by; floors of logarithms; the part of the ramp below the least
# positive value, in shares and in decades.
DEGENERATE, LOG_FLOOR, LOG_DECADES, LOG_RAMP, LOG_GAP = 1e-9, 1e-30, 1e-3, 0.1, 0.05


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))


def _tallied(df: DataFrame, value: str) -> DataFrame:
    """A row for each distinct value: ties, rows below and values below. Values, not rows, meet in ranges."""
    each = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__ties"))
    run = prefixes(each.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1)), "__all", "__v", {"__upto": "__ties", "__index": "__one"})
    return run.select("__v", "__ties", (F.col("__upto") - F.col("__ties")).alias("__below"), (F.col("__index") - 1).alias("__index"))


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Percentiles (0 to 100) of the finite values, interpolated between neighbours; NaN if there are none.

    Every value is counted and placed in parallel; the driver gets two values for each percentile.
    """
    v = F.col(value).cast("double")
    some = df.select(F.when(_finite(v), v).alias("__w"))
    n = some.filter("__w is not null").count()
    if not n:
        return [math.nan] * len(shares)
    tall, out = _tallied(some, "__w"), []
    at = [q / 100 * (n - 1) for q in shares]
    wanted = sorted({k for p in at for k in (math.floor(p), math.ceil(p))})
    held = F.explode(F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("__below")) & (k < F.col("__below") + F.col("__ties"))))
    found = {r["k"]: r["__v"] for r in tall.select("__v", held.alias("k")).collect()}
    for p in at:
        low, high, f = found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)
        out.append(high - (high - low) * (1 - f) if f >= 0.5 else low + (high - low) * f)
    return out


def normalise(df: DataFrame, value: str, mode: str = "LINEAR", gamma: float = 1.0, clip_low: float = 0, clip_high: float = 100, vmin: float | None = None, vmax: float | None = None, out: str = "t") -> DataFrame:
    """df with value scaled to 0..1: LINEAR, LOG, RANK (ties averaged) or QUANTILE (place among distinct values).

    Values are cut to the bounds: the range, percentiles of it if clipped, vmin and vmax where given. At the end
    1 / gamma is the power. What is not finite is NaN.
    """
    v = F.col(value).cast("double")
    v = F.when(_finite(v), v)
    if clip_low > 0 or clip_high < 100:
        lo, hi = percentiles(df, value, sorted(min(max(q, 0), 100) for q in (clip_low, clip_high)))
    else:
        lo, hi = df.agg(F.min(v), F.max(v)).first()
    lo, hi = vmin if vmin is not None else lo, vmax if vmax is not None else hi
    nan = F.lit(math.nan)
    if lo is None or hi is None or math.isnan(lo) or math.isnan(hi):
        return df.withColumn(out, nan)
    if hi == lo:
        hi = lo + DEGENERATE
    work = F.when(v.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), v)))
    if mode in ("RANK", "QUANTILE"):
        rows = df.withColumn("__work", work)
        each = _tallied(rows, "__work")
        n, distinct = each.agg(F.sum("__ties"), F.count("*")).first()
        by = max((n if mode == "RANK" else distinct) - 1, 1)
        t = (F.col("__below") + (F.col("__ties") - 1) / 2.0) / by if mode == "RANK" else F.col("__index") / by
        df = rows.join(each.select("__v", t.alias("__t")), rows["__work"] == each["__v"], "left").drop("__v", "__work")
        t = F.col("__t")
    elif mode == "LOG":
        least, other = df.agg(F.min(F.when(work > 0, work)), F.count_if(work <= 0)).first()
        if least is None:
            eps = LOG_FLOOR
        elif not other:
            eps = max(least * LOG_DECADES, LOG_FLOOR)
        else:
            span = math.log10(max(hi, least)) - math.log10(least)
            eps = max(least * 10 ** -max(span * LOG_RAMP / (1 - LOG_RAMP), LOG_GAP), LOG_FLOOR)
        a, b = math.log10(max(lo, eps)), math.log10(max(hi, eps))
        t = (F.log10(F.greatest(work, F.lit(eps))) - a) / ((b if b != a else a + DEGENERATE) - a)
        t = F.when(work.isNotNull(), t)
    else:
        t = (work - float(lo)) / float(hi - lo)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) if mode not in ("RANK", "QUANTILE") else t
    t = F.when(t.isNotNull(), t if gamma == 1 or not gamma > 0 or math.isinf(gamma) else F.pow(t, F.lit(1 / gamma))).otherwise(nan)
    return df.withColumn(out, F.when(v.isNotNull(), t).otherwise(nan)).drop("__t")


def sample_ramp(t: Column, stops: list[tuple[float, float, float]], missing: tuple[float, float, float] = (0.5, 0.5, 0.5)) -> Column:
    """struct<r, g, b> at t on a ramp of colours, between its stops in proportion; the missing colour for what is no number."""
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(s, "rgb", strict=True)]) for s in stops])
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 1)).cast("int")
    a, b = F.get(table, low), F.get(table, F.least(low + 1, F.lit(len(stops) - 1)))
    mixed = F.struct(*[(a[c] + (b[c] - a[c]) * (at - low)).alias(c) for c in "rgb"])
    return F.when(_finite(t), mixed).otherwise(F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(missing, "rgb", strict=True)]))


def snapped(df: DataFrame, t: str, most: int = 1024) -> DataFrame:
    """df with t on a grid of `most` places if it has more distinct values than that."""
    many = df.select(t).distinct().limit(most + 1).count() > most
    return df.withColumn(t, F.floor(F.col(t) * (most - 1) + 0.5) / (most - 1)) if many else df


def slots(df: DataFrame, key: str, order: str, most: int = 512, out: str = "slot") -> DataFrame:
    """The first-seen place of each key, from 0; keys past the last slot share it. Keys that are null have none."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    top = firsts.orderBy("__first").limit(most)
    placed = top.withColumn(out, F.row_number().over(Window.orderBy("__first")) - 1).drop("__first")
    return df.join(F.broadcast(placed), key, "left").withColumn(out, F.when(F.col(key).isNotNull(), F.coalesce(out, F.lit(most))))


def group_slots(df: DataFrame, group: str, order: str, most: int = 4096, none: str = "(no group)", others: str = "(other groups)") -> DataFrame:
    """df with slot and slot_name: groups by first appearance, a missing one named as such, those past the last as one."""
    named = df.withColumn("__g", F.coalesce(group, F.lit(none)))
    out = slots(named, "__g", order, most)
    return out.withColumn("slot_name", F.when(F.col("slot") == most, others).otherwise(F.col("__g"))).drop("__g")


def colour_key(by: str) -> Column:
    """The key that a categorical colouring goes by: group, kind, tag (the first) or db; others have one colour."""
    keys = {"group": F.col("group_label"), "kind": F.col("kind"), "tag": F.get(F.col("tags"), F.lit(0)), "db": F.col("database_id")}
    return F.coalesce(keys[by], F.lit("")) if by in keys else F.lit("")


def size_value(by: str) -> Column:
    """What a node's size goes by: weight or degree; others have one size."""
    return {"weight": F.col("weight").cast("double"), "degree": F.col("degree").cast("double")}.get(by, F.lit(1.0))


def legend(df: DataFrame, key: str = "slot") -> DataFrame:
    """(slot, n): the nodes of each slot of a colouring."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def cyclic(slot: Column, palette: list[str], most: int = 512, muted: str = "muted") -> Column:
    """The colour of a slot: the palette over and over, the overflow slot muted."""
    return F.when(slot >= most, muted).otherwise(F.get(F.array(*map(F.lit, palette)), (slot % len(palette)).cast("int")))
