"""Jaccard join of documents by their word n-grams, as a size-aware heavy-light join.

Documents with one set are one class. Sets meet in lists: a set above the size boundary enters the inverted
lists of the tokens of its prefix, a set below it enters a list for every two-element subset of its (one
longer) prefix, and sets close above the boundary enter both. The boundary is where enumerating subsets costs
as much as scanning lists. Any token order gives exact prefixes; here tokens that are frequent come last, so
that lists stay short.

No list is expanded into all its pairs. First every member meets its list's first member; what links is one
component. Then only members of different components of a list meet, in bands of like size and blocks of a
bounded number of members, so a hot list is spread over many tasks; each pair is bounded by sizes and by
512-bit parity maps before it becomes a row. Parity maps of as many bits as a set has tokens then part most
pairs without moving sets; every pair left is checked exactly on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, drop_keys, map_arrow, sized

#: Bytes of text whose shingles are computed at once.
PIECE_BYTES = 1 << 19
#: A token counts as frequent from this many sets on; the number doubles until at most HEAVY_TOKENS remain.
HEAVY_FROM = 8
HEAVY_TOKENS = 500_000
#: A batch reports tokens that it holds in so many sets.
LOCAL_FROM = 2
MAP_WORDS = 8
#: Members of a list that one task compares with as many others, about.
LIST_BLOCK = 4096
#: Of the lists that a set is in, the least ones that tell whether a pair has met before.
LEAST_LISTS = 16

_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M2)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int):
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(texts: list[bytes], k: int) -> list:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    import numpy as np

    with np.errstate(over="ignore"):
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        empty = np.zeros(0, np.int64)
        if not len(data):
            return [empty] * len(texts)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        ends = np.cumsum(sizes)
        gap = blank[data]
        fresh = np.zeros(len(data) + 1, bool)  # a text begins here
        fresh[np.concatenate(([0], ends))] = True
        solid = ~gap
        starts = np.flatnonzero(solid & (np.concatenate(([True], gap[:-1])) | fresh[:-1]))
        stops = np.flatnonzero(solid & (np.concatenate((gap[1:], [True])) | fresh[1:])) + 1
        base = 0x100000001B3
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * _powers(len(data), base))))
        inverse = _powers(len(data), pow(base, -1, 1 << 64))
        words = _mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        first = np.concatenate(([0], np.searchsorted(starts, ends)))
        c = np.uint64(_M1)
        joined = words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            joined = joined * c + words[j : j + len(joined)]
        joined = _mix(joined)
        out = []
        for i in range(len(texts)):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                out.append(np.unique(joined[a : b - k + 1].view(np.int64)))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * c + w
                out.append(_mix(np.array([h])).view(np.int64))
            else:
                out.append(empty)
        return out


def _pieces(batches: Iterator, k: int) -> Iterator[tuple[list, list]]:
    """(keys, sets) of the rows (k, t) of Arrow batches, a bounded number of bytes at once."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        i = 0
        while i < len(keys):
            part, held = [], 0
            while i + len(part) < len(keys) and held < PIECE_BYTES:
                part.append((texts[i + len(part)].as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(part[-1])
            yield keys[i : i + len(part)], shingles(part, k)
            i += len(part)


def _fingerprint(s) -> tuple[int, int]:
    import numpy as np

    with np.errstate(over="ignore"):
        u = s.view(np.uint64)
        return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (_mix(u + np.uint64(_M1)), _mix(u ^ np.uint64(_M2))))


def _surveyor(k: int):
    """A row for each document: its set's size and 128-bit fingerprint; and rows for tokens that recur."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def tokens(held: list):
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_FROM
            m = int(often.sum())
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_pydict({"key": none, "n": none, "a": values[often], "b": counts[often].astype(np.int64)})

        held, size, seen = [], 0, set()
        for keys, sets in _pieces(batches, k):
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "a": pa.array([p[0] for p in prints], pa.int64()), "b": pa.array([p[1] for p in prints], pa.int64())})
            for s, p in zip(sets, prints, strict=True):
                if p not in seen:
                    seen.add(p)
                    held.append(s)
                    size += len(s)
            if size > 1_500_000:
                yield tokens(held)
                held, size, seen = [], 0, set()
        if held:
            yield tokens(held)

    return run


def least_overlap(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any set that it may link with."""
    return -(-n * num // den)


def boundary(scan: float, num: int, den: int) -> int:
    """The largest set for which enumerating pairs of its prefix costs no more than scanning its lists.

    p prefix tokens cost p (1 + scan) to enter and scan lists of mean length `scan`; their pairs, with one more
    token, cost p (p + 1) / 2 to enter, with lists next to empty.
    """
    n = 2
    while True:
        p = (n + 1) - least_overlap(n + 1, num, den) + 1
        if (p + 1) / 2 > 1 + scan:
            return n
        n += 1


def _entries(k: int, num: int, den: int, bound: int, heavy):
    """key, n, lists array<long>, and two parity maps, for each document with a set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, often = heavy.value
        upper = bound * den // num  # sets up to here may link with one below the boundary
        for keys, sets in _pieces(batches, k):
            rows: dict[str, list] = {"key": [], "n": [], "lists": []}
            maps, wides = [], []
            for key, s in zip(keys, sets, strict=True):
                n = len(s)
                if not n or key is None:
                    continue
                if len(known):
                    mixed = _mix(s.view(np.uint64) + np.uint64(1)).view(np.int64)
                    at = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
                    is_heavy = known[at] == mixed
                    late = np.flatnonzero(is_heavy)
                    order = np.concatenate((s[~is_heavy], s[late[np.argsort(often[at[late]], kind="stable")]]))
                else:
                    order = s
                p = n - least_overlap(n, num, den) + 1
                lists = []
                with np.errstate(over="ignore"):
                    if n > bound:
                        lists.append(_mix(order[:p].view(np.uint64) + np.uint64(1)).view(np.int64))
                    if n <= upper and n > 1:
                        u = _mix(order[: p + 1].view(np.uint64) + np.uint64(2))
                        i, j = np.triu_indices(len(u), 1)
                        low, high = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
                        lists.append(_mix(low * np.uint64(_M1) + high).view(np.int64))
                rows["key"].append(key)
                rows["n"].append(n)
                rows["lists"].append(np.concatenate(lists) if lists else np.zeros(0, np.int64))
                bits = (np.bincount(s & (64 * MAP_WORDS - 1), minlength=64 * MAP_WORDS) & 1).astype(np.uint8)
                maps.append(np.packbits(bits).view(np.int64))
                width = max(64, 1 << (n - 1).bit_length())
                bits = (np.bincount(s & (width - 1), minlength=width) & 1).astype(np.uint8)
                wides.append(np.packbits(bits).view(np.int64))
            if not maps:
                continue
            table = np.stack(maps)
            arrays = {"key": pa.array(rows["key"], pa.int64()), "n": pa.array(rows["n"], pa.int64())}
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows["lists"]]))).astype(np.int32)
            arrays["lists"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows["lists"])))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in wides]))).astype(np.int32)
            arrays["wide"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(wides)))
            yield pa.RecordBatch.from_pydict(arrays | {f"m{i}": pa.array(table[:, i].copy()) for i in range(MAP_WORDS)})

    return run


def _whole(k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for keys, sets in _pieces(batches, k):
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "tokens": lists})

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, component) for the ends of links (x, y): the smallest key that is reachable.

    Rounds of least labels over links and one jump along labels; each round is a written table.
    """
    both = scratch.table(links.select("x", "y").union(links.select("y", "x")).distinct())
    labels = scratch.table(both.groupBy(F.col("x").alias("key")).agg(F.least(F.col("key"), F.min("y")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("key").alias("x"), "component"), "x").groupBy(F.col("y").alias("key")).agg(F.min("component").alias("near"))
        nearer = labels.join(near, "key").select("key", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("key").alias("near"), F.col("component").alias("far"))
        new = scratch.table(nearer.join(jump, "near").select("key", F.col("component").alias("old"), "far"))
        changed = new.filter("old != far").limit(1).count()
        scratch.drop(labels)
        labels = new.select("key", F.col("far").alias("component"))
        labels._scratch = new._scratch
        if not changed:
            return labels


def _first_heavy(counts: DataFrame, count: str) -> int:
    """The least power of two, HEAVY_FROM at least, that at most HEAVY_TOKENS rows reach."""
    levels = {r["l"]: r["n"] for r in counts.groupBy(F.floor(F.log2(count)).cast("int").alias("l")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    l = HEAVY_FROM.bit_length() - 1
    while sum(n for at, n in levels.items() if at >= l) > HEAVY_TOKENS:
        l += 1
    return 1 << l


def _blocks(rows: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """rows (list, key, n, ...) twice, with `at`: those that may link and share a list meet at exactly one place.

    A place is a list, two bands of sizes side by side and a block of each band. Sizes of sets that link differ by
    den / num at most, so by less than a band.
    """
    rows = rows.withColumn("band", F.floor(F.log("n") / (1.001 * math.log(den / num))).cast("int"))
    many = rows.groupBy("list", "band").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("b"))
    beside = lambda d, name: many.select("list", (F.col("band") + d).alias("band"), F.col("b").alias(name))
    many = scratch.table(many.join(beside(-1, "up"), ["list", "band"], "left").join(beside(1, "down"), ["list", "band"], "left"))
    rows = rows.join(sized(many), ["list", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("b")).cast("int"))
    kept = [c for c in rows.columns if c not in ("band", "b", "up", "down", "block")]
    place = "named_struct('list', list, 'u', {u}, 'v', {v}, 'i', {i}, 'j', {j})"
    x = f"""concat(transform(sequence(block, b - 1), j -> {place.format(u="band", v="band", i="block", j="j")}),
        if(up is null, array(), transform(sequence(0, up - 1), j -> {place.format(u="band", v="band + 1", i="block", j="j")})))"""
    y = f"""concat(transform(sequence(0, block), i -> {place.format(u="band", v="band", i="i", j="block")}),
        if(down is null, array(), transform(sequence(0, down - 1), i -> {place.format(u="band - 1", v="band", i="i", j="block")})))"""
    return tuple(rows.select(*kept, F.explode(F.expr(e)).alias("at")) for e in (x, y))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets; component_id is the
    smallest key reachable by links. A text that is null, empty or without words has no set and links with
    nothing. A row with a null key links with nothing and has a null component. Rows repeated with one key are one
    document and share its component; if their texts differ, the text with the least hash (xxhash64, as signed) makes
    the links, and n_shingles is each row's own. Other columns are not read. An empty table stays empty.
    """
    import numpy as np

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("t"))

    def surveyed(rows: DataFrame) -> DataFrame:
        return scratch.table(map_arrow(rows, _surveyor(k), "key long, n long, a long, b long"))

    survey = surveyed(slim)
    every = survey.filter("n is not null")
    told = slim.filter("key is not null").groupBy("key").agg(F.min(F.xxhash64("t")).alias("low"), F.max(F.xxhash64("t")).alias("high"))
    told = scratch.table(told.filter("low != high").select("key", "low"))
    if told.limit(1).count():
        slim = slim.join(sized(told), "key", "left").filter("low is null or xxhash64(t) = low").select("key", "t")
        survey = surveyed(slim)
    sets = survey.filter("n is not null")
    counts = scratch.table(survey.filter("n is null").groupBy("a").agg(F.sum("b").alias("df")).filter(F.col("df") >= HEAVY_FROM))
    found = counts.filter(F.col("df") >= _first_heavy(counts, "df")).toPandas()  # at most HEAVY_TOKENS rows
    with np.errstate(over="ignore"):
        known = _mix(found["a"].to_numpy(np.int64).view(np.uint64) + np.uint64(1)).view(np.int64)
    often = found["df"].to_numpy(np.int64)

    def last(known, often):
        order = np.argsort(known, kind="stable")
        return spark.sparkContext.broadcast((known[order], often[order]))

    # an inverted list's mean length, if all tokens that recur were looked up
    scan = math.log2(2 + float(found["df"].mean() if len(found) else 0))
    bound = boundary(scan, num, den)

    classes = sets.filter("n > 0 and key is not null").groupBy("n", "a", "b").agg(F.min("key").alias("rep"), F.count("*").alias("c"))
    classes = scratch.table(classes.filter("c > 1").drop("c"))
    copies = scratch.table(sets.join(sized(classes), ["n", "a", "b"]).filter("key != rep").select("key", "rep").distinct())
    maps = [f"m{i}" for i in range(MAP_WORDS)]
    schema = "key long, n long, lists array<long>, wide array<long>, " + ", ".join(f"{m} long" for m in maps)

    def enter(heavy) -> DataFrame:
        return map_arrow(slim, _entries(k, num, den, bound, heavy), schema).join(sized(copies), "key", "left_anti")

    # the survey misses tokens that recur thinly; the lists they make are counted, and those tokens come last too
    first = enter(last(known, often)).select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("c"))
    first = scratch.table(first.filter(F.col("c") >= HEAVY_FROM))
    long = first.filter(F.col("c") >= _first_heavy(first, "c")).toPandas()  # at most HEAVY_TOKENS rows
    fresh = ~np.isin(long["list"].to_numpy(np.int64), known)
    known = np.concatenate((known, long["list"].to_numpy(np.int64)[fresh]))
    often = np.concatenate((often, long["c"].to_numpy(np.int64)[fresh]))
    entries = scratch.table(enter(last(known, often)))
    info = entries.select("key", "n", *maps)

    posted = entries.select("key", F.explode("lists").alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("c"), F.min("key").alias("first")).filter("c > 1")
    shared = scratch.table(shared)
    members = scratch.table(posted.join(shared, "list").filter("c > 1"))

    def near(x: str, y: str):
        """Bounds that a pair has to meet: sizes, and bits in which the parity maps differ."""
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        differ = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in maps), F.lit(0))
        overlap = F.ceil((nx + ny) * num / (num + den) - F.lit(1e-9))
        return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (differ <= nx + ny - 2 * overlap)

    def linked(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (x, y) those that link, by their whole sets. Each join ends in a written table, so Spark can part a hot x."""
        pairs = scratch.table(pairs)
        x, y = (entries.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}")) for c in "xy")
        both = pairs.join(y, "y").join(x, "x")
        for c, other in ("xy", "yx"):  # maps of different widths: the wider one is folded
            half = f"cast(size(w{c}) / 2 as int)"
            folded = f"zip_with(slice(w{c}, 1, {half}), slice(w{c}, {half} + 1, {half}), (a, b) -> a ^ b)"
            both = both.withColumn(f"w{c}", F.expr(f"if(size(w{c}) > size(w{other}), {folded}, w{c})"))
        differ = F.expr("aggregate(zip_with(wx, wy, (a, b) -> bit_count(a ^ b)), 0, (s, v) -> s + v)")
        overlap = F.ceil((F.col("nx") + F.col("ny")) * num / (num + den) - F.lit(1e-9))
        pairs = scratch.table(both.filter(differ <= F.col("nx") + F.col("ny") - 2 * overlap).select("x", "y"))
        ids = scratch.table(pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct())
        whole = map_arrow(slim.join(sized(ids), "key", "left_semi"), _whole(k), "key long, tokens array<long>")
        whole = scratch.table(whole.dropDuplicates(["key"]))
        x, y = (whole.select(F.col("key").alias(c), F.col("tokens").alias(f"t{c}")) for c in "xy")
        met = pairs.join(y, "y").join(x, "x")
        met = met.withColumn("both", F.size(F.array_intersect("tx", "ty")))
        return scratch.table(met.filter(F.col("both") * (num + den) >= (F.size("tx") + F.size("ty")) * num).select("x", "y"))

    pairs = members.filter("key != first").select(F.col("first").alias("x"), F.col("key").alias("y")).distinct()
    at = lambda c: info.select(*[F.col(v).alias(f"{c}_{v}") for v in ("key", "n", *maps)]).select(F.col(f"{c}_key").alias(c), F.struct(*[F.col(f"{c}_{v}").alias(v) for v in ("n", *maps)]).alias(f"i{c}"))
    links = linked(pairs.join(at("y"), "y").join(at("x"), "x").filter(near("ix", "iy")).select("x", "y"))
    labels = components(links, scratch)

    own = info.join(sized(labels), "key", "left").select("key", "n", *maps, F.coalesce("component", "key").alias("component"))
    wide = members.filter("c > 2").join(own.select("key", "component"), "key")
    mixed = wide.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    mixed = scratch.table(mixed.select("list"))
    rest = scratch.table(members.filter("c > 2 and key != first").join(mixed, "list").join(own, "key").drop("first", "c"))
    # a pair meets in every list that both are in; it counts where no smaller one, of each set's least few, is shared
    least = rest.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("list")), 1, LEAST_LISTS).alias("few"))
    x, y = (r.alias(c) for r, c in zip(_blocks(rest.join(least, "key"), scratch, num, den), "xy", strict=True))
    once = (F.col("x.at.u") < F.col("x.at.v")) | (F.col("x.at.i") < F.col("x.at.j")) | (F.col("x.key") < F.col("y.key"))
    fresh = F.coalesce(F.array_min(F.array_intersect("x.few", "y.few")) >= F.col("x.list"), F.lit(True))
    apart = (F.col("x.at") == F.col("y.at")) & once & (F.col("x.component") != F.col("y.component"))
    late = x.join(y, apart & near("x", "y") & fresh).select(F.least("x.key", "y.key").alias("x"), F.greatest("x.key", "y.key").alias("y")).distinct()
    more = linked(late)
    if more.limit(1).count():
        labels = components(links.union(more), scratch)

    out = every.join(sized(copies), "key", "left").withColumn("at", F.coalesce("rep", "key"))
    out = out.join(sized(labels).withColumnRenamed("key", "at"), "at", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "at").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs less those whose component has a smaller key. Rows with a null key stay."""
    found = jaccard_components(docs, key, text, k, num, den)
    return drop_keys(docs, key, found.filter(F.col("component_id") != F.col(f"`{key}`")).select(f"`{key}`"))
