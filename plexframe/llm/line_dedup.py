"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines chooses where a chunk ends, so an insertion moves
only the boundaries beside it. A line of more than LONG_WORDS words is a chunk of its own. Chunks of several
lines, or of one such long line, that occur again anywhere in the corpus are compared byte by byte with their
first occurrence and removed. `line_dedup` holds to that rule, as its SQL does.

A chunk that crosses the edge of a repeated passage differs in every copy, so chunks leave part of it. `line_runs`
does the whole job: it compares every two neighbouring lines, of which each chunk and each longer run is made, so
every run of lines that stood before goes, wherever its edges are. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, spare, without

#: A chunk ends after a line with probability 1 / DIVISOR.
DIVISOR = 3
LONG_WORDS = 50


def _let(name: str, value: str, body: str) -> str:
    """SQL for body, with the value computed once and called name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def chunks_of(text: str, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> str:
    """SQL for array<struct<k, n_lines, long, body>>: the bodies joined by line feeds are the text."""
    hashes = "transform(l, x -> cast(conv(substr(md5(x), 1, 8), 16, 10) as bigint))"
    big = f"transform(l, x -> length(x) - length(replace(x, ' ', '')) >= {long_words})"
    rolled = f"pmod(v.h[i] * 31 + if(i = 0, 0L, v.h[greatest(i - 1, 0)]), {divisor}) = 0"
    ends = f"filter(sequence(0, size(l) - 1), i -> i = size(l) - 1 or v.big[i] or v.big[least(i + 1, size(l) - 1)] or {rolled})"
    start = "if(k = 0, 0, e[greatest(k - 1, 0)] + 1)"
    chunk = f"named_struct('k', k, 'n_lines', z - {start} + 1, 'long', v.big[z] and {start} = z, 'body', array_join(slice(l, {start} + 1, z - {start} + 1), '\\n'))"
    inner = _let("v", f"named_struct('h', {hashes}, 'big', {big})", _let("e", ends, f"transform(e, (z, k) -> {chunk})"))
    return _let("l", f"split(coalesce({text}, ''), '\\n', -1)", inner)


def _repeats(spans: DataFrame, place: Column, scratch: Scratch) -> DataFrame:
    """Of spans (id, v, ..., body, h, len) those that are byte by byte equal to one at an earlier place.

    Hashes are combined before they shuffle. The two joins by hash end in a written table and in an exchange by
    document, so Spark can part the spans of a hot hash.
    """
    firsts = scratch.table(spans.groupBy("h", "len").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last"))
    again = scratch.table(spans.join(sized(firsts), ["h", "len"]))
    kept = scratch.table(again.filter(place == F.col("first")).groupBy("h", "len").agg(F.first("body").alias("kept_body")))
    return again.filter(place != F.col("first")).join(kept, ["h", "len"]).filter("body = kept_body")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with repeated chunks removed from the text column, and columns n_chunks, n_removed (longs) added.

    The occurrence with the smallest place stays: key, hash of the whole text, number in the text. A null text stays
    null and an empty one empty; rows with a null key take no part and keep their text; rows repeated with one key and
    text are one occurrence and are treated alike; rows with one key and other texts are documents of their own.
    Columns of docs named n_chunks or n_removed are replaced. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    docs = without(docs, "n_chunks", "n_removed")
    gone, key_of, hash_of, cut, made = (spare(docs, n) for n in ("__gone", "__id", "__v", "__c", "__r"))
    t = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.col(f"`{key}`").alias("id"), t.alias("t")).filter("id is not null and t is not null")
    able = (
        slim.select("id", F.xxhash64("t").alias("v"), F.inline(F.expr(chunks_of("t", divisor, long_words)))).filter("n_lines > 1 or long")
        .select("id", "v", "k", "body", F.xxhash64("body").alias("h"), F.octet_length("body").alias("len"))
    )
    same = _repeats(able, F.struct("id", "v", "k"), scratch)
    removed = scratch.table(same.groupBy(F.col("id").alias(key_of), F.col("v").alias(hash_of)).agg(F.collect_set("k").alias(gone)))

    joined = docs.join(sized(removed), (F.col(f"`{key}`") == F.col(key_of)) & (F.xxhash64(t) == F.col(hash_of)), "left")
    joined = joined.withColumn(cut, F.expr(chunks_of(f"`{text}`", divisor, long_words)))
    stay = F.expr(f"array_join(transform(filter({cut}, c -> not array_contains({gone}, c.k)), c -> c.body), '\\n')")
    out = joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.when(F.col(gone).isNotNull(), stay).otherwise(t).alias("t"), F.size(cut).alias("n"), F.coalesce(F.size(gone), F.lit(0)).alias("gone")).alias(made),
    )
    shown = [F.col(f"{made}.t").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns]
    count = F.when(t.isNull(), F.lit(0)).otherwise(F.col(f"{made}.n")).cast("long")
    return out.select(*shown, count.alias("n_chunks"), F.col(f"{made}.gone").cast("long").alias("n_removed"))


def spans_of(text: str, long_words: int = LONG_WORDS) -> str:
    """SQL for array<struct<a, b, body>>: two neighbouring lines with signs, and the blank ones between; long lines."""
    pair = "named_struct('a', z, 'b', w[j + 1], 'body', array_join(slice(l, z + 1, w[j + 1] - z + 1), '\\n'))"
    long = f"filter(w, i -> length(l[i]) - length(replace(l[i], ' ', '')) >= {long_words})"
    both = f"concat(transform(slice(w, 1, greatest(size(w) - 1, 0)), (z, j) -> {pair}), transform({long}, i -> named_struct('a', i, 'b', i, 'body', l[i])))"
    inner = _let("w", "filter(sequence(0, size(l) - 1), i -> l[i] rlike '\\\\S')", both)
    return _let("l", f"split({text}, '\\n', -1)", inner)


def line_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """docs with every repeated run of lines removed from the text column; n_lines, n_removed (longs) added.

    A run is two or more lines with signs in them (and the blank ones between), or one line of more than long_words
    words, that stood before in the order of (key, line), here or in another document. A line never goes at its own
    first place, so no line is lost to the corpus. A null text stays null and an empty one empty; rows with a null
    key take no part; rows repeated with one key and text are one occurrence. Columns of docs named n_lines or
    n_removed are replaced. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession)
    docs = without(docs, "n_lines", "n_removed")
    gone, key_of, hash_of = (spare(docs, n) for n in ("__gone", "__id", "__v"))
    t = F.col(f"`{text}`").cast("string")
    slim = docs.select(F.col(f"`{key}`").alias("id"), t.alias("t")).filter("id is not null and t is not null")
    spans = (
        slim.select("id", F.xxhash64("t").alias("v"), F.inline(F.expr(spans_of("t", long_words))))
        .select("id", "v", "a", "b", "body", F.xxhash64("body").alias("h"), F.octet_length("body").alias("len"))
    )
    same = _repeats(spans, F.struct("id", "v", "a"), scratch)
    lines = F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "b"))))
    removed = scratch.table(same.groupBy(F.col("id").alias(key_of), F.col("v").alias(hash_of)).agg(lines.alias(gone)))

    joined = docs.join(sized(removed), (F.col(f"`{key}`") == F.col(key_of)) & (F.xxhash64(t) == F.col(hash_of)), "left")
    stay = F.expr(_let("l", f"split(cast(`{text}` as string), '\\n', -1)", f"array_join(transform(array_except(sequence(0, size(l) - 1), {gone}), i -> l[i]), '\\n')"))
    shown = [F.when(F.col(gone).isNotNull(), stay).otherwise(t).alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in docs.columns]
    n = F.when(t.isNull(), 0).otherwise(F.size(F.split(t, "\n", -1))).cast("long")
    return joined.select(*shown, n.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
