"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level is a narrow aggregate; a row goes to the next level only if its group still has company, so the
full text is hashed for survivors alone and no text is ever shuffled. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

#: The characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """One narrow row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Of equal texts (equal after deleting blanks) the row with the most code points stays, then the smallest key.
    A null text counts as empty; empty texts are equal to each other. Null keys sort before all others. Rows
    repeated with one key share their decision, and each counts in group_size. Other columns of docs are not
    read, whatever their names. An empty table gives an empty result. text_sha256 is null for texts that no
    level needed to hash, unless digest_all asks for all of them.
    """
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = src.select("k", F.coalesce(F.char_length("t"), F.lit(0)).alias("points"), normalised(F.col("t")).alias("norm"))
    rows = rows.withColumn("len", F.octet_length("norm"))

    lengths = scratch.table(rows.groupBy("len").count().filter("count > 1").select("len"))
    by_length = rows.join(sized(lengths), "len", "left_semi")

    prefix = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix")
    prefixes = scratch.table(by_length.select("len", prefix).groupBy("len", "prefix").count().filter("count > 1").select("len", "prefix"))
    known = sized(prefixes).withColumn("again", F.lit(True))
    narrow = rows.select("*", prefix).join(known, ["len", "prefix"], "left")
    need = F.lit(True) if digest_all else F.col("again")
    hashed = narrow.select("k", "points", F.col("again").isNotNull().alias("again"), F.when(need, F.sha2("norm", 256)).alias("text_sha256"))

    groups = scratch.table(
        hashed.filter("again").groupBy(F.col("text_sha256").alias("full"))
        .agg(F.count("*").alias("n"), F.min(F.struct((-F.col("points")).alias("p"), F.col("k").alias("k"))).alias("best"))
        .filter("n > 1").select("full", "n", F.col("best.k").alias("keep"))
    )
    # rows without a hash get a key of their own, so they spread evenly
    at = F.coalesce(F.col("text_sha256"), F.col("k").cast("string"), F.lit(""))
    out = hashed.withColumn("at", at).join(groups, F.col("at") == F.col("full"), "left")
    keep = F.when(F.col("n").isNotNull(), F.col("keep")).otherwise(F.col("k"))
    return out.select(
        F.col("k").alias(key), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("k")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less the rows whose text another row keeps, by key and text. Rows with a null key stay."""
    lost = exact_dedup(docs, key, text).filter("not kept").select(F.col(f"`{key}`").alias("__lost"), F.col("text_sha256").alias("__sha")).distinct()
    own = F.sha2(normalised(F.col(f"`{text}`").cast("string")), 256)
    return docs.join(lost, (F.col(f"`{key}`") == F.col("__lost")) & (own == F.col("__sha")), "left_anti")


__all__ = ["drop_copies", "exact_dedup", "normalised"]
