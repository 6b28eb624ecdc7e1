"""The ordered change log: what is current, what a page holds, what is kept, and a streaming sink that applies batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexframe.sources.tables import dense, prefixes


def latest(ops: DataFrame) -> DataFrame:
    """Of ops (ws, collection, id, seq, op, text) the current records: the last op of each, if it is no delete."""
    last = ops.groupBy("ws", "collection", "id").agg(F.max_by(F.struct("op", "text", "seq"), "seq").alias("o"))
    return last.select("ws", "collection", "id", "o.*").filter("op != 'delete'").drop("op")


def revisions(ops: DataFrame) -> DataFrame:
    """rev of each op that changes something: an upsert with the text already stored, or a delete of nothing, does not."""
    w = Window.partitionBy("ws", "collection", "id").orderBy("seq")
    text = F.when(F.col("op") != "delete", F.col("text"))
    told = ops.withColumn("__text", text).withColumn("__before", F.lag("__text").over(w))
    real = told.filter(~F.col("__text").eqNullSafe(F.col("__before"))).drop("__before")
    return real.withColumn("rev", F.row_number().over(w)).drop("__text")


def retention_cut(headers: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(ws, cut): the largest seq to go, so that at most so many of the newest changes and bytes stay."""
    one = headers.select("ws", (-F.col("seq")).alias("back"), "bytes", F.lit(1).alias("one"))
    run = prefixes(one, "ws", "back", {"n": "one", "b": "bytes"})
    return run.filter((F.col("n") > most) | (F.col("b") > most_bytes)).groupBy("ws").agg((-F.min("back")).alias("cut"))


def change_page(headers: DataFrame, since: int, limit: int, most_bytes: int) -> DataFrame:
    """For each ws the next changes after `since`, by count and bytes, at least one."""
    run = prefixes(headers.filter(F.col("seq") > since).withColumn("__one", F.lit(1)), "ws", "seq", {"__n": "__one", "__b": "bytes"})
    return run.filter((F.col("__n") == 1) | ((F.col("__n") <= limit) & (F.col("__b") <= most_bytes))).drop("__n", "__b", "__one")


def record_page(records: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """The next `limit` records (collection, id, ...) behind the key `after`, in the order of their keys."""
    rest = records
    if after is not None:
        c, i = map(F.lit, after)
        rest = records.filter((F.col("collection") > c) | ((F.col("collection") == c) & (F.col("id") > i)))
    return rest.orderBy("collection", "id").limit(limit)


def sync_ops(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """What makes stored (collection, id, text) into wanted: upserts of new or changed records, deletes of others.

    (collection, id, op, text, rev): rev is the record's next revision, one above the stored one or 1. A record whose
    text is the same needs nothing.
    """
    old = stored.select("collection", "id", F.col("text").alias("__old"), F.col("rev").alias("__rev"))
    both = old.join(wanted.select("collection", "id", "text", F.lit(True).alias("__wanted")), ["collection", "id"], "full_outer")
    op = F.when(F.col("__wanted").isNull(), "delete").when(F.col("__rev").isNull() | ~F.col("text").eqNullSafe(F.col("__old")), "upsert")
    return both.select("collection", "id", op.alias("op"), "text", (F.coalesce("__rev", F.lit(0)) + 1).cast("long").alias("rev")).filter("op is not null")


def batch_refusals(batch: DataFrame, most_ops: int) -> DataFrame:
    """(rule, collection, id) for which a batch (collection, id, op) is refused as a whole: keys named twice, too many."""
    twice = batch.groupBy("collection", "id").count().filter("count > 1").select(F.lit("named_twice").alias("rule"), "collection", "id")
    many = batch.agg(F.count("*").alias("n")).filter(F.col("n") > most_ops)
    return twice.union(many.select(F.lit("too_many"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def chunked(ops: DataFrame, most: int) -> DataFrame:
    """ops (collection, id, ...) in their canonical order, by (id, collection), with the number of the batch of `most` ops they go in."""
    by = dense(ops.withColumn("__by", F.struct("id", "collection")), "__by", "ord")
    return by.drop("__by").withColumn("batch", F.floor(F.col("ord") / most).cast("long"))


def accounting(records: DataFrame, text: str = "text") -> DataFrame:
    """(ws, records, bytes) of what each workspace stores."""
    return records.groupBy("ws").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))


def cursor_state(epoch: Column, seq: Column, at_epoch: Column, low: Column, head: Column) -> Column:
    return F.when((epoch == at_epoch) & (seq + 1 >= low) & (seq <= head), "valid").otherwise("gone")


def apply_stream(batches: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends a stream of ops to folder, each micro-batch once: a repeated batch overwrites itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return batches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
