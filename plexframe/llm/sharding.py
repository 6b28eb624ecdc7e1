"""Sharding by a two-pass external shuffle.

Pass one scatters the records with seeded hashes: rendezvous hashing of the key chooses the shard, a hash of
the whole row chooses one of the shard's memory-sized buckets. Pass two holds one bucket at a time, Fisher-Yates
shuffles it and writes it. A shard is its buckets in order; a record's slot is its place in its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, group_arrow, spare, utf8_bytes, without

#: Bytes of text in a bucket, on average; a task holds one bucket.
BUCKET_BYTES = 4 << 20


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard whose seeded hash of the key is largest: one more shard takes rows only into itself."""
    hashes = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(n_shards)]
    return F.array_max(F.array(*hashes))["i"]


def _fisher_yates(seed: int, hashed: str, base: str):
    def run(group, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bucket = group[0].as_py()
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        # one order whatever the arrival, so that a recomputed bucket is the same bucket
        place = pc.sort_indices(table.column(hashed)).to_numpy().copy()
        rng.shuffle(place)  # Fisher-Yates, in place
        slot = table.column(base)[0].as_py() + np.arange(table.num_rows)
        out = table.drop_columns([base, hashed]).combine_chunks().take(pa.array(place))
        return out.append_column("slot", pa.array(slot, pa.int64()))

    return run


def shard_shuffle(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 20177, bucket_bytes: int = BUCKET_BYTES, salt: Column | None = None) -> DataFrame:
    """docs with size, shard, bucket (ints) and slot (long): a uniformly shuffled, seeded order inside each shard.

    Law `key`: key and n_shards alone choose the shard. A null text has size 1; null keys go to one shard like any
    other value. A shard has as many buckets as its bytes ask for; the bucket depends on all columns and on salt
    (say, the position in the source file), so a repeated key is spread over its shard's buckets, and with a salt
    equal rows are too. The order does not depend on the partitions of docs: rows that tie are equal in all columns
    and in salt. Repeated rows each get a slot. Columns of docs with the names produced are replaced. An empty table
    gives an empty result. The result is written, as the second pass asks, and read again.
    """
    spark = docs.sparkSession
    docs = without(docs, "size", "shard", "bucket", "slot")
    hashed, base = spare(docs, "__h"), spare(docs, "__base")
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    whole = [F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in docs.schema.fields]
    h = F.xxhash64(F.lit(seed + 1), *whole, *([] if salt is None else [salt]))
    rows = docs.withColumn(hashed, h).withColumn("size", utf8_bytes(t) + 1).withColumn("shard", rendezvous(k, n_shards, seed))
    sizes = rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()  # n_shards rows
    many = [1] * n_shards
    for r in sizes:
        many[r["shard"]] += r["n"] // bucket_bytes
    first = [sum(many[:i]) for i in range(n_shards)]
    plan = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(n).alias("many")) for a, n in zip(first, many, strict=True)])[F.col("shard")]
    rows = rows.withColumn("bucket", (plan["first"] + F.pmod(hashed, plan["many"])).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = Scratch(spark).table(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias(base)))
    # a row for each bucket of some MB: a small table, if not, a shuffled join by an even key
    placed = rows.join(bases, "bucket").select(*[f"`{c}`" for c in rows.columns], base)
    schema = T.StructType([*[f for f in placed.schema.fields if f.name not in (base, hashed)], T.StructField("slot", T.LongType())])
    return Scratch(spark).table(group_arrow(placed, ["bucket"], _fisher_yates(seed, hashed, base), schema))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the result of shard_shuffle as folders shard=N; each file holds buckets in slot order."""
    shuffled.repartition("bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
