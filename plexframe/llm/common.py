"""What the corpus operators share: tables in the shared folder, size-checked broadcasts, column guards."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of narrow rows is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

#: Bytes of rows that move to a Python worker at once.
ARROW_BYTES = 1 << 20

#: A table of rows of any width is broadcast up to so many bytes of its files as well.
BROADCAST_BYTES = 8 << 20

_own_folder: str | None = None
_opened: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir.

    Where it is unset, a temporary folder will do in local mode only: other machines would each see their own.
    """
    global _own_folder
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="plexframe-")
    return _own_folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Scratch:
    """Tables written to the shared folder, to cut lineage in a way that outlives any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        _opened.append(self)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        at, path = file_system(self.spark, df._scratch)
        at.delete(path, True)


@contextmanager
def fleeting() -> Iterator[None]:
    """Deletes, at its end, the scratch tables that operators opened inside: their results are written by then."""
    before = len(_opened)
    try:
        yield
    finally:
        while len(_opened) > before:
            gone = _opened.pop()
            at, path = file_system(gone.spark, gone.root)
            at.delete(path, True)


def sized(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table of a Scratch, marked for broadcast if it has at most so many rows and bytes; else left to a shuffled join."""
    at, path = file_system(table.sparkSession, table._scratch)
    small = at.getContentSummary(path).getLength() <= size and table.count() <= rows
    return F.broadcast(table) if small else table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns whose names (in any case) an operator is about to produce."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def spare(df: DataFrame, name: str) -> str:
    """A column name, made from this one, that df does not have in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_keys(docs: DataFrame, key: str, lost: DataFrame) -> DataFrame:
    """docs less the rows whose key is in lost, a table of one column. Rows with a null key stay."""
    name = spare(docs, "__lost")
    lost = Scratch(docs.sparkSession).table(lost.toDF(name).distinct())
    return docs.join(sized(lost), F.col(f"`{key}`") == F.col(name), "left_anti")


def _bounded(spark: SparkSession) -> None:
    """Batches of at most ARROW_BYTES (one row at least), whatever the length of the texts.

    Spark takes the bound from the session when it runs the plan, so the session keeps it; a smaller one stays.
    """
    stated = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(stated)
    if not 0 < have <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow in bounded batches; the worker gives memory back at the end of a task."""
    _bounded(df.sparkSession)
    return df.mapInArrow(_tidied(run), schema)


def group_arrow(df: DataFrame, by: list[str], run: Callable, schema) -> DataFrame:
    """df.groupBy(by).applyInArrow in bounded batches; the worker gives memory back after each group."""
    _bounded(df.sparkSession)

    def one(group, table):
        out = run(group, table)
        del table
        give_back()
        return out

    return df.groupBy(*by).applyInArrow(one, schema)


def give_back() -> None:
    """Return freed memory to the system: workers are kept between tasks and stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def _tidied(run: Callable) -> Callable:
    """run, and then the worker gives freed memory back, also if the task fails or is cut short."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
