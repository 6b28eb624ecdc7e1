"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader deals out byte ranges of the files: a task looks for gzip
magic in its range, accepts a place if a WARC header decodes there and the member ends at another member or
at the end of the file, and owns the records that start inside its range, reading past its end for the last.
From its first record on, records follow each other without a gap. The owner of a range's last record also decodes
the member behind it, and the first range of a file has to begin with one, so no damaged member goes unseen.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, sized, utf8_bytes

MAGIC = b"\x1f\x8b\x08"
#: Bytes of payload from which equal payloads are stored once.
REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 20
#: Tasks that one read is dealt over at most.
TASKS = 50_000
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long"


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least `least` bytes that with the largest key is the response and the others revisit
    it. A null payload is empty. Rows with a null key are always responses. Rows repeated with the largest key
    are all responses. A missing url column gives null urls; other columns are ignored.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), url.alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_bytes", utf8_bytes(F.col("payload"))).withColumn("payload_digest", F.sha1("payload"))
    groups = (
        rows.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("main"))
        .filter("n > 1").drop("n")
    )
    groups = Scratch(pages.sparkSession).table(groups)
    out = rows.join(sized(groups), ["payload_digest", "payload_bytes"], "left")
    again = F.col("main").isNotNull() & (F.col("page_id") != F.col("main"))
    kind = F.when(F.coalesce(again, F.lit(False)), "revisit").otherwise("response")
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), F.when(again, F.col("main")).alias("refers_to"))


def record(row: dict) -> bytes:
    """One WARC record, uncompressed. A revisit holds the HTTP head only, with the full payload's length."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"].encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"] + payload
    uri = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<urn:page:{'null' if row['page_id'] is None else row['page_id']}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": uri if row["url"] is not None else None,
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Refers-To": f"<urn:page:{row['refers_to']}>" if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        at, root = fs.FileSystem.from_uri(folder)
        # a name for each attempt: a repeated task never meets the file of a lost one, which no manifest names
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        at.create_dir(root, recursive=True)
        n = size = 0
        with at.open_output_stream(posixpath.join(root, name), compression=None) as out:  # members come compressed
            for batch in batches:
                for row in batch.to_pylist():
                    size += out.write(_member(record(row)))
                    n += 1
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [size], "n": [n]})

    return run


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits as folder/part-N-ATTEMPT.warc.gz; return the manifest (file, size, n).

    The manifest names what finished tasks wrote; files of lost attempts may lie beside them, so read by manifest.
    """
    return Scratch(rows.sparkSession).table(map_arrow(rows, _writer(folder), "file string, size long, n long"))


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Window:
    """A file from some offset on, read in blocks; what lies before the current record is let go."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, b""
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(BLOCK)
        self.data += got
        return bool(got)

    def cut(self, to: int) -> None:
        self.data, self.base = self.data[to - self.base :], to


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at offset `at` and its end, or None if there is no WARC record."""
    z, out, pos = zlib.decompressobj(31), [], at - window.base
    seen = 0
    try:
        while not z.eof:
            if pos >= len(window.data) and not window.more():
                return None
            step = window.data[pos : pos + (512 if not seen else BLOCK)]
            got = z.decompress(step)
            pos += len(step)
            out.append(got)
            seen += len(got)
            if seen >= 7 and not b"".join(out[:8])[:7] == b"WARC/1.":
                return None
    except zlib.error:
        return None
    pos -= len(z.unused_data)
    while len(window.data) - pos < len(MAGIC) and window.more():
        pass
    follows = window.data[pos : pos + len(MAGIC)]
    if seen < 7 or follows not in (b"", MAGIC):
        return None
    return b"".join(out), window.base + pos


def _parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x or "")) else None
    digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
    return {
        "page_id": page(f["warc-record-id"]), "url": f.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": int(_fields(http)["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": page(f.get("warc-refers-to")),
    }


class DamagedArchive(ValueError):
    """A place in an archive where a record should begin and none can be read."""


def _magic(window: _Window, at: int, end: int) -> int | None:
    """The first place from `at` on, before `end`, where gzip magic stands."""
    while (found := window.data.find(MAGIC, at - window.base)) < 0:
        known = window.base + len(window.data)
        at = max(at, known - len(MAGIC) + 1)
        window.cut(min(at, known))
        if at >= end or not window.more():
            return None
    return window.base + found if window.base + found < end else None


def records_in(file, size: int, start: int, end: int, skip_damaged: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that start in [start, end)."""
    window, at = _Window(file, start, size), start
    due = start == 0  # a record has to begin at this very place
    while at < end:
        if not due and (at := _magic(window, at, end)) is None:
            return
        got = _decode(window, at)
        if got is None:
            if due and not skip_damaged:
                raise DamagedArchive(f"no record can be read at byte {at}")
            at, due = at + 1, False
            continue
        yield at, got[0]
        at, due = got[1], True
        window.cut(at)
    if due and at < size and not skip_damaged and _decode(window, at) is None:
        raise DamagedArchive(f"no record can be read at byte {at}")


def _reader(skip_damaged: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("start", pa.int64())])
        for batch in batches:
            for split in batch.to_pylist():
                at, path = fs.FileSystem.from_uri(split["file"])
                rows, held = [], 0
                with at.open_input_file(path) as file:
                    for offset, data in records_in(file, split["size"], split["start"], split["end"], skip_damaged):
                        rows.append(_parse(data) | {"file": split["file"], "start": offset})
                        held += len(data)
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, skip_damaged: bool = False) -> DataFrame:
    """The records of the files of a manifest (file, size), one task a byte range (or several, beyond TASKS ranges).

    A member that cannot be read fails the job with DamagedArchive, or is passed over if skip_damaged is set.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = manifest.filter("size > 0").select("file", "size", F.explode(starts).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    # a stated number, so that ranges of a few bytes in the plan and many in the files are not merged into one task
    return map_arrow(splits.repartition(min(int(n), TASKS)), _reader(skip_damaged), RECORD_SCHEMA)


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the *.warc.gz files of any folder that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"))


def round_trip(pages: DataFrame, folder: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages to archives in the shared folder, and the records read back."""
    folder = folder or Scratch(pages.sparkSession).path()
    return read_warc(write_warc(with_revisits(pages), folder), split_bytes)
