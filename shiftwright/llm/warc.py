"""WARC archives with a shared Zstandard dictionary.

An archive file starts with a skippable frame that holds the dictionary; every record follows as a frame of its own,
so that a record can be read without those before it. Records whose payload another record holds are ``revisit``.

Files are written by the tasks through the file system of the target URI and read back with Spark's binary reader.
A task's file gets its final name only when it is complete, its name tells partition and attempt, and only files named
in the rows that the job returned belong to the archive: tasks may be repeated without harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright.session import cut, shared_path

# The frame type that archives with a dictionary start with.
SKIPPABLE_MAGIC = 0x184D2A5D
DICT_BYTES = 64 << 10
# Bound of the sample the dictionary is built from: documents and bytes of each.
DICT_RECORDS = 1_000
DICT_RECORD_BYTES = 16 << 10
# A file is closed when it has grown beyond this; the reader holds one file at a time.
FILE_BYTES = 32 << 20
LEVEL = 3
URN = "urn:x-page:"

_OUT = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def build_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples; empty if they are too few or too small to build one."""
    size = min(DICT_BYTES, sum(map(len, samples)) // 10)
    if size < 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no content; its payload's length is kept as a header."""
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(stream: io.BufferedReader) -> tuple[dict[str, str], bytes] | None:
    """Headers, by lower-case name, and the content block of the next record; None at the end."""
    if not stream.readline():
        return None
    headers = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
        headers[name.lower()] = value
    block = stream.read(int(headers["content-length"]))
    stream.read(4)
    return headers, block


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive file, one after the other."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with its dictionary frame")
    known = data[8 : 8 + size]
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    frames = unpack.stream_reader(memoryview(data)[8 + size :], read_across_frames=True)
    stream = io.BufferedReader(frames, 1 << 18)
    while found := read_record(stream):
        yield found


def with_references(pages: DataFrame) -> DataFrame:
    """``pages`` with _payload (binary, never null), payload_digest and refers_to.

    Of rows with equal payloads the largest page_id holds it; the others refer to it. Only ids and digests are
    exchanged to find it, counted within tasks first, so a payload that a third of all pages share is one small group.
    """
    digested = _with_digest(pages)
    keepers = (
        digested.groupBy("_sha1").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).select("_sha1", "_keeper")
    )
    return digested.join(keepers, "_sha1", "left").withColumn(
        "refers_to", F.when(~F.col("_keeper").eqNullSafe(F.col("page_id")), F.col("_keeper"))
    )


def _with_digest(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.withColumn("_payload", payload).withColumn("_sha1", F.sha1("_payload"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder`` and return (path, records, bytes) of its files.

    Null html is an empty payload. A null page_id is written as an empty id, and never holds a payload for others but
    where all ids of the payload are null. Rows that repeat a page_id and a payload are all ``response``.
    """
    spark = pages.sparkSession
    # About DICT_RECORDS rows, chosen by a hash of the id; only they reach the driver.
    place = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = (
        pages.where(place * pages.count() < DICT_RECORDS)
        .select(F.substring(F.coalesce("html", F.lit("")), 1, DICT_RECORD_BYTES).alias("html"))
        .limit(2 * DICT_RECORDS).collect()
    )
    known = spark.sparkContext.broadcast(build_dictionary(
        [record(str(i), "http://www.example.com/", x["html"].encode("utf-8", "surrogatepass"), "A" * 32, None)
         for i, x in enumerate(sample)]
    ))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        pack = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known.value) if known.value else None,
        )
        number, out, name, count, size = 0, None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            files.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": size}], schema=_OUT)

        for batch in batches:
            for page, url, payload, refers in zip(
                batch["page_id"], batch["url"], batch["_payload"], batch["refers_to"], strict=True
            ):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    number, count, size = number + 1, 0, 8 + len(known.value)
                    out = files.open_output_stream(f"{base}/.{name}", compression=None)
                    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(known.value)) + known.value)
                body = payload.as_py()
                frame = pack.compress(
                    record(page.as_py() or "", url.as_py(), body, payload_digest(body), refers.as_py())
                )
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    ready = with_references(pages.select("page_id", "url", "html")).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "_payload",
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    return cut(ready.mapInArrow(rows, "path string, records long, bytes long"), "archive-files")


def read_archives(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of all records of the named files.

    The digest of a response is computed anew from the content read. html is null for a revisit.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                out: list[dict] = []
                for headers, block in read_archive(data.as_buffer()):
                    kind = headers["warc-type"]
                    told = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(block) != told:
                        raise ValueError("the content of a record does not fit its digest")
                    out.append({
                        "page_id": _id(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
                        "payload_bytes": int(headers["x-payload-length"]), "payload_digest": told, "record_type": kind,
                        "refers_to": _id(headers.get("warc-refers-to")),
                        "html": block.decode("utf-8", "surrogatepass") if kind == "response" else None,
                    })
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([
        ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.string()), ("html", pa.string()),
    ])
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    valid = names.select(F.col("path").alias("_name"))
    return (
        listed.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(valid, "_name", "left_semi")
        .select("content").mapInArrow(
            rows,
            "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
            "refers_to string, html string",
        )
    )


def _id(urn: str | None) -> str | None:
    """The id within ``<urn:...>``; null for none or an empty one."""
    return (urn.removeprefix(f"<{URN}").removesuffix(">") or None) if urn else None


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back.

    An empty table writes no file and gives an empty result.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    names = write_archives(pages, folder)
    if names.isEmpty():
        return spark.createDataFrame(
            [], "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
                "refers_to string, html string",
        )
    return read_archives(spark, folder, names)


def id_column(page_id: Column, like: DataFrame) -> Column:
    """A record's id in the type it had in the table."""
    return page_id.cast(like.schema["page_id"].dataType)
