"""Dictionary-compressed WARC archives.

Pages become WARC records: a response holds the page, a revisit stands for a page
whose payload equals that of another record.  A task writes its records to archives of bounded
size.  For each archive it builds a Zstandard dictionary from the archive's own records, puts
it into a skippable frame at the front (magic 0x184D2A5D, the .warc.zst convention), and
compresses every record as a frame of its own, so a reader can start at any record.

Scale: which page is the response follows from grouped counts of payload digests, combined
map-side; only digests that occur twice take part in the join with the pages, whose
hot side AQE splits.  An archive's records wait in memory up to ``archive_bytes``, the
dictionary is built from at most ``sample_bytes`` of them (a documented bound), and archives are read back
one file a row.  Archives go to a folder that all executors share; a file is written
under a task's own name and then moved, so a task that runs again replaces it by the same bytes.

Nulls and ties: a null html is an empty payload; a null page_id loses to any other, and among
records that tie at the largest page_id all are responses, each with an id of its own, of which revisits
name one; a null url has no target line.  The date is a constant, as pages have none.  Archives are written
through pyarrow's file systems, so the folder's scheme must be one that these know (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketml.llm.common import prepare
from marketml.session import scratch_path

MIN_REVISIT = 1000
DICTIONARY_FRAME = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to, first): refers_to is the page of the
    response that a revisit stands for, null for a response; ``first`` marks the one response
    of a digest that its revisits name."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    large = F.octet_length("html") >= min_bytes
    again = rows.where(large).groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("of"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("again"), F.col("of.page_id").alias("last"), F.col("of.row").alias("last_row"))
    joined = rows.join(again, (F.col("digest") == F.col("again")) & large, "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
                         F.coalesce(F.col("row") == F.col("last_row"), F.lit(False)).alias("first"))


def record_id(place, digest: str) -> str:
    """An id from a digest and a place: an archive and a position in it, or, for the response
    that revisits name, its page."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}/{digest}').urn}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to, own_id: str | None = None) -> bytes:
    """One WARC record."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    block = _HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id or record_id(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{b32}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-X-Refers-To-Page: {refers_to}"]
    if page is not None:
        head.append(f"WARC-X-Page: {page}")
    head += [f"WARC-X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], sample_bytes: int, dictionary_bytes: int, level: int) -> bytes:
    """The dictionary's skippable frame, then a frame for each record."""
    sample, size = [], 0
    step = max(1, sum(map(len, records)) // max(1, sample_bytes))
    for r in records[::step]:
        sample.append(r)
        size += len(r)
        if size > sample_bytes:
            break
    try:
        data = zstandard.train_dictionary(min(dictionary_bytes, max(256, size // 8)), sample, level=level).as_bytes()
    except zstandard.ZstdError:  # too few records to learn from: the first ones serve as they are
        data = b"".join(sample)[:dictionary_bytes]
    compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True, write_checksum=True).compress
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(data)), data, *map(compress, records)])


def read_archive(data: bytes):
    """Yields each record of an archive, decompressed."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the front")
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        # Fed in pieces, as what lies beyond the frame's end is copied.
        one, parts = decompress.decompressobj(), []
        while not one.eof:
            piece = data[at : at + 16384]
            if not piece:
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _writer(folder: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def run(batches):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        task = TaskContext.get()
        files.create_dir(base, recursive=True)
        held, size, number = [], 0, 0

        def write():
            nonlocal held, size, number
            name = f"{base}/part-{task.partitionId():06d}-{number:05d}.warc.zst"
            own = f"{base}/.{task.taskAttemptId()}-{number}.tmp"
            with files.open_output_stream(own) as out:
                out.write(pack_archive(held, sample_bytes, dictionary_bytes, level))
            files.move(own, name)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)])], ["file", "records"])
            held, size, number = [], 0, number + 1
            return done

        for b in batches:
            for page, url, html, digest, refers, first in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                place = page if first else f"{base}/{task.partitionId()}/{number}/{len(held)}"
                held.append(record(page, url, html.encode(), digest, refers, record_id(place, digest)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield write()
        if held:
            yield write()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT, archive_bytes: int = 32 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, **columns) -> str:
    """Writes ``pages`` as .warc.zst archives and returns their folder, by default a new
    one below the shared checkpoint folder."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "warc")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)  # also where no page needs an archive
    plan = plan_records(pages, min_bytes, **columns)
    plan.mapInArrow(_writer(folder, archive_bytes, sample_bytes, dictionary_bytes, level), "file string, records long").agg(F.sum("records")).collect()
    return folder


def _reader(batches):
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "sound"]
    for b in batches:
        for content in b.column(0):
            rows = []
            for data in read_archive(content.as_buffer().to_pybytes()):
                h, block = parse(data)
                digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                sound = payload is None or hashlib.sha1(payload).hexdigest() == digest and len(payload) == int(h["WARC-X-Payload-Length"])
                rows.append((h.get("WARC-X-Page"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, int(h["WARC-X-Payload-Length"]), h.get("WARC-X-Refers-To-Page"), payload, sound))
                if len(rows) == 500:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark, folder: str) -> DataFrame:
    """One row for each record of the archives in ``folder``: page_id and refers_to
    (as text), url, record_type, payload_digest, payload_bytes, payload (null for a
    revisit), and whether the payload read has the recorded digest and length."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(_reader, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary, sound boolean")
