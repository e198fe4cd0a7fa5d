"""Archives: an exact round trip, and records against a plain version."""

import hashlib
import struct

import zstandard
from pyspark.sql import types as T

from marketml.llm import warc

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("digest", T.StringType()), ("n", T.LongType()))])
LONG = "<p>sámе words over and over</p>" * 60


def _rows():
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" + "x" * (i * 37 % 2500)) for i in range(300)]
    rows += [(1000 + i, "http://copy/", LONG) for i in range(40)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://a\r\nb", "short"), (2003, "u", "short"), (None, "n", LONG), (1039, "http://tie/", LONG), (5, "http://h/5", rows[5][2])]
    return rows


def plain(rows):
    last = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            last[data] = max(last.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = last.get(data) if len(data) >= 1000 and last.get(data) != page else None
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = _rows()
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    folder = warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=100_000)
    got = warc.read_archives(spark, folder).collect()
    num = lambda x: None if x is None else int(x)
    assert sorted(((num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in got), key=str) == plain(rows)
    assert all(r.sound for r in got)
    html = {(p, hashlib.sha1((h or "").encode()).hexdigest()): (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == html[num(r.page_id), r.payload_digest] for r in got if r.record_type == "response")
    assert {r.url for r in got} >= {None, "", "http://a%0D%0Ab"}


def test_archive_layout():
    records = [warc.record(i, "u", b"payload %d " % i * 50, hashlib.sha1(b"payload %d " % i * 50).hexdigest(), None) for i in range(200)]
    data = warc.pack_archive(records, 1 << 20, 4096, 3)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < size <= 4096
    assert list(warc.read_archive(data)) == records
    # A reader of plain Zstandard, told the dictionary, can start at any record.
    frames = data[8 + size :]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(frames) == records[0]
    assert len(data) < sum(map(len, records)) / 3


def test_few_records_and_empty(spark, tmp_path):
    data = warc.pack_archive([b"one"], 100, 4096, 3)
    assert list(warc.read_archive(data)) == [b"one"]
    pages = spark.createDataFrame([(1, "u", "x", None, None)], SCHEMA)
    folder = warc.write_archives(pages, str(tmp_path / "b"))
    assert warc.read_archives(spark, folder).count() == 1
    assert warc.plan_records(pages.where("false")).count() == 0
    folder = warc.write_archives(pages.where("false"), str(tmp_path / "c"))
    assert warc.read_archives(spark, folder).count() == 0


def test_record_ids_are_unique_and_named(spark, tmp_path):
    page = "x" * 2000
    rows = [(i, "u", page) for i in (1, 2, 3, 3, 3)] + [(7, "u", "short")] * 3 + [(None, "u", page), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.write_archives(df.repartition(2), folder=str(tmp_path / "w"), archive_bytes=3000)
    heads = []
    for file in sorted((tmp_path / "w").glob("*.zst")):
        heads += [warc.parse(r)[0] for r in warc.read_archive(file.read_bytes())]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(rows) == len(set(ids))
    named = {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"}
    assert len(named) == 1 and [h["WARC-X-Page"] for h in heads if h["WARC-Record-ID"] in named] == ["3"]
    assert folder == str(tmp_path / "w")
