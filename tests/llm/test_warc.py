"""WARC archives: exact round trip, revisits, file layout, awkward rows."""

import base64
import glob
import hashlib
import io
import struct

import zstandard

from fieldmarch.llm import warc


def plain(rows, least):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(b) if len(b) >= least else None
        revisit = f is not None and i != f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


def test_awkward_rows(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>page {i % 40} of many</p>" * (i % 7)) for i in range(300)]
    pages += [(300, None, None), (301, "", ""), (None, "u", "lone"), (None, "u", "page 1"), (302, "a\r\nb", "WARC/1.1\r\n\r\n"), (303, "u", "é" * 500_000), (5, "again", pages[5][2])]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, first string").repartition(3)
    rows = [(i, h) for i, _, h in pages]
    for least in (0, 30):
        manifest = warc.write(df, f"file://{tmp_path}/w{least}", least)
        back = warc.read(manifest)
        assert got(back) == plain(rows, least)
        assert {(r.page_id, r.html) for r in back.collect() if r.record_type == "response"} <= {(i, h or "") for i, h in rows}
        assert sum(r.records for r in manifest.collect()) == len(pages)
    for path in glob.glob(f"{tmp_path}/w0/*.warc.zst"):
        data = open(path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        found = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        tool, rest, n = zstandard.ZstdDecompressor(dict_data=found), data[8 + size :], 0
        while rest:  # every frame is one record
            one = tool.decompressobj()
            text = one.decompress(rest)
            rest, n = one.unused_data, n + 1
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert n == len(list(warc.read_archive(io.BytesIO(data))))
    assert warc.round_trip(df.limit(0)).collect() == []


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(warc.round_trip(df)) == plain([(r.page_id, r.html) for r in df.collect()], 0)
