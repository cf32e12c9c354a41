import gzip
import hashlib

import pytest

from vigilo.llm.common import shared_dir
from vigilo.llm.warc import read_archives, write_archives

BIG = "é<p>" * 70_000
HTML = [(1, "http://a/x y\r\nWARC-Type: evil", "h" * 120), (2, None, "h" * 120), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (9, "u", BIG), (8, "u", BIG), (7, "u", BIG), (7, "v", BIG),
        (10, "u", "h" * 99), (11, "u", "h" * 99), (None, "u", BIG), (None, "u", "n" * 200), (12, "u", "\r\n\r\nWARC/1.1\r\n" * 30)]


def want():
    first = {}
    for page, _, html in HTML:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html in HTML:
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return out


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 16])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string")
    manifest = write_archives(pages, shared_dir(spark, "warc"), chunk_bytes=max(chunk, 1000))
    rows = read_archives(manifest, chunk_bytes=chunk).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    last = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows if r["last"]]
    assert sorted(last, key=lambda r: key(r[:2]) + r[2:4]) == sorted(want(), key=lambda r: key(r[:2]) + r[2:4])
    assert max(len(r.data) for r in rows) <= chunk
    whole = {p: h for p, _, h in HTML}
    for page in (1, 7, 12):  # chunks in order give the payload, digests go along
        parts = [r for r in rows if r.page_id == page and r.record_type == "response"]
        parts = parts[:len(parts) // (2 if page == 7 else 1)]
        data = b""
        for r in parts:
            data += r.data
            assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data)
        assert data.decode() == whole[page]


def test_archives_are_gzip_members_of_records(spark):
    manifest = write_archives(spark.createDataFrame(HTML, "page_id long, url string, html string").coalesce(1), shared_dir(spark, "warc"))
    (r,) = manifest.collect()
    text = gzip.open(r.path.removeprefix("file:")).read()
    assert r.records == len(HTML) and text.startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert b"\r\nWARC-Type: evil" not in text


def test_empty_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x", "mine", "mine")], "page_id long, url string, html string, digest string, data string")
    assert read_archives(write_archives(pages, shared_dir(spark, "w"))).count() == 1
    assert read_archives(write_archives(pages.limit(0), shared_dir(spark, "w"))).count() == 0
