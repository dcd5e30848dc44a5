import base64
import gzip
import hashlib
import os

import pytest

from schedlake.llm.warc import (
    capture_key, look_up, op8_warc, parse, read_records, record, reversed_host, write_archives, write_index,
)

PAGES = [
    (1, "http://a.org/x", "same", "c"), (2, "http://b.a.org/", "same", "c"), (3, "http://a.org/x", "other é", "c"),
    (4, None, None, "c"), (5, "", "", "c"), (6, "https://u@a.org:81/p q?x=1#f", "line\r\n\r\nWARC/1.1", "c"), (7, "x\ty\nz", "q" * 200_000, "c"),
    (None, "http://a.org/x", "same", "c"), (None, "http://n.org", "lonely", "c"), (8, "http://a.org/x", "twice", "c"), (8, "http://a.org/x", "twice", "c"),
]


def expected(rows, least=0):
    groups = {}
    for i, _, body, *_ in rows:
        groups.setdefault(body or "", []).append(i)
    out = []
    for i, _, body, *_ in rows:
        body, ids = body or "", groups[body or ""]
        keep = max((x for x in ids if x is not None), default=None)
        response = len(body.encode()) < least or i == keep
        digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        out.append((i, len(body.encode()), digest, "response" if response else "revisit", None if response else keep))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize(("least", "lines", "size"), [(0, 3000, 1 << 30), (5, 1, 300), (0, 2, 1)])
def test_round_trip(spark, tmp_path, least, lines, size):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, key string").repartition(3)
    folder = str(tmp_path / "warc")
    captures = write_archives(df, folder, revisit_bytes=least, file_bytes=size)
    found = look_up(captures, folder, write_index(captures, folder, lines))
    rows = read_records(found, folder).collect()
    got = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=key) == sorted(expected(PAGES, least), key=key)
    bodies = {i: (b or "").encode() for i, _, b, _ in PAGES if i is not None}
    assert all(bytes(r.payload) == bodies[r.id] for r in rows if r.record_type == "response" and r.id is not None)
    for name in os.listdir(folder):
        if name.startswith("archive"):  # any gzip reader opens an archive
            assert gzip.open(f"{folder}/{name}").read().startswith(b"WARC/1.1\r\n")


def test_only_what_is_asked_for_is_found(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"body {i}") for i in range(500)], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    captures = write_archives(df, folder)
    catalogue = write_index(captures, folder, 10)
    asked = [capture_key(f"http://h{i % 7}.org/{i}", i) for i in (0, 7, 499)] + [capture_key("http://none.org", 1), "", "~"]
    keys = spark.createDataFrame([(k,) for k in [*asked, asked[0], None]], "key string")
    assert sorted(r.id for r in read_records(look_up(keys, folder, catalogue), folder).collect()) == [0, 7, 499]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    captures = write_archives(df, folder)
    catalogue = write_index(captures, folder)
    assert catalogue == [] and read_records(look_up(captures, folder, catalogue), folder).count() == 0


def test_keys_and_damage():
    assert reversed_host("http://WWW.Example.com:80/A?b#c") == "com,example,www:80)/A?b"
    assert reversed_host("x.org?q") == "org,x)?q" and reversed_host("http://x.org") == "org,x)/" and reversed_host(None) == ""
    assert capture_key("u", -5) < capture_key("u", 3) < capture_key("u", 20)
    damaged = record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), True, None)
    with pytest.raises(ValueError):
        parse(damaged)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, op8_warc(spark, sf).collect()), key=key) == sorted(expected(pages), key=key)
