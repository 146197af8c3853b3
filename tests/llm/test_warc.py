import hashlib
import zlib

import pytest

from rayscape.llm import warc

PAGES = "page_id long, url string, html string, digest string, file string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(3)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    long, small = "é" * 400, "x" * 99
    rows = [(i, f"https://www.h{i % 3}.example.org/p/{i % 7}?q={i}", long if i % 5 == 0 else f"<p>{i}</p>" + "y" * i) for i in range(1, 60)]
    rows += [(100, "http://same.example/a", small), (101, "http://same.example/a", small), (102, None, None), (103, "bad\r\nurl: x", "")]
    df = pages(spark, rows)
    archive = warc.Archive.write(df)
    found = {r.page_id: r for r in archive.read(df, payloads=True).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if h == html), default=i) if len(body) >= 100 else i
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert bytes(r.payload) == (body if first == i else b"")


def test_lookup_of_some_and_of_unknown_pages(spark):
    df = pages(spark, [(i, f"http://a.example/{i % 4}", str(i)) for i in range(40)])
    archive = warc.Archive.write(df)
    wanted = spark.createDataFrame([(5, "http://a.example/1"), (6, "http://a.example/1"), (999, "http://zzz.example/")], "page_id long, url string")
    assert [r.page_id for r in archive.read(wanted).collect()] == [5]


def test_edge_cases(spark):
    empty = pages(spark, [])
    assert warc.Archive.write(empty).read(empty).count() == 0
    same = pages(spark, [(None, "u", "z" * 200), (None, "u", "z" * 200), (3, "u", "z" * 200), (3, "u", "z" * 200)])
    rows = warc.Archive.write(same).read(same).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "revisit"), (0, "revisit"), (3, "response"), (3, "response")]


def test_records_and_keys():
    data = warc.record(1, "http://x/", b"hi", "d" * 64, None, False)
    assert warc.parse(zlib.decompress(warc.gzipped(data), 31))["payload"] == b"hi"
    with pytest.raises(ValueError):
        warc.parse(data[:-1])
    assert warc.surt("https://www.Example.com:443/a?b=c#d") == "com,example,www)/a?b=c"
    assert warc.surt("http://e.com:8080") == "com,e:8080)/" and warc.surt(None) == ""
