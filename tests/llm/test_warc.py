import hashlib
import io

import pytest

from eventloom.llm import warc

LONG = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1</p>"
PAGES = [(1, "http://a", "short"), (2, "http://b\n", "short"), (5, None, LONG), (3, "http://c", LONG), (4, "http://d", None), (6, "u", ""), (None, "n", LONG), (7, "big", "z" * 300_000), (7, "big", "z" * 300_000), (8, "big2", "z" * 300_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, size int").repartition(3)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(PAGES)
    for r in got:
        html = next(h for i, _, h in PAGES if i == r["page_id"]) or ""
        body = html.encode()
        first = min((i for i, _, h in PAGES if h == html and i is not None), default=None) if len(body) >= 100 else r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
        assert r["payload"] == (body if r["record_type"] == "response" else None)


def test_damage_is_found():
    good = [warc.record(i, "u", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in range(3)]
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(b"".join(map(warc.member, good))))] == [0, 1, 2]
    for bad in (
        warc.member(good[0].replace(b"payload 0", b"payload 9")),
        warc.member(good[0])[:-20],
        warc.member(good[0] + good[1]),
        warc.member(good[0].replace(b"WARC/1.1", b"WARC/9.9")),
        warc.member(good[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)),
        warc.member(b"junk"),
    ):
        with pytest.raises(ValueError, match="record 1"):
            list(warc.read_records(io.BytesIO(warc.member(good[1]) + bad)))


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
