import gzip
import hashlib

from sluice.llm import warc as W


def test_records_survive_any_chunking():
    recs = [W.record(i, f"http://x/{i}", (b"\r\n\r\n" if i % 2 else b"WARC/1.1\r\n") * i, None if i % 3 else 0) for i in range(20)]
    one = W.gzip_stream(recs)
    assert list(W.records_of(one, 7)) == recs and list(W.records_of(one + one)) == recs * 2
    data, index = W.normalise(one)
    assert gzip.decompress(data) == b"".join(recs)
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in index] == recs
    assert [W.page_of(e["record_id"]) for e in index] == list(range(20)) and list(W.records_of(W.gzip_stream([]))) == []


def test_round_trip(spark):
    rows = [(5, "u\r\n5", "<p>é</p>", "a"), (2, None, "<p>é</p>", "b"), (9, "u9", None, "c"), (8, "u8", "", "d"), (2, "again", "<p>é</p>", "e"), (None, "n", "<p>é</p>", "f"), (None, "n", "alone", "g"), (7, "u7", "x" * 100_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = W.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        r = by[page_id, len(body)]
        assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        assert r.payload == (None if r.record_type == "revisit" else body)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 8), (8, "response", None), (None, "revisit", 2), (None, "response", None), (7, "response", None)}
    assert {r.record_type for r in W.round_trip(pages, least=50).collect() if r.page_id != 7} == {"response"}
    assert W.round_trip(pages.limit(0)).count() == 0
