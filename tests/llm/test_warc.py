import glob
import gzip
import hashlib

from quiltgraph.llm import warc

ROWS = [
    (5, "http://a/b c", "<p>é</p>", 1),
    (9, "http://a/d\r\nX: y", "<p>é</p>", 2),
    (9, "http://again", "<p>é</p>", 3),
    (1, None, None, 4),
    (2, "u", "", 5),
    (None, "u", "x", 6),
    (None, "u", "x", 7),
    (None, "u", "", 8),
    (12, "long", "WARC/1.1\r\n\r\n" * 20_000, 9),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=400).collect()
    assert len(manifest) > 3 and sum(r["records"] for r in manifest) == len(ROWS)
    for r in manifest:
        data = open(f"{tmp_path}/w/{r['name']}", "rb").read()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()), key=repr)
    e = "<p>é</p>"
    want = [(5, "revisit", 9, 9, None), (9, "response", None, 9, e), (9, "response", None, 9, e), (1, "revisit", 2, 0, None), (2, "response", None, 0, ""), (0, "response", None, 1, "x"), (0, "response", None, 1, "x"), (0, "revisit", 2, 0, None), (12, "response", None, 240_000, "WARC/1.1\r\n\r\n" * 20_000)]
    assert got == sorted(want, key=repr)
    assert not glob.glob(f"{tmp_path}/w/_temporary*")
    # the same bytes again, however the input is dealt out
    again = warc.write_warc(pages.repartition(1), f"file://{tmp_path}/again", roll_bytes=400).collect()
    assert sorted(r["sha256"] for r in again) == sorted(r["sha256"] for r in manifest)


def test_least_bytes_and_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    pages = spark.createDataFrame(ROWS + [(i, "h", "hot page", 0) for i in range(100, 300)], "page_id long, url string, html string, payload int")
    warc.write_warc(pages, f"file://{tmp_path}/w", least_bytes=2)
    got = warc.read_warc(spark, f"file://{tmp_path}/w", with_payload=False).collect()
    assert sum(r["record_type"] == "revisit" for r in got) == 1 + 199
    assert {r["refers_to"] for r in got} == {None, 9, 299} and {r["payload"] for r in got} == {None}


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(pages, f"file://{tmp_path}/w").collect() == []
    assert warc.read_warc(spark, f"file://{tmp_path}/w").collect() == []


def test_query(spark):
    from oracle import both

    got, want = both(spark, "op6_warc", "/root/testdata/sf0.001")
    assert got == want and got
