import hashlib

from pyspark.sql import functions as F

from tracewarden.llm import warc

BIG = "<p>ünïcode</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")


def archived(spark, rows, path):
    warc.write_archives(warc.resolve_revisits(warc.from_pages(pages_of(spark, rows))), path)
    return warc.referred_keys(warc.read_archives(spark, path)).collect()


def test_round_trip_and_revisits(spark, tmp_path):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nX-Evil: 1", BIG), (9, None, BIG), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, "e", None), (6, "f", "")]
    got = {int(r["key"]): r for r in archived(spark, rows, str(tmp_path / "a"))}
    assert len(got) == len(rows)
    for key, _, html in rows:
        payload = (html or "").encode()
        assert got[key]["payload_bytes"] == len(payload)
        assert got[key]["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert got[key]["intact"]
        assert got[key]["payload"] == (None if key in (1, 2) else payload)
    assert {k: r["record_type"] for k, r in got.items()} == {k: "revisit" if k in (1, 2) else "response" for k in got}
    assert got[1]["refers_to"] == got[2]["refers_to"] == "9" and got[3]["refers_to"] is None
    assert got[9]["uri"] is None and "\n" not in got[2]["uri"]


def test_archives_with_revisits_are_resolved_again(spark, tmp_path):
    first, second, merged = (str(tmp_path / n) for n in "abc")
    warc.write_archives(warc.resolve_revisits(warc.from_pages(pages_of(spark, [(1, "u", BIG), (2, "v", BIG)]))), first)
    warc.write_archives(warc.resolve_revisits(warc.from_pages(pages_of(spark, [(30, "w", BIG), (4, "x", "other")]))), second)
    warc.dedup_archives(spark, f"{tmp_path}/[ab]", merged)
    got = {int(r["key"]): r for r in warc.referred_keys(warc.read_archives(spark, merged)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", "30"), 2: ("revisit", "30"), 30: ("response", None), 4: ("response", None),
    }
    assert got[30]["payload"] == BIG.encode() and all(r["intact"] for r in got.values())


def test_edge_cases(spark, tmp_path):
    assert archived(spark, [], str(tmp_path / "none")) == []
    twice = archived(spark, [(7, "u", BIG), (7, "u", BIG), (None, "v", "x")], str(tmp_path / "twice"))
    assert sorted((str(r["key"]), r["record_type"]) for r in twice) == [("7", "response"), ("7", "response"), ("None", "response")]


def test_headers_only_meet_the_digests(spark):
    records = warc.from_pages(pages_of(spark, [(i, "u", BIG) for i in range(5)]))
    assert records.select(F.max("payload_bytes")).first()[0] == len(BIG.encode())
