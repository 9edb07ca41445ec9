import hashlib

import pytest

from tessera.llm import warc


def archive():
    return [warc.member("response", f"urn:page:{i}", "http://x", p, warc.b32(hashlib.sha1(p).digest()), len(p)) for i, p in enumerate([b"", b"abc\r\n\r\n" * 900, b"\x00\xff"])]


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_reader_is_incremental(step):
    raw = b"".join(archive())
    chunks = (raw[i : i + step] for i in range(0, len(raw), step))
    assert [p for _, p in warc.read_archive(chunks)] == [b"", b"abc\r\n\r\n" * 900, b"\x00\xff"]


def test_reader_refuses_damage():
    good = archive()
    with pytest.raises(warc.WarcError):
        list(warc.read_archive([good[1][:-20]]))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive([b"garbage"]))
    wrong = warc.member("response", "urn:page:1", "u", b"payload", warc.b32(hashlib.sha1(b"other").digest()), 7)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive([wrong]))
    with pytest.raises(warc.WarcError):
        warc.parsed(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_round_trip(spark):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "u", big), (2, "u", big), (3, None, small), (4, "u v", small), (5, "u", None), (6, "u", ""), (None, "u", "no id"), (7, "u", "é" * 600)] + [(10 + i, "u", "z" * 5000) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        p = (h or "").encode()
        assert got[i].payload_bytes == len(p) and got[i].payload_digest == hashlib.sha1(p).hexdigest()
    revisits = {r.page_id: r.refers_to for r in got.values() if r.record_type == "revisit"}
    assert revisits == {1: 2} | {i: 59 for i in range(10, 59)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    texts = warc.read_archives(warc.write_archives(pages, warc.run_dir(spark, "warc-test")), with_payload=True)
    assert {r.page_id: bytes(r.payload) for r in texts.where("record_type = 'response'").collect()}[7] == ("é" * 600).encode()


def test_manifest_is_one_file(spark):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 10 * int(id)) AS html").repartition(20)
    manifest = warc.write_archives(pages, warc.run_dir(spark, "warc-files"))
    assert len(manifest.inputFiles()) == 1 and manifest.agg({"records": "sum"}).first()[0] == 40
