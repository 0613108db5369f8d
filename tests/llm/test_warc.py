import base64
import gzip
import hashlib

from lodestone.llm import warc


def test_round_trip(spark, tmp_path):
    pages = [
        (1, "http://a.com/", "<p>one</p>"), (2, "http://b.com/", "<p>one</p>"), (3, None, None), (4, "http://c.com/\r\nX: y", "two\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (5, "http://d.com/ü", ""), (6, "http://e.com/", "<p>one</p>"), (6, "http://e.com/", "<p>one</p>"), (None, "http://f.com/", "é" * 200_000), (7, "http://g.com/", "\r\n\r\n"),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, keeper string")
    path = str(tmp_path / "archive")
    warc.write_archives(df, path)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(rows) == len(pages)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.metadata.page_id, []).append(r)
        assert r.request.concurrent_to == r.capture_id == r.metadata.concurrent_to
    for i, _, html in pages:
        data = (html or "").encode()
        same = [p for p in pages if (p[2] or "") == (html or "")]
        keeper = max((p[0] for p in same if p[0] is not None), default=None)
        for r in by_id[i]:
            assert r.response.payload_bytes == len(data)
            assert r.response.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert r.response.type == ("response" if i == keeper else "revisit")
            if i == keeper:
                assert r.response.payload == data and r.response.intact
            else:
                assert r.response.refers_to == by_id[keeper][0].capture_id
    assert len(by_id[6]) == 2


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def test_links_that_the_response_tells(spark):
    rows = [("r1", "response", "q1", None), ("q1", "request", None, None), ("m1", "metadata", "r1", None), ("q9", "request", None, None)]
    full = spark.createDataFrame([(i, t, c, f, None, 5 if t == "metadata" else None, 1, "D", True, b"x") for i, t, c, f in rows], warc.RECORD)
    (r,) = warc.assemble(full).collect()
    assert (r.capture_id, r.request.record_id, r.metadata.page_id) == ("r1", "q1", 5)


def test_parser_reads_members():
    one = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse(one + one))) == 2
    assert len(list(warc.parse(gzip.compress(one) + gzip.compress(one)))) == 2
    assert list(warc.parse(b"")) == []


def test_cut_and_damaged_records_are_told():
    one = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    packed = gzip.compress(one * 2)
    for data, cuts in (
        (one + one[:-6], [False, True]), (one + b"WARC/1.1\r\nWARC-Ty", [False, True]), (one.replace(b": 3", b": x") + one, [True]), (one.replace(b": 3", b": " + b"9" * 18), [True]),
        (one.replace(b": 3", b": -1"), [True]), (gzip.compress(one) + packed[:-3], [False, False, False, True]), (gzip.compress(one) + bytes(9) + packed, [False] * 3), (gzip.compress(one) + b"\x1f\x8b\x08" + b"?" * 40, [False, True]),
    ):
        assert [r["cut"] for r in warc.parse(data)] == cuts
        last = list(warc.parse(data))[-1]
        assert warc._row(last, True)["intact"] is (False if last["cut"] else None)


def test_archives_of_others(spark, tmp_path):
    """A gzip member for each record, a plain archive, a digest of another kind,
    and a file that ends early."""

    def record(kind, i, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{i}>", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    body = bytes(range(256))
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    answer = b"HTTP/1.1 200 OK\r\n\r\n" + body
    first = [record("warcinfo", "i", b"software: x"), record("response", "r1", answer, f"WARC-Payload-Digest: sha1:{digest.lower()}"), record("request", "q1", b"GET /", "WARC-Concurrent-To: <r1>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))
    second = [record("metadata", "m2", b"pageId: -7\r\n", "WARC-Concurrent-To: <r2>"), record("response", "r2", answer, "WARC-Payload-Digest: sha256:00"), record("response", "r3", answer, f"WARC-Payload-Digest: sha1:{digest}")[:-40]]
    (tmp_path / "b.warc").write_bytes(b"".join(second))
    (tmp_path / "c.cdx").write_bytes(b"no archive")
    records = warc.read_records(spark, str(tmp_path))
    assert records.count() == 6 and records.filter("not intact").count() == 1
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>"}
    assert got["<r1>"].response.payload == body and got["<r1>"].response.intact and got["<r1>"].request.record_id == "<q1>"
    assert got["<r2>"].response.intact is None and got["<r2>"].metadata.page_id == -7
    assert got["<r3>"].response.intact is False and got["<r3>"].response.payload is None


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 8000)
    monkeypatch.setattr(warc, "TIERS", (400, 4000))
    sizes = [100] * 40 + [3000] * 8 + [20_000] * 3 + [3000]
    rows = [(i, "http://a.com/", chr(97 + i % 26) * n) for i, n in enumerate(sizes)] + [(90, "http://a.com/" + "u" * 9000, "b" * 100)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part*")]
    for f in files:
        pages = sum(r["fields"]["warc-type"] in ("response", "revisit") for r in warc.parse(f))
        assert pages == 1 or len(f) <= 8000 + pages * 1500  # the payloads and the heads
    assert sum(f.count(b"WARC/1.1") for f in files) == 3 * len(rows)
    got = {r.metadata.page_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert {i: r.response.payload_bytes for i, r in got.items()} == {i: len(h) for i, _, h in rows}
    # the keeper of a payload may be in another tier, by its url
    assert got[90].response.type == "response" and {got[i].response.refers_to for i in (1, 27)} == {got[90].capture_id}


def test_query(spark, sf):
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = warc.op3_warc(spark, sf).collect()
    assert {r.page_id for r in rows} == set(html)
    for r in rows:
        keeper = max(i for i, h in html.items() if h == html[r.page_id])
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == keeper else ("revisit", keeper))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id].encode()).digest()).decode()
