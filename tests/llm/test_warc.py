from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from marketloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max([x for x in (best.get(h or ""), i) if x is not None], default=None)
    out = {}
    for i, _, h in rows:
        data = (h or "").encode()
        response = len(data) < least or best[h or ""] == i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else best[h or ""])
    return out


def found(df, **more):
    return {r[0]: tuple(r)[1:5] for r in warc.round_trip(df, **more).collect()}


ROWS = [
    (1, "http://a/b c\r\n", None), (2, None, ""), (3, "x", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (4, "y", "é\x00\r\n\r\n"),
    (5, "z", "same"), (6, "z", "same"), (7, "z", "same"), (-8, "n", "\r\n"), (None, "q", "other"), (9, "q", "big " * 300_000),
]


def test_round_trip(table):
    assert found(table(SCHEMA, *ROWS).repartition(3)) == expected(ROWS)
    assert found(table(SCHEMA, *ROWS), least=5) == expected(ROWS, 5)


def test_many_copies_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 50)
    df = spark.range(500).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 = 0, 'hot', concat('p', id % 100)) AS html", "id AS payload")
    assert found(df) == expected([tuple(r)[:3] for r in df.collect()])


def test_nested_captures_carry_payloads(spark, table, tmp_path):
    warc.write_archive(table(SCHEMA, *ROWS), str(tmp_path / "a"))
    rows = warc.captures(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(ROWS)
    by = {r.capture_id.split(":")[2]: r for r in rows}
    three = by["3"]
    assert bytes(three.response.payload).decode() == ROWS[2][2] and three.request.concurrent_to == three.capture_id and three.metadata.target_uri == "x"
    assert by["1"].response.target_uri == "http://a/b%20c%0D%0A" and by["5"].response.refers_to == by["7"].capture_id


def test_repeated_ids_empty_table_broken_file(spark, table, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (0, "v", "a"), (None, "u", "a"), (None, "u", "c"), (None, "u", "c")]
    kept = warc.round_trip(table(SCHEMA, *rows).repartition(3)).collect()
    assert all(r.has_request and r.has_metadata for r in kept)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in kept), key=str)
    assert got == sorted([(1, "response", None)] * 3 + [(0, "revisit", 1), (None, "revisit", 1)] + [(None, "response", None)] * 2, key=str)
    assert found(table(SCHEMA)) == {}
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "part-0.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort")
    with pytest.raises(Exception, match="does not end where"):
        warc.read_archive(spark, str(folder)).collect()


def test_files_are_walked_a_piece_at_a_time(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 7)
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\nH\r\n\r\n%s" % (k, 5 + len(x), x) + b"\r\n\r\n" for k, x in enumerate([b"", b"a\r\n\r\nb" * 9, b"x" * 100])]
    plain = b"".join(records)
    for data in (plain, gzip.compress(plain), b"".join(map(gzip.compress, records)), gzip.compress(records[0]) + gzip.compress(b"".join(records[1:]))):
        rows = list(warc._records(warc._Stream(warc._unpacked(data)), True))
        assert [r[1] for r in rows] == ["<0>", "<1>", "<2>"] and [r[-1] for r in rows] == [b"", b"a\r\n\r\nb" * 9, b"x" * 100]


def test_long_pages_in_bounded_memory():
    import tracemalloc

    page = b"x" * 5_000_000
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5000005\r\n\r\nH\r\n\r\n" + page + b"\r\n\r\n"
    data = gzip.compress(record * 30, 1)
    tracemalloc.start()
    assert sum(r[6] for r in warc._records(warc._Stream(warc._unpacked(data)), False)) == 150_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
