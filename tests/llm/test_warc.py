import hashlib
import zlib

import pytest

from tests.llm.rows import LONG, same
from tranche.llm import warc
from tranche.llm.common import written_once

PAGES = [
    (7, "http://a.example/1", "<p>" + "same text " * 40), (3, "http://a.example/2", "<p>" + "same text " * 40), (9, None, "<p>" + "same text " * 40),
    (1, "http://a.example/3\r\nX: y", "short"), (2, "http://a.example/4", "short"), (4, "u", None), (5, "u", ""), (6, "ü 😀", "é" * 50),
    (8, "u", "é" * 50), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9),
    (13, "u", LONG * 12), (3, "http://a.example/2", "<p>" + "same text " * 40), (None, "u", "no id " * 40), (None, "u", "no id " * 40),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n int, digest string")


def brute(rows=PAGES):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        alike = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        again = len(raw) >= 100 and alike and i != min(alike)
        digest = hashlib.sha256(raw).hexdigest()
        out.append((i, len(raw), digest, "revisit" if again else "response", min(alike) if again else None))
    return out


def test_round_trip(spark):
    found = warc.round_trip(pages(spark)).collect()
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], brute())
    texts = {(i, html or "") for i, _, html in PAGES}
    assert all((r["page_id"], r["payload"].decode()) in texts for r in found if r["record_type"] == "response")
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert {r["url"] for r in found} == {u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in PAGES}


def test_archives_are_one_stream_and_members_are_records(spark, tmp_path):
    rows = warc.decided(pages(spark)).coalesce(1)
    archives = warc.write_archives(rows, f"{tmp_path}/streams", archive_bytes=3000)
    assert archives.count() > 1
    for r in archives.collect():
        stream = zlib.decompressobj(31)
        raw = stream.decompress(open(r["archive"], "rb").read())
        assert stream.eof and not stream.unused_data and raw.count(b"WARC-Record-ID") == r["records"]
    indexes = warc.normalise(archives, f"{tmp_path}/members")
    for r in indexes.collect():
        lines = [line.split("\t") for line in open(r["index"]).read().splitlines()]
        body, at = open(r["index"].removesuffix(".idx"), "rb").read(), 0
        for _, offset, size, record_id, kind in lines:
            assert int(offset) == at
            at += int(size)
            raw = zlib.decompress(body[int(offset) : at], wbits=31)
            assert raw.startswith(b"WARC/1.1\r\n") and record_id.encode() in raw and kind.encode() in raw and raw.endswith(b"\r\n\r\n")
        assert at == len(body)


@pytest.mark.parametrize("piece", [1, 13, 1 << 20])
def test_streams_are_inflated_by_pieces(monkeypatch, tmp_path, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    body = b"head\r\n\r\n" + b"0123456789" * 20
    path = tmp_path / "two.gz"
    path.write_bytes(zlib.compress(body, wbits=31) + zlib.compress(body, wbits=31))
    source = warc.Inflated(str(path))
    for _ in range(2):
        assert source.until(b"\r\n\r\n") == b"head\r\n\r\n"
        assert b"".join(source.pieces(200)) == b"0123456789" * 20
    assert source.until(b"\r\n\r\n") == b""


def test_broken_archives_fail(spark, tmp_path):
    archives = warc.write_archives(warc.decided(pages(spark)).coalesce(1), f"{tmp_path}/streams")
    path = archives.first()["archive"]
    raw = open(path, "rb").read()
    (tmp_path / "cut.warc.gz").write_bytes(raw[: len(raw) // 2])
    cut = written_once(spark.createDataFrame([(str(tmp_path / "cut.warc.gz"), 1)], "archive string, records long"), "cut")
    with pytest.raises(Exception, match="ends within"):
        warc.normalise(cut, f"{tmp_path}/members")


def test_empty_table(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
