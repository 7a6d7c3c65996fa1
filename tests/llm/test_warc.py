import base64
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seatflow.llm import warc


def expected(rows, least=0):
    """page_id, size, digest, kind, response by plain Python."""
    first = {}
    for page, html in sorted(((p, h or "") for p, h in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html, page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= least and first[html or ""] != page
        out.append((page, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "<p>" + "long é " * 3000), (3, "<p>" + "long é " * 3000), (9, None), (8, ""), (7, "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"),
    (11, "twice"), (11, "twice"), (12, "twice"), (2, "x" * 300), (6, "日本"),
]


@pytest.mark.parametrize("segment_bytes", [150, 8192])
@pytest.mark.parametrize("least", [0, 6])
def test_pages_come_back(spark, rows, segment_bytes, least):
    pages = rows([(p, h, "u", b"x") for p, h in ROWS], "page_id long, html string, uri string, payload binary")
    got = warc.archive_pages(pages.repartition(3), least, segment_bytes).collect()
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=repr) == expected(ROWS, least)
    assert all(r["digest_ok"] is None if r["record_type"] == "revisit" else r["digest_ok"] for r in got)


def test_no_pages(spark, rows):
    assert warc.archive_pages(rows([], "page_id long, html string")).count() == 0


def test_payloads_are_joined_from_segments(spark, rows, tmp_path):
    data = [("a", bytes(range(256)) * 50, 1), ("b", b"", 2), ("c", None, 3)]
    path = str(tmp_path / "w")
    warc.write_archives(rows(data, "uri string, payload binary, n int"), path, 1, 100, "n")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    got = {r["uri"]: bytes(r["payload"]) for r in warc.read_archives(files).collect()}
    assert got == {"a": bytes(range(256)) * 50, "b": b"", "c": b""}


@given(st.binary(max_size=20_000))
def test_chunked_framing_round_trip(data):
    assert warc.dechunked(warc.chunked(data)) == data


@pytest.mark.parametrize("bad", [b"", b"5\r\nabc", b"zz\r\nabc\r\n0\r\n\r\n", b"3\r\nabcXX0\r\n\r\n"])
def test_broken_framing(bad):
    with pytest.raises(warc.BrokenArchive):
        warc.dechunked(bad)


def segments(block, cut=40):
    records = list(warc._records(b"0-0", b"page:1", block, None, cut))
    return [warc.VERSION + r[len(warc.VERSION) :] for r in records]


@pytest.mark.parametrize("spoil", ["missing", "repeated", "no last", "short"])
def test_broken_segments(spark, rows, spoil):
    parts = segments(b"z" * 200)
    assert len(parts) > 4
    if spoil == "missing":
        del parts[2]
    elif spoil == "repeated":
        parts.insert(2, parts[2])
    elif spoil == "no last":
        del parts[-1]
    data = b"".join(p + b"\r\n\r\n" for p in parts)
    if spoil == "short":
        data = data[:-30]
    with pytest.raises(Exception, match="BrokenArchive"):
        warc.read_archives(rows([(data,)], "content binary")).collect()
