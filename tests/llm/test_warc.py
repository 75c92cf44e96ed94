"""Archives: exact round trips, the index, and reading ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexiweight.llm import warc

SCHEMA = "page_id bigint, url string, html string, name string, first int"
ROWS = [
    (5, "http://a/x", "<p>one</p>"), (3, "http://a/y", "<p>one</p>"), (9, None, "<p>one</p>"), (4, "http://b\r\nX: y", None), (6, " http://c ", ""),
    (7, "http://d/é", "é\r\n\r\nWARC/1.1\r\n\r\n" * 3), (8, "", "x" * 300_000), (2, "http://e", "x" * 300_000), (None, "http://f", "alone"), (None, "http://g", "<p>one</p>"),
    (10, "http://h", "twice"), (10, "http://h", "twice"), (11, "http://i", "twice"),
]


def pages(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash", 1) for p, u, h in rows], SCHEMA)


def expected(rows, least=0):
    first = defaultdict(list)
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            first[payload].append(page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        to = min(first[payload], default=None) if page is not None and len(payload) >= least else None
        to = None if to == page else to
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), name, "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def columns(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(map(tuple, df.select(names).collect()), key=str)


@pytest.mark.parametrize("least", [0, 6, 10**6])
def test_round_trip(spark, least):
    assert columns(warc.round_trip(pages(spark, ROWS), least)) == expected(ROWS, least)


def test_payloads_and_files(spark, tmp_path):
    """The files are WARC: what the index says, a plain reader of gzip members finds in order."""
    index = warc.write_archives(pages(spark, ROWS).repartition(2), str(tmp_path), archive_bytes=500)
    rows = index.collect()
    assert len(rows) == len(ROWS) and len({r.archive for r in rows}) > 2
    for r in rows:
        member = open(r.archive, "rb").read()[r.offset : r.offset + r.length]
        data = gzip.decompress(member)
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and data.endswith(b"\r\n\r\n")
    for archive in {r.archive for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.archive == archive)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert gzip.decompress(open(archive, "rb").read()).count(b"WARC-Type: ") == len(own)
    texts = {r.page_id: r.payload.decode() for r in warc.read_records(index).collect() if r.payload is not None and r.page_id}
    assert texts == {p: h or "" for p, _, h in ROWS if p in (3, 4, 7, 2, 10)}


def test_selected_records_only(spark, tmp_path):
    index = warc.write_archives(pages(spark, ROWS), str(tmp_path))
    some = warc.read_records(index.filter("page_id in (3, 8)"))
    assert columns(some) == [r for r in expected(ROWS) if r[0] in (3, 8)]
    assert warc.read_records(index.filter("false")).collect() == []


def test_ranges_are_joined_across_small_gaps(spark):
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 500, 5), ("a", 990, 20), ("a", 1010, 5), ("b", 0, 3)]
    index = spark.createDataFrame(rows, "archive string, offset bigint, length bigint")
    found = sorted((r.archive, r.start, r.end, len(r.records)) for r in warc.ranges(index, range_bytes=1000, gap_bytes=5).collect())
    assert found == [("a", 0, 25, 3), ("a", 500, 505, 1), ("a", 990, 1010, 1), ("a", 1010, 1015, 1), ("b", 0, 3, 1)]


def test_broken_payload_is_noticed():
    member = warc.record(1, "u", b"abc", warc.digest(b"abd"), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_one_payload_under_most_ids(spark):
    rows = [(i, f"http://x/{i}", "same" if i % 3 else f"other {i}") for i in range(600)]
    found = warc.round_trip(pages(spark, rows).repartition(4))
    assert columns(found) == expected(rows)
    assert found.filter(F.col("refers_to") != 1).isEmpty()
