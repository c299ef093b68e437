import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from tessera.llm import archives

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("record", T.StringType()), T.StructField("digest", T.StringType())])
BODIES = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\n\nhttp://x 1.1.1.1 2000 text/html 3\n", b"", b"\xff\xfe\x00raw\r\n\r\n", b"x" * 70_000]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_arc_is_parsed_by_declared_lengths(version, pack):
    rows = [(f"http://h/{i} with space", "1.2.3.4", "19970203040506", "text/html", b) for i, b in enumerate(BODIES)]
    data = archives.arc_archive("a.arc", rows, version)
    got = list(archives.parse_arc(pack(data)))
    assert [r.body for r in got[1:]] == BODIES
    assert [r.fields["url"] for r in got[1:]] == [r[0] for r in rows]
    assert got[0].body.startswith(f"{version} 0".encode())
    assert all(data[r.offset:].startswith(r.fields["url"].encode()) for r in got)


def test_bad_archives_are_reported(spark):
    good = archives.arc_archive("a", [("u", "1.1.1.1", "2000", "text/html", b"abc")])
    rows = [("cut", good[:-3]), ("line", good + b"u 1.1.1.1 2000 text/html many\n"), ("none", None), ("empty", b""),
            ("noblock", b"u 1.1.1.1 2000 text/html 0\n"), ("fine", good)]
    out = archives.convert_arc(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r.name for r in out if r.problem} == {"cut", "line", "noblock"}
    assert sum(r.name == "fine" for r in out) == 2 and not any(r.name in ("none", "empty") for r in out)
    assert sum(r.name == "line" and r.record is not None for r in out) == 2


def test_warc_fields(spark, tmp_path):
    rows = [(f"http://h/{i}", "1.2.3.4", "199702", "image/png", b) for i, b in enumerate(BODIES)]
    arcs = spark.createDataFrame([("a.arc", archives.arc_archive("a.arc", rows, 2))], "path string, content binary")
    records = archives.convert_arc(arcs)
    archives.write_warc(records.where("problem is null"), f"{tmp_path}/w")
    back = archives.read_warc(spark, f"{tmp_path}/w").collect()
    assert [r.record_type for r in back] == ["warcinfo", "response", "resource", "resource", "resource"]
    for r, b in zip(back[1:], BODIES):
        payload = archives.split_http(b)[1]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    again = [r.record for r in records.collect()]
    assert again == [r.record for r in records.collect()]
    assert b"WARC-Date: 1997-02-01T00:00:00Z\r\n" in again[1]
    assert len({r.record_id for r in back}) == 5


def test_pages_round_trip(spark):
    big = "<p>é" + "copy " * 40
    rows = [(5, "http://a", big, "c", "c"), (3, "http://b c", big, "c", "c"), (9, None, big, "c", "c"), (1, "", "tiny", "c", "c"),
            (2, "x", "tiny", "c", "c"), (4, "x", None, "c", "c"), (6, "x", "", "c", "c"), (None, "x", big, "c", "c"),
            (7, "x", "long " * 300_000, "c", "c"), (8, "x", "\r\n\r\nWARC/1.1\r\n" * 20, "c", "c"), (11, "d", "z" * 100, "", ""),
            (11, "d", "z" * 100, "", ""), (12, "d", "z" * 100, "", ""), (13, "d", "z" * 99, "", ""), (14, "d", "z" * 99, "", "")]
    got = archives.archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    want = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = min((r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == data), default=None)
        again = i is not None and len(data) >= 100 and first < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    key = str
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert archives.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
