import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF_SMALL

from quarry.llm import warc as W

SCHEMA = "page_id long, url string, html string, block string, rid long"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def convert(spark, tmp_path, df, version=None, min_bytes=0):
    arc, warc = str(tmp_path / f"arc{version}{min_bytes}"), str(tmp_path / f"warc{version}{min_bytes}")
    W.write_arc(df, arc, version=version)
    W.arc_to_warc(spark, arc, warc, min_bytes=min_bytes)
    return arc, warc


@pytest.mark.parametrize("version", [1, 2, None])
@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, tmp_path, version, min_bytes):
    data = [(1, "http://a/x", "line\nline\r\n\r\nWARC/1.1\r\n"), (2, "http://a/b c\n", "same"), (3, None, "same"), (4, "", None), (5, "u", ""),
            (6, "http://z", "é\n" * 5000), (9, "http://z", "é\n" * 5000), (7, "http://q 0.0.0.0 19990101 text/html 3", "\nfiledesc://x 0 0 0 9\n"), (8, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(3)
    _, warc = convert(spark, tmp_path, df, version, min_bytes)
    got = {r.row_id: r for r in W.warc_index(spark, warc).collect()}
    assert len(got) == len(data)
    first = {}
    for i, _, h in sorted(data):
        first.setdefault((h or "").encode(), i)
    for i, _, h in data:
        p, r = (h or "").encode(), got[str(i)]
        assert (r.payload_bytes, r.payload_digest) == (len(p), b32(p))
        again = first[p] != i and len(p) >= min_bytes
        assert (r.record_type, r.refers_to) == (("revisit", str(first[p])) if again else ("response", None))
    full = {r.row_id: r.payload for r in W.read_warc(spark, warc).collect() if r.record_type == "response"}
    assert all(full[str(i)] == (h or "").encode() for i, _, h in data if str(i) in full)


def test_archives_are_well_formed(spark, tmp_path):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet").coalesce(1)
    arc, warc = convert(spark, tmp_path, df, version=2)
    text = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "arc20").glob("*.gz")))
    assert text.startswith(b"filedesc://") and b"\n2 0 quarry\nURL IP-address Archive-date Content-type Result-code" in text
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "warc20").glob("*.gz")))
    at = n = 0
    ids = set()
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        begin = at + len(head) + 4
        block = data[begin:begin + int(fields[b"Content-Length"])]
        assert head.startswith(b"WARC/1.1") and fields[b"WARC-Block-Digest"].decode() == "sha1:" + b32(block)
        at = begin + len(block) + 4
        assert data[at - 4:at] == b"\r\n\r\n"
        ids.add(fields[b"WARC-Record-ID"])
        n += 1
    assert n == len(ids) == df.count()


def records(text: bytes, file=1):
    lines = text.split(b"\n")
    if lines[-1] == b"":
        lines.pop()

    class Batch:
        def column(self, c):
            class Col:
                def to_pylist(_):
                    return [file] * len(lines) if c == "file" else lines
            return Col()
    return list(W.arc_records([Batch()]))


def test_legacy_forms():
    v1 = (b"filedesc://a 0.0.0.0 19970101000000 text/plain 70\n1 0 org\n" + b"URL IP-address Archive-date Content-type Archive-length\n".ljust(62) + b"\n"
          b"http://x/a b 1.2.3.4 1997 text/html 5\nab\ncd\ngarbage\ndns:x 1.2.3.4 19970102030405 text/dns 3\nabc\n")
    got = records(v1)
    assert [(r[2], r[5], r[6]) for r in got] == [(b"http://x/a b", b"ab\ncd", False), (b"dns:x", b"abc", False)]
    assert W.iso_date(got[0][3]) == "1997-01-01T00:00:00Z" and W.iso_date(got[1][3]) == "1997-01-02T03:04:05Z"
    cut = records(b"http://x 1.2.3.4 19970101000000 text/html 50\nabc\n")
    assert cut[0][6] is True
    long = records(b"u 1 1999 t 2\nabcdef\nv 1 1999 t 1\nz\n")          # content goes on past its declared length
    assert [r[5] for r in long] == [b"ab", b"z"]
    empty = records(b"u 1 1999 t 0\n\nv 1 1999 t 1\nz\n")
    assert [r[5] for r in empty] == [b"", b"z"]


@given(st.lists(st.binary(max_size=30).map(lambda b: b.replace(b"\0", b"\n")), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_declared_lengths_rule(blocks):
    text = b"".join(b"http://u/%d 1.1.1.1 20000101000000 text/html %d\n" % (i, len(b)) + b + b"\n" for i, b in enumerate(blocks))
    assert [(r[1], r[5], r[6]) for r in records(text)] == [(i, b, False) for i, b in enumerate(blocks)]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    _, warc = convert(spark, tmp_path, df)
    assert W.warc_index(spark, warc).count() == 0


def test_repeated_rows_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", "b", 2), (1, "a", "x", "b", 2), (None, "a", "x", "b", 2), (None, "q", "other", "b", 2)], SCHEMA)
    _, warc = convert(spark, tmp_path, df)
    rows = W.warc_index(spark, warc).collect()
    assert sorted((r.row_id or "", r.record_type, r.refers_to or "") for r in rows) == [
        ("", "response", ""), ("", "revisit", "1"), ("1", "response", ""), ("1", "revisit", "1")]
