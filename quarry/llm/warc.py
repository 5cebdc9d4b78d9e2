"""Legacy ARC archives, and their conversion to WARC.

``write_arc`` writes ARC files of version 1 or 2 (a ``filedesc`` block that
names the version and the header fields, then one record for each row).
``read_arc`` parses them: the version block fixes how many fields a header
line has, the fields are taken from the right (an URL may hold blanks), and
the declared length alone says where the content ends. ``arc_to_warc``
synthesises what ARC lacks: record ids, ISO dates, record types, payload and
block digests, and revisit records for payloads that were seen before.
``read_warc`` reads the archives back.

Archives are gzip files read line by line through Spark's text reader (any
store that Spark reads), so a task holds one record, never one archive. Two
passes over the ARC files avoid keeping a copy of the payloads: the first
takes digests only, the second builds the records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import staged

# Header definitions of the two ARC versions
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location",
        "Offset", "Filename", "Archive-length"],
}
ROW_HEADER = "X-Row-Id"
FLUSH = 8 << 20
EPOCH = "19700101000000"
_DATE = re.compile(rb"\d{4,14}")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _blocks(rows, names, kinds):
    """Record batches of a few megabytes from an iterator of (size, tuple)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= FLUSH or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def http_block(row_id, payload: bytes) -> bytes:
    """An HTTP response whose header names the row the page came from."""
    row = b"" if row_id is None else f"{ROW_HEADER}: {row_id}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\n" + row + b"Content-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def split_http(block: bytes) -> tuple[dict, bytes, bytes]:
    """(header fields, header bytes, payload); a block that is no HTTP
    message is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, block, b""
    fields = {}
    for line in block[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
    return fields, block[:end + 4], block[end + 4:]


def sha1_b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(text, default: str) -> bytes:
    """One field of an ARC header line: no blanks, line ends or nothing."""
    out = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (text or "").encode())
    return out or default.encode()


def _arc_lines(version: int | None, date: str):
    def run(batches):
        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2
        names = ARC_FIELDS[v]

        def rows():
            began = False
            for b in batches:
                for rid, url, text in zip(b.column("id").to_pylist(), b.column("url").to_pylist(),
                                          b.column("text").to_pylist(), strict=True):
                    if not began:
                        began = True
                        body = f"{v} 0 quarry\n{' '.join(names)}\n".encode()
                        yield 200, (f"filedesc://part-{part}.arc 0.0.0.0 {date} text/plain ".encode()
                                    + (b"200 - - 0 part.arc " if v == 2 else b"") + b"%d\n" % len(body) + body,)
                    block = http_block(rid, (text or "").encode())
                    head = [_token(url, "unknown:"), b"0.0.0.0", date.encode(), b"text/html"]
                    if v == 2:
                        head += [b"200", sha1_b32(block).encode(), b"-", b"0", b"part.arc"]
                    yield len(block), (b" ".join([*head, b"%d" % len(block)]) + b"\n" + block,)
        yield from _blocks(rows(), ["value"], [pa.binary()])
    return run


def write_arc(pages: DataFrame, path: str, version: int | None = None, date: str = EPOCH,
              id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """One gzip ARC file for each partition of ``pages``; version None
    alternates between the two from file to file. Null texts are empty, null
    or empty URLs ``unknown:``, blanks in URLs are percent-encoded."""
    (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("text"))
     .mapInArrow(_arc_lines(version, date), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", "gzip").text(path))


def _lines(batches):
    """(file, line without its line end) of whole files in order."""
    for b in batches:
        yield from zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True)


def _take(feed, first: bytes, need: int, end: bytes, file):
    """``need`` bytes that start with the line ``first`` and are followed by
    ``end``: (bytes, what comes after them in the last line, next (file,
    line) or None, truncated)."""
    got, size = [first], len(first) + 1
    ahead = None
    while size < need + len(end):
        nxt = next(feed, None)
        if nxt is None or nxt[0] != file:
            return b"\n".join(got)[:need], b"", nxt, size < need + 1 and need > 0
        got.append(nxt[1])
        size += len(nxt[1]) + 1
    data = b"\n".join(got) + b"\n"
    return data[:need], data[need + len(end):], ahead, False


def arc_records(batches):
    """(file, ordinal, url, date, type, block, truncated) of ARC lines. A
    record cut off by the end of its file is marked; after content that does
    not end where declared, lines are skipped up to the next header line."""
    feed = _lines(batches)
    cur = next(feed, None)
    file, fields, ordinal = None, 0, 0
    while cur is not None:
        if cur[0] != file:
            file, fields, ordinal = cur[0], 0, 0
        line = cur[1]
        if line.startswith(b"filedesc://"):
            length = int(line.rsplit(b" ", 1)[1])
            nxt = next(feed, None)
            if nxt is None or nxt[0] != file:
                cur = nxt
                continue
            body, _, cur, _ = _take(feed, nxt[1], length, b"\n", file)
            version = int(body.split(b" ", 1)[0] or b"1")
            fields = len(ARC_FIELDS[2 if version == 2 else 1])
            cur = next(feed, None) if cur is None else cur
            continue
        part = line.rsplit(b" ", (fields or 5) - 1)
        if len(part) != (fields or 5) or not part[-1].isdigit() or not _DATE.fullmatch(part[2]):
            cur = next(feed, None)                      # no header line: skip
            continue
        length = int(part[-1])
        nxt = next(feed, None)
        if nxt is None or nxt[0] != file:
            yield file, ordinal, part[0], part[2], part[3], b"", length > 0
            ordinal, cur = ordinal + 1, nxt
            continue
        block, _, after, cut = _take(feed, nxt[1], length, b"\n", file)
        yield file, ordinal, part[0], part[2], part[3], block, cut
        ordinal += 1
        cur = after if after is not None else next(feed, None)


def _arc_digests(batches):
    def rows():
        for file, n, url, date, _, block, _ in arc_records(batches):
            head, _, payload = split_http(block)
            yield 200, (file, n, head.get(ROW_HEADER.lower()), hashlib.sha256(payload).digest(), len(payload),
                        record_id(file, n, url, date, block), url.decode("latin-1"), iso_date(date))
    yield from _blocks(rows(), ["file", "ordinal", "row_id", "sha", "size", "rid", "uri", "date"],
                       [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()])


def record_id(file: int, n: int, url: bytes, date: bytes, block: bytes) -> str:
    """The same record gets the same id in every attempt of a task."""
    h = hashlib.sha256(b"%d %d " % (file, n) + url + b" " + date + b" " + hashlib.sha1(block).digest()).digest()
    return str(uuid.UUID(bytes=h[:16], version=4))


def iso_date(date: bytes) -> str:
    """YYYYMMDDhhmmss, shorter ones are the start of their period."""
    d = date.decode() + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, rid: str, date: str, uri: str, ctype: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            *extra, ("WARC-Block-Digest", f"sha1:{sha1_b32(block)}"), ("Content-Type", ctype), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("latin-1") + b"\r\n" + block


def _warc_lines(batches):
    """ARC records with the record they repeat, as WARC records."""
    cols = ["rid", "url", "date", "kind", "block", "cut", "to_rid", "to_uri", "to_date"]

    def rows():
        for b in batches:
            for rid, url, date, kind, block, cut, to, to_uri, to_date in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                head, raw, payload = split_http(block)
                extra = [("WARC-Truncated", "unspecified")] if cut else []
                extra.append(("WARC-Payload-Digest", f"sha1:{sha1_b32(payload)}"))
                uri = url.decode("latin-1")
                if to is not None:
                    extra += [("WARC-Refers-To", f"<urn:uuid:{to}>"), ("WARC-Refers-To-Target-URI", to_uri),
                              ("WARC-Refers-To-Date", to_date), ("WARC-Profile", _PROFILE)]
                    what, block = "revisit", raw
                else:
                    what = "response" if raw else "resource"
                ctype = "application/http;msgtype=response" if raw else kind.decode("latin-1")
                out = warc_record(what, rid, iso_date(date), uri, ctype, block, extra)
                yield len(out), (out,)
    yield from _blocks(rows(), ["value"], [pa.binary()])


def _arc_blocks(batches):
    def rows():
        for file, n, url, date, kind, block, cut in arc_records(batches):
            yield len(block), (file, n, url, date, kind, block, cut)
    yield from _blocks(rows(), ["file", "ordinal", "url", "date", "kind", "block", "cut"],
                       [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()])


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary").alias("line")))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, url, date, kind, block, cut) for every ARC record."""
    return _text_lines(spark, path).mapInArrow(
        _arc_blocks, "file long, ordinal long, url binary, date binary, kind binary, block binary, cut boolean")


def arc_to_warc(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Convert the ARC files under ``arc`` into gzip WARC files under
    ``warc``. Of records with equal payloads of at least ``min_bytes`` bytes
    the one of the smallest row id (numbers by value, then others, then none;
    ties by URI, date and record id) is a response, the others are revisits of
    it without payload; records that are no HTTP message become resources.
    """
    found = staged(_text_lines(spark, arc).mapInArrow(
        _arc_digests, "file long, ordinal long, row_id string, sha binary, size long, rid string, uri string, date string"), "arc-digests")
    order = F.struct(F.expr("try_cast(row_id as bigint) is null").alias("a"), F.expr("try_cast(row_id as bigint)").alias("b"),
                     F.col("row_id").isNull().alias("c"), "row_id", "uri", "date", "rid")
    first = (found.where(F.col("size") >= min_bytes).groupBy("sha", "size")
             .agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("sha", "size", F.col("o.rid").alias("to_rid"), F.col("o.uri").alias("to_uri"), F.col("o.date").alias("to_date")))
    place = (found.join(first, ["sha", "size"], "left")
             .withColumn("again", F.col("to_rid") != F.col("rid"))
             .select("file", "ordinal", "rid", *[F.expr(f"case when again then {c} end").alias(c) for c in ("to_rid", "to_uri", "to_date")]))
    (read_arc(spark, arc).join(place, ["file", "ordinal"])
     .mapInArrow(_warc_lines, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc))


def warc_records(batches):
    """(header fields, block) of WARC lines, by their declared lengths."""
    feed = _lines(batches)
    cur = next(feed, None)
    while cur is not None:
        file, line = cur
        if not line.startswith(b"WARC/"):
            cur = next(feed, None)
            continue
        fields = {}
        cur = next(feed, None)
        while cur is not None and cur[0] == file and cur[1] != b"\r":
            k, _, v = cur[1].partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("latin-1")
            cur = next(feed, None)
        nxt = next(feed, None)
        if nxt is None or nxt[0] != file:
            yield fields, b""
            cur = nxt
            continue
        block, _, after, _ = _take(feed, nxt[1], int(fields.get("content-length", 0)), b"\r\n\r\n", file)
        yield fields, block
        cur = after if after is not None else next(feed, None)


def _warc_rows(payloads: bool):
    def run(batches):
        def rows():
            for f, block in warc_records(batches):
                head, _, payload = split_http(block)
                full = f.get("warc-type") != "revisit"
                digest = sha1_b32(payload) if full else f.get("warc-payload-digest", "").removeprefix("sha1:")
                row = (head.get(ROW_HEADER.lower()), f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"),
                       f.get("warc-target-uri"), f.get("warc-date"), len(payload) if full else None, digest)
                yield (len(payload) if payloads else 0) + 200, (*row, payload if full else None) if payloads else row
        names = ["row_id", "record_type", "record_id", "refers_id", "uri", "date", "payload_bytes", "payload_digest"]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string()]
        if payloads:
            names, kinds = [*names, "payload"], [*kinds, pa.binary()]
        yield from _blocks(rows(), names, kinds)
    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files. Payload size and digest are taken from the
    payload; a revisit has no payload, and the digest of its header."""
    return _text_lines(spark, path).mapInArrow(
        _warc_rows(payloads), "row_id string, record_type string, record_id string, refers_id string, uri string, date string,"
        " payload_bytes long, payload_digest string" + (", payload binary" if payloads else ""))


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to, uri,
    date) for each record read back: revisits resolved to the row and the
    payload size of the response that they name. A payload that a third of
    all records repeat makes a hot join key, which adaptive execution splits.
    """
    rows = staged(read_warc(spark, path, payloads=False), "warc-index")
    full = rows.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_id"), F.col("row_id").alias("to_row"), F.col("payload_bytes").alias("to_bytes"))
    return (rows.join(full, "refers_id", "left")
            .select("row_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                    F.col("to_row").alias("refers_to"), "uri", "date"))
