"""WARC archives: a writer with revisit records, and a splittable reader.

The writer puts every record into a gzip member of its own. The reader cuts files into byte ranges. A task looks
for gzip magic in its range, validates a candidate by inflating its first bytes and parsing the WARC version and
header lines, and owns all records whose member starts inside its range, reading past the end for the last one.
Magic bytes inside compressed data fail the validation and are passed over.

Edge cases: a null html is an empty payload; a null url gives no target URI, a null page_id no id header; pages
with equal or null ids are records of their own; an empty table gives no file and no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltra.llm.common import file_system, shared_dir, slices, staged, tidy

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."


# ---------------------------------------------------------------- records


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member that holds one record; the same record always gives the same bytes."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    return GZIP + b"\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
    return headers, rest[: int(headers.get("content-length", 0))]


def candidate(buf: bytes, at: int) -> bool | None:
    """Whether a record's member starts at ``at``; None if more bytes are needed to tell."""
    if len(buf) - at < 18:
        return None
    if buf[at + 3] & 0xE0:
        return False
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(buf[at : at + 4096], 4096)
        short = not z.eof and len(buf) - at < 4096  # more bytes may tell more
        if not head.startswith(VERSION[: len(head)]):
            return False
        first = head[len(VERSION) :].split(b"\r\n")
        if len(first) < 3 and short:
            return None
        return head.startswith(VERSION) and bool(re.fullmatch(rb"[0-9]", first[0])) and len(first) > 1 and (len(first) == 2 or b":" in first[1])
    except zlib.error:
        return False


def records(src, size: int, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record whose member starts in [start, end) of a seekable file."""
    buf, base = b"", start  # bytes from file position base on

    def more() -> bool:
        nonlocal buf
        at = base + len(buf)
        if at >= size:
            return False
        src.seek(at)
        got = src.read(min(chunk, size - at))
        buf += got
        return bool(got)

    at = 0
    while base + at < end:
        k = buf.find(GZIP, at)
        if k < 0:
            keep = max(at, len(buf) - 2)
            buf, base, at = buf[keep:], base + keep, 0
            if base >= end or not more():
                return
            continue
        if base + k >= end:
            return
        ok = candidate(buf, k)
        while ok is None and more():
            ok = candidate(buf, k)
        if not ok:
            at = k + 1
            continue
        z, out, fed = zlib.decompressobj(31), [], k
        try:
            while not z.eof:
                if fed >= len(buf) and not more():
                    break
                part = buf[fed : fed + chunk]
                fed += len(part)
                out.append(z.decompress(part))
            whole = z.eof
        except zlib.error:
            whole = False
        if not whole:  # a member that ends early or fails its checksum is no record
            at = k + 1
            continue
        headers, block = parsed(b"".join(out))
        yield base + k, headers, block
        k = fed - len(z.unused_data)
        buf, base, at = buf[k:], base + k, 0
        if not buf and not more():
            return


# ---------------------------------------------------------------- tables


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) with payload digest and size, and the page that a revisit refers to.

    Equal payloads are found by digest: a pre-aggregated minimum, written, so that the join back may split the rows of a
    common page over tasks. Payloads that are too small to be revisited take no part in it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(html.cast("binary"), 256)).withColumn("bytes", F.octet_length(html).cast("long"))
    large = p.where(F.col("bytes") >= least)
    first = staged(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to")
    marked = large.hint("merge").join(first.hint("merge"), "digest", "left").select(*p.columns, refers)
    return marked.unionByName(p.where(F.col("bytes") < least).withColumn("refers_to", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, file_bytes: int = 1 << 28) -> DataFrame:
    """Writes a record for each page and returns the list of files: path, bytes, n_records.

    Files of repeated or lost tasks have other names and are not on the list.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")

    def write(batches):
        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        out, done, name, size, n = None, [], "", 0, 0
        for b in slices(batches, 64):
            for page_id, url, html, digest, refers in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is not None and size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                payload = (html or "").encode("utf-8")
                kind = "response" if refers is None else "revisit"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                if url:
                    target = re.sub(r"\s", "%20", url)
                    headers += [("WARC-Target-URI", target)] + ([("X-Url", json.dumps(url))] if target != url else [])
                headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
                headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
                if refers is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers))]
                else:
                    headers += [("Content-Type", "text/html; charset=utf-8")]
                raw = record(headers, payload if refers is None else b"")
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "n_records"])

    return staged(revisits(pages, least).mapInArrow(tidy(write), "path string, bytes long, n_records long"), "warcfiles")


def read_archives(files: DataFrame, split_bytes: int = 1 << 23) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Digest and size of a response are those of the payload read back; a revisit carries them in its header. If fewer or
    more records are found in a file than the list has, because one is damaged, that is a ValueError.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))).alias("from"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path"]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for path, size, start in zip(b["path"].to_pylist(), b["bytes"].to_pylist(), b["from"].to_pylist(), strict=True):
                fs, at = file_system(path)
                rows = []
                with fs.open_input_file(at) as src:
                    for _, h, block in records(src, size, start, min(size, start + split_bytes)):
                        kind = h.get("warc-type")
                        full = (len(block), hashlib.sha256(block).hexdigest()) if kind == "response" else (number(h.get("x-payload-length")), h.get("warc-payload-digest", "").rpartition(":")[2])
                        url = json.loads(h["x-url"]) if "x-url" in h else h.get("warc-target-uri")
                        rows.append((number(h.get("x-page-id")), url, *full, kind, number(h.get("x-refers-to-page-id")), path))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = staged(ranges.repartition(n, "path", "from").mapInArrow(tidy(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string"), "records")
    counted = found.groupBy("path").agg(F.count("*").alias("found"))
    wrong = files.select("path", "n_records").join(counted, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("n_records")).first()
    if wrong is not None:
        raise ValueError(f"{wrong['path']} holds {wrong['found'] or 0} sound records, {wrong['n_records']} were written")
    return found.drop("path")
