"""WARC archives: a writer of gzip-per-record files and a splittable reader.

The reader's tasks each scan a byte range for gzip magic. A candidate is a member only if its decoded start is a WARC
header and its checksum holds; a record belongs to the range that it starts in, so ranges can be cut anywhere and
a task reads past its end only to finish its last record.

Defined results: null html counts as an empty payload; null page_id or url are written as such and read back as
null; of rows repeated whole, one is the response. An empty table gives no archive and no records. A damaged record is an
error. Extra columns are ignored. Files are reached by pyarrow's filesystems (file, hdfs, s3, gs); each task writes a file
of its own name, and only files of tasks that ended well are in the manifest, so lost executors leave no double records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import scratch

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, with the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _urn(page_id, rid) -> str:
    return f"urn:page:{'null' if pd.isna(page_id) else int(page_id)}:{int(rid)}"


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page; of equal payloads of ``min_bytes`` or more, the smallest page_id's is the response and others
    revisit it. Returns the manifest, path and bytes of each file, as a written table."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("rid", F.monotonically_increasing_id()).withColumn("sha", F.sha1("payload"))
    first = base.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("first"))
    rows = base.join(first, "sha", "left").select("page_id", "url", "payload", "rid", "sha", F.col("first.page_id").alias("first_page"), F.col("first.rid").alias("first_rid"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = _open(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz")
        out, n = None, 0
        for batch in batches:
            for page_id, url, payload, rid, sha, first_page, first_rid in batch.itertuples(index=False, name=None):
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                own = pd.isna(first_rid) or int(first_rid) == int(rid)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.write(got := record("response" if own else "revisit", _urn(page_id, rid), url, digest, bytes(payload), None if own else _urn(first_page, first_rid)))
                n += len(got)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rpartition('/')[2]}"], "bytes": [n]})

    # Ids and rids pass through pandas as nullable integers, never as floats.
    safe = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "rid", "first_page", "first_rid")})
    return scratch.table(safe.mapInPandas(write, "path string, bytes long"), "manifest")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut short")
    return headers, rest[:n]


def members(file, size: int, start: int, end: int, step: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each WARC member that starts in [start, end)."""
    data = file.read_at(min(end + len(MAGIC) - 1, size) - start, start)
    at = data.find(MAGIC)
    while 0 <= at < end - start:
        z, head, pos = zlib.decompressobj(31), b"", start + at
        try:
            chunk = data[at : at + 4096]
            if len(chunk) < 4096:
                chunk = file.read_at(min(4096, size - pos), pos)
            head = z.decompress(chunk, 64)
        except zlib.error:
            head = b""
        if not head.startswith(b"WARC/"):
            at = data.find(MAGIC, at + 1)
            continue
        parts, pos = [head, z.decompress(z.unconsumed_tail)], pos + len(chunk)
        while not z.eof:
            if pos >= size:
                raise ValueError("a WARC record is cut short")
            chunk = file.read_at(min(step, size - pos), pos)
            parts.append(z.decompress(chunk))
            pos += len(chunk)
        yield start + at, b"".join(parts)
        at = pos - len(z.unused_data) - start
        at = data.find(MAGIC, at) if at < len(data) else -1


SCHEMA = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of ``files`` (path, bytes), a row each. Digests of responses are computed anew from what was read."""
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start"))
    count = files.agg(F.sum(F.expr(f"(bytes + {range_bytes - 1}) div {range_bytes}"))).first()[0] or 1

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start in batch.itertuples(index=False, name=None):
                fs, local = _open(path)
                rows = []
                with fs.open_input_file(local) as file:
                    for offset, raw in members(file, int(size), int(start), min(int(start) + range_bytes, int(size))):
                        h, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, n = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(payload)
                        if h.get("warc-type") == "revisit":
                            found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            n, payload = int(found[1]) if found else None, None
                        elif h.get("warc-type") == "response":
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        rows.append((path, offset, h.get("warc-record-id", "").strip("<>"), h.get("warc-type"), h.get("warc-target-uri"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, digest, n, payload if with_payload else None))
                        if len(rows) == 200:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return ranges.repartition(min(int(count), 100_000), "path", "start").mapInPandas(read, SCHEMA)


def page_of(urn: str) -> F.Column:
    return F.expr(f"try_cast(split_part({urn}, ':', 3) AS bigint)")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from its archive."""
    spark = pages.sparkSession
    scratch.small_batches(spark)
    manifest = write_warc(pages, scratch.new_folder(spark, "warc"), min_bytes)
    found = read_warc(spark, manifest, with_payload=False)
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS n, html, array_to_string(list_transform(string_split(sha1(html), ''),
  lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits,
  row_number() OVER (PARTITION BY html ORDER BY page_id) AS r, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN substr(bits, 5 * i::INT + k::INT, 1) = '1' THEN 2 ** (5 - k) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to FROM d
"""
