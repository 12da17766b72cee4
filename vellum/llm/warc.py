"""WARC: an archive writer with revisit records, and a splittable reader.

Writing: each task compresses its pages, one gzip member per record, before anything is shuffled; the members are then
joined with the digests that occur more than once, and each task writes its records to one file of the shared folder.
A file counts only if its task's manifest row was committed, so repeated attempts leave nothing behind that is read.

Reading: files are cut into byte ranges. A task scans its range for gzip's magic number, accepts a candidate only if it
inflates to a WARC header, and from there follows member after member. It owns the records that start inside its range
and reads the last one past the range's end. A task holds one block of the file and one record at a time.

Equal payloads of at least ``REVISIT_BYTES``: the record with the largest id is the response, the others revisit it.
Rows that share this largest id are all responses; a null id counts as the smallest, and where all are null all are
responses. A null text is an empty payload, a null url an empty target. Digest groups are combined before the shuffle,
and the join has one row per digest on its small side, so AQE can split a hot digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.storage import Window, open_fs

#: Payloads below this size are always written in full.
REVISIT_BYTES = 1000
#: Bytes of an archive that one read task takes.
SPLIT_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, n_bytes: int, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP headers alone."""
    name = lambda x: f"<urn:x-page:{'none' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or ""), "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode(),
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + gz.flush()


def headers(lines: list[str]) -> dict[str, str]:
    """Header fields by their names in lower case; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def unchunk(body: bytes) -> bytes:
    """A payload sent in chunks; what follows a broken size stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) + body[at:]
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def digest_of(field: str | None) -> str | None:
    """The SHA-1 of a digest field, written in base 32 or 16, in hex; null for another algorithm or none."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def page_of(name: str | None) -> int | None:
    """The page in a record id of our own; null for another's."""
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def parse(raw: bytes) -> dict:
    """The fields of an inflated record of any kind and writer. A response's payload is what its HTTP message carries; of
    other records it is their block. Digests are checked where the record is one of our own."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = headers(lines)
    length = int(fields.get("content-length", len(rest)))
    kind, name, body, http = fields.get("warc-type", "").lower(), fields.get("warc-record-id"), rest[:length], {}
    if len(body) < length:
        raise ValueError(f"record {name} ends early")
    if fields.get("content-type", "").lower().startswith("application/http"):
        lead, _, body = body.partition(b"\r\n\r\n")
        http = headers(lead.decode("utf-8", "replace").split("\r\n")[1:])
        if http.get("transfer-encoding", "").lower() == "chunked":
            body = unchunk(body)
    digest, own = digest_of(fields.get("warc-payload-digest")), (name or "").startswith("<urn:x-page:")
    n_bytes = int(http["content-length"]) if http.get("content-length", "").isdigit() and (own or kind == "revisit") else len(body)
    if own and kind == "response" and (len(body) != n_bytes or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {name} does not match its headers")
    if digest is None and kind == "response":
        digest = hashlib.sha1(body).hexdigest()
    return {"page_id": page_of(name), "record_id": name, "url": fields.get("warc-target-uri"), "payload": body, "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to"))}


def inflate(window: Window, start: int) -> tuple[bytes, int]:
    """The member at ``start`` and the offset behind it."""
    gz, out, at = zlib.decompressobj(31), [], start
    while not gz.eof:
        piece = window.at(at, 1 << 14)
        if not piece:
            raise ValueError(f"archive ends inside the member at {start}")
        out.append(gz.decompress(piece))
        at += len(piece)
    return b"".join(out), at - len(gz.unused_data)


def is_member(window: Window, start: int) -> bool:
    """Whether the bytes at ``start`` inflate to the beginning of a WARC record."""
    gz, seen, at = zlib.decompressobj(31), b"", start
    try:
        while len(seen) < 7 and not gz.eof:
            piece = window.at(at, 512)
            if not piece:
                return False
            seen += gz.decompress(piece, 64)
            at += len(piece)
    except zlib.error:
        return False
    return seen.startswith(b"WARC/1.")


def first_member(window: Window, start: int, end: int) -> int | None:
    """Offset of the first record that starts in ``[start, end)``."""
    at, tail = start, b""
    while at < end + 2:
        piece = window.at(at, 1 << 16)
        if not piece:
            return None
        data, base = tail + piece, at - len(tail)
        k = data.find(MAGIC)
        while k >= 0:
            if base + k >= end:
                return None
            if is_member(window, base + k):
                return base + k
            k = data.find(MAGIC, k + 1)
        at += len(piece)
        tail = data[-2:]
    return None


def read_split(path: str, start: int, end: int, block: int = 1 << 20) -> Iterator[dict]:
    """The records that start in ``[start, end)`` of the archive."""
    fs, name = open_fs(path)
    with fs.open_input_file(name) as file:
        window = Window(file, file.size(), block)
        at = first_member(window, start, end)
        while at is not None and at < min(end, window.size):
            raw, at = inflate(window, at)
            yield parse(raw)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` to archives under ``path``; the manifest ``path, n_bytes, n_records``."""
    payload = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    known = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= REVISIT_BYTES)
    copies = known.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")

    def compress(batches):
        for b in batches:
            out = []
            for i, u, p in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                digest = hashlib.sha1(p).digest()
                out.append((i, u, digest.hex(), len(p), record(i, u, p, digest, len(p))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("member", pa.binary())])
    members = rows.mapInArrow(compress, "page_id long, url string, digest string, size long, member binary")
    marked = members.join(copies, "digest", "left").select("page_id", "url", "digest", "size", "first_id", F.when((F.col("page_id") == F.col("first_id")) | F.col("first_id").isNull(), F.col("member")).alias("member"))

    def write(batches):
        fs, folder = open_fs(path)
        name, n, size, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                data = r["member"]
                if data is None:
                    data = record(r["page_id"], r["url"], b"", bytes.fromhex(r["digest"]), r["size"], r["first_id"], True)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path + name[len(folder):]], "n_bytes": pa.array([size], pa.int64()), "n_records": pa.array([n], pa.int64())})

    return common.table(marked.mapInArrow(write, "path string, n_bytes long, n_records long"), f"{path}.manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True, split_bytes: int = SPLIT_BYTES, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """``page_id, record_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of every record of these
    kinds in the archives. ``manifest`` has the ``path`` and ``n_bytes`` of each; other writers' archives are read as well,
    their records have no page_id. Empty files have no records."""
    splits = manifest.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(common.shuffle_partitions(manifest.sparkSession), 1)
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), *[("payload", pa.binary())] * with_payload, ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for r in read_split(path, start, start + split_bytes):
                    if r["record_type"] not in kinds:
                        continue
                    held.append({k: r[k] for k in schema.names})
                    size += len(r["payload"]) if with_payload else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    names = {"int64": "long", "string": "string", "binary": "binary"}
    return splits.repartition(n, "path", "start").mapInArrow(read, ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to archives and read back from them."""
    path = common.workdir(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP4_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to, coalesce(url, '') AS url
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""
