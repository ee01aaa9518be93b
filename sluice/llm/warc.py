"""WARC archives: writing, normalising monolithic gzip, reading back by offset (operator 6).

`monolithic` writes archives as crawlers with one gzip stream for a whole file do. `normalised`
inflates each of them once, as a stream, rewrites every record as a gzip member of its own and
notes each member's offset, length and record id in a sidecar index. `read_back` opens members by
that index alone. Archives travel as rows (name, bytes) of Parquet, which any Spark store can hold.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is the
response; the others are revisits without a body, which refer to it.

Defined cases: null html is an empty payload; a null url leaves its header out; a row with a null
page_id is never referred to, and is a response if no known page has its payload; rows with the
smallest page_id of a payload are responses even if repeated; an empty table gives no rows.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table, written

SALTS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVES = "archive string, data binary"
INDEXED = "archive string, data binary, index array<struct<offset:long,length:long,record_id:string>>"
RECORDS = "archive string, offset long, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, response or (where it refers to another page) revisit."""
    body = HTTP if refers_to is not None else HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": urn(page_id), "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Bytes": str(len(payload)), "Content-Type": "application/http; msgtype=response",
        "WARC-Refers-To": None if refers_to is None else urn(refers_to), "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Length": str(len(body)),
    }
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head.items() if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def gzip_stream(parts: Iterable[bytes], level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, parts), z.flush()])


def records_of(gz: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of a gzip file with any number of members, inflated once, a chunk at a time."""
    z, held, whole = zlib.decompressobj(31), bytearray(), None
    for i in range(0, len(gz), chunk):
        part = gz[i : i + chunk]
        while part:
            held += z.decompress(part)
            part = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)
            while True:
                if whole is None and (end := held.find(b"\r\n\r\n")) >= 0:
                    length = next(line.split(b":", 1)[1] for line in held[:end].split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    whole = end + 4 + int(length) + 4
                if whole is None or len(held) < whole:
                    break
                yield bytes(held[:whole])
                del held[:whole]
                whole = None
    if held:
        raise ValueError("the archive ends within a record")


def normalise(gz: bytes, level: int = 4) -> tuple[bytes, list[dict]]:
    """A member for each record, and the sidecar index."""
    out, at, index = [], 0, []
    for r in records_of(gz):
        out.append(gzip_stream([r], level))
        index.append({"offset": at, "length": len(out[-1]), "record_id": parse(r)[0]["WARC-Record-ID"]})
        at += len(out[-1])
    return b"".join(out), index


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. The key is hashed in Spark; a hot payload is spread over SALTS keys."""
    rows = picked(pages, "page_id", "url", "html").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    firsts = rows.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(firsts, ["sha", "salt"], "left")
    return rows.select("page_id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def monolithic(rows: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives of about so many bytes of records, each one gzip stream."""

    def write(batches):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, payload, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page_id, url, payload, to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [f"{part:05d}-{n:05d}.warc.gz"], "data": [gzip_stream(held)]})
                    n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [f"{part:05d}-{n:05d}.warc.gz"], "data": [gzip_stream(held)]})

    return rows.mapInArrow(write, ARCHIVES)


def normalised(archives: DataFrame) -> DataFrame:
    schema = pa.schema({"archive": pa.string(), "data": pa.binary(), "index": pa.list_(pa.struct({"offset": pa.int64(), "length": pa.int64(), "record_id": pa.string()}))})

    def rewrite(batches):
        for b in batches:
            for name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out, index = normalise(data)
                yield pa.RecordBatch.from_pylist([{"archive": name, "data": out, "index": index}], schema)

    return archives.mapInArrow(rewrite, INDEXED)


def read_back(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, each member opened by its place in the index."""

    def read(batches):
        for b in batches:
            for name, data, index in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = []
                for entry in index:
                    head, block = parse(zlib.decompress(data[entry["offset"] : entry["offset"] + entry["length"]], 31))
                    revisit = head["WARC-Type"] == "revisit"
                    payload = None if revisit else block[len(HTTP) :]
                    bare = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload)
                    size = int(head["X-Payload-Bytes"]) if revisit else len(payload)
                    out.append((name, entry["offset"], page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), payload, size, bare, head["WARC-Type"], page_of(head.get("WARC-Refers-To"))))
                    if len(out) == 500:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    raw = written(monolithic(revisits(pages, least)), "warc-monolithic", "none")
    return read_back(written(normalised(raw), "warc-members", "none", 1))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a monolithic archive, the normaliser and its index."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL has no base32: SHA-1's hexadecimal digits are put into bits five at a time.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s),
b AS (SELECT s, list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(s, i + 1, 1))::INT), 4, '0')), 'string_agg', '') AS bits FROM f),
d AS (SELECT s, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS digest FROM b)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (s) JOIN d USING (s)
"""
