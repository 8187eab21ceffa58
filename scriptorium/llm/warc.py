"""WARC with a chunked record table.

`write_warc` writes gzip members, a record each, shard by shard; `read_warc` streams a shard and yields rows
(record, chunk number, bytes so far, digest so far): neither holds a whole payload beside the row that Spark
itself hands over. A chunk's digest covers the payload up to its end, so the row marked `last` has the payload's.

Payloads of at least `least` bytes that are equal are stored once: the record with the smallest page_id is the
response, the others revisit it. Which pages those are is found by an aggregate over digests with partial sums;
its result, a row for each payload that occurs twice or more, is broadcast if rows and bytes have been counted
and are few. Beyond that pages are joined to it by digest and salt, so that a payload that a third of all pages
have goes to SALTS tasks. Record ids are unique: they name the archive and the record's place in it. A revisit
names its response by address, date and page_id, as the archive that holds it is not known when it is written.

Defined results: a null html is an empty payload; payloads under `least` bytes are all responses; rows that
repeat the smallest page_id are responses each; a row with null page_id never is the first unless all of its
group are null, and then all are responses; a payload of any length is written and read in chunks; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.files import Committed, attempt_name, opened
from scriptorium.llm.memory import trimmed
from scriptorium.session import materialize, new_dir, ship

CHUNK = 64 << 10
#: What of the repeated payloads may be broadcast, and the parts that a payload's pages are dealt into beyond that.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 200_000, 32 << 20, 64
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "path string, record_no bigint, record_type string, page_id bigint, refers_to bigint, chunk_no int, bytes_so_far bigint, digest_so_far string, last boolean"


def record_id(path: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{number}')}>"


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, n, digest, first, first_url: the page that a revisit refers to (null: a response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    at = F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    firsts = p.where(F.col("n") >= least).groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    firsts = materialize(firsts.select(F.unhex("digest").alias("_d"), F.col("first.page_id").alias("_first"), F.col("first.url").alias("_url")), "firsts")
    rows, size = firsts.agg(F.count("*"), F.sum(F.octet_length("_url") + 64)).first()
    key = F.unhex("digest") == F.col("_d")
    if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        j = p.join(F.broadcast(firsts), key, "left")
    else:
        dealt = firsts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = p.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, key & (F.col("_salt") == F.col("_part")), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("_first"))
    return j.select("page_id", "url", "html", "n", "digest", F.when(other, F.col("_first")).alias("first"), F.when(other, F.col("_url")).alias("first_url"))


def _uri(url: str | None) -> str:
    return " ".join((url or "").split())


def _headers(kind: str, name: str, page_id, url, n: int, digest: str, refers, refers_url, length: int) -> bytes:
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    return ("\r\n".join(fields) + "\r\n\r\n").encode()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """path, records: a row for each shard written from rows of `plan_records`."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, out, count = f"{folder}/shard-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        try:
            for batch in batches:
                html = batch.column(2)
                for k, (page_id, url, n, digest, first, first_url) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)), strict=True)):
                    out = out or Committed(path, attempt_name())
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    response = first is None
                    out.write(z.compress(_headers("response" if response else "revisit", record_id(path, count), page_id, url, n, digest, first, first_url, len(HTTP) + n * response)))
                    out.write(z.compress(HTTP))
                    if response:
                        body = memoryview(html[k].as_buffer())
                        for at in range(0, n, CHUNK):
                            out.write(z.compress(body[at : at + CHUNK]))
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    count += 1
        except BaseException as e:
            if out is not None:
                out.__exit__(type(e), e, None)
            raise
        if out is not None:
            out.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    return records.select("page_id", "url", "html", "n", "digest", "first", "first_url").mapInArrow(trimmed(write), "path string, records bigint")


class _Plain:
    """Bytes of a file of gzip members, a block at a time."""

    def __init__(self, stream):
        self.stream, self.z, self.rest, self.buf = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        raw = self.rest or self.stream.read(CHUNK)
        if not raw:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buf += self.z.decompress(raw, CHUNK)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self._more():
                return None
        out = bytes(self.buf[:at])
        del self.buf[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self._more():
                raise ValueError("record cut short")
            part = bytes(self.buf[: min(n, CHUNK)])
            del self.buf[: len(part)]
            n -= len(part)
            if part:
                yield part


def chunks(path: str, keep: bool = False) -> Iterator[tuple]:
    """Rows of CHUNKS of one archive; with keep each has the chunk's bytes at its end."""
    store, name = opened(path)
    with store.open_input_stream(name, compression=None) as stream:
        plain, number = _Plain(stream), 0
        while (head := plain.until(b"\r\n\r\n")) is not None:
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
            of = lambda key: int(fields[key]) if key in fields else None
            length, kind = int(fields["Content-Length"]), fields["WARC-Type"]
            http = plain.until(b"\r\n\r\n")
            length -= len(http) + 4
            row = (path, number, kind, of("X-Page-ID"), of("X-Refers-To-Page-ID"))
            stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "revisit":
                yield (*row, 0, of("X-Payload-Length"), stated, True) + ((b"",) if keep else ())
            else:
                digest, done, k = hashlib.sha256(), 0, 0
                for part in plain.take(length) if length else [b""]:
                    digest.update(part)
                    done += len(part)
                    if done == length and digest.hexdigest() != stated:
                        raise ValueError(f"payload digest differs in {path}, record {number}")
                    yield (*row, k, done, digest.hexdigest(), done == length) + ((part,) if keep else ())
                    k += 1
            if b"".join(plain.take(4)) != b"\r\n\r\n":
                raise ValueError("record end is missing")
            number += 1


def read_warc(spark: SparkSession, paths: list[str], keep: bool = False) -> DataFrame:
    """The chunked record table of archives; keep adds the column `data`."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
    schema = CHUNKS + (", data binary" if keep else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for row in chunks(path, keep):
                    rows.append(row)
                    if len(rows) == (16 if keep else 2000):
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths)), "path").mapInArrow(trimmed(read), schema) if paths else spark.createDataFrame([], schema)


def archive(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    ship(spark)
    written = write_warc(plan_records(pages, least), folder or new_dir(spark, "warc")).collect()  # a row for each file
    table = read_warc(spark, sorted(r["path"] for r in written))
    return table.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
