"""Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

A shard holds records in ascending document order:

    length   unsigned 64-bit          masked CRC-32C of those 8 bytes   unsigned 32-bit
    payload  `length` bytes           masked CRC-32C of the payload     unsigned 32-bit

and a payload is doc_id (signed 64-bit), width (unsigned 32-bit: 2 or 4 bytes an id), then the ids. All
numbers are little-endian. `<shard>.idx` has an (offset, doc_id) pair of signed 64-bit numbers for each
record, for shuffled reads (`read_at`) without a scan of the shard.

Texts are exchanged, not ids: ids of 16 bits take about as much room in a shuffle as compressed text does. Shards
are read as streams, a group of records at a time, so neither writing nor reading holds more than some records.

Defined results: a null text is empty and gives the end id alone; a null doc_id is written as the smallest
64-bit number and comes back null, first; repeated doc_ids are kept, ordered by text; a very long text is one
record, held whole as Spark itself holds its row; an empty table gives no shard; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from io import BufferedReader

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.crc32c import crc32c, crc32c_one, masked
from scriptorium.llm.files import Committed, attempt_name, opened, read_whole, streamed
from scriptorium.llm.memory import trimmed
from scriptorium.llm.tokens import encoder
from scriptorium.session import new_dir, ship

NO_ID = -(1 << 63)
MANIFEST = "shard int, path string, records bigint, tokens bigint, first_id bigint"
HEAD = struct.Struct("<QI")


@lru_cache(1 << 16)
def head(length: int) -> bytes:
    """A record's length and its checksum."""
    n = struct.pack("<Q", length)
    return n + struct.pack("<I", int(masked(np.array([crc32c_one(n)], np.uint32))[0]))


def frame(payloads: list[bytes]) -> list[bytes]:
    """Framed records of payloads."""
    sums = masked(crc32c(payloads)).tolist()
    return [b"".join((head(len(p)), p, struct.pack("<I", y))) for p, y in zip(payloads, sums, strict=True)]


def payload(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """ids: little-endian, `width` bytes each; stored in 16 bits where all fit."""
    if width == 4:
        wide = np.frombuffer(ids, "<u4")
        if wide.size == 0 or int(wide.max()) < 1 << 16:
            ids, width = wide.astype("<u2").tobytes(), 2
    return struct.pack("<qI", NO_ID if doc_id is None else doc_id, width) + ids


def unpack(data: bytes) -> tuple[int | None, bytes]:
    doc_id, width = struct.unpack_from("<qI", data)
    ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=12).astype("<u4").tobytes()
    return None if doc_id == NO_ID else doc_id, ids


#: Records, and bytes of them, whose checksums are told at once.
GROUP, GROUP_BYTES = 256, 4 << 20


def unframe(shard: BufferedReader) -> Iterator[bytes]:
    """Payloads of a shard, from a stream; raises ValueError where a checksum or a length is wrong."""
    payloads, sums, held, at = [], [], 0, 0
    while True:
        start = shard.read(HEAD.size)
        if start:
            n = HEAD.unpack(start)[0] if len(start) == HEAD.size else 0
            if len(start) < HEAD.size:
                raise ValueError(f"record cut short at {at}")
            if start != head(n):
                raise ValueError("checksum differs")
            data, end = shard.read(n), shard.read(4)
            if len(data) < n or len(end) < 4:
                raise ValueError(f"record cut short at {at}")
            payloads.append(data)
            sums.append(struct.unpack("<I", end)[0])
            held, at = held + n, at + 16 + n
        if payloads and (not start or len(payloads) == GROUP or held >= GROUP_BYTES):
            if masked(crc32c(payloads)).tolist() != sums:
                raise ValueError("checksum differs")
            yield from payloads
            payloads, sums, held = [], [], 0
        if not start:
            return


def read_at(path: str, offset: int) -> tuple[int | None, bytes]:
    """One record by its place in the index: what a shuffled reader does."""
    store, name = opened(path)
    with store.open_input_file(name) as f:
        start = f.read_at(HEAD.size, offset)
        n = HEAD.unpack(start)[0]
        if start != head(n):
            raise ValueError("checksum differs")
        data, y = f.read_at(n, offset + 12), struct.unpack("<I", f.read_at(4, offset + 12 + n))[0]
    if masked(crc32c([data])).tolist() != [y]:
        raise ValueError("checksum differs")
    return unpack(data)


def read_index(path: str) -> np.ndarray:
    """(offset, doc_id) rows of a shard."""
    return np.frombuffer(read_whole(f"{path}.idx"), "<i8").reshape(-1, 2)


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode and write; returns the manifest, a row for each shard (its only trip to the driver).

    A range partitioning by doc_id makes the shards consecutive, so a document's global start needs no more
    than the token counts of the shards before it. A task writes under another name and renames at its end.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        path, index, tokens, first = f"{folder}/shard-{shard:06d}.rec", [], 0, None
        tail = enc.end(end_id)
        out = None
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for k in range(0, len(ids), 256):
                    if out is None:
                        out, first = Committed(path, attempt_name()), ids[k]
                    coded = [x + tail for x in enc.encode(texts.slice(k, 256).to_pylist())]
                    for doc_id, rec in zip(ids[k : k + 256], frame([payload(i, x, enc.width) for i, x in zip(ids[k : k + 256], coded, strict=True)]), strict=True):
                        index.append((out.size, NO_ID if doc_id is None else doc_id))
                        out.write(rec)
                    tokens += sum(map(len, coded)) // enc.width
        except BaseException as e:
            if out is not None:
                out.__exit__(type(e), e, None)
            raise
        if out is not None:
            out.__exit__(None, None, None)
            with Committed(f"{path}.idx", attempt_name()) as idx:
                idx.write(np.asarray(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "records": pa.array([len(index)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "first_id": pa.array([first], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(trimmed(write, keeps="encoders"), MANIFEST)


def read_records(spark: SparkSession, manifest: list) -> DataFrame:
    """Documents of written shards with their place in the token sequence of all shards.

    manifest: rows of write_records, one for each file, collected.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"
    rows, before = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        rows.append((r["shard"], r["path"], before))
        before += r["tokens"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 4, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with streamed(path) as stream:
                    rows = []
                    for data in unframe(stream):
                        doc_id, ids = unpack(data)
                        rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), shard))
                        start += len(ids) // 4
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    files = spark.createDataFrame(rows, "shard int, path string, start bigint")
    return files.repartition(max(1, len(rows)), "shard").mapInArrow(trimmed(read), schema) if rows else spark.createDataFrame([], schema)


def tokens_to_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = docs.sparkSession
    ship(spark)
    manifest = write_records(docs, tokenizer, folder or new_dir(spark, "records"), end_id).collect()
    return read_records(spark, manifest)
