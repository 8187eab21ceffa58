"""Media columns: Ogg. Pages with checksums, packets from lacing values, logical streams, granule timestamps.

`mux` lays packets of several logical streams into pages; `demux` verifies each page's checksum, splits the
pages by serial number, joins packets across pages and gives each page's granule position to the last packet
that ends in it. A page whose checksum fails or whose number is missing drops the packets that it breaks, and
is counted.

The stored form of a payload of 8-bit samples has two logical streams: the samples in packets of BLOCK, with
the count of samples so far as granule position, and an envelope packet (lowest, highest, sum) for each block.

Defined results: a null text is an empty payload padded to one unit; equal texts have equal stored forms;
repeated rows give repeated rows, whether they share a doc_id or not; pages with equal granule positions go by
serial number, then by their place in the stream; a text of any length is one payload of many pages, held whole
as Spark holds its row; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.memory import trimmed
from scriptorium.session import ship

PAGE = struct.Struct("<4sBBqIII B")
CONTINUED, FIRST, LAST = 1, 2, 4
BLOCK = 4000
RATE = 8000
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, no reflection, register from zero) by way of zlib's reflected one."""
    reg = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reg.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", checksum(bare)) + bare[26:]


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; packets are (data, granule at their end). The first has a page to itself."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, went_on = bytearray(), [], -1, False
    flush_after = {0, len(packets) - 1}
    number = 0

    def flush(end: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, went_on, number
        flags = CONTINUED * went_on | FIRST * (number == 0) | LAST * end
        out.append((granule, _page(flags, granule, serial, number, bytes(lacing), b"".join(body))))
        lacing, body, granule, went_on, number = bytearray(), [], -1, goes_on, number + 1

    for i, (data, at) in enumerate(packets):
        values, pos = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255]), 0
        while values:
            if len(lacing) == 255:
                flush(False, pos > 0)
            part, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            size = sum(part)
            lacing += part
            body.append(data[pos : pos + size])
            pos += size
        granule = at
        if i in flush_after:
            flush(i == len(packets) - 1, False)
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: first pages first, then by granule position, ties by serial number."""
    every = []
    for serial, packets in streams.items():
        reached = 0
        for k, (granule, page) in enumerate(pages_of(packets, serial)):
            reached = max(reached, granule)
            every.append((k > 0, reached, serial, k, page))
    return b"".join(x[-1] for x in sorted(every, key=lambda x: x[:-1]))


@dataclass
class Stream:
    """A logical stream as read: packets, the granule position at the end of each (-1: none given), and what broke."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _next: int = 0
    _open: list[bytes] | None = None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != self._next:
            self.lost += max(1, number - self._next)
            self._open = None
        self.pages, self._next, self.ended = self.pages + 1, number + 1, bool(flags & LAST)
        skip = bool(flags & CONTINUED) and self._open is None  # the start of this packet is lost
        if not flags & CONTINUED:
            self._open = None
        parts, at, last = self._open or [], 0, None
        for v in lacing:
            parts.append(body[at : at + v])
            at += v
            if v < 255:
                if not skip:
                    last = len(self.packets)
                    self.packets.append(b"".join(parts))
                    self.granules.append(-1)
                parts, skip = [], False
        self._open = parts if lacing and lacing[-1] == 255 and not skip else None
        if last is not None:
            self.granules[last] = granule


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages had a wrong checksum."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while (at := data.find(b"OggS", at)) >= 0 and at + PAGE.size <= len(data):
        _, _, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
        lacing = data[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        page = data[at:end]
        if len(lacing) < n or end > len(data) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        streams.setdefault(serial, Stream()).add(flags, granule, number, lacing, page[PAGE.size + n :])
        at = end
    return streams, bad


def store(payload: bytes) -> bytes:
    """8-bit samples as an Ogg file."""
    serial = zlib.crc32(payload)
    samples = [(b"\x01pcm8" + struct.pack("<IQ", RATE, len(payload)), 0)]
    envelope = [(b"\x02env8" + struct.pack("<I", BLOCK), 0)]
    for at in range(0, len(payload), BLOCK):
        part = payload[at : at + BLOCK]
        end = at + len(part)
        samples.append((part, end))
        envelope.append((struct.pack("<BBI", min(part), max(part), sum(part)), end))
    return mux({serial: samples, serial ^ 0xFFFFFFFF: envelope})


def load(data: bytes) -> tuple[bytes, str]:
    """The samples of a stored file and features of its streams; raises ValueError where it is damaged."""
    streams, bad = demux(data)
    kinds = {s.packets[0][:5]: s for s in streams.values() if s.packets}
    pcm, env = kinds.get(b"\x01pcm8"), kinds.get(b"\x02env8")
    if bad or pcm is None or env is None or pcm.lost or env.lost or not (pcm.ended and env.ended):
        raise ValueError("damaged Ogg file")
    rate, size = struct.unpack_from("<IQ", pcm.packets[0], 5)
    payload = b"".join(pcm.packets[1:])
    if len(payload) != size or pcm.granules[-1] != size:
        raise ValueError("samples are missing")
    low, high, total = (min, max, sum)
    rows = [struct.unpack("<BBI", p) for p in env.packets[1:]]
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    values = {
        "streams": len(streams), "pages": pcm.pages + env.pages, "packets": len(pcm.packets) + len(env.packets),
        "duration_us": pcm.granules[-1] * 1_000_000 // rate, "min": low(r[0] for r in rows), "max": high(r[1] for r in rows),
        "sum": total(r[2] for r in rows), "energy": int((x * x).sum()), "crossings": crossings,
    }
    return payload, ";".join(f"{k}={v}" for k, v in values.items())


OUT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def ogg_texts(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Store every whole text as an Ogg file, read the stored bytes back, and describe what was read."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                media = store(raw + b"\0" * (-len(raw) % unit or unit * (not raw)))
                back, feature = load(media)
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-unit:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(work), OUT)


def ogg_columns(media: DataFrame, column: str) -> DataFrame:
    """Adds streams, pages, bad_pages, packets and last_granule of each Ogg file in a binary column (null: nulls)."""
    ship(media.sparkSession)
    kind = "streams int, pages int, bad_pages int, packets int, last_granule bigint"

    @F.pandas_udf(kind)
    def describe(values):
        import pandas as pd

        rows = []
        for data in values:
            if data is None:
                rows.append((None,) * 5)
                continue
            streams, bad = demux(data)
            rows.append((len(streams), sum(s.pages for s in streams.values()), bad, sum(len(s.packets) for s in streams.values()), max((g for s in streams.values() for g in s.granules), default=None)))
        return pd.DataFrame(rows, columns=["streams", "pages", "bad_pages", "packets", "last_granule"])

    return media.withColumn("ogg", describe(F.col(column)))
