"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens; whole pieces are sequences of their own, and the rest is
packed in rounds. A round deals the open pieces evenly to tasks of at most ITEMS pieces, each task packs its
pieces by best-fit decreasing, and a lower bound from dual-feasible functions certifies its count. A certified
task keeps all its bins but its emptiest; a task with a gap keeps only its full bins. What is not kept is dealt
anew, to other neighbours, in the next round; the last round has one task or is number ROUNDS, and keeps all.

Each piece says in which round its sequence was closed and whether the task that closed it was certified: only the
last round keeps bins that are not. `certificate` holds the whole packing against the same bound over all pieces,
from their histogram of lengths.

A task holds at most ITEMS rows of a few numbers, whatever the table's size. Rounds are written to the shared
folder, so that lost executors do not change bins already closed.

Defined results: a null text is empty and gives one piece with the end id; rows with equal or null doc_id are
packed each by itself; a very long text is cut into pieces like any other; an empty table gives no rows; ties in length go by doc_id, piece and checksum; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.memory import trimmed
from scriptorium.llm.tokens import encoder
from scriptorium.session import materialize, ship

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACES = "sequence_id bigint, offset bigint, round int, certified boolean"
ITEMS = 16_384
ROUNDS = 6


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of whole texts; the first piece of a long document is the one that may be shorter."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = enc.end(end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                rows = []
                for doc_id, coded in zip(ids[k : k + 256], enc.encode(texts.slice(k, 256).to_pylist()), strict=True):
                    data = np.frombuffer(coded + tail, f"<u{enc.width}").astype("<u4").tobytes()
                    n, at, no = len(data) // 4, 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        rows.append((doc_id, no, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                        at, no, size = at + size, no + 1, capacity
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(cut, keeps="encoders"), PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: the bin and the offset of each, and the room left in each bin."""
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set where a bin has r left
    where, offset, left = [], [], []
    for size in lengths:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(left), capacity
            left.append(room)
        where.append(k)
        offset.append(capacity - room)
        left[k] = room - size
        if left[k]:
            by_room[left[k]].append(k)
            rooms |= 1 << left[k]
    return where, offset, left


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(*np.unique(lengths.astype(np.int64), return_counts=True), capacity)


def bound_of(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest bound of two families of dual-feasible functions and their compositions.

    Rounding: u_k(x) is x where (k+1)x is whole, else floor((k+1)x)/k. Threshold: for e up to half, x over
    1-e counts 1, x under e counts 0. Sizes are whole numbers, so all sums are exact.
    """
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    cuts = np.unique(np.minimum(sizes, capacity - sizes))
    cuts = cuts[(cuts > 0) & (2 * cuts <= capacity)]
    for e in [0, *cuts.tolist()]:
        kept = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes)) if e else sizes
        best = max(best, -(-int((kept * counts).sum()) // capacity))
        if e in (0, *cuts[:: max(1, len(cuts) // 16)].tolist()):
            for k in range(1, 17):
                scaled = np.where((k + 1) * kept % capacity == 0, kept * k, (k + 1) * kept // capacity * capacity)
                best = max(best, -(-int((scaled * counts).sum()) // (capacity * k)))
    return best


def _round(open_pieces: DataFrame, number: int, tasks: int, capacity: int, last: bool) -> DataFrame:
    """One round; rows that stay open have a null sequence_id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = 1 + 2 * ((number << 56) + (TaskContext.get().partitionId() << 28))
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t["length"].to_numpy()
        where, offset, left = best_fit_decreasing(lengths.tolist(), capacity)
        bins, room = np.asarray(where), np.asarray(left)
        certified = len(left) == lower_bound(lengths, capacity)
        if last:
            keep = np.ones(len(left), bool)
        elif certified:
            keep = np.arange(len(left)) != int(room.argmax())
            keep |= room == 0
        else:
            keep = room == 0
        t = t.append_column("sequence_id", pa.array(base + 2 * bins, pa.int64(), mask=~keep[bins])).append_column("offset", pa.array(offset, pa.int64()))
        # Bins without room are as good as any, whatever their task's bound.
        t = t.append_column("round", pa.array([number] * len(bins), pa.int32())).append_column("certified", pa.array(certified | (room[bins] == 0)))
        yield from t.to_batches(max_chunksize=10_000)

    return open_pieces.repartition(tasks).mapInArrow(trimmed(pack), f"{PIECES}, {PLACES}")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Packed pieces of all documents: PIECES and PLACES (offsets are gapless from 0 in each sequence)."""
    ship(docs.sparkSession)
    return pack_pieces(materialize(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """cut: PIECES, read from a table, as it is read once for each round and the result."""
    whole = F.col("length") == capacity
    out = cut.where(whole).select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"), F.lit(True).alias("certified"))
    left = cut.where(~whole)
    for number in range(1, ROUNDS + 1):
        n = left.count()
        if not n:
            break
        tasks = -(-n // ITEMS)
        last = tasks == 1 or number == ROUNDS
        done = materialize(_round(left, number, tasks, capacity, last), "packed")
        out = out.unionByName(done.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left = done.where(F.col("sequence_id").isNull()).select(*cut.columns)
    return out


def certificate(packed: DataFrame, capacity: int) -> dict[str, int]:
    """bins: the sequences of a packing; bound: what no packing of these pieces can go below; gap: their difference."""
    rows = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()  # a row for each length
    bound = bound_of(np.array([r["length"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), capacity)
    bins = sum(r["first"] for r in rows)
    return {"bins": bins, "bound": bound, "gap": bins - bound}
