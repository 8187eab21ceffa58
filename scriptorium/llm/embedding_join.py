"""Near duplicates of embeddings by an epsilon grid order join.

Unit vectors whose cosine reaches a threshold lie within eps = sqrt(2 - 2 * threshold) of each other, and so do their
projections on any orthonormal directions. Vectors are sorted by label, then by the grid cells (of side eps) of
their projections on the leading principal directions, and the sorted sequence is cut into blocks. Nodes of a tree
over the blocks know the box that their projections fill. Pairs of intervals of the sequence are joined from
the root down: a pair is replaced by the pairs of its children, and those whose boxes are over eps apart are skipped
(`close_blocks`, one Spark join a level). Tasks go on in the same way within the pairs of blocks that are left,
down to BASE vectors, whose cosines are then told in double precision (`linked`).

The join is exact: grid, directions and boxes decide only what is skipped, and a skipped pair is provably too far
apart. Directions come from a bounded sample (SAMPLE numbers in all); a poor sample costs time, no link. What can be skipped
depends on the data: vectors that fill all directions evenly lie within eps in a few directions though they are far
apart in all, so of those nearly all blocks of a label meet, one matrix product a pair of blocks.

Equal vectors of a label are one class with a count before anything is compared. A pair of blocks gives at most one
row for each of its vectors: how many vectors it is linked with, and the least class that it reaches within the
pair; so a group of a third of all vectors makes rows by its blocks, never by its pairs. Blocks have BLOCK vectors
at most and end with a partition of the sorted sequence, in which class numbers split what lies in one cell.

Defined results: a vector with a null label, or that is null, empty, zero, or holds null or non-finite numbers, is
linked with nothing and kept; vectors of unlike length are not linked; repeated rows are vectors each, linked if
their label is not null; equal vec_ids are rows each; a null vec_id is the least of nothing: its component has the
least vec_id that is not null, or null, and it is not kept; an empty table gives no rows; columns other than vec_id, embedding and
label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.llm.memory import trimmed
from scriptorium.session import BATCH, materialize, setting, ship

#: Vectors of a block, and bytes of them; vectors below which cosines are told; blocks of a partition of the sequence.
BLOCK, BLOCK_BYTES, BASE, BLOCKS = 2048, 4 << 20, 256, 16
#: Numbers of the sample that directions are fitted on.
SAMPLE = 1 << 20
#: Binary digits of a block's place that a level of the tree takes off.
FAN = 3
#: Rows that may be broadcast, of vectors of copies.
BROADCAST_ROWS = 20_000
#: Rounding that no skip may rest on.
SLACK = 1e-9


def comparable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, length: int) -> np.ndarray:
    """Rows of unit length in double precision, scaled first so that no square overflows."""
    x = flat.reshape(-1, length).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Grid:
    """Directions by the length of vectors, `dims` each; lengths that the sample lacks take the first axes."""

    eps: float
    dims: int
    directions: dict[int, np.ndarray]

    def project(self, vectors: np.ndarray) -> np.ndarray:
        length = vectors.shape[1]
        out = np.zeros((len(vectors), self.dims))
        known = self.directions.get(length)
        part = vectors[:, : self.dims] if known is None else vectors @ known
        out[:, : part.shape[1]] = part
        return out

    def cells(self, projected: np.ndarray) -> list[bytes]:
        """Grid cells as bytes that sort as they do."""
        numbers = np.clip(np.floor(projected / self.eps), -(1 << 15), (1 << 15) - 1).astype(np.int32) + (1 << 15)
        return [row.tobytes() for row in numbers.astype(">u2")]


def fit_grid(classes: DataFrame, threshold: float, dims: int) -> Grid:
    """Principal directions of a bounded sample: the classes of least hash."""
    eps = float(np.sqrt(max(2 - 2 * threshold, 0)) + SLACK)
    widest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = classes.select("embedding").orderBy(F.xxhash64("embedding"), "class").limit(max(64, SAMPLE // widest)).toArrow().column(0)
    groups: dict[int, list[np.ndarray]] = {}
    for chunk in rows.chunks:
        for x in chunk:
            values = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            groups.setdefault(len(values), []).append(values)
    directions = {}
    for length, group in groups.items():
        x = unit(np.concatenate(group), length)
        x = x - x.mean(axis=0)
        directions[length] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims]
    return Grid(eps, dims, directions)


def classes_of(vectors: DataFrame) -> DataFrame:
    """class, label, embedding, least, n, as a written table: the distinct vectors of each label."""
    rows = vectors.where(comparable(F.col("label"), F.col("embedding"))).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return materialize(rows.withColumn("class", F.monotonically_increasing_id()), "classes")


def blocks_of(classes: DataFrame, grid: Grid) -> DataFrame:
    """label, length, part, k, classes, sizes, vectors, low, high, as a written table: the sorted sequence in blocks."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(grid)
    wide = classes.schema["embedding"].dataType.elementType.typeName() != "float"
    number = np.float64 if wide else np.float32

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, keys = batch.column(2), np.empty(batch.num_rows, object)
            flat, size = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(size) - size
            for length in np.unique(size):
                rows = np.flatnonzero(size == length)
                keys[rows] = shared.value.cells(shared.value.project(unit(flat[starts[rows][:, None] + np.arange(length)], length)))
            blobs = [flat[a : a + s].astype(number).tobytes() for a, s in zip(starts, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["class", "label", "n", "length", "cells", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        of = None

        def block() -> pa.RecordBatch:
            nonlocal made, held
            label, length = of
            ids, sizes, blobs = zip(*held, strict=True)
            p = shared.value.project(unit(np.frombuffer(b"".join(blobs), number), length))
            fields = [pa.array([label], kind), pa.array([length], pa.int32()), pa.array([part], pa.int64()), pa.array([made], pa.int64())]
            fields += [pa.array([b], pa.binary()) for b in (np.array(ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), b"".join(blobs))]
            fields += [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (p.min(axis=0), p.max(axis=0))]
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays(fields, names=names)

        for batch in batches:
            kind = batch.column(1).type
            for class_, label, n, length, _, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((label, length) != of or len(held) >= max(1, min(BLOCK, BLOCK_BYTES // len(vector)))):
                    yield block()
                of = label, length
                held.append((class_, n, vector))
        if held:
            yield block()

    label = classes.schema["label"].dataType.simpleString()
    schema = f"label {label}, length int, part bigint, k bigint, classes binary, sizes binary, vectors binary, low array<double>, high array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = classes.select("class", "label", "embedding", "n").mapInArrow(trimmed(cells), f"class bigint, label {label}, n bigint, length int, cells binary, vector binary")
    order = ["label", "length", "cells", "class"]
    return materialize(rows.repartitionByRange(-(-classes.count() // (BLOCK * BLOCKS)) or 1, *order).sortWithinPartitions(*order).mapInArrow(trimmed(cut), schema), "blocks")


def close_blocks(blocks: DataFrame, grid: Grid) -> DataFrame:
    """label, length, s, t (s <= t), as a written table: pairs of blocks whose boxes are within eps; places of `placed`."""
    boxes = placed(blocks).select("label", "length", "place", *[F.col(c)[d].alias(f"{c}{d}") for c in ("low", "high") for d in range(grid.dims)])
    last = boxes.agg(F.max("place")).first()[0]
    if last is None:
        return materialize(boxes.select("label", "length", F.col("place").alias("s"), F.col("place").alias("t")), "pairs")
    levels = -(-int(last).bit_length() // FAN)

    def nodes(level: int, side: str) -> DataFrame:
        """The boxes of a level, named for one side of a pair, under the node of the level above."""
        node = F.shiftright("place", FAN * level)
        ends = [f(f"{c}{d}").alias(f"{side}_{c}{d}") for c, f in (("low", F.min), ("high", F.max)) for d in range(grid.dims)]
        rows = boxes.groupBy("label", "length", node.alias(f"{side}_node")).agg(*ends)
        return rows.withColumn(side, F.shiftright(f"{side}_node", FAN))

    gap = F.lit(0.0)
    for d in range(grid.dims):
        apart = F.greatest(F.col(f"s_low{d}") - F.col(f"t_high{d}"), F.col(f"t_low{d}") - F.col(f"s_high{d}"), F.lit(0.0))
        gap = gap + apart * apart
    pairs = boxes.select("label", "length").distinct().select("label", "length", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    for level in reversed(range(max(levels, 1))):
        joined = pairs.join(nodes(level, "s"), ["label", "length", "s"]).join(nodes(level, "t"), ["label", "length", "t"])
        near = joined.where(((F.col("s") < F.col("t")) | (F.col("s_node") <= F.col("t_node"))) & (gap <= grid.eps**2))
        pairs = materialize(near.select("label", "length", F.col("s_node").alias("s"), F.col("t_node").alias("t")), "pairs")
    return pairs


def placed(blocks: DataFrame) -> DataFrame:
    """Blocks with their place: the partition of the sequence, then the number within it."""
    most = blocks.agg(F.max("k")).first()[0] or 0
    return blocks.withColumn("place", F.shiftleft("part", int(most).bit_length()) + F.col("k"))


def meeting(first: np.ndarray, second: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, eps: float, same: bool) -> np.ndarray:
    """Which rows of two blocks reach the threshold; p, q: their projections. Of one block with itself, those above the diagonal."""
    out = np.zeros((len(first), len(second)), bool)
    todo = [(0, len(first), 0, len(second))]
    while todo:
        a, b, c, d = todo.pop()
        if same and a >= d:
            continue
        apart = np.maximum(np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)), 0)
        if apart @ apart > eps * eps:
            continue
        if b - a <= BASE and d - c <= BASE:
            out[a:b, c:d] = first[a:b] @ second[c:d].T >= threshold
            continue
        rows = [(a, b)] if b - a <= BASE else [(a, (a + b) // 2), ((a + b) // 2, b)]
        columns = [(c, d)] if d - c <= BASE else [(c, (c + d) // 2), ((c + d) // 2, d)]
        todo += [(*r, *s) for r in rows for s in columns]
    return np.triu(out, 1) if same else out


def reached(links: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number that each row and each column reaches over links; first, second: the numbers of rows and columns."""
    most = np.iinfo(np.int64).max
    x, y = first.copy(), second.copy()
    while True:
        nx = np.minimum(x, np.where(links, y, most).min(axis=1, initial=most))
        ny = np.minimum(y, np.where(links, nx[:, None], most).min(axis=0, initial=most))
        if (nx == x).all() and (ny == y).all():
            return x, y
        x, y = nx, ny


def linked(pairs: DataFrame, blocks: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """class, least, links, as a written table: a row for each linked vector of a pair of blocks."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(grid)
    number = np.float32 if not _wide(blocks) else np.float64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, t, length, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, other, n, m = (np.frombuffer(b, "<i8") for b in blobs[:4])
                x, y = (unit(np.frombuffer(b, number), length) for b in blobs[4:])
                g = shared.value
                met = meeting(x, y, g.project(x), g.project(y), threshold, g.eps, s == t)
                if s == t:
                    met |= met.T
                rows, columns = np.flatnonzero(met.any(axis=1)), np.flatnonzero(met.any(axis=0))
                if not len(rows):
                    continue
                met = met[np.ix_(rows, columns)]
                least, least_of = reached(met, ids[rows], other[columns])
                sides = [(ids[rows], least, met @ m[columns])]
                if s != t:
                    sides.append((other[columns], least_of, n[rows] @ met))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*sides, strict=True)], names=["class", "least", "links"])

    side = lambda name: placed(blocks).select("label", "length", F.col("place").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("classes", "sizes", "vectors")])
    both = pairs.join(side("s"), ["label", "length", "s"]).join(side("t"), ["label", "length", "t"])
    both = both.select("s", "t", "length", *[f"{x}_{c}" for c in ("classes", "sizes", "vectors") for x in ("s", "t")])
    with setting(spark, BATCH, "4"):  # a row holds two blocks
        return materialize(both.mapInArrow(trimmed(work), "class bigint, least bigint, links bigint"), "linked")


def _wide(blocks: DataFrame) -> bool:
    """Whether blocks hold numbers of 64 bits."""
    row = blocks.select(F.length("vectors") / (F.length("classes") / 8) / F.col("length")).first()
    return bool(row) and row[0] == 8


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, dims: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", "embedding", "label")
    classes = classes_of(rows)
    grid = fit_grid(classes, threshold, dims)
    blocks = blocks_of(classes, grid)
    found = linked(close_blocks(blocks, grid), blocks, grid, threshold)
    parts = materialize(components(found.select(F.col("class").alias("u"), F.col("least").alias("v"))), "components")
    names = classes.select(F.col("class").alias("node"), "least").join(parts, "node").groupBy("comp").agg(F.min("least").alias("component_id"))
    names = materialize(names, "names")  # a join with a written table can be split where one component is hot
    named = materialize(parts.join(names, "comp").select(F.col("node").alias("class"), "component_id"), "named")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    told = classes.join(links, "class", "left").join(named, "class", "left").select(
        "label", "embedding", F.col("least").alias("vec_id"), "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = told.where("n = 1").select("vec_id", "n_links", "component_id")
    alone = rows.where(~comparable(F.col("label"), F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    if copies := classes.where("n > 1").count():
        several = told.where("n > 1").select("label", "embedding", "n_links", "component_id")
        several = F.broadcast(several) if copies <= BROADCAST_ROWS else materialize(several, "several")
        out = out.unionByName(rows.join(several, ["label", "embedding"]).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
