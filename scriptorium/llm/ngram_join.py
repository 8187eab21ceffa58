"""N-gram Jaccard join by prefix trees, and the components of its links.

A text's set is its distinct word n-grams (hashes). All sets are ordered alike: rare n-grams first, by a
sketch of how often each occurs in the corpus (counters of a fixed number, over all rows), ties by hash. Two
sets that are similar enough share an n-gram within their first n - ceil(t n) + 1, so those prefixes are what
is joined.

Work on classes, not copies: equal sets have one digest, which stands for all their documents. Then

1. n-grams that stand in the prefixes of two classes or more are found by an aggregate with partial sums, and
   only their postings are kept;
2. each such n-gram's classes are paired with two leaders, each class is verified against the two whose bitmaps
   are nearest, after exact length and bitmap bounds, and the links found give first components;
3. an n-gram with BLOCK classes or more, still of different components, puts them into a block, named by its
   least class, so that the n-grams of a group mostly name one block. The classes outside the block's largest
   component are held against all of it, in buckets, and only links that join components are kept;
4. for n-grams with fewer classes, pairs of different components that pass the length, position and bitmap
   bounds are verified. Nothing else could join two components.

`jaccard_components` needs no link inside a component; `jaccard_links` finds every link of two classes.

So a group of k near copies costs about k verified pairs and not k squared, yet every link that matters to a
component is tested, without caps. Verification builds a trie of sets, frequent n-grams first, and walks it
with each set to be held against them: a beginning that sets share is counted once, and a subtree is left when
what is counted plus what remains on the probe's side cannot reach the threshold. Both sides of a comparison
are dealt in buckets of BUCKET sets, so that no task holds a whole group.

The bitmap bound: each set has parity bits, two to four for an element and 512 at least; two sets differ in at
least as many elements as their bitmaps do in bits. A bitmap folds to fewer bits, so joins look at 512 of them
first, and only pairs that are left meet with all.

Defined results: a null text or a text without words has no set, n_shingles 0, and is its own component; fewer
words than n make one n-gram of the whole sequence; repeated rows are copies, and rows that repeat a doc_id with
other texts are documents of their own; components are named by their least doc_id (rows with null doc_id: null,
unless linked to others); a very long text has a set like any other; an empty table gives no rows; only doc_id
and text are read by `jaccard_components`, and all columns pass through `keep_one`.

Hashes: a class is named by 64 bits and held against 64 others; where two unlike sets share a name, which of a
billion classes is likely to happen once in some forty runs, all are named anew. Overlaps are counted by 40-bit
hashes beside their frequency level (56 bits where prefixes are joined), so a chance collision can raise the
overlap of a pair of sets of 200 n-grams by one in about one of 25 million pairs; that matters only to a pair
that lacks exactly one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.llm.memory import trimmed
from scriptorium.llm.textbytes import slices, splitmix, words
from scriptorium.session import discard, materialize, ship

#: The threshold as a fraction, and the words of an n-gram.
NUM, DEN = 3, 4
N = 5
SKETCH_BITS = 18
CHUNK = 4096
SIG_WORDS = 8
BROADCAST_ROWS = 300_000
#: Leaders that a class is verified against first, and sets on either side of a comparison in one bucket.
LEADERS = 2
BUCKET = 256
#: Classes of an n-gram that are held against each other as a block.
BLOCK = 256
#: How often classes may be named anew.
SALTS = 8
WANTED = ("block", "bucket", "side", "node", "comp")
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams."""
    for _, _, data, offsets in slices(texts):
        w, before = words(data, offsets, GAP)
        if len(w) >= n:
            h = w[: len(w) - n + 1].copy()
            for k in range(1, n):
                h = h * _MIX + w[k : len(w) - n + 1 + k]
            h = splitmix(h)
        else:
            h = np.zeros(0, np.uint64)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(h[a : b - n + 1])  # np.unique hashes, which takes several times as long
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                one = w[a : a + 1] + np.uint64(b - a)
                for k in range(a + 1, b):
                    one = one * _MIX + w[k : k + 1]
                yield splitmix(one)
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's name and what it is held against."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16, salt=bytes([salt])).digest())


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the count of elements at each of 512 places or more, two to four for each element."""
    places = 64 * SIG_WORDS
    while places < 2 * len(s):
        places *= 2
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (as 64-bit words) on fewer places."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def unlike(a: bytes, b: bytes) -> int:
    """In how many places two bitmaps differ, on the places of the smaller: no more than their sets do in elements."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")  # unsigned: signed numbers are counted by magnitude
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def coded(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Elements as ordered codes, ascending: a logarithm of the sketched count in the high byte, then hash bits."""
    level = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return np.sort((level << np.uint64(56)) | ((s << np.uint64(8)) >> np.uint64(8)))


def _prefix(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


NODES = "doc_id bigint, key binary, node bigint, other bigint, n int, chunk int, counts binary, bits binary, " + ", ".join(f"s{k} bigint" for k in range(SIG_WORDS))


def _nodes(docs: DataFrame, salt: int) -> DataFrame:
    """A row for each document (node: digest of its set, null where empty), and rows of the sketch (chunk, counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            rows, cells = [], []
            for doc_id, key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2)), strict=True):
                if len(s):
                    cells.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                    bits = bitmap(s)
                    rows.append((doc_id, key, *digest(s, salt), len(s), None, None, bits, *folded(np.frombuffer(bits, "<i8"), SIG_WORDS).tolist()))
                else:
                    rows.append((doc_id, key, None, None, 0, None, None, None, *([0] * SIG_WORDS)))
            if cells:
                counts += np.bincount(np.concatenate(cells), minlength=1 << SKETCH_BITS)
            yield _batch(rows)
        filled = np.minimum(counts, (1 << 32) - 1).astype("<u4")
        if filled.any():
            yield _batch([(None, None, None, None, None, k, filled[k * CHUNK : (k + 1) * CHUNK].tobytes(), None, *([None] * SIG_WORDS)) for k in range((1 << SKETCH_BITS) // CHUNK)])

    return docs.select("doc_id", "key", "text").mapInArrow(trimmed(work), NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *([pa.int64()] * SIG_WORDS)]
    names = [x.split()[0] for x in NODES.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _sketch(nodes: DataFrame) -> np.ndarray:
    """The level of each counter: what `coded` puts in the high byte. Sums are made in two steps, so no group is large."""

    def add(batch_rows):
        import pandas as pd

        total = np.zeros(CHUNK, np.uint64)
        for c in batch_rows["counts"]:
            x = np.frombuffer(c, "<u4" if len(c) == 4 * CHUNK else "<u8")
            total += x.astype(np.uint64)
        return pd.DataFrame({"chunk": [batch_rows["chunk"].iloc[0]], "counts": [total.tobytes()]})

    rows = nodes.where(F.col("chunk").isNotNull()).select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("salt"))
    some = rows.groupBy("chunk", "salt").applyInPandas(lambda p: add(p), "chunk int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in some.groupBy("chunk").applyInPandas(lambda p: add(p), "chunk int, counts binary").collect():  # 64 rows
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<u8")
    # Only what stands out of a counter's share of rare n-grams is told apart.
    mean = max(1.0, float(np.median(total)))
    return np.clip(16 * np.log2(np.maximum(total / mean, 1.0)), 0, 255).astype(np.uint64)


def _postings(docs: DataFrame, sketch, salt: int) -> DataFrame:
    """token, node, pos of every prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.value
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes, count = [], [], []
            for s in shingle_sets(batch.column(0)):
                if len(s):
                    d = digest(s, salt)[0]
                    if d in seen:  # copies met in this task give equal postings
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(d)
                    p = _prefix(len(s))
                    tokens.append(coded(s, levels)[:p])
                    nodes.append(d)
                    count.append(p)
            if not tokens:
                continue
            flat, count = np.concatenate(tokens).view(np.int64), np.array(count)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            columns = [flat, np.repeat(np.array(nodes, np.int64), count), pos.astype(np.int32)]
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "pos"])
            for at in range(0, out.num_rows, 65_536):
                yield out.slice(at, 65_536)

    return docs.select("text").mapInArrow(trimmed(work), "token bigint, node bigint, pos int")


def packed(codes: np.ndarray) -> bytes:
    """The upper six bytes of each code."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _shipped(rows: DataFrame, sketch) -> DataFrame:
    """rows of key, text and wanted (array of WANTED structs): a row of the text's set for each. Copies met in one task ship once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.value
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                rows, blobs = [], []
                for s, key, wanted in zip(shingle_sets(part.column(0)), part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if key in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    blob = packed(coded(s, levels))
                    for w in wanted:
                        rows.append(tuple(w[c] for c in WANTED))
                        blobs.append(blob)
                        if len(blobs) * len(blob) > 4 << 20:
                            yield _set_rows(rows, blobs)
                            rows, blobs = [], []
                if rows:
                    yield _set_rows(rows, blobs)

    return rows.select("text", "wanted", "key").mapInArrow(trimmed(work), "block bigint, bucket int, side int, node bigint, comp bigint, codes binary")


def _set_rows(rows: list[tuple], blobs: list[bytes]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(blobs, pa.binary())], names=[*WANTED, "codes"])


def need(n, m):
    """The least overlap of similar sets of n and m elements: 7 I >= 3 (n + m) for a threshold of 3/4."""
    return -(-(NUM * (n + m)) // (NUM + DEN))


def bounded(a: str, b: str, positions: bool) -> Column:
    """Whether rows a and b (n, s0.., and pos) may be of similar sets."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.expr(f"({NUM} * ({a}.n + {b}.n) + {NUM + DEN - 1}) div {NUM + DEN}")
    ok = (F.least(n, m) * DEN >= F.greatest(n, m) * NUM)
    ok &= F.expr(" + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(SIG_WORDS))) <= n + m - 2 * least
    if positions:
        i, j = F.col(f"{a}.pos"), F.col(f"{b}.pos")
        ok &= F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= least
    return ok


class Trie:
    """Sets of descending codes; each branch holds a run of codes, the sizes of the sets below, and those that end there."""

    __slots__ = ("run", "kids", "ends", "least")

    def __init__(self, run: np.ndarray, least: int):
        self.run, self.kids, self.ends, self.least = run, {}, [], least

    def insert(self, codes: np.ndarray, name: int) -> None:
        node, at = self, 0
        node.least = min(node.least, len(codes))
        while at < len(codes):
            kid = node.kids.get(int(codes[at]))
            if kid is None:
                kid = node.kids[int(codes[at])] = Trie(codes[at:], len(codes))
                kid.ends.append((name, len(codes)))
                return
            k = min(len(kid.run), len(codes) - at)
            unequal = np.flatnonzero(kid.run[:k] != codes[at : at + k])
            same = int(unequal[0]) if len(unequal) else k
            if same < len(kid.run):  # split the branch
                low = Trie(kid.run[same:], kid.least)
                low.kids, low.ends = kid.kids, kid.ends
                kid.run, kid.kids, kid.ends = kid.run[:same], {int(low.run[0]): low}, []
            kid.least = min(kid.least, len(codes))
            node, at = kid, at + same
        node.ends.append((name, len(codes)))

    def similar(self, probe: np.ndarray) -> list[int]:
        """Names of the sets whose overlap with the probe (descending codes) is large enough."""
        out, up, n = [], probe[::-1], len(probe)
        todo = [(self, 0)]
        while todo:
            node, common = todo.pop()
            for kid in node.kids.values():
                place = np.minimum(np.searchsorted(up, kid.run), n - 1)
                got = common + int((up[place] == kid.run).sum())
                left = int(np.searchsorted(up, kid.run[-1]))  # codes of the probe below the last of the run
                if got + left < need(n, kid.least):
                    # No set below is short enough to be reached: larger sets need more still.
                    continue
                out += [name for name, m in kid.ends if got >= need(n, m)]
                if kid.kids:
                    todo.append((kid, got))
        return out


class Joined:
    """Components that links seen so far have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _similar(rows: DataFrame, every: bool = False) -> DataFrame:
    """Links (u, v) of shipped rows that join components, or every link; within a block and bucket the probes (side 0) come before the sets of the trie."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, probes, joined, last = None, [], Joined(), None
        for batch in batches:
            block, bucket, side, node, comp = (batch.column(k).to_pylist() for k in range(5))
            codes = batch.column(5)
            us, vs, k = [], [], 0
            while k < len(node):
                here = (block[k], bucket[k])
                if here != place:
                    place, probes, joined = here, [], Joined()
                if side[k] == 0:
                    if last != (*here, node[k]):  # a set that was shipped from two tasks counts once
                        last = (*here, node[k])
                        probes.append((node[k], comp[k], unpacked(codes[k].as_buffer())[::-1]))
                    k += 1
                    continue
                trie, end = Trie(np.zeros(0, np.uint64), 1 << 31), k
                while end < len(node) and (block[end], bucket[end]) == here and end - k < BUCKET:
                    trie.insert(unpacked(codes[end].as_buffer())[::-1], end)
                    end += 1
                for name, own, probe in probes:
                    for hit in trie.similar(probe):
                        if name != node[hit] and (every or joined.joins(own, comp[hit])):
                            us.append(name)
                            vs.append(node[hit])
                k = end
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(trimmed(work), "u bigint, v bigint")


@dataclass(frozen=True)
class Prepared:
    """Documents by id and key, a row for each of them, their classes, and the postings that classes share."""

    docs: DataFrame
    nodes: DataFrame
    classes: DataFrame
    shared: DataFrame
    sketch: object
    written: DataFrame


def _prepared(docs: DataFrame) -> Prepared:
    spark = docs.sparkSession
    ship(spark)
    # A document's text is read again by its doc_id and the key of its text.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    sigs = [f"s{k}" for k in range(SIG_WORDS)]
    for salt in range(SALTS):
        rows = materialize(_nodes(docs, salt), "nodes")
        nodes = rows.where(F.col("chunk").isNull())
        classes = nodes.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min(F.struct("doc_id", "key")).alias("at"), F.first("n").alias("n"), F.first("bits").alias("bits"), *[F.first(s).alias(s) for s in sigs],
            F.min("other").alias("low"), F.max("other").alias("high"))
        written = materialize(classes, "classes")
        if written.where("low <> high").isEmpty():
            break
        discard(rows, written)
    else:
        raise RuntimeError("unlike sets share names under every salt")
    classes = written.drop("low", "high")
    sketch = spark.sparkContext.broadcast(_sketch(rows))

    # 1. N-grams in the prefixes of two classes or more, and two leaders of each: the least and the greatest class
    # under one of four orders, so that the n-grams of one large group do not all name the same leaders.
    order = F.xxhash64(F.lit("order"), F.pmod("token", F.lit(4)))
    # The postings are dealt by token once, for the aggregate and the join alike: k, a count of them, has both read all
    # columns, so that they are the same exchange and texts are cut into n-grams once. The aggregate's side of the join has at
    # most half as many rows as the postings, of fixed size, and most often few, so it is hashed and nothing is sorted.
    found = _postings(docs, sketch, salt).repartition("token")
    size = found.groupBy("token").agg(F.min(F.col("node").bitwiseXOR(order)).alias("low"), F.max(F.col("node").bitwiseXOR(order)).alias("high"), F.count("pos").alias("k"))
    size = size.where("low <> high").select("token", F.col("low").bitwiseXOR(order).alias("low"), F.col("high").bitwiseXOR(order).alias("high"), "k")
    shared = materialize(found.join(size.hint("shuffle_hash"), "token"), "shared")
    return Prepared(docs, nodes.select("doc_id", "key", "node", "n"), classes, shared, sketch, written)


def _labels(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """nodes (doc_id, key, node, n) of all documents, and comp of the nodes that are linked."""
    p = _prepared(docs)
    docs, classes, shared, sketch = p.docs, p.classes, p.shared, p.sketch

    # 2. Leaders.
    pairs = shared.select(F.col("node").alias("x"), F.explode_outer(F.array("low", "high")).alias("y")).where("x <> y")
    pairs = _bounded_pairs(pairs.distinct(), classes)
    best = pairs.groupBy("x").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y"))), 1, LEADERS).alias("best"))
    pairs = materialize(best.select("x", F.explode_outer("best").alias("b")).select(F.greatest("x", "b.y").alias("x"), F.least("x", "b.y").alias("y")).distinct(), "pairs")
    links = _verified(docs, classes, _stars(pairs), None, sketch)
    comp = None if links.isEmpty() else materialize(components(links), "components")
    members = shared.select("token", "node", "pos")
    members = members.withColumn("comp", F.col("node")) if comp is None else _with_comp(members, comp)

    # 3. and 4. What still shares an n-gram but no component: blocks, and pairs.
    groups = members.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("block"), F.count("*").alias("k"))
    groups = groups.where("low <> high").select("token", "block", (F.col("k") >= BLOCK).alias("many"))
    members = materialize(members.join(groups, "token"), "members")
    discard(shared)
    few = members.where("not many").select("token", "node", "pos", "comp").join(classes.drop("bits", "at"), "node")
    a, b = few.alias("a"), few.alias("b")
    cross = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & bounded("a", "b", True))
    cross = cross.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct().join(pairs, ["x", "y"], "left_anti")
    cross = materialize(_bounded_pairs(cross, classes).select("x", "y"), "cross")
    found = _verified(docs, classes, _stars(cross).unionByName(_blocks(members.where("many"))), comp, sketch)
    if not found.isEmpty():
        comp = components(links.unionByName(found))
    discard(pairs, cross, members, p.written)
    return p.nodes, comp


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, node, n: the class of each document and the size of its set) and links (u, v: every pair of linked classes).

    Unlike the components this takes time in proportion to the pairs of classes that share a prefix n-gram and
    pass the bounds, as its result may: copies are one class, but k unlike near copies have k (k - 1) / 2 links.
    """
    p = _prepared(docs)
    members = p.shared.select("token", "node", "pos", (F.col("k") >= BLOCK).alias("many"))
    few = members.where("not many").select("token", "node", "pos").join(p.classes.drop("bits", "at"), "node")
    a, b = few.alias("a"), few.alias("b")
    cross = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.node") > F.col("b.node")) & bounded("a", "b", True))
    cross = materialize(_bounded_pairs(cross.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct(), p.classes).select("x", "y"), "cross")
    block = members.where("many").select(F.col("token").alias("block"), "node")
    found = _verified(p.docs, p.classes, _stars(cross).unionByName(_dealt(block, block)), None, p.sketch, every=True)
    links = materialize(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    discard(p.shared, cross, found, p.written)
    return p.nodes.select("doc_id", "node", "n"), links


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _bounded_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """x, y, d of the pairs (x, y) that the length and bitmap bounds leave; d: places of the bitmaps that differ."""
    a, b = classes.drop("bits", "at").alias("a"), classes.drop("bits", "at").alias("b")
    both = pairs.join(a, F.col("a.node") == pairs["x"]).join(b, F.col("b.node") == F.col("y")).where(bounded("a", "b", False))
    both = both.select("x", "y", F.col("a.n").alias("n"), F.col("b.n").alias("m"))  # whole bitmaps meet only what is left
    both = both.join(classes.select(F.col("node").alias("x"), F.col("bits").alias("bx")), "x").join(classes.select(F.col("node").alias("y"), F.col("bits").alias("by")), "y")
    both = both.select("x", "y", "n", "m", "bx", "by")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            d = np.array([unlike(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int32)
            ok = pa.array(d <= n + m - 2 * need(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(d).filter(ok)], names=["x", "y", "d"])

    return both.mapInArrow(trimmed(work), "x bigint, y bigint, d int")


def _dealt(probes: DataFrame, others: DataFrame) -> DataFrame:
    """Rows (block, bucket, side, node) of blocks whose probes and others (block, node) meet; both are dealt into buckets of about BUCKET."""

    def share(rows: DataFrame, n: str) -> DataFrame:
        return rows.groupBy("block").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias(n))

    # Written first: a join with an aggregate in its plan cannot split a block that holds many classes.
    size = materialize(share(probes, "pn").join(share(others, "tn"), "block"), "sizes")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode_outer(F.sequence(F.lit(0), F.col(n) - 1))
    p = probes.join(size, "block").select("block", "node", "tn", own("pn").alias("p"), every("tn").alias("t"))
    t = others.join(size, "block").select("block", "node", "tn", own("tn").alias("t"), every("pn").alias("p"))
    rows = p.withColumn("side", F.lit(0)).unionByName(t.withColumn("side", F.lit(1)))
    return rows.select("block", (F.col("p") * F.col("tn") + F.col("t")).alias("bucket"), "side", "node")


def _stars(pairs: DataFrame) -> DataFrame:
    """Rows (block, bucket, side, node) of pairs (x, y): the member with more partners is the probe of a block of its own."""
    ends = pairs.select(F.explode_outer(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    a, b = ends.select(F.col("node").alias("x"), F.col("deg").alias("dx")), ends.select(F.col("node").alias("y"), F.col("deg").alias("dy"))
    first = F.struct("dy", "y") >= F.struct(F.col("dx").alias("dy"), F.col("x").alias("y"))
    turned = pairs.join(a, "x").join(b, "y").select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("node"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("block")).distinct()
    return _dealt(turned.select("block", F.col("block").alias("node")).distinct(), turned.select("block", "node"))


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (block, bucket, side, node) that hold the classes outside a block's largest component against all of the block."""
    rows = materialize(members.select("block", "node", "comp").distinct(), "blocks")
    top = rows.groupBy("block", "comp").agg(F.count("*").alias("k")).groupBy("block").agg(F.max(F.struct("k", "comp")).alias("top"))
    outside = rows.join(top.select("block", F.col("top.comp").alias("most")), "block").where("comp <> most")
    return _dealt(outside.select("block", "node"), rows.select("block", "node"))


def _verified(docs: DataFrame, classes: DataFrame, rows: DataFrame, comp: DataFrame | None, sketch, every: bool = False) -> DataFrame:
    """Links (u, v) between components, or every link, that the rows (block, bucket, side, node) find.

    One document of each class is read again, and its set goes where it is wanted. What is wanted is broadcast to
    the documents if a count has shown it small; else texts and lists are shuffled, of the wanted documents alone where these are few enough to be broadcast by id.
    """
    rows = rows.withColumn("comp", F.col("node")) if comp is None else _with_comp(rows, comp)
    wanted = rows.join(classes.select("node", "at"), "node").groupBy("at").agg(F.collect_list(F.struct(*WANTED)).alias("wanted"))
    wanted = materialize(wanted.select(F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key"), "wanted"), "wanted")
    read, few = wanted.select(F.count("*"), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    if read <= BROADCAST_ROWS < few:
        docs = docs.join(F.broadcast(wanted.select("_id", "_key")), here, "left_semi")
    sets = _shipped(docs.join(F.broadcast(wanted) if few <= BROADCAST_ROWS else wanted, here), sketch)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = sets.repartition(parts, "block", "bucket").sortWithinPartitions("block", "bucket", "side", "node")
    links = materialize(_similar(ordered, every), "links")
    discard(wanted)
    return links


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, comp of every document (comp: null without a set)."""
    nodes, comp = _labels(docs)
    return nodes.withColumn("comp", F.col("node")) if comp is None else _with_comp(nodes, comp)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    named = _named(docs)
    # Written first: a join with an aggregate in its plan cannot split a component that holds many documents.
    least = materialize(named.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = named.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: that of least doc_id (null ids last; ties: least digest of the text).

    Of rows that repeat the doc_id and the text of such a document one stays. Rows without words are linked with
    nothing and all stay.
    """
    found = materialize(_named(docs).where(F.col("comp").isNotNull()).select("comp", "doc_id", "key"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = materialize(found.groupBy("comp").agg(F.min(place).alias("first")), "firsts")
    rest = found.join(first, "comp").where(~((F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))))
    gone = materialize(rest.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone")
    again = materialize(found.groupBy("doc_id", "key").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "repeated")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    small = lambda t: F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t
    left = row.join(small(gone), here, "left_anti")
    if not again.isEmpty():
        left = left.join(small(again), here, "left_anti").unionByName(left.join(small(again), here, "left_semi").dropDuplicates(["doc_id", "key"]))
    return left.select("row.*")
