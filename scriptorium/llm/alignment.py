"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes. np.repeat writes, for each of them, which token owns each byte; where the pair
of owners differs from that of the byte before, a new overlap of an A and a B token (a link) begins, and where both
owners change at once both have ended a token: a cut. What lies between two cuts is a group, the least run of A
tokens that spells the same as a run of B tokens. Texts are taken a slice at a time; a long text is taken in
segments between cuts, so that owner arrays stay small.

Over a corpus, `mapping` counts for each pair of ids the documents in which they are linked and marks the pairs
with the highest count of their A id. Tasks add up the pairs of their documents before they are exchanged, so a
pair that is in every document is exchanged once a task.

To look counts up, the HEAD most frequent pairs are broadcast, whose size HEAD alone bounds. The pairs beyond it
are joined with the documents' remaining links. No pair among these can be hot: HEAD pairs are at least as frequent,
so a pair of the tail has at most one part in HEAD of all links.

Token ids are written once (`tokenized`), 16 bits where they fit: a document costs about its own size.
Pieces of the second file are told between spaces where none of its pieces reaches over the space before a word
(`Pieces.cut`), with a bounded memo; any other file of this kind gets texts whole.

Defined results: a text that is null or empty, or that either tokenizer does not spell as a space and the text, has
no tokens, so zeros and an empty string; special tokens' strings are plain text; repeated rows count as documents
each, null doc_ids too; a pair counts once a document; ties for the highest count are all highest; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import memory
from scriptorium.llm.memory import trimmed
from scriptorium.llm.tokens import Encoder, Memo, byte_letters
from scriptorium.session import materialize, ship

#: Pairs that are broadcast, some 20 bytes each.
HEAD = 1 << 20
#: Bytes whose owners are told at once, tokens that are aligned at once, and distinct pairs that a task holds.
SEGMENT, TOKENS, HELD = 1 << 20, 1 << 19, 1 << 20
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"  # what pieces write for a space
CHUNK = re.compile(" *[^ ]+| +")
BYTE = re.compile("<0x([0-9A-F]{2})>")


class ByteLevel(Encoder):
    """A byte-level BPE file of the tokenizers library, special tokens read as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        tokens = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or ()
        self.added = [t["content"] for t in tokens if not t.get("special")]
        byte = {letter: b for b, letter in self.letters.items()}
        self.pieces = [b""] * (max(self.tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
        for token, k in self.tok.get_vocab(with_added_tokens=True).items():
            self.pieces[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()


class Pieces:
    """A sentencepiece file; it puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(BYTE.fullmatch(n)[1], 16)]) if self.model.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
        self.kind = "H" if len(names) <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        probe = "  a  b\t c\n "
        inner = any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names)
        self.cut = not inner and SPACE in names and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.forget()

    def forget(self) -> None:
        """Let go of the memo."""
        self.chunks = Memo(self.ask)

    def ask(self, chunk: str) -> bytes:
        """A run that begins with a space."""
        ids = self.model.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.model.piece_to_id(SPACE)]
        return array(self.kind, ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts that begin with a space."""
        chunks = self.chunks
        out = [b"" if not t else b"".join([chunks[c] for c in CHUNK.findall(t)]) if self.cut else self.ask(t) for t in texts]
        self.chunks = self.chunks.next()
        return out


_tokenizers: dict[str, ByteLevel | Pieces] = {}


def tokenizer(path: str) -> ByteLevel | Pieces:
    """One per worker and file, until a task of another kind begins; the file's name says its library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memory.kept["tokenizers"] = _tokenizers.clear
    if path not in _tokenizers:
        _tokenizers[path] = (Pieces if path.endswith(".model") else ByteLevel)(path)
    return _tokenizers[path]


def numbers(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def spelt(text: str | None, first: ByteLevel | Pieces, second: ByteLevel | Pieces, a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """The ids of a text where both spell it, else none."""
    if text:
        whole = text.encode()
        if all(b"".join([t.pieces[k] for k in numbers(x, t.width).tolist()]) == whole for t, x in ((first, a), (second, b))):
            return a, b
    return b"", b""


def tokenized(docs: DataFrame, a: str, b: str) -> DataFrame:
    """row, doc_id, a, b, as a written table: ids of both tokenizers; row tells rows of equal doc_id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizer(a), tokenizer(b)
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    texts = [f" {t}" if t else None for t in part.column(2).to_pylist()]
                    both = [spelt(*x) for x in zip(texts, [first] * len(texts), [second] * len(texts), first.encode(texts), second.encode(texts), strict=True)]
                    ids = [pa.array(x, pa.binary()) for x in zip(*both, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ids], names=["row", "doc_id", "a", "b"])
                pa.default_memory_pool().release_unused()
        finally:  # an executor may hold more workers than tasks: those that wait keep no memo
            first.forget()
            second.forget()

    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(trimmed(work, keeps="tokenizers"), "row bigint, doc_id bigint, a binary, b binary"), "tokens")


@dataclass(frozen=True)
class Sizes:
    """Of each id the bytes it spells, and how wide its ids are written; for both tokenizers."""

    a: np.ndarray
    b: np.ndarray
    width_a: int
    width_b: int

    @staticmethod
    def of(a: str, b: str) -> Sizes:
        x, y = tokenizer(a), tokenizer(b)
        lengths = lambda t: np.array([len(p) for p in t.pieces], np.int64)
        return Sizes(lengths(x), lengths(y), x.width, y.width)


def segments(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """The tokens of runs of about SEGMENT bytes that end where both tokenizers end a token."""
    total = int(ends_a[-1]) if len(ends_a) else 0
    stops = np.array([total])
    if total > SEGMENT:
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stops = np.unique(common[np.searchsorted(common, np.append(np.arange(SEGMENT, total, SEGMENT), total))])
    x = y = 0
    for stop in stops:
        u, v = int(np.searchsorted(ends_a, stop, "right")), int(np.searchsorted(ends_b, stop, "right"))
        yield slice(x, u), slice(y, v)
        x, y = u, v


@dataclass(frozen=True)
class Aligned:
    """Documents' tokens one after the other; before_a, before_b: the tokens before each document (n + 1 numbers).

    link_a, link_b: the places of linked tokens in byte order.
    """

    a: np.ndarray
    b: np.ndarray
    before_a: np.ndarray
    before_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @staticmethod
    def of(a: list[np.ndarray], b: list[np.ndarray], sizes: Sizes) -> Aligned:
        none = np.zeros(0, np.int64)
        flat_a, flat_b = (np.concatenate([none, *x]).astype(np.int64) for x in (a, b))
        before = [np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64) for each in (a, b)]
        long_a, long_b = sizes.a[flat_a], sizes.b[flat_b]
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in segments(np.cumsum(long_a), np.cumsum(long_b)):
            owner_a = np.repeat(np.arange(x.start, x.stop), long_a[x])
            owner_b = np.repeat(np.arange(y.start, y.stop), long_b[y])
            begins = np.ones(len(owner_a), bool)
            begins[1:] = (owner_a[1:] != owner_a[:-1]) | (owner_b[1:] != owner_b[:-1])
            links.append((owner_a[begins], owner_b[begins]))
        link_a, link_b = (np.concatenate([none, *x]) for x in zip(*links, strict=True)) if links else (none, none)
        return Aligned(flat_a, flat_b, *before, link_a, link_b)

    @property
    def docs(self) -> int:
        return len(self.before_a) - 1

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each link."""
        return np.repeat(np.arange(self.docs), np.diff(self.before_a))[self.link_a]

    @cached_property
    def cut(self) -> np.ndarray:
        """Whether a link begins a group: both owners have changed."""
        out = np.ones(len(self.link_a), bool)
        out[1:] = (self.link_a[1:] != self.link_a[:-1]) & (self.link_b[1:] != self.link_b[:-1])
        return out

    def pairs(self, ids_b: int) -> np.ndarray:
        """The pair of ids of each link as one number."""
        return self.a[self.link_a] * ids_b + self.b[self.link_b]

    def distinct(self, ids_a: int, ids_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links of each pair that a document has."""
        every = ids_a * ids_b
        found, n = np.unique(self.doc * every + self.pairs(ids_b), return_counts=True)
        return found // every, found % every, n

    def written(self, names_a: np.ndarray, names_b: np.ndarray) -> Iterator[bytes]:
        """The groups of each document, `a1,a2|b1;a3|b2,b3`; names: by id and whether a group's last, with what follows."""
        first_a, first_b = np.append(self.link_a[self.cut], len(self.a)), np.append(self.link_b[self.cut], len(self.b))
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[first_a[1:] - 1] = last_b[first_b[1:] - 1] = 1
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.repeat(first_b[:-1], size_a)] = names_a[self.a * 2 + last_a]
        out[np.arange(len(self.b)) + np.repeat(first_a[1:], size_b)] = names_b[self.b * 2 + last_b]
        ends = self.before_a + self.before_b
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            yield b"".join(out[x:y].tolist())[:-1]


def names(ids: int, after: bytes) -> np.ndarray:
    """Decimal ids, each with a comma and then with what follows a group's last."""
    out = np.empty(2 * ids, object)
    out[:] = [b"%d%s" % (k, end) for k in range(ids) for end in (b",", after)]
    return out


def aligned(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Slices of rows of `tokenized` of about TOKENS tokens, and their alignment."""
    for batch in batches:
        columns = [[numbers(x, w) for x in batch.column(name).to_pylist()] for name, w in (("a", sizes.width_a), ("b", sizes.width_b))]
        total, start = 0, 0
        for k in range(batch.num_rows):
            total += len(columns[0][k]) + len(columns[1][k])
            if total >= TOKENS or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), Aligned.of(columns[0][start : k + 1], columns[1][start : k + 1], sizes)
                total, start = 0, k + 1


def mapping(tokens: DataFrame, sizes: Sizes) -> DataFrame:
    """a_id, b_id, n, best, as a written table: in how many documents ids are linked, and whether no B id is linked to that A id in more."""
    ids_a, ids_b = len(sizes.a), len(sizes.b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (found // ids_b, found % ids_b, n)], names=["a_id", "b_id", "n"])

        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return found, np.bincount(place, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _, x in aligned(batches, sizes):
            parts.append(np.unique(x.distinct(ids_a, ids_b)[1], return_counts=True))
            if sum(len(p) for p, _ in parts) > HELD:
                parts = [added(parts)]
                if len(parts[0][0]) > HELD // 2:
                    yield rows(*parts.pop())
        if parts:
            yield rows(*added(parts))

    each = tokens.select("a", "b").mapInArrow(trimmed(work), "a_id bigint, b_id bigint, n bigint").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    # a part of this window has at most as many rows as B has ids
    return materialize(each.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a_id"))), "mapping")


def alignments(tokens: DataFrame, sizes: Sizes) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends, link_a, link_b: tokens up to the end of each group, and linked places."""
    kinds = {"a_ids": "array<int>", "b_ids": "array<int>", "a_ends": "array<int>", "b_ends": "array<int>", "link_a": "array<int>", "link_b": "array<int>"}

    def listed(values: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in aligned(batches, sizes):
            of_a, of_b = (np.repeat(np.arange(x.docs), np.diff(n)) for n in (x.before_a, x.before_b))
            ends = [np.append(link[x.cut], n)[1:] for link, n in ((x.link_a, len(x.a)), (x.link_b, len(x.b)))]
            group = x.doc[x.cut]
            columns = [(x.a, of_a), (x.b, of_b), (ends[0] - x.before_a[group], group), (ends[1] - x.before_b[group], group), (x.link_a - x.before_a[x.doc], x.doc), (x.link_b - x.before_b[x.doc], x.doc)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(listed(v, d, x.docs) for v, d in columns)], names=["doc_id", *kinds])

    return tokens.select("doc_id", "a", "b").mapInArrow(trimmed(work), ", ".join(["doc_id bigint", *(f"{k} {v}" for k, v in kinds.items())]))


def summaries(tokens: DataFrame, pairs: DataFrame, sizes: Sizes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of tokens; pairs: of `mapping`."""
    spark, ids_a, ids_b = tokens.sparkSession, len(sizes.a), len(sizes.b)
    head = pairs.orderBy(F.col("n").desc(), "a_id", "b_id").limit(HEAD).select((F.col("a_id") * ids_b + F.col("b_id")).alias("pair"), "n", "best").toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(head.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    whole = pairs.count() <= HEAD
    schema = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        names_a, names_b = names(ids_a, b"|"), names(ids_b, b";")
        for batch, x in aligned(batches, sizes):
            doc, pair, links = x.distinct(ids_a, ids_b)
            place = np.searchsorted(known, pair)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == pair[hit]
            place, told_of = place[hit], doc[hit]
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.written(names_a, names_b)]
            sums = [np.diff(x.before_a), np.diff(x.before_b), np.bincount(x.doc[x.cut], minlength=x.docs), np.bincount(x.doc, minlength=x.docs)]
            sums += [exact(told_of, links[hit] * weight[place], x.docs) for weight in (best, count)]
            columns = [batch.column(0), batch.column(1), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(digests, pa.string())]
            left = ~hit
            offsets = pa.array(np.searchsorted(doc[left], np.arange(x.docs + 1)).astype(np.int32))
            rest = pa.StructArray.from_arrays([pa.array(pair[left]), pa.array(links[left].astype(np.int64))], names=["pair", "links"])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, rest)], names=[*(c.split()[0] for c in schema.split(", ")), "rest"])

    told = tokens.mapInArrow(trimmed(work), f"{schema}, rest array<struct<pair:bigint,links:bigint>>")
    if whole:
        return told.drop("row", "rest")
    told = materialize(told, "told")
    tail = pairs.select((F.col("a_id") * ids_b + F.col("b_id")).alias("pair"), "n", "best")
    links = told.select("row", F.explode_outer("rest").alias("x")).where("x is not null").select("row", "x.pair", "x.links").join(tail, "pair")
    more = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum"))
    sums = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return told.drop("rest").join(more, "row", "left").withColumns(sums).drop("row", "_best", "_sum")


def exact(rows: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ascending row, without the rounding of floating numbers."""
    ends = np.searchsorted(rows, np.arange(n + 1))
    return np.diff(np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])[ends])


def piece_tokenizer() -> str:
    """Production parameter of the query: a public vocabulary of pieces that the box provides."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The summary of each document, against the mapping of all."""
    sizes, tokens = Sizes.of(a, b), tokenized(docs, a, b)
    return summaries(tokens, mapping(tokens, sizes), sizes)
