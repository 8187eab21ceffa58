"""Alignment of two tokenizers against the libraries and a version that looks at every pair of tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from scriptorium.llm import alignment
from scriptorium.llm.tokens import default_tokenizer

A, B = default_tokenizer(), alignment.piece_tokenizer()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows, libraries):
    a, b = libraries
    letters = {c: n for n, c in alignment.byte_letters().items()}
    docs = []
    for _, text in rows:
        ids, bytes_of = ([], []), ([], [])
        if text:
            ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            bytes_of = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids[0]], []
            for k in ids[1]:
                p = b.id_to_piece(k)
                bytes_of[1].append(bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode())
            if any(b"".join(x) != f" {text}".encode() for x in bytes_of):
                ids, bytes_of = ([], []), ([], [])
        x, y = map(spans, bytes_of)
        links = [(i, j) for i, (p, q) in enumerate(x) for j, (r, s) in enumerate(y) if p < s and r < q] if len(x) * len(y) < 400_000 else None
        cuts = sorted({q for _, q in x} & {s for _, s in y})
        groups, lo = [], 0
        for c in cuts:
            groups.append(([i for i, (_, q) in enumerate(x) if lo < q <= c], [j for j, (_, s) in enumerate(y) if lo < s <= c]))
            lo = c
        docs.append((ids, links, groups))
    count = collections.Counter(p for ids, links, _ in docs for p in {(ids[0][i], ids[1][j]) for i, j in links})
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, _), (ids, links, groups) in zip(rows, docs, strict=True):
        own = [(ids[0][i], ids[1][j]) for i, j in links]
        text = ";".join(",".join(str(ids[0][i]) for i in g) + "|" + ",".join(str(ids[1][j]) for j in h) for g, h in groups)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, count, most


def texts(seed):
    rng = random.Random(seed)
    signs = [" ", "  ", "\n", " \n", "\t", "the", "of", "ing", "Über", "naïve", "日本", "😀", "<s>", "</s>", "<|endoftext|>", "<0x41>", "\x00", "é", "1234", "'s", "...", "\xa0", "​"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return out + [None, "", " ", "  ", "a ", " a", "\n", "a▁b", "▁", "don't stop", "don't stop", "x" * 300, " " * 200, "the the the the"]


def order(r):
    return r[0] is None, r[0] or 0, r[1:]


@pytest.mark.parametrize("head, segment, tokens, held", [(1 << 20, 1 << 20, 1 << 19, 1 << 20), (40, 64, 50, 60), (0, 16, 1, 1)])
def test_against_every_pair(spark, libraries, monkeypatch, head, segment, tokens, held):
    for name, value in (("HEAD", head), ("SEGMENT", segment), ("TOKENS", tokens), ("HELD", held)):
        monkeypatch.setattr(alignment, name, value)
    rows = [*enumerate(texts(1)), (None, "no number"), (3, "three twice"), (3, "three twice")]
    want, count, most = brute(rows, libraries)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, a int, pair string").repartition(3)
    got = alignment.token_alignment(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    sizes = alignment.Sizes.of(A, B)
    pairs = alignment.mapping(alignment.tokenized(docs, A, B), sizes).collect()
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_places_of_groups_and_links(spark, libraries):
    rows = [(k, t) for k, t in enumerate(texts(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.alignments(alignment.tokenized(docs, A, B), alignment.Sizes.of(A, B)).collect()}
    pieces = [alignment.tokenizer(x).pieces for x in (A, B)]
    for k, t in rows:
        r = got[k]
        assert [x for x in (r.a_ends[-1:], r.b_ends[-1:])] == ([[len(r.a_ids)], [len(r.b_ids)]] if r.a_ids else [[], []])
        x, y = spans(pieces[0][i] for i in r.a_ids), spans(pieces[1][i] for i in r.b_ids)
        assert [x[i - 1][1] for i in r.a_ends] == [y[i - 1][1] for i in r.b_ends] == sorted({q for _, q in x} & {s for _, s in y})
        assert sorted(zip(r.link_a, r.link_b, strict=True)) == [(i, j) for i, (p, q) in enumerate(x) for j, (u, s) in enumerate(y) if p < s and u < q]
        assert t is None or not r.a_ids or b"".join(pieces[1][i] for i in r.b_ids) == f" {t}".encode()


def test_pieces_between_spaces_are_those_of_the_whole_text(spark, sf, libraries):
    own = alignment.Pieces(B)
    assert own.cut
    some = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text] + [t for t in texts(4) if t]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode([f" {t}" for t in some])] == libraries[1].encode(some)
    own.cut = False
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode([f" {t}" for t in some])] == libraries[1].encode(some)


def test_a_long_text_and_an_empty_table(spark):
    long = "lorem ipsum dolor " * 100_000
    docs = spark.createDataFrame([(1, long), (2, "z" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.token_alignment(docs, A, B).collect()}
    assert got[1].n_groups > 300_000 and got[1].n_links >= got[1].n_groups and got[2].n_groups > 0
    assert alignment.token_alignment(docs.where("doc_id = 0"), A, B).collect() == []


def test_tasks_leave_no_memo(spark, monkeypatch):
    """A worker that waits for its next task holds no words of the last one, whether that ended or was stopped."""
    works = []
    monkeypatch.setattr(alignment, "trimmed", lambda work, keeps="": works.append(work) or work)
    monkeypatch.setattr(alignment, "materialize", lambda df, label: df)
    alignment.tokenized(spark.createDataFrame([(1, "a")], "doc_id long, text string"), A, B)
    batch = alignment.pa.RecordBatch.from_pydict({"row": [1, 2], "doc_id": [1, 2], "text": ["some words", "other words"]})
    held = lambda: [m for t in (alignment.tokenizer(A), alignment.tokenizer(B)) for m in (getattr(t, "words", {}), t.chunks) if m]
    out = works[0](iter([batch, batch]))
    assert next(out).num_rows == 2 and held()
    assert next(out).num_rows == 2 and list(out) == [] and not held()
    out = works[0](iter([batch, batch]))
    next(out)
    out.close()
    assert not held()
