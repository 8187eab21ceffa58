"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear machines within it.

Features are byte n-grams of one to three of the lower-cased text, as shares of the text's n-grams of that
length. Families are told apart by one-versus-one machines too, and so are the languages of a family; all are
linear support vector machines with squared hinge loss.

Families of known languages are a table; the others are put into about as many groups as the square root of
their number, by how like their n-gram shares are. So the number of machines grows with the power 1.5 of the
languages, and each has weights for the CELLS most frequent n-grams only: for a hundred languages of an unknown
kind some 35 MB are broadcast. The machines within a family are asked only about the texts of that family.

Fitting takes a bounded sample, all of whose bounds are parameters (`Limits`): so many texts of each language, those
of least hash of doc_id and text (`sampling`), so many of all languages, and the languages with most unlike texts; what
comes to the driver never has more rows. All texts are then read whole.

Defined results: a text that is null or has no letter is `und` with score 0; texts with null lang teach
nothing; null and repeated doc_ids teach like any other, copies of a row teach once; repeated rows get equal results; ties go to the language first by name; a very long text is read like
any other, alone in its slice; without any language to learn every text is `und`, with one language that one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.llm.memory import release, trimmed
from scriptorium.llm.sampling import digest, distinct_rows, least
from scriptorium.llm.textbytes import slices
from scriptorium.session import ship

#: Families of common languages.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
UND = "und"
BITS = 16
BASE = (0, 1 << 8, (1 << 8) + (1 << 16))
SIZE = BASE[2] + (1 << BITS)
#: Features that have weights: the most frequent ones of the sample.
CELLS = 16_384
#: Features of the sample that a step of the fit handles at once.
BLOCK = 1 << 17

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1), every other ASCII byte a space."""
    out = _FOLD[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that begin at each byte, for n of 1, 2, 3 (the last n - 1 places have none)."""
    x = fold(data).astype(np.uint32)
    two = (x[:-1] << 8) | x[1:]
    three = (((two[:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return [x + BASE[0], two + BASE[1], three + BASE[2]]


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit."""

    per_language: int = 700
    texts: int = 12_000
    languages: int = 256


@dataclass
class Machine:
    """Positive margins speak for `first`. weights: by column, the first of which is of the features that have none."""

    first: str
    second: str
    weights: np.ndarray
    bias: float
    scale: float


@dataclass
class Hierarchy:
    """column: the place of each feature among the weights (0: none)."""

    column: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.int16))
    families: dict[str, list[str]] = field(default_factory=dict)
    between: list[Machine] = field(default_factory=list)
    within: dict[str, list[Machine]] = field(default_factory=dict)

    def predict(self, texts: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
        names = sorted(self.families)
        if not names:
            return lang, score
        for a, b, data, offsets in slices(texts):
            columns = [np.concatenate([self.column[g], np.zeros(n, np.int16)]) for n, g in enumerate(grams(data))] if len(data) >= 3 else [np.zeros(len(data), np.int16)] * 3
            family, sure = vote(names, self.between, columns, offsets)
            for k, name in enumerate(names):
                mine = lettered[a:b] & (family == k)
                if not mine.any():
                    continue
                sizes = np.diff(offsets)
                own = [c[np.repeat(mine, sizes)] for c in columns] if self.within[name] else columns
                best, part = vote(self.families[name], self.within[name], own, np.concatenate([[0], np.cumsum(sizes[mine])]))
                lang[a:b][mine] = np.array(self.families[name], object)[best]
                score[a:b][mine] = sure[mine] * part
        return lang, np.clip(score, 0, 1)


def margin(m: Machine, columns: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """The margin of each text; columns: those of the n-grams that begin at each byte."""
    total = np.full(len(offsets) - 1, m.bias)
    for n, c in enumerate(columns):
        sums = np.concatenate([[0.0], np.cumsum(m.weights[c], dtype=np.float64)])
        ends = np.maximum(offsets[1:] - n, offsets[:-1])
        total += (sums[ends] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets) - n, 1)
    return total / m.scale


def vote(names: list[str], machines: list[Machine], columns: list[np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class that wins most pairs (ties: by summed probability, then by name) and the mean probability of its pairs."""
    n = len(offsets) - 1
    if len(names) < 2:
        return np.zeros(n, np.int64), np.ones(n)
    wins, sums = np.zeros((len(names), n)), np.zeros((len(names), n))
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(3 * margin(m, columns, offsets), -30, 30)))
        i, j = names.index(m.first), names.index(m.second)
        wins[i] += p >= 0.5
        wins[j] += p < 0.5
        sums[i] += p
        sums[j] += 1 - p
    best = np.argmax(wins + sums / (len(names) * 2), axis=0)
    return best, sums[best, np.arange(n)] / (len(names) - 1)


def grouped(means: dict[str, np.ndarray]) -> dict[str, list[str]]:
    """Families of languages: those of the table, and groups of the others by the cosine of their mean features.

    The two groups that are most alike on average are joined, as long as there are more groups than the square
    root of the languages and none would have more than twice that many.
    """
    out: dict[str, list[str]] = {}
    for lang in sorted(set(means) & set(FAMILY)):
        out.setdefault(FAMILY[lang], []).append(lang)
    rest = sorted(set(means) - set(FAMILY))
    if not rest:
        return out
    x = np.stack([means[k] / max(float(np.linalg.norm(means[k])), 1e-12) for k in rest])
    like, groups, most = x @ x.T, [[k] for k in range(len(rest))], ceil(sqrt(len(rest)))  # like: summed over the pairs of two groups
    while len(groups) > most:
        size = np.array([len(g) for g in groups])
        mean = like / np.outer(size, size)
        mean[np.tril_indices(len(groups))] = -np.inf
        mean[np.add.outer(size, size) > 2 * most] = -np.inf
        i, j = np.unravel_index(int(mean.argmax()), mean.shape)
        if mean[i, j] == -np.inf:
            break
        like[i] += like[j]
        like[:, i] += like[:, j]
        like = np.delete(np.delete(like, j, 0), j, 1)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return out | {f"like {rest[g[0]]}": [rest[k] for k in g] for g in groups}


def shares(docs: DataFrame) -> DataFrame:
    """lang, cells, counts: the n-gram counts of each text as blobs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                    own = data[x:y]
                    got = np.concatenate(grams(own)) if len(own) >= 3 else np.zeros(0, np.uint32)
                    c, n = np.unique(got, return_counts=True)
                    cells.append(c.astype("<u4").tobytes())
                    counts.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "cells", "counts"])

    return docs.select("lang", "text").mapInArrow(trimmed(work), "lang string, cells binary, counts binary")


@dataclass(frozen=True)
class Sample:
    """Languages of texts, in order, and the share of each of their n-grams among those of its length; those of text i begin at starts[i]."""

    langs: np.ndarray
    starts: np.ndarray
    cell: np.ndarray
    value: np.ndarray


def gathered(rows: Iterable[tuple[str, np.ndarray, np.ndarray]]) -> Sample:
    """rows: language, cells, counts of each text; held in few bytes, as the driver's memory is small."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: r[0])
    starts = np.cumsum([0, *(len(cells) for _, cells, _ in rows)])
    cell, value = np.empty(starts[-1], np.int32), np.empty(starts[-1], np.float32)
    for at, (_, cells, counts) in zip(starts, rows, strict=False):
        cell[at : at + len(cells)], share = cells, value[at : at + len(cells)]
        share[:] = counts
        for n in range(3):
            mine = (cells >= BASE[n]) & (cells < (BASE[n + 1] if n < 2 else SIZE))
            share[mine] /= max(float(share[mine].sum()), 1.0)
    return Sample(np.array([lang for lang, _, _ in rows], object), starts, cell, value)


@dataclass(frozen=True)
class Texts:
    """Features of some texts of one language: where each text begins and how many it has, column, scaled share."""

    starts: np.ndarray
    sizes: np.ndarray
    column: np.ndarray
    value: np.ndarray


def _runs(starts: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Texts a to b in runs of about BLOCK features, so that what a step makes of a run is small."""
    while a < b:
        end = min(b, max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK, "right")) - 1))
        yield a, end
        a = end


def _texts(sample: Sample, a: int, b: int, column: np.ndarray, spread: np.ndarray) -> Texts:
    """Texts a to b without the features that have no column, and without texts that have no others."""
    own = slice(sample.starts[a], sample.starts[b])
    c = column[sample.cell[own]]
    on = c > 0
    sizes = np.add.reduceat(on, sample.starts[a:b] - sample.starts[a], dtype=np.int64)
    sizes, c = sizes[sizes > 0], c[on]
    return Texts(np.cumsum(sizes) - sizes, sizes, c, sample.value[own][on] * spread.astype(np.float32)[c])


def train(sample: Sample, steps: int = 150) -> Hierarchy:
    h = Hierarchy()
    n = len(sample.langs)
    if not n:
        return h
    mean = np.zeros(SIZE)
    for a, b in _runs(sample.starts, 0, n):
        own = slice(sample.starts[a], sample.starts[b])
        mean += np.bincount(sample.cell[own], sample.value[own], SIZE)
    mean /= n
    used = np.sort(np.argsort(-mean, kind="stable")[:CELLS])
    used = used[mean[used] > 0]
    h.column[used] = np.arange(1, len(used) + 1)
    spread = np.concatenate([[0.0], 1 / np.sqrt(np.maximum(mean[used], 1e-5))])
    names, first = np.unique(sample.langs, return_index=True)
    texts = {k: [_texts(sample, a, b, h.column, spread) for a, b in _runs(sample.starts, x, y)] for k, x, y in zip(names, first, [*first[1:], n], strict=True)}
    texts = {k: [t for t in own if len(t.sizes)] for k, own in texts.items()}
    h.families = grouped({k: sum((np.bincount(t.column, t.value, len(spread)) for t in own), np.zeros(len(spread))) for k, own in texts.items()})
    some = lambda members: [t for k in members for t in texts[k]]
    h.between = [_machine(a, b, some(h.families[a]), some(h.families[b]), spread, steps) for a, b in combinations(sorted(h.families), 2)]
    h.within = {f: [_machine(a, b, some([a]), some([b]), spread, steps) for a, b in combinations(members, 2)] for f, members in h.families.items()}
    return h


def _machine(first: str, second: str, ours: list[Texts], theirs: list[Texts], spread: np.ndarray, steps: int) -> Machine:
    """Squared hinge with a ridge term, by accelerated gradient steps; the features are never put together, only sums of them."""
    both = [*ours, *theirs]
    ends = np.cumsum([0, *(len(t.sizes) for t in both)])
    size, n, ridge = len(spread), int(ends[-1]), 1e-4

    def by_text(w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.add.reduceat(w[t.column] * t.value, t.starts) for t in both)])

    def by_column(e: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for t, x, z in zip(both, ends[:-1], ends[1:], strict=True):
            total += np.bincount(t.column, np.repeat(e[x:z], t.sizes) * t.value, size)
        return total

    y = np.where(np.arange(n) < ends[len(ours)], 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x, norm = np.ones(size), 1.0
    for _ in range(8):
        z = by_column(weight * by_text(x))
        norm = float(np.linalg.norm(z)) / max(float(np.linalg.norm(x)), 1e-12)
        x = z / max(float(np.linalg.norm(z)), 1e-12)
    rate = 1 / (2 * (norm + 1) + ridge)
    w, b, t = np.zeros(size), 0.0, 1.0
    u, ub = w, b
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (by_text(u) + ub))
        e = -2 * weight * y * slack
        nw, nb = u - rate * (by_column(e) + ridge * u), ub - rate * e.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, ub = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    apart = np.abs(by_text(w) + b)
    return Machine(first, second, (w * spread).astype(np.float32), float(b), max(float(np.median(apart)), 1e-9))


def held_out_quarter(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """lang, text, digest: the texts to learn from, at most `per_language` of each language and `texts` in all."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", digest("langid", "doc_id", "text").alias("digest"))
    counts = distinct_rows(known, "lang").orderBy(F.col("n").desc(), "lang").limit(limits.languages).collect()
    most = min(limits.per_language, max(1, limits.texts // max(1, len(counts))))
    return least(known, "lang", {r["lang"]: (r["n"], most) for r in counts})


def fit(docs: DataFrame, limits: Limits = Limits()) -> Hierarchy:
    """docs: doc_id, text, lang of the documents to learn from."""
    ship(docs.sparkSession)
    found = sorted({(r["lang"], bytes(r["cells"]), bytes(r["counts"])) for r in shares(sampled(docs, limits)).collect()})
    parts = gathered((a, np.frombuffer(c, "<u4"), np.frombuffer(n, "<u4")) for a, c, n in found)
    del found
    model = train(parts)
    del parts
    release()  # the driver's Python lives on beside its JVM
    return model


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """All columns of docs, with lang_pred and lang_score (in place of any of these names)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    schema = StructType([docs.schema[c] for c in rest]).add("lang_pred", "string").add("lang_score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = shared.value.predict(batch.column(batch.schema.get_field_index("text")), lettered)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "lang_score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*rest, lettered.alias("_lettered")).mapInArrow(trimmed(work), schema)


def language_id(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that are not held out."""
    model = fit(docs.where(~held_out_quarter(F.col("doc_id"))), limits)
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out_quarter(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
