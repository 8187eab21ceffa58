"""Toxicity: a counterfactually regularised linear classifier over word presence.

Features are the distinct words of a whole text and their beginnings of PREFIXES bytes, which inflected and
compounded forms share (64-bit hashes, so unlike words do not collide). The loss is
balanced logistic loss, an L1 term that leaves weight on few words, and a counterfactual term: for a labelled
text with an identity term, the squared change of its logit when that term is swapped for the others of its
group. A term counts with all its features, the word and its beginnings; a feature without a weight counts as 0.
The swap must not move the score, so the logits of a group are drawn together and towards that of its neutral
member, whatever the labels of the texts that mention a group.

Fitting takes a bounded sample (`Limits`): at most so many labelled texts of each label, chosen by a hash of
doc_id and, where ids have many texts, by one of doc_id and text (`sampling`), and at most so many features. Copies
within the sample count once, features are counted and chosen where the texts are, and what reaches the driver is the
numbers of the chosen features of each text, 32 bits each: bounded by both limits, however long the texts are and
however often an id is repeated. Everything else covers all rows: each text is scored whole, from a broadcast of the weights
that are not zero, which the feature limit bounds. A text is read a slice at a time, a very long one alone.

How strongly swaps are penalised (`pair`) was chosen by scoring made-up neutral texts with the terms of a group
swapped, where toxic texts name one term eight times as often: without the penalty the mean scores of the terms
lie 0.3 to 0.6 apart, at 0.05 up to 0.04, at 0.5 under 0.01, and toxic texts are found as before.

Defined results: a null or empty text has no words and gets the model's base score; labels that are null, not
0 or 1, or of documents that are missing are left out, repeated labels of a document count once if they agree
and not at all if they differ; repeated documents are scored each by itself; without labelled rows of both
labels every score is 0; of features that tell the labels apart equally well those of least hash are taken; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.memory import trimmed
from scriptorium.llm.sampling import digest, distinct_rows, least
from scriptorium.llm.textbytes import slices, word_hash, words
from scriptorium.session import materialize, ship

#: Identity terms by group; the last of each group is its neutral member.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic", "protestant", "believer"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "protestants", "believers"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "european", "american", "local"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual", "adult"),
    ("women", "men", "girls", "boys", "females", "males", "people"),
    ("woman", "man", "girl", "boy", "female", "male", "person"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "croyant"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("muslime", "christ", "jude", "hinduist", "buddhist", "atheist", "gläubiger"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "creyente"),
    ("mujeres", "hombres", "chicas", "chicos", "gente"),
)

PREFIXES = (4, 5, 6)
#: Texts of the sample that a feature with a weight is in.
LEAST = 3
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts in order (0 stands for none), and how many come before each text."""
    found, before = words(data, offsets, GAP, PREFIXES)
    return found.reshape(-1), before * (1 + len(PREFIXES))


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit."""

    positives: int = 2000
    negatives: int = 4000
    features: int = 30_000


@dataclass(frozen=True)
class Model:
    """Weights of words by hash, ascending; base: the logit of a text without any of them."""

    hashes: np.ndarray
    weights: np.ndarray
    base: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.base)
        if len(self.hashes):
            for a, b, data, offsets in slices(texts):
                found, before = features(data, offsets)
                place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[place] == found)
                doc = np.searchsorted(before, hit, "right") - 1
                pairs = np.unique(doc * np.int64(len(self.hashes)) + place[hit])
                out[a:b] += np.bincount(pairs // len(self.hashes), self.weights[pairs % len(self.hashes)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def distinct_words(docs: DataFrame) -> DataFrame:
    """label, words: a blob of the distinct 64-bit hashes of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for _, _, data, offsets in slices(batch.column(1)):
                found, before = features(data, offsets)
                blobs += [np.unique(found[x:y]).tobytes() for x, y in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["label", "words"])

    return docs.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(trimmed(work), "label int, words binary")


def counted(rows: DataFrame) -> DataFrame:
    """feature, n, positive of rows of label and words: in how many texts each feature is, and in how many of label 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(1)]
            labels = np.repeat(batch.column(0).to_numpy(), [len(w) for w in words])
            found, place, n = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
            columns = [found.view(np.int64), n.astype(np.int64), np.bincount(place, labels, len(found)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "n", "positive"])

    each = rows.select("label", "words").mapInArrow(trimmed(work), "feature bigint, n bigint, positive bigint")
    return each.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def narrowed(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """label, and as words the places in a sorted array of the features that are in it, 32 bits each."""
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(1))
            left = [np.flatnonzero(np.isin(shared.value, w, assume_unique=True)).astype("<u4").tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary())], names=["label", "words"])

    return rows.select("label", "words").mapInArrow(trimmed(work), "label int, words binary")


def unit(column: Column, salt: str) -> Column:
    """A number in [0, 1) from a hash, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 30)) / float(1 << 30)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, limits: Limits = Limits()) -> Model:
    """Learn `label` (0 or 1) from the rows for which learn(doc_id) holds."""
    one = labels.where(F.col(label).isin(0, 1) & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where(F.col("label") == F.col("_most"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (counts.get(0) and counts.get(1)):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    rows = materialize(distinct_words(sampled(docs, one, counts, limits)).distinct(), "labelled")  # copies would count twice
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = materialize(counted(rows), "features")
    lift = F.abs(F.col("positive") / max(1, totals.get(1, 0)) - (F.col("n") - F.col("positive")) / max(1, totals.get(0, 0)))
    best = each.where((F.col("n") >= LEAST) & (F.col("feature") != 0)).orderBy(lift.desc(), "feature").limit(limits.features).select("feature").collect()
    kept = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    kept = np.unique(np.concatenate([kept, *(term_features(word) for group in IDENTITY for word in group)]))
    unlike = sorted((r["label"], bytes(r["words"])) for r in narrowed(rows, kept).collect())
    return train([kept[np.frombuffer(w, "<u4")] for _, w in unlike], np.array([y for y, _ in unlike], float), limits.features)


def sampled(docs: DataFrame, one: DataFrame, counts: dict[int, int], limits: Limits = Limits()) -> DataFrame:
    """label, text, digest: the texts to learn from, at most `positives` and `negatives` of either label.

    one: doc_id and label; counts: its rows by label. So many ids of each label are drawn by hash and broadcast; as an
    id may have any number of texts, those of least hash are taken of what they have.
    """
    most = {0: limits.negatives, 1: limits.positives}
    share = F.when(F.col("label") == 1, min(1.0, most[1] / counts[1])).otherwise(min(1.0, most[0] / counts[0]))
    ids = one.where(unit(F.col("doc_id"), "toxicity") < share).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = rows.select("label", "text", digest("toxicity", "doc_id", "text").alias("digest"))
    return least(rows, "label", {r["label"]: (r["n"], most[r["label"]]) for r in distinct_rows(rows, "label").collect()})


def term_features(word: str) -> np.ndarray:
    """The hashes of a word and its beginnings, ascending."""
    data = np.frombuffer(word.encode(), np.uint8)
    found = np.unique(features(data, np.array([0, len(data)]))[0])
    return found[found != 0]


def train(docs: list[np.ndarray], y: np.ndarray, features: int, l1: float = 2e-3, pair: float = 0.5, steps: int = 250) -> Model:
    """Accelerated proximal gradient steps on the loss above, then the same without L1 on the words that were left."""
    if not len(docs) or not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    flat = np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    row, flat = row[flat != 0], flat[flat != 0]
    vocab, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    keep = df >= LEAST
    if keep.sum() > features:
        positive = np.bincount(column, y[row], len(vocab))
        lift = np.abs(positive / y.sum() - (df - positive) / (len(y) - y.sum()))
        keep &= lift >= np.sort(lift[keep])[-features]
    at = np.cumsum(keep) - 1
    use = keep[column]
    found, vocab = vocab, vocab[keep]
    row, column = row[use], at[column[use]]
    swaps = counterfactuals(found, df / len(docs), vocab)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = _descend(row, column, y, weight, swaps, len(vocab), l1, pair, steps)
    left = np.flatnonzero(w)
    if len(left):
        new = np.full(len(vocab), -1)
        new[left] = np.arange(len(left))
        on = new[column] >= 0
        vocab = vocab[left]
        swaps = counterfactuals(found, df / len(docs), vocab)
        w, b = _descend(row[on], new[column[on]], y, weight, swaps, len(left), 0.0, pair, 4 * steps, ridge=2e-5)
    return Model(vocab[: len(w)], w, float(b))


@dataclass(frozen=True)
class Swaps:
    """Identity terms (numbered) and their features, and the swaps between the terms of a group."""

    term: np.ndarray  # of each pair of a term and one of its features
    feature: np.ndarray
    source: np.ndarray  # of each swap: the term in a text, the term put in its place, the share of labelled texts
    target: np.ndarray
    share: np.ndarray
    terms: int

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of the sum of squared changes of the logit, weighted by share."""
        z = np.bincount(self.term, w[self.feature], self.terms)
        d = 2 * self.share * (z[self.source] - z[self.target])
        z = np.bincount(self.source, d, self.terms) - np.bincount(self.target, d, self.terms)
        return np.bincount(self.feature, z[self.term], len(w))

    def curvature(self) -> float:
        """A bound of the largest curvature of that sum."""
        size = np.bincount(self.term, minlength=self.terms)
        d = 2 * self.share * (size[self.source] + size[self.target])
        z = np.bincount(self.source, d, self.terms) + np.bincount(self.target, d, self.terms)
        return float(np.bincount(self.feature, z[self.term]).max(initial=0))


def counterfactuals(found: np.ndarray, share: np.ndarray, vocab: np.ndarray) -> Swaps:
    """Swaps of the identity terms in the labelled texts.

    found, share: hashes of all features of those texts, ascending, and the share of texts that have each; vocab:
    the hashes that have weights, ascending. What a term has outside vocab counts as weight 0.
    """
    term, feature, source, target, shares, terms = [], [], [], [], [], 0
    for group in IDENTITY:
        held = []
        for word in group:
            hashes = term_features(word)
            place = np.searchsorted(vocab, hashes)
            known = place[np.isin(hashes, vocab)]
            term += [terms] * len(known)
            feature += known.tolist()
            k = int(np.searchsorted(found, np.uint64(word_hash(word))))
            held.append((terms, float(share[k]) if k < len(found) and found[k] == word_hash(word) else 0.0))
            terms += 1
        for a, part in held:
            others = [c for c, _ in held if part and c != a]
            source += [a] * len(others)
            target += others
            shares += [part] * len(others)
    whole = lambda x: np.array(x, np.int64)
    return Swaps(whole(term), whole(feature), whole(source), whole(target), np.array(shares, float), terms)


def _descend(row, column, y, weight, swaps, size, l1, pair, steps, ridge=1e-5):
    n = len(y)

    def gradient(w, b):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], n) + b, -40, 40)))
        e = weight * (p - y)
        g = np.bincount(column, e[row], size) + ridge * w
        if pair and len(swaps.source):
            g += pair * swaps.gradient(w)
        return g, e.sum()

    x, norm = np.full(size, 1.0), 1.0
    for _ in range(8):  # power method: the largest curvature
        z = np.bincount(column, (weight * np.bincount(row, x[column], n))[row], size)
        norm = float(np.linalg.norm(z)) / max(float(np.linalg.norm(x)), 1e-12)
        x = z / max(float(np.linalg.norm(z)), 1e-12)
    rate = 1 / (0.25 * (norm + 1) + ridge + pair * swaps.curvature())
    w, b, t = np.zeros(size), 0.0, 1.0
    v, vb = w, b
    for _ in range(steps):
        g, gb = gradient(v, vb)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        nb = vb - rate * gb
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def held_out_third(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_third(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(trimmed(work), "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score all."""
    ship(docs.sparkSession)
    return score_documents(docs, fit(docs, labels, "toxic", lambda doc_id: ~held_out_third(doc_id), limits))
