"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

All terms of the examples (words, and the first letters of longer words) span the vectors. A term's weight is its
logarithmic count times its inverse frequency over all documents times its relevance, which grows with how surely the
term tells the labels apart and is never zero. Labelled examples stand in an inverted index in blocks: rare
terms have postings, frequent ones rows with each block's largest weight. A query adds up its rare terms, bounds the
rest by the block maxima, and completes only blocks that can still hold one of its nearest, so neighbours are exact.
They vote with their squared cosine; an isotonic fit to leave-one-out votes of the examples makes calibrated scores.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, ship

#: Labelled rows that the index is built from: those of each label with the smallest hashes of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Labelled rows are split by crc32(doc_id) modulo PARTS; the part HELD_OUT is never learnt from.
PARTS, HELD_OUT = 5, 0
#: Neighbours that vote; examples in a block; the prior's weight among the votes; letters of a stem.
NEIGHBOURS, BLOCK, PRIOR_WEIGHT, STEM = 15, 64, 0.3, 5
#: Terms in more than this share of the examples have rows instead of postings.
FREQUENT = 1 / 4
#: Standard errors by which a term must tell the labels apart; the relevance of all terms that don't.
SURE, LEAST_RELEVANCE = 3.0, 0.01
LEAST_HASHES = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Words, lower-case, and stems (marked by *) of longer ones, with their counts."""
    words = Counter(_LETTERS.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out[w[:STEM] + "*"] += n
    return out


def _signature(text: str) -> bytes:
    """The same for texts whose words are all the same in the same order, and for no others."""
    return hashlib.sha256(" ".join(text.lower().split()).encode("utf-8", "surrogatepass")).digest()


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, counts) of the examples; of examples with the same label and the same words in the same order the one with the smallest doc_id stays.

    Labels without a doc_id or a value teach nothing, nor do labels of rows that docs lacks; a label that is repeated
    counts once; no labels give no rows.
    """
    ship(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64(F.lit("toxic"), "label_id"), F.col("label_id")]
    some = marked.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).union(marked.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            found = [sorted(terms(t).items()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([_signature(t) for t in texts], pa.binary()), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))],
                ["doc_id", "toxic", "signature", "terms", "counts"],
            )

    each = rows.mapInArrow(run, "doc_id long, toxic int, signature binary, terms array<string>, counts array<long>")
    return each.groupBy("signature", "toxic").agg(F.min(F.struct("doc_id", "terms", "counts")).alias("x")).select("x.doc_id", "toxic", "x.terms", "x.counts")


def relevance(share: np.ndarray, toxic: np.ndarray, term: np.ndarray, sizes: np.ndarray, n_terms: int) -> np.ndarray:
    """For each term how far the log odds of the labels, given the term, surely lie from even: SURE standard errors less than they do, LEAST_RELEVANCE at least. term: the terms of all examples one after another, `sizes` of each; an example counts with its share."""
    held = lambda weight: np.bincount(term, np.repeat(weight, sizes), minlength=n_terms).astype(np.float64) + 0.5
    bad, good = share * toxic, share * (1 - toxic)
    k, m = held(bad), held(good)
    odds = np.log(k / (bad.sum() + 1)) - np.log(m / (good.sum() + 1))
    return np.maximum(LEAST_RELEVANCE, np.abs(odds) - SURE * np.sqrt(1 / k + 1 / m))


def shares(hashes: np.ndarray, toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One for each example, parted among those with the same label whose terms have the same LEAST_HASHES least hashes: near copies. Only relevance is counted with it. hashes: of the terms of all examples one after another."""
    parts = np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []
    least = [(y, *np.sort(x)[:LEAST_HASHES].tolist()) for x, y in zip(parts, toxic.tolist(), strict=True)]
    n = Counter(least)
    return np.array([1 / n[x] for x in least])


class Index:
    """Unit vectors of the examples, (term numbers ascending, weights) each, in an inverted index with block maxima."""

    def __init__(self, weight: np.ndarray, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]):
        n, self.weight = len(ids), weight
        lead = [int(t[np.argmax(w)]) if len(t) else len(weight) for t, w in vectors]
        order = sorted(range(n), key=lambda i: (lead[i], ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.int8)
        sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
        at = np.repeat(np.arange(n), sizes)
        term = np.concatenate([vectors[i][0] for i in order]) if n else np.zeros(0, np.int64)
        w = np.concatenate([vectors[i][1] for i in order]) if n else np.zeros(0)
        by_term = np.argsort(term, kind="stable")
        at, term, w = at[by_term], term[by_term], w[by_term]
        df = np.bincount(term, minlength=len(weight))
        often = np.flatnonzero(df > FREQUENT * n)
        self.row = np.full(len(weight), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.blocks = -(-n // BLOCK)
        self.rows = np.zeros((len(often), self.blocks * BLOCK))
        frequent = self.row[term] >= 0
        self.rows[self.row[term[frequent]], at[frequent]] = w[frequent]
        self.most = self.rows.reshape(len(often), self.blocks, BLOCK).max(2) if n else np.zeros((0, 0))
        self.at, self.w = at[~frequent].astype(np.int32), w[~frequent]
        df[often] = 0
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.prior = float(self.labels.mean()) if n else 0.0
        self.curve: tuple[list[float], list[float]] = ([], [])

    def neighbours(self, t: np.ndarray, w: np.ndarray, but: int | None = None) -> list[tuple[float, int, int]]:
        """(cosine, example id, label) of the nearest examples with a common term, but the one with id `but`; ties go to the smaller id."""
        if not len(t) or not len(self.ids):
            return []
        row = self.row[t]
        often = row >= 0
        rows, wo, tr, wr = row[often], w[often], t[~often], w[~often]
        first = self.start[tr]
        size = self.start[tr + 1] - first
        places = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(tr) else np.zeros(0, np.int64)
        sums = np.bincount(self.at[places], self.w[places] * np.repeat(wr, size), minlength=self.blocks * BLOCK).astype(np.float64)
        if but is not None:
            sums[np.flatnonzero(self.ids == but)] = -np.inf
        want = min(NEIGHBOURS, len(sums))
        least = max(0.0, float(np.partition(sums, -want)[-want]))
        columns = np.arange(len(sums))
        if len(rows):
            bound = wo @ self.most[rows]
            blocks = np.flatnonzero(sums.reshape(-1, BLOCK).max(1) + bound >= least - 1e-9)
            if len(blocks) * 2 > self.blocks:
                sums += wo @ self.rows[rows]
            else:
                columns = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                sums[columns] += wo @ self.rows[rows[:, None], columns]
            least = max(0.0, float(np.partition(sums[columns], -want)[-want])) if len(columns) >= want else 0.0
        near = columns[(sums[columns] >= least - 1e-9) & (sums[columns] > 0)]
        found = [(round(float(sums[i]), 9), int(self.ids[i]), int(self.labels[i])) for i in near.tolist()]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:NEIGHBOURS]

    def vector(self, at: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return unit(self.weight, at, counts)

    def vote(self, near: list[tuple[float, int, int]]) -> float:
        """The neighbours' labels weighed by their squared cosines, with the prior as one more vote."""
        w = [s * s for s, _, _ in near]
        return (sum(x * y for x, (_, _, y) in zip(w, near, strict=True)) + PRIOR_WEIGHT * self.prior) / (sum(w) + PRIOR_WEIGHT)

    def calibrate(self, votes: list[float], labels: list[int]) -> None:
        """Pool adjacent violators: ascending votes get ascending shares of toxic examples."""
        pools: list[list[float]] = []
        for v, y in sorted(zip(votes, labels, strict=True)):
            pools.append([v, v, float(y), 1.0])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        at = [(x, (p[2] + self.prior) / (p[3] + 1)) for p in pools for x in p[:2]]
        self.curve = [x for x, _ in at], np.maximum.accumulate([y for _, y in at]).tolist()

    def score(self, near: list[tuple[float, int, int]]) -> float:
        """The calibrated share of toxic examples at the neighbours' vote, between pools in proportion, with a hundredth of the vote itself so that no two votes tie; the prior without neighbours."""
        if not near:
            return self.prior
        vote = self.vote(near)
        return 0.99 * float(np.interp(vote, *self.curve)) + 0.01 * vote


def unit(weight: np.ndarray, at: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of term numbers and counts, with logarithmic counts."""
    t = np.asarray(at, np.int64)
    w = (1 + np.log(np.array(counts, np.float64))) * weight[t] if len(t) else np.zeros(0)
    t, w = t[w > 0], w[w > 0]
    return t, w / (np.linalg.norm(w) or 1.0)


class Reader:
    """Counts numbered terms in texts. White space parts words, so a text is read token by token, equal tokens once."""

    def __init__(self, number: dict[str, int]):
        self.words = {w: i for w, i in number.items() if w[-1] != "*"}
        self.stems = {w[:-1]: i for w, i in number.items() if w[-1] == "*"}

    def counted(self, text: str | None) -> tuple[list[int], list[int]]:
        """The numbers of the terms in a whole text, ascending, and how often each occurs."""
        found: dict[int, int] = {}
        word, stem, get = self.words.get, self.stems.get, found.get
        for token, n in Counter((text or "").lower().split()).items():
            for w in (token,) if token.isalpha() else _LETTERS.findall(token):
                if (i := word(w)) is not None:
                    found[i] = get(i, 0) + n
                if len(w) > STEM and (i := stem(w[:STEM])) is not None:
                    found[i] = get(i, 0) + n
        at = sorted(found)
        return at, [found[i] for i in at]


def featurised(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(doc_id, at, counts) of each row of docs: the numbers of the terms in its whole text, ascending, and how often each occurs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            ends, at, counts = [0], [], []
            for text in b.column(1).to_pylist():
                t, n = reader.counted(text)
                at += t
                counts += n
                ends.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "at", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, at array<int>, counts array<int>")


def document_frequencies(rows: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many hold each of so many terms."""
    found = rows.select(F.explode("at").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(terms, np.int64)
    df[found.column("t").to_numpy()] = found.column("n").to_numpy()
    return rows.count(), df


def build(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Index]:
    """The featurised rows of docs and the calibrated index; the examples, bounded in number, are gathered on the driver as Arrow columns."""
    known = cut(examples(docs, labels), "examples").toArrow().sort_by("doc_id")
    ids, toxic = known.column("doc_id").to_pylist(), known.column("toxic").to_numpy().astype(np.int64)
    lists = known.column("terms").combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
    counts = known.column("counts").combine_chunks().flatten().to_numpy()
    words = coded.dictionary.to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    number = {words[i]: at for at, i in enumerate(order)}
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in order), np.uint64, len(order))
    del known, lists, coded, words
    rows = cut(featurised(docs, number), "features")
    n, df = document_frequencies(rows, len(number))
    weight = np.log((n + 1) / (df + 1)) * relevance(shares(hashes[term], toxic, sizes), toxic, term, sizes, len(number))
    ends = np.cumsum(sizes)[:-1]
    vectors = [unit(weight, t, c) for t, c in zip(np.split(term, ends), np.split(counts, ends), strict=True)] if ids else []
    index = Index(weight, ids, toxic.tolist(), vectors)
    index.calibrate([index.vote(index.neighbours(*v, but=i)) for i, v in zip(ids, vectors, strict=True)], toxic.tolist())
    return rows, index


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: (doc_id, score, evidence), evidence the nearest examples as id:cosine:label.

    labels: the rows to learn from. Null and empty texts, and texts without a term of the examples, have no neighbours
    and get the score of the prior. No labels, or clean ones alone, give score 0 to all; toxic ones alone give 1.
    Repeated rows are scored alike; an empty table gives no rows. Texts are read once, whole; their term counts are
    written, and frequencies and scores come from these.
    """
    ship(docs.sparkSession)
    rows, index = build(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores, evidence = [], []
            ends = b.column(1).offsets.to_numpy().tolist()
            at, counts = b.column(1).values.to_numpy(), b.column(2).values.to_numpy()
            for first, last in zip(ends, ends[1:], strict=False):
                near = model.neighbours(*model.vector(at[first:last], counts[first:last]))
                scores.append(model.score(near))
                evidence.append(" ".join(f"{i}:{s:.4f}:{y}" for s, i, y in near))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.string())], ["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, "doc_id long, score double, evidence string")
