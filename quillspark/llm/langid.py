"""Language identification by words first: known words score by their log frequency in each language, unknown ones by
the longest character n-grams that are known.

The model is fitted on a bounded sample of the labelled rows (PER_LANG documents of each language, chosen by a hash of
doc_id); everything that is labelled counts towards how many rows a language has. Predicting reads whole texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, resident, ship

#: Documents of each language that the model is fitted on.
PER_LANG = 1500
#: Words seen fewer times in the sample are scored by their n-grams.
LEAST_COUNT = 2
LONGEST_GRAM = 5
#: Words whose scores a worker keeps; beyond it starts anew.
CACHE = 400_000
#: Evidence is counted as of so many words at most, or scores would all be 0 or 1.
EVIDENCE = 20
UNKNOWN = "und"
#: Labelled rows are split by crc32(doc_id) modulo PARTS; the part HELD_OUT is never learnt from.
PARTS, HELD_OUT = 4, 2
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG_TEXT = 1 << 20
_SAMPLE = 1 << 30


def _words(text: str) -> Iterator[list[str]]:
    """The runs of letters, lower-case, in lists of bounded length."""
    text = text.lower()
    if len(text) <= _LONG_TEXT:
        yield _LETTERS.findall(text)
        return
    found = (m[0] for m in _LETTERS.finditer(text))
    while part := list(islice(found, 1 << 16)):
        yield part


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counted(df: DataFrame, run, key: str) -> DataFrame:
    return df.mapInArrow(run, f"lang string, {key} string, n long").groupBy("lang", key).agg(F.sum("n").alias("n"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in _words(text):
                seen.update((lang, w) for w in part)
        yield pa.RecordBatch.from_pylist([{"lang": k[0], "word": k[1], "n": n} for k, n in seen.items()], _schema("word"))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for size in range(1, LONGEST_GRAM + 1):
                for g in _grams(word, size):
                    seen[lang, g] += n
        yield pa.RecordBatch.from_pylist([{"lang": k[0], "gram": k[1], "n": n} for k, n in seen.items()], _schema("gram"))


def _schema(key: str) -> pa.Schema:
    return pa.schema([("lang", pa.string()), (key, pa.string()), ("n", pa.int64())])


class Model:
    """Log frequencies of words and n-grams, a row of one number for each language; what the worker has scored is kept behind the words."""

    def __init__(self, langs: list[str], words: list[str], word_rows: np.ndarray, grams: list[str], gram_rows: np.ndarray):
        self.langs, self.words, self.word_rows, self.gram_rows = langs, words, word_rows, gram_rows
        self.gram = {g: i for i, g in enumerate(grams)}
        self.forget()

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps((self.langs, self.words, self.word_rows, list(self.gram), self.gram_rows)), 1)

    @staticmethod
    def unpacked(data: bytes) -> Model:
        return resident(("language model", zlib.crc32(data), len(data)), lambda: Model(*pickle.loads(zlib.decompress(data))))  # noqa: S301

    def forget(self) -> None:
        self.row = {w: i for i, w in enumerate(self.words)}
        self.rows = np.zeros((len(self.row) + CACHE, len(self.langs)), dtype=np.float32)
        self.rows[: len(self.row)] = self.word_rows

    def unseen(self, word: str) -> np.ndarray:
        """The mean of the n-grams of the longest size of which at least half are known; zeros if no letter is known."""
        for size in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            grams = _grams(word, size)
            known = [i for g in grams if (i := self.gram.get(g)) is not None]
            if known and 2 * len(known) >= len(grams):
                return self.gram_rows[known].mean(0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def _index(self, word: str) -> int:
        i = self.row.get(word)
        if i is None:
            if len(self.row) >= len(self.rows):
                self.forget()
            i = self.row[word] = len(self.row)
            self.rows[i] = self.unseen(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); `und` and 0 for null, for texts without a letter and for a model without languages. Ties go to the first language by code point."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        total, n, letter = np.zeros(len(self.langs)), 0, False
        for part in _words(text):
            letter = letter or any(c.isalpha() for w in part for c in w)
            for i in range(0, len(part), 4096):
                piece = part[i : i + 4096]
                row = self.row
                if len(row) + len(piece) > len(self.rows):
                    self.forget()
                    row = self.row
                try:
                    at = [row[w] for w in piece]
                except KeyError:
                    at = [self._index(w) for w in piece]
                total += self.rows[at].sum(0)
            n += len(part)
        if not letter:
            return UNKNOWN, 0.0
        z = total / max(1.0, n / EVIDENCE)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _rows(df: DataFrame) -> list[tuple]:
    """The rows of a table of bounded size on the driver, by Arrow."""
    return list(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))


def _logs(rows: list, langs: list[str], least: int) -> tuple[list[str], np.ndarray]:
    """Keys seen `least` times or more, and for each the smoothed log frequency by language, less the mean over languages."""
    at, key_at = {x: i for i, x in enumerate(langs)}, {}
    for _, key, _ in rows:
        key_at.setdefault(key, len(key_at))
    counts = np.zeros((len(key_at), len(langs)), dtype=np.float32)
    for lang, key, n in rows:
        counts[key_at[key], at[lang]] += n
    logs = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * max(1, len(key_at)))
    kept = np.flatnonzero(counts.sum(1) >= least)
    keys = list(key_at)
    return [keys[i] for i in kept], (logs - logs.mean(1, keepdims=True))[kept].astype(np.float32) if langs else np.zeros((0, 0), np.float32)


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from (doc_id, text, lang). Rows without lang or text teach nothing; no rows give a model that answers `und`."""
    ship(labelled.sparkSession)
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    picked = (
        rows.join(F.broadcast(share), "lang")
        .where(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(_SAMPLE)) * F.col("rows") < F.lit(per_lang * _SAMPLE))
        .select("lang", "text")
    )
    words = cut(_counted(picked, _count_words, "word"), "langid-words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    common = words.join(words.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_COUNT), "word", "left_semi")
    grams = _counted(words.select("lang", "word", "n"), _count_grams, "gram")
    grams = grams.join(grams.groupBy("gram").agg(F.sum("n").alias("all")).where("all >= 3"), "gram", "left_semi")
    return Model(langs, *_logs(_rows(common.select("lang", "word", "n")), langs, LEAST_COUNT), *_logs(_rows(grams.select("lang", "gram", "n")), langs, 3))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, whole texts; null and empty texts and texts without letters are `und`."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = Model.unpacked(shared.value)
            got = [known.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose language is `und`; all columns stay as they are. Rows are judged in place, without a shuffle.

    Null texts and texts without a letter go. A model that learnt no language rejects nothing else.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = Model.unpacked(shared.value)
            keep = [known.predict(t)[0] != UNKNOWN if known.langs else any(map(str.isalpha, t or "")) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
