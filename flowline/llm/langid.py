"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and all n-grams of 1 to 3 characters of the whole
text are hashed into ``BUCKETS`` features. Training counts features by language on the executors; the driver gets
languages * BUCKETS sums, smooths them into a matrix of log-probabilities and broadcasts it. Scoring gathers the
matrix rows of a batch's features in numpy and sums them by document.

The fit uses a bounded sample: ``sample`` labelled rows are expected, picked by a hash of doc_id (all, if fewer).

A text that is null or holds no letter gets ``und`` with score 0. Rows without a lang train nothing. If nothing
is learned at all, every text gets ``und``. Equal scores go to the language that sorts first. Repeated rows give
repeated rows; very long texts are read in parts, which changes no feature, so memory is bounded. An empty table gives an
empty result; ``identify`` ignores extra columns, ``predict`` keeps them.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices

BUCKETS = 1 << 14
UND = "und"
PART = 1 << 17


@functools.cache
def _letters() -> np.ndarray:
    """By code point: is it a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def points(lowered: str) -> np.ndarray:
    """Code points of a lower-cased text, with a space for anything but a letter."""
    out = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters()[out], out, 32).astype(np.uint32)


def features(p: np.ndarray, known: int = 0) -> np.ndarray:
    """Hashed n-grams of code points that end after the first ``known`` ones; all of one size after the other."""
    one = p * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (p[1:] * np.uint32(0x85EBCA77) + np.uint32(1))
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (p[2:] * np.uint32(0xC2B2AE3D) + np.uint32(2))
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    fresh = lambda grams, n, ok: grams[max(0, known - n + 1) :][ok[max(0, known - n + 1) :]]
    grams = np.concatenate([fresh(one, 1, p != 32), fresh(two, 2, (p[:-1] != 32) | (p[1:] != 32)), fresh(three, 3, p[1:-1] != 32)])
    return ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift


def text_features(text: str):
    """The features of a whole text between two spaces, in parts of bounded size: each n-gram is in the part it ends in."""
    lowered, space = text.lower(), np.full(1, 32, dtype=np.uint32)
    before, known = space, 0
    for start in range(0, len(lowered), PART):
        p = np.concatenate([before, points(lowered[start : start + PART]), *([space] if start + PART >= len(lowered) else [])])
        if len(found := features(p, known)):
            yield found
        before = p[-2:]
        known = len(before)


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for part in slices(batches):
        for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
            for f in text_features(text or ""):
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(f, minlength=BUCKETS)
            docs[lang] = docs.get(lang, 0) + 1
    for lang, own in counts.items():
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(there) + 1), "bucket": [-1, *there.tolist()], "n": [docs[lang], *own[there].tolist()]}, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))


class Model:
    """Languages, and the log-probabilities of features (BUCKETS x languages) and of languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.matrix = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32).copy()
        self.prior = np.log(docs / max(1, docs.sum()))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        total, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=bool)
        rows: list[np.ndarray] = []
        owner: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for part in text_features(text or ""):
                rows.append(part)
                owner.append(i)
                # so many rows of the matrix at a time that memory follows neither texts nor languages
                held += len(part)
                if held * len(self.langs) > 1 << 20:
                    self._add(total, rows, owner)
                    rows, owner, held = [], [], 0
                seen[i] = True
        self._add(total, rows, owner)
        total += self.prior
        for i in np.flatnonzero(seen):
            best = int(total[i].argmax())
            names[i], scores[i] = self.langs[best], 1 / np.exp(total[i] - total[i, best]).sum()
        return names, scores

    def _add(self, total: np.ndarray, rows: list[np.ndarray], owner: list[int]) -> None:
        if rows:
            at = np.cumsum([0, *map(len, rows[:-1])])
            np.add.at(total, owner, np.add.reduceat(self.matrix[np.concatenate(rows)], at, axis=0, dtype=np.float64))


def train(labelled: DataFrame, sample: int = 8000) -> Model:
    """Fit on (doc_id, text, lang); ``sample`` rows are expected to be read, all if there are fewer."""
    labelled = labelled.where("lang is not null").selectExpr("cast(doc_id as string) doc_id", "text", "cast(lang as string) lang")
    n = labelled.select("lang").count()
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = labelled.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique()) if len(got) else []
    place, counts, docs = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    row, bucket, n = got.lang.map(place).to_numpy(dtype=int), got.bucket.to_numpy(dtype=int), got.n.to_numpy(dtype=float)
    counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    docs[row[bucket < 0]] = n[bucket < 0]
    return Model(langs, counts, docs)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its score added, by ``names`` (columns of those names are replaced)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages * BUCKETS floats

    own = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*[docs[f"`{c}`"] for c in own])

    def guess(batches):
        for part in slices(batches, 64):
            langs, scores = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, *names])

    return docs.mapInArrow(guess, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = 8000) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the labels of the rows not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), sample)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
