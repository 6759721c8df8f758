"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are whether it has a word, a word's first five letters, a pair of
neighbours or a pair with one word between, each hashed to 2**18 places. Words are lower-cased and cleared of
punctuation around them. Training sees the labelled rows outside the held-out fold,
at most ``max_train_rows`` of them (those with the least hash of their doc_id): the
follow-the-regularised-leader step keeps a rate per coordinate and sets weights of
little evidence to nothing, so the model is a few hundred weights and is broadcast.

Defined results: a null text is empty and gets the score of the bias; rows without a
label are scored and not learned from; a null doc_id counts as held out; without
labelled rows every score is 0.5; repeated rows are scored each, and repeated labels are
learned from each within the bound; equal hashes of training rows go by label and text;
long texts are read whole; an empty table of documents gives no rows; other columns of
any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.llm.common import documents, text_or_empty
from reachgrid.llm.words import MULTIPLIER, hashes_at, mixed, slices, word_places

FOLDS = 5
#: A word's first so many letters stand for its inflected forms.
STEM = 5
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_STEMS = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 3
    max_train_rows: int = 12_000


def fold(doc_id: Column) -> Column:
    """CRC-32 of the doc_id as text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _forms(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased texts in one, start, end and end of the stem of each word without punctuation around it, words per text)."""
    data, starts, ends, sizes = word_places([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    signs = np.frombuffer(data, dtype=np.uint8)
    kept = np.flatnonzero(~_PUNCTUATION.take(signs))
    first = np.minimum(kept[np.searchsorted(kept, starts)], ends)
    last = np.maximum(kept[np.searchsorted(kept, ends) - 1] + 1, first)
    letters = np.flatnonzero(signs & 0xC0 != 0x80)
    stem = np.minimum(letters[np.searchsorted(letters, first) + STEM], last)
    return data, first, last, stem, sizes


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all words, stems, pairs and skip pairs, repeats included; place 2**bits is none."""
    data, first, last, stem, sizes = _forms(texts)
    words, stems = hashes_at(data, first, last), hashes_at(data, first, stem)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    shift, n = np.uint64(64 - bits), len(words)
    out = np.full((4, n), 1 << bits, dtype=np.int32)
    out[0] = mixed(words + np.uint64(1)) >> shift
    out[3] = mixed(stems ^ _STEMS) >> shift
    for gap in (1, 2):
        if n > gap:
            pair = mixed(words[:-gap] * MULTIPLIER + words[gap:] + np.uint64(gap + 1)) >> shift
            out[gap, :-gap] = np.where(row[:-gap] == row[gap:], pair.astype(np.int32), 1 << bits)
    return np.tile(row, 4), out.ravel()


def training_rows(docs: DataFrame, labels: DataFrame, p: Ftrl) -> DataFrame:
    """text, label and order of the rows to learn from, at most ``max_train_rows``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    some = known.select("doc_id", F.col("toxic").alias("label"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("order")).orderBy("order", "label").limit(p.max_train_rows)
    some = some.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    # Repeated documents must not pass the bound.
    return rows.select("text", "label", "order").orderBy("order", "text").limit(p.max_train_rows)


def learn(rows: DataFrame, p: Ftrl) -> np.ndarray:
    """Weights, the bias last: one task reads the bounded rows in a fixed order."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray, float]] = []
        for batch in batches:
            texts, labels, order = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts):
                row, feature = features(texts[a:b], p.bits)
                key = np.unique(row.astype(np.int64) << 32 | feature)
                key = key[(key & 0xFFFFFFFF) < 1 << p.bits]
                ends = np.searchsorted(key >> 32, np.arange(b - a + 1))
                found = (key & 0xFFFFFFFF).astype(np.int32)
                held += [(order[a + i], found[ends[i] : ends[i + 1]], float(labels[a + i])) for i in range(b - a)]
        held.sort(key=lambda x: x[0])
        size = (1 << p.bits) + 1
        z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
        bias = np.array([size - 1])
        for _ in range(p.epochs):
            for _, found, label in held:
                at = np.concatenate([found, bias])
                zi, ni = z[at], n[at]
                wi = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
                guess = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35)))
                g = guess - label
                rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
                z[at] = zi + g - rate * wi
                n[at] = ni + g * g
        at = np.flatnonzero(np.abs(z) > p.l1)
        w = (np.sign(z[at]) * p.l1 - z[at]) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["feature", "weight"])

    # At most 2**bits + 1 rows.
    found = rows.repartition(1).mapInArrow(train, "feature long, weight double").toArrow()
    weights = np.zeros((1 << p.bits) + 1, dtype=np.float32)
    weights[found["feature"].to_numpy()] = found["weight"].to_numpy()
    return weights


def scored(docs: DataFrame, weights: np.ndarray, p: Ftrl = Ftrl(), key: str = "doc_id") -> DataFrame:
    """``key`` and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.copy()
        bias = float(w[-1])
        w[-1] = 0  # the place of pairs that are none
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = np.full(len(texts), bias)
            for a, b in slices(texts):
                row, feature = features(texts[a:b], p.bits)
                some = np.flatnonzero(w.take(feature))
                unique = np.unique(row[some].astype(np.int64) << 32 | feature[some])
                total[a:b] += np.bincount(unique >> 32, weights=w[unique & 0xFFFFFFFF], minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty().alias("text")).mapInArrow(score, f"`{key}` {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = scored(docs, learn(training_rows(docs, labels, p), p), p)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
