"""Language ID by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the share of the
character n-grams (n = 1 to 3, lower case, letters with single blanks between words)
that both texts hold, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).  N-grams are
hashed to a fixed number of positions, so G(x) is a 0/1 vector.  The kernel is
approximated with Nystroem landmarks: phi(x) = K(x, L) K(L, L)^(-1/2), and one ridge
regressor per language is fitted on phi, one versus the rest.  A batch of texts is
scored by two matrix products: presence rows by landmark columns, then by the folded
weights.

The fit uses a bounded sample of the training rows: at most ``SAMPLE`` rows of each
language, those with the smallest hash of the doc_id.  Everything else covers whole
texts of all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0.  Ties
between languages go to the first in alphabetical order.  With no training row every
text is ``und``.  An empty table gives an empty result.  Repeated rows are scored
alike.  Columns other than doc_id, text and lang are ignored, and lang is only read
for the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import held_out, short_batches, smallest_hashes, table

NGRAMS = (1, 2, 3)
DIM_BITS = 13
DIMS = 1 << DIM_BITS
# Bounds of the fit: training rows of each language, and landmarks of each language.
SAMPLE, LANDMARKS = 600, 24
RIDGE = 1e-2
SHARPNESS = 4.0
UNDETERMINED = "und"
# Texts in one matrix product, and characters taken at once from a long text.
BATCH, CHUNK = 256, 1 << 16


_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(text: str, out: np.ndarray) -> None:
    """Mark the hashed n-grams of a whole text in the row ``out`` of ``DIMS`` positions."""
    marked = " " + " ".join(_WORD.findall(text.lower())) + " "
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    longest = max(NGRAMS)
    for at in range(0, len(codes), CHUNK):
        part = codes[at:at + CHUNK + longest - 1].astype(np.uint64)
        value = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            value = value[:size] * np.uint64(0x100000001B3) + (part[n - 1:] + np.uint64(n))
            if n in NGRAMS:
                out[(value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)] = 1


def presence_rows(texts: list[str]) -> np.ndarray:
    rows = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(rows, texts):
        presence(text, row)
    return rows


def root_sizes(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    """Landmark columns (dims, landmarks), scaled, and weights (landmarks, languages)."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        rows = presence_rows(texts)
        return ((rows @ self.landmarks) / root_sizes(rows)) @ self.weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the languages' margins."""
        pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for at in range(0, len(known), BATCH):
            part = known[at:at + BATCH]
            margin = self.margins([texts[i] for i in part]).astype(np.float64)
            share = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            for i, k, p in zip(part, share.argmax(axis=1), share.max(axis=1)):
                pred[i], score[i] = self.langs[k], p
        return pred, score


def fit_model(rows: np.ndarray, langs: list[str], per_lang: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nystroem features of presence rows, taken in the given order."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros((0, 0), np.float32))
    rows = rows / root_sizes(rows)
    label = np.array([names.index(x) for x in langs])
    chosen = np.concatenate([np.nonzero(label == k)[0][:per_lang] for k in range(len(names))])
    landmarks = np.ascontiguousarray(rows[chosen].T)
    values, vectors = np.linalg.eigh((rows[chosen] @ landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = (rows @ landmarks).astype(np.float64) @ whiten
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    # every language counts alike, however many rows it has in the sample
    weight = 1 / np.bincount(label, minlength=len(names))[label][:, None]
    gram = phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1])
    return Model(names, landmarks, (whiten @ np.linalg.solve(gram, phi.T @ (target * weight))).astype(np.float32))


def training_sample(docs: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """(lang, h, text): of each language the training rows with the smallest hash of the doc_id.

    Repeated ids count once."""
    rows = (docs.select("doc_id", "text", "lang")
            .filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
            .withColumn("h", F.xxhash64("doc_id")))
    ids = smallest_hashes(rows.select("lang", "h").distinct(), "lang", F.lit(per_lang))
    # one row per language, for each of which the model holds landmarks anyway
    edge = F.broadcast(ids.groupBy("lang").agg(F.max("h").alias("edge")))
    return rows.join(edge, "lang").filter("h <= edge").groupBy("lang", "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, per_lang: int = SAMPLE) -> Model:
    """The model of a documents table.

    At most ``per_lang`` presence rows of each language are collected, as bits."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = presence_rows(b.column("text").to_pylist()).astype(bool)
            bits = [x.tobytes() for x in np.packbits(rows, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(bits, pa.binary())],
                                             ["lang", "h", "bits"])

    sample = training_sample(docs, per_lang).mapInArrow(run, "lang string, h long, bits binary").collect()
    sample.sort(key=lambda r: (r.h, r.lang))
    bits = np.frombuffer(b"".join(r.bits for r in sample), dtype=np.uint8).reshape(len(sample), DIMS // 8)
    return fit_model(np.unpackbits(bits, axis=1).astype(np.float32), [r.lang for r in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = sent.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no language (``und``) go; rows without a ``lang`` get the predicted one.

    Without a labelled row no language is learnt and every text is ``und``; then only
    texts without a letter go, which are in no language whatever the labels are."""
    sent = spark.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")
    lang_at = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if sent.value.langs:
                found = list(sent.value.predict(texts)[0])
                kept = [p != UNDETERMINED for p in found]
                langs = pc.coalesce(b.column(lang_at), pa.array(found, pa.string()).cast(b.schema.field(lang_at).type))
                b = b.set_column(lang_at, b.schema.field(lang_at), langs)
            else:
                kept = [has_letter(t) for t in texts]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op9_language_id": op9_language_id}
