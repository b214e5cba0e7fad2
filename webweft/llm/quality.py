"""Quality classifier from weak labels.

Overlapping heuristic labellers look at a whole text and vote good, bad or abstain: signs
stuck to words, table bars, words or lines that repeat, shouting, digits, length of
words, variety of words, sentence ends.  Expectation-maximisation estimates how often each
labeller votes each way on good and on bad texts, from the counts of all vote patterns in
the table (at most 3 ** labellers).  The posterior labels of a bounded sample then
train a linear scorer on hashed features, which scores whole texts of all rows: n-grams
of the text's character classes, and how words follow each other.

No label of the tables is read.  Bound of the fit: ``SAMPLE`` rows, of each side of the
posterior half, those with the smallest hash of the doc_id.

Defined results: null, empty and blank texts are bad: score 0.  Repeated rows are scored
alike.  Without texts, or with texts of one side only, the posterior itself is the score.
An empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import held_out, materialise, short_batches, smallest_hashes, table

GOOD, ABSTAIN, BAD = 1, 0, -1
SAMPLE = 4000
DIM_BITS = 11
NGRAMS = (1, 2, 3)
CHUNK = 1 << 16
RIGHT, TRUST = 0.8, 0.2
FEW_WORDS = 20
# Limits of the labellers.  The first vote bad from a limit on and else abstain;
# the second vote bad up to a limit and good from another on.
DEFECTS = {"signs": 0.03, "stuck": 0.2, "bars": 0.05, "repeats": 0.1, "shouting": 0.3, "digits": 0.2, "top_word": 0.35, "line_copies": 0.3}
MERITS = {"variety": (0.1, 0.3), "word_length": (2.0, 3.0), "ends": (0.005, 0.03), "plain": (0.6, 0.85)}
LABELLERS = (*DEFECTS, *MERITS)

# Classes of bytes: letters, capitals, digits, blanks; other signs stand for themselves.
_CLASSES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57
                 else ord("_") if c < 32 and c not in (10, 13) else c for c in range(256))
_SIGNS = b"#$%&*@^~<>=+\\{}"
_STUCK = re.compile(r"[^\W_][#$%&*@^~<>=+\\{}]")
_PLAIN = re.compile(r"(?<!\S)[(\"']*[^\W\d_]+[.,;:!?)\"']{0,2}(?!\S)")


def measures(text: str) -> dict[str, float]:
    """What the labellers look at, each between 0 and 1 but for the length of words."""
    raw = text.encode()
    shape = raw.translate(_CLASSES)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    letters, capitals = shape.count(b"a"), shape.count(b"A")
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    found = {
        "signs": sum(map(shape.count, (bytes([c]) for c in _SIGNS))) / size,
        "stuck": len(_STUCK.findall(text)) / n,
        "plain": len(_PLAIN.findall(text)) / n,
        "bars": shape.count(b"|") / n,
        "repeats": sum(a == b for a, b in pairwise(words)) / n,
        "shouting": capitals / max(letters + capitals, 1),
        "digits": shape.count(b"0") / size,
        "top_word": max(counts.values(), default=0) / n,
        "line_copies": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        "variety": min(1.0, len(counts) / n * np.sqrt(max(n / 400, 1))),
        "word_length": len(text) / n - 1,
        "ends": (shape.count(b".") + shape.count(b"!") + shape.count(b"?")) / n,
    }
    if n < FEW_WORDS:  # a number or a name says nothing about a short text
        found |= {"digits": 0.0, "shouting": 0.0, "top_word": 0.0, "plain": sum(MERITS["plain"]) / 2}
    return found


def votes(text: str | None) -> tuple[int, ...]:
    if not text or not text.strip():
        return (BAD,) * len(LABELLERS)
    m = measures(text)
    defects = [BAD if m[k] >= limit else ABSTAIN for k, limit in DEFECTS.items()]
    merits = [BAD if m[k] <= bad else GOOD if m[k] >= good else ABSTAIN for k, (bad, good) in MERITS.items()]
    return (*defects, *merits)


def pattern_of(cast: tuple[int, ...]) -> int:
    """Votes as one number, three values each."""
    return sum((v + 1) * 3 ** i for i, v in enumerate(cast))


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3 ** i % 3 - 1 for i in range(len(LABELLERS))]


@dataclass
class LabelModel:
    """P(vote | class) of each labeller, and the share of good texts."""

    prior: float
    tables: np.ndarray  # (bad and good, labellers, bad/abstain/good)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        log = np.log(self.tables)
        odds = np.full(len(cast), np.log(self.prior / (1 - self.prior)))
        for j in range(cast.shape[1]):
            odds += (log[1, j] - log[0, j])[cast[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracy(self) -> np.ndarray:
        """P(vote is right | it votes) of each labeller."""
        right = self.prior * self.tables[1, :, 2] + (1 - self.prior) * self.tables[0, :, 0]
        wrong = self.prior * self.tables[1, :, 0] + (1 - self.prior) * self.tables[0, :, 2]
        return right / (right + wrong)


def fit_label_model(cast: np.ndarray, counts: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over vote patterns; one bad vote starts a text as bad.

    Before the data speak, a vote is taken to be right ``RIGHT`` of the time, and that
    weighs ``TRUST`` times the votes: labellers that seldom overlap keep their meaning."""
    post = np.where((cast == BAD).any(axis=1), 0.02, 0.98)
    seen = np.stack([cast == v for v in (BAD, ABSTAIN, GOOD)]).astype(np.float64)
    for _ in range(rounds):
        tables = np.empty((2, cast.shape[1], 3))
        for k, w in enumerate(((1 - post) * counts, post * counts)):
            share = np.array([1 - RIGHT, 0.5, RIGHT] if k else [RIGHT, 0.5, 1 - RIGHT])
            told = (seen * w[:, None]).sum(axis=1).T + TRUST * (seen * counts[:, None]).sum(axis=1).T * share + 0.5
            tables[k] = told / told.sum(axis=1, keepdims=True)
        # a labeller is taken to be right more often than not
        flipped = tables[1, :, 0] > tables[0, :, 0]
        tables[:, flipped] = tables[:, flipped].mean(axis=0)
        prior = float(np.clip((post * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        model = LabelModel(prior, tables)
        post = model.posterior(cast)
    return model


# --- hashed scorer -------------------------------------------------------------------------------

def features(text: str | None, out: np.ndarray) -> None:
    """Rates of hashed n-grams of character classes, and of equal neighbours among words and lines."""
    if not text:
        return
    shape = np.frombuffer(text.encode().translate(_CLASSES), dtype=np.uint8)
    for at in range(0, len(shape), CHUNK):
        part = shape[at:at + CHUNK + max(NGRAMS) - 1].astype(np.uint64)
        value = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            size = min(len(part) - n + 1, CHUNK)
            if size <= 0:
                break
            value = value[:len(part) - n + 1] * np.uint64(257) + part[n - 1:] + np.uint64(n)
            slot = (value[:size] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)
            out += np.bincount(slot.astype(np.int64), minlength=len(out))
    out /= len(shape)
    words, lines = text.split(), text.split("\n")
    for k, items in enumerate((words, lines)):
        out[-1 - k] += sum(a == b for a, b in pairwise(items)) / max(len(items), 1)
    out[-3] += len(set(words)) / max(len(words), 1)
    np.sqrt(out, out=out)


def rows_of(texts: list[str | None]) -> np.ndarray:
    rows = np.zeros((len(texts), 1 << DIM_BITS))
    for row, text in zip(rows, texts):
        features(text, row)
    return rows


def fit_linear(rows: np.ndarray, target: np.ndarray, rounds: int = 400, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps; the constant is last."""
    x = np.column_stack([rows, np.ones(len(rows))]).astype(np.float32)
    target = target.astype(np.float32)
    step = np.float32(4 / (np.square(x).sum(axis=1).mean() + ridge))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (p - target) / np.float32(len(x)) + np.float32(ridge) * ahead)
        w, ahead = new, new + np.float32((t - 1) / (t + 2)) * (new - w)
    return w


@dataclass
class Model:
    labels: LabelModel | None
    weights: np.ndarray | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.labels is None:
            return np.zeros(len(texts))
        if self.weights is None:
            out = self.labels.posterior(np.array([votes(t) for t in texts]))
        else:
            out = 1 / (1 + np.exp(-np.clip(rows_of(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))
        return np.where([bool(t and t.strip()) for t in texts], out, 0.0)


def vote_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of every row, written once."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cast = [pattern_of(votes(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cast, pa.int64())], ["doc_id", "pattern"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(run, "doc_id long, pattern long"), "quality_votes")


def training_sample(docs: DataFrame, cast: DataFrame, good: list[int], rows: int) -> DataFrame:
    """(h, pattern, text): of each side of the posterior the training rows with the smallest hash."""
    # at most 3 ** labellers numbers, 4 MB
    side = docs.sparkSession.createDataFrame([(p, True) for p in good], "pattern long, good boolean")
    known = (cast.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("pattern").alias("pattern")).join(F.broadcast(side), "pattern", "left")
             .withColumn("good", F.coalesce("good", F.lit(False))).withColumn("h", F.xxhash64("doc_id")))
    # at most SAMPLE rows of three numbers
    chosen = F.broadcast(smallest_hashes(known, "good", F.lit(rows // 2)).drop("good"))
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "h", "pattern").agg(F.min("text").alias("text"))


def train(docs: DataFrame, sample_rows: int = SAMPLE) -> Model:
    cast = vote_rows(docs)
    counted = sorted((r.pattern, r.n) for r in cast.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counted:
        return Model(None, None)
    patterns = np.array([votes_of(p) for p, _ in counted])
    labels = fit_label_model(patterns, np.array([n for _, n in counted], dtype=np.float64))
    post = dict(zip((p for p, _ in counted), labels.posterior(patterns)))
    good = [int(p) for p, x in post.items() if x >= 0.5]
    if len(good) in (0, len(counted)):
        return Model(labels, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(b.column("text").to_pylist()).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("pattern"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["h", "pattern", "x"])

    sample = training_sample(docs, cast, good, sample_rows).select("h", "pattern", "text")
    rows = sample.mapInArrow(run, "h long, pattern long, x binary").collect()
    rows.sort(key=lambda r: (r.h, r.pattern, r.x))
    target = np.array([post[r.pattern] for r in rows])
    if not len(rows) or target.min() >= 0.5 or target.max() < 0.5:
        return Model(labels, None)
    x = np.frombuffer(b"".join(r.x for r in rows), dtype="<f4").reshape(len(rows), -1)
    return Model(labels, fit_linear(x, target))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; higher is better."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.concatenate([np.zeros(0), *(sent.value.score(texts[i:i + 128]) for i in range(0, len(texts), 128))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
