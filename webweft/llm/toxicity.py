"""Toxicity by weak supervision.

A lexicon of patterns (whole words, and words with a given beginning) is mined from
labelled training rows: patterns that toxic texts hold far more often than others.
Each pattern is a voter: it votes toxic where its rate in a text passes ``VOTE_RATE``
and abstains elsewhere.  Further voters look at the lexicon as a whole: its rate may
vote toxic or clean, and no hit at all votes clean.  Labels serve to mine the lexicon only;
they have no vote.

A generative label model, fitted by expectation-maximisation, estimates for every voter
how often it votes each way in toxic and in clean texts.  Voters are not independent: the
correlation that is left given the class is estimated for every pair, and a voter
counts the less the more it repeats others.  It starts from the lexicon's rate alone.  The posterior labels then train a linear
classifier on the patterns' rates, which scores whole texts of all rows.

Bounds of the fit: ``POSITIVES`` and ``NEGATIVES`` labelled training rows, those with
the smallest hash of the doc_id, and ``PATTERNS`` patterns.

Defined results: null and empty texts, and texts without a letter, have no pattern and
get the score of a text without any.  Without labels of both classes every score is 0.
A doc_id with several labels counts as toxic if one says so.  Repeated rows are scored
alike.  An empty table gives an empty result.  Columns other than doc_id, text and
toxic are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import held_out, materialise, short_batches, smallest_hashes, table

POSITIVES, NEGATIVES, PATTERNS = 4000, 8000, 300
PREFIXES = (4, 5, 6, 7, 8)
# A pattern must be in so many toxic training texts, and so much likelier there (log odds).
SUPPORT, LOG_ODDS = 3, 2.0
VOTE_RATE = 0.004
# Correlations below this are taken for chance.
CORRELATED = 0.3
LEXICON_RATES = (0.002, 0.01, 0.02)
START_RATE = 0.01
THRESHOLD = 0.3
TOXIC, CLEAN, ABSTAIN = 1, -1, 0
WORD = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 300_000


# --- patterns ------------------------------------------------------------------------------------

def patterns_of(word: str) -> list[str]:
    """``=word`` and ``^beginning`` for each prefix length shorter than the word."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Lexicon:
    """Finds pattern numbers in texts; words that were seen are remembered up to a bound."""

    patterns: list[str]
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {p: i for i, p in enumerate(self.patterns)}

    def hits(self, text: str | None) -> tuple[Counter, int, int]:
        """Hits of each pattern, words with any pattern, and words of a whole text."""
        words = WORD.findall((text or "").lower())
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
        seen, found = self.seen, []
        for w in words:
            if (own := seen.get(w)) is None:
                own = seen[w] = tuple(self.number[p] for p in patterns_of(w) if p in self.number)
            if own:
                found.append(own)
        return Counter(k for own in found for k in own), len(found), len(words)


def mine(sample: DataFrame, n_toxic: int, n_clean: int, top: int = PATTERNS) -> list[str]:
    """The lexicon: patterns by log odds times the root of their toxic texts.

    Texts are counted for each pattern and class in every task before the shuffle; only
    the ``top`` best patterns reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[tuple[str, int]] = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                counts.update((p, toxic) for p in {p for w in words for p in patterns_of(w)})
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array(list(counts.values()), pa.int64())], ["pattern", "toxic", "n"])

    counted = (sample.select("text", "toxic").mapInArrow(run, "pattern string, toxic int, n long")
               .groupBy("pattern").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"),
                                       F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg")))
    odds = F.log((F.col("pos") + 0.5) / (n_toxic + 1)) - F.log((F.col("neg") + 0.5) / (n_clean + 1))
    scored = counted.withColumn("odds", odds).filter((F.col("pos") >= SUPPORT) & (F.col("odds") >= LOG_ODDS))
    best = scored.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "pattern").limit(top)
    return [r.pattern for r in best.collect()]


# --- label model ---------------------------------------------------------------------------------

def votes_of(rates: np.ndarray, any_rate: np.ndarray) -> np.ndarray:
    """Votes (texts, voters): the patterns, the lexicon's rate at each limit, no hit."""
    patterns = np.where(rates >= VOTE_RATE, TOXIC, ABSTAIN)
    limits = [np.where(any_rate >= x, TOXIC, CLEAN) for x in LEXICON_RATES]
    none = np.where(any_rate == 0, CLEAN, ABSTAIN)
    return np.column_stack([patterns, *limits, none]).astype(np.int8)


@dataclass
class LabelModel:
    """P(vote | class) of each voter, its share in the posterior, and the prior."""

    prior: float
    tables: np.ndarray  # (2 classes, voters, 3 votes)
    shares: np.ndarray  # (voters,)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes.astype(np.int64) + 1
        log = np.log(self.tables)
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            odds += self.shares[j] * (log[1, j] - log[0, j])[at[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def accuracy(self) -> np.ndarray:
        """P(vote is right | it votes) of each voter."""
        right = self.prior * self.tables[1, :, 2] + (1 - self.prior) * self.tables[0, :, 0]
        wrong = self.prior * self.tables[1, :, 0] + (1 - self.prior) * self.tables[0, :, 2]
        return right / (right + wrong)


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 12) -> LabelModel:
    """Expectation-maximisation from the starting posterior ``start``."""
    n, voters = votes.shape
    post, shares = start.astype(np.float64), np.full(voters, 1 / voters)
    cast = np.stack([votes == v for v in (CLEAN, ABSTAIN, TOXIC)]).astype(np.float64)
    for _ in range(rounds):
        tables = np.empty((2, voters, 3))
        for k, w in enumerate((1 - post, post)):
            tables[k] = ((cast * w[:, None]).sum(axis=1).T + 0.5) / (w.sum() + 1.5)
        shares = 1 / (1 + left_correlation(votes, post, tables).sum(axis=1))
        model = LabelModel(float(np.clip(post.mean(), 1e-4, 1 - 1e-4)), tables, shares)
        post = model.posterior(votes)
    return model


def left_correlation(votes: np.ndarray, post: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Size of every pair's correlation given the class; chance ones and the diagonal are zero."""
    values = np.array([CLEAN, ABSTAIN, TOXIC])
    cov = np.zeros((votes.shape[1],) * 2)
    for k, w in enumerate((1 - post, post)):
        off = (votes - tables[k] @ values) * np.sqrt(w)[:, None]
        cov += off.T @ off
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / sd[:, None] / sd)
    np.fill_diagonal(corr, 0)
    return np.where(corr >= CORRELATED, corr, 0)


# --- classifier ----------------------------------------------------------------------------------

def features(rates: np.ndarray, any_rate: np.ndarray) -> np.ndarray:
    """Pattern rates and the lexicon's rate, on a scale where a rate of 1 % is about 1."""
    scaled = np.log1p(200 * np.column_stack([rates, any_rate]))
    steps = [any_rate >= x for x in LEXICON_RATES]
    return np.column_stack([scaled, *steps, np.ones(len(any_rate))])


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + penalty * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class Model:
    patterns: list[str]
    weights: np.ndarray | None
    voters: LabelModel | None = None

    def score(self, hits: list[tuple[Counter, int, int]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(hits))
        x = features(*rates_of(hits, len(self.patterns)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def rates_of(hits: list[tuple[Counter, int, int]], patterns: int) -> tuple[np.ndarray, np.ndarray]:
    rates = np.zeros((len(hits), patterns))
    for i, (counts, _, words) in enumerate(hits):
        for k, n in counts.items():
            rates[i, k] = n / words
    return rates, np.array([found / max(words, 1) for _, found, words in hits])


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, toxic, text): labelled training rows of both classes, those with the smallest hash.

    Repeated ids count once."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
             .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
             .withColumn("h", F.xxhash64("doc_id")))
    bound = F.when(F.col("toxic") == 1, POSITIVES).otherwise(NEGATIVES)
    # at most POSITIVES + NEGATIVES rows of three numbers: sent to where the texts are
    chosen = F.broadcast(smallest_hashes(known, "toxic", bound))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")
    return texts.groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text")).drop("doc_id")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    short_batches(docs.sparkSession)
    sample = materialise(training_sample(docs, labels), "toxic_sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], None)
    patterns = mine(sample, sizes[1], sizes[0])
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value)
        for b in batches:
            rows = [lexicon.hits(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("toxic"), pa.array([list(c) for c, _, _ in rows], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c, _, _ in rows], pa.list_(pa.int32())),
                 pa.array([f for _, f, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int64())],
                ["h", "toxic", "k", "n", "found", "words"])

    rows = sample.select("h", "toxic", "text").mapInArrow(
        run, "h long, toxic int, k array<int>, n array<int>, found long, words long").collect()
    rows.sort(key=lambda r: (r.h, r.toxic, r.words, r.found))
    rates, any_rate = rates_of([(Counter(dict(zip(r.k, r.n))), r.found, r.words) for r in rows], len(patterns))
    votes = votes_of(rates, any_rate)
    voters = fit_label_model(votes, np.where(any_rate >= START_RATE, 0.95, 0.05))
    return Model(patterns, fit_linear(features(rates, any_rate), voters.posterior(votes)), voters)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value.patterns)
        for b in batches:
            scores = sent.value.score([lexicon.hits(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
