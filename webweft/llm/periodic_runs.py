"""Periodic runs by seed and extend on diagonals, and texts with their repeats folded.

A run is a maximal stretch of words that repeats with smallest period q (words q apart
are the same) and is at least max(24, 3q) words long.  On the diagonal of lag q such a
run is a match of at least max(24 - q, 2q) words with the words q further on, so the
lags fall into scales: lags up to 16 are seeded by 16-grams, lags of (K/2, K] by K-grams
with K = 32, 64, ....  K is never more than the guaranteed overlap and never less than
the lag.  The second half makes neighbours enough: if a
K-gram at i and its next occurrence lie d <= K words apart, then d is the smallest
period there, and within a run of period q the next occurrence of a K-gram is always q
words on.  Only pairs of neighbouring occurrences are enumerated, a linear number.

K-grams are named exactly by doubling: a 2k-gram is the pair of the names of its halves,
so no two different K-grams share a name.  Names that occur once in a document leave
the index before the next doubling.  A seed is extended to both sides along its diagonal,
and a table with a row per lag holds how far that diagonal is covered: seeds in the covered
part are skipped, so no run is extended twice.

Every document is worked on whole, in one task and without a shuffle; memory is
proportional to a batch of documents or to one long document.

Defined results: a null or blank text has no words and no run; a null doc_id has no words
replaced in the query; repeated rows give repeated rows; an empty table gives an empty
result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import short_batches, table

# A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 24, 3
# Grams of the first scale: the least overlap that LEAST and TIMES guarantee.
FIRST = 16
# Words that are indexed together; a longer document is indexed alone.
WORDS_AT_ONCE = 1 << 18

RUN_TYPE = "array<struct<start:long,length:long,period:long>>"


def _named(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of the pairs (high, low); equal pairs have equal names."""
    return np.unique(high * (low.max(initial=0) + 1) + low, return_inverse=True)[1]


def _repeated(at: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring occurrences (left, right) of a name in one document, and the mask of ``at`` that has one."""
    order = np.argsort(name, kind="stable")  # positions ascend within a name
    a, b = order[:-1], order[1:]
    same = (name[a] == name[b]) & (doc[at[a]] == doc[at[b]])
    a, b = a[same], b[same]
    member = np.zeros(len(at), dtype=bool)
    member[a] = member[b] = True
    return at[a], at[b], member


def seeds(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each scale the seeds (position, lag, gram length): the gram there occurs again ``lag`` words on."""
    at, name, k = np.arange(len(codes)), codes, 1
    _, _, member = _repeated(at, name, doc)
    while len(at := at[member]):
        # the 2k-gram is named by its halves, both of which must occur twice in the document
        whole = np.full(len(codes), -1, dtype=np.int64)
        whole[at] = name[member]
        inside = at + 2 * k <= ends[doc[at]]
        at = at[inside]
        at = at[whole[at + k] >= 0]
        name, k = _named(whole[at], whole[at + k]), 2 * k
        left, right, member = _repeated(at, name, doc)
        if k >= FIRST:
            lag = right - left
            wanted = (lag <= k) & ((lag > k // 2) | (k == FIRST))
            yield left[wanted], lag[wanted], k


def _reach(codes: np.ndarray, at: int, lag: int, end: int) -> int:
    """First place from ``at`` on whose word differs from the one ``lag`` further on; ``end`` if none does."""
    step = 32
    while at < end:
        upto = min(at + step, end)
        differs = codes[at:upto] != codes[at + lag:upto + lag]
        if differs.any():
            return at + int(differs.argmax())
        at, step = upto, step * 2
    return end


def _reach_back(codes: np.ndarray, at: int, lag: int, begin: int) -> int:
    """Least start of the match that ends before ``at``."""
    step = 8
    while at > begin:
        low = max(at - step, begin)
        differs = codes[low:at] != codes[low + lag:at + lag]
        if differs.any():
            return at - int(differs[::-1].argmax())
        at, step = low, step * 2
    return begin


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period.

    ``codes`` has the words of all documents one after the other, ``sizes`` their numbers."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for position, lag, k in seeds(codes, doc, ends):
        # diagonals: the seeds of one document and lag in order of position
        order = np.lexsort((position, lag, doc[position]))
        position, lag = position[order], lag[order]
        new = np.ones(len(position), dtype=bool)
        new[1:] = (lag[1:] != lag[:-1]) | (doc[position[1:]] != doc[position[:-1]])
        covered: dict[tuple[int, int], int] = {}  # how far each diagonal is covered
        for low, high in zip(np.nonzero(new)[0].tolist(), [*np.nonzero(new)[0][1:].tolist(), len(position)]):
            d, q = int(doc[position[low]]), int(lag[low])
            begin, end = int(begins[d]), int(ends[d])
            while low < high:
                seed = int(position[low])
                start = _reach_back(codes, seed, q, max(begin, covered.get((d, q), begin)))
                covered[d, q] = stop = _reach(codes, seed + k, q, end - q)
                if stop - start + q >= max(LEAST, TIMES * q):
                    found[d].append((start - begin, stop - start + q, q))
                low += int(np.searchsorted(position[low:high], stop))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that stay: a run's words after its first period go."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # by start and period: a later run must be strictly greater
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about WORDS_AT_ONCE words."""
    low, words = 0, 0
    for i, n in enumerate(sizes):
        if i > low and words + n > WORDS_AT_ONCE:
            yield low, i
            low, words = i, 0
        words += n
    if low < len(sizes):
        yield low, len(sizes)


def _batch_runs(texts: list[bytes | None], places=None) -> Iterator[tuple[int, list[bytes], list[tuple[int, int, int]]]]:
    """(row, words, runs) of each text; ``places`` may replace a document's words by others of its own."""
    split = [(t or b"").split() for t in texts]
    for low, high in _groups([len(w) for w in split]):
        known: dict[bytes, int] = {}
        parts = []
        for i in range(low, high):
            codes = np.array([known.setdefault(w, len(known)) for w in split[i]], dtype=np.int64)
            chosen = places(i, len(codes)) if places else None
            if chosen is not None:
                codes, split[i] = codes[chosen], [split[i][j] for j in chosen.tolist()]
            parts.append(codes)
        found = runs_of(np.concatenate(parts), np.array([len(p) for p in parts]))
        for i in range(low, high):
            yield i, split[i], found[i - low]
            split[i] = []


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and the text without their repeats.

    ``collapsed`` has the words that stay, joined by one space."""
    short_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, kept = [], [], []
            for _, words, found in _batch_runs(b.column("text").to_pylist()):
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(_joined(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUN_TYPE}, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _joined(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.nonzero(kept_words(len(words), runs))[0].tolist()])


def planted_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's contract: in one document of ten, words from place a on repeat those from a to a + p."""
    if doc_id is None or n == 0:
        return None
    h = crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


_DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark, 256)
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in _DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for i, words, runs in _batch_runs(b.column("text").to_pylist(), lambda i, n: planted_places(ids[i], n)):
                best = strongest(runs)
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                rows.append((ids[i], len(runs), *shown, hashlib.sha256(listed).hexdigest(),
                             hashlib.sha256(_joined(words, runs)).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _DIGEST)


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
