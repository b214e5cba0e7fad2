"""Packing of token pieces into fixed-length sequences, shortest pack first.

Documents are tokenised and cut at the sequence length, so each gives full pieces and
one shorter rest.  Only the histogram of piece lengths (at most ``SEQUENCE`` entries)
reaches the driver.  There lengths are placed longest first, each into the shortest
pack that still has room, and packs of the same content are one pattern with a count:
placing a length splits or moves whole patterns, never single packs.  Pieces are
joined back by rank: the pieces of a length are numbered, and each pattern slot owns a
range of those numbers.  Numbers are dealt over salted buckets of every length, so a
length that holds a third of all pieces is spread over many tasks.

Tokens are cut at the sequence length where that packs well, else at the largest half
of it that does: then no piece is long, and the shortest pack has room for it.  The
choice is made on the histogram alone.

Defined results: null and empty texts are one piece that holds only the end token.  A
null doc_id and repeated rows are packed like other rows.  An empty table gives an
empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import materialise, short_batches, table
from webweft.llm.pieces import PieceStore, gathered

SEQUENCE, END_ID = 2048, 1
VOCABULARY = "word_bpe_49k.json"
# Padding that a cut may leave before a shorter one is tried, and the shortest cut.
GOOD_PADDING, LEAST_CUT = 0.01, 128
# Pieces of a length and bucket that are numbered together.
BUCKET_ROWS = 4_000


# --- tokens --------------------------------------------------------------------------------------

# The vocabulary's own word pattern, for lower-case texts of plain characters.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Texts with other characters go to the library whole: there its classes of letters,
# digits and blanks, its lower case or its normal form may differ from Python's.
NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7e\u00c0-\u012f\u0131-\u017f]")
BLANK = re.compile(r"[\x20\t-\r]")
# Characters of such texts taken at once, and the longest word kept by a worker.
CHUNK, LONGEST = 1 << 18, 48


class WordIds(PieceStore):
    """Token ids of texts by the `tokenizers` library, which sees each distinct word once.

    The vocabulary splits texts into words, which no token crosses; the last token of
    a word has the end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # tokens that the library finds in the text as written, before it is split into words
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        super().__init__()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a whole text, taken in chunks that end at blanks."""
        found, at = [np.zeros(0, dtype=np.uint32)], 0
        while at < len(text):
            blank = BLANK.search(text, min(at + CHUNK, len(text)))
            stop = blank.start() if blank else len(text)
            found.append(self.encode(text[at:stop]))
            at = stop
        return np.concatenate(found)

    def learn(self, pieces: list[str]) -> None:
        """Keep new pieces: their new words are encoded as one text, then put together."""
        words = [[p] if p.isalpha() else WORDS.findall(p) for p in pieces]
        new = sorted({w for own in words for w in own if w not in self.code})
        if new:
            ids = self.encode(" ".join(new))
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) != len(new):
                raise ValueError("a word of the vocabulary's pattern was split")
            self.keep(new, ids, np.diff(stops, prepend=0))
        joined = [(p, own) for p, own in zip(pieces, words) if p not in self.code]
        ids, sizes = self.ids_at(np.array([self.code[w] for _, own in joined for w in own], dtype=np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *(len(own) for _, own in joined)])]
        self.keep([p for p, _ in joined], ids, np.diff(ends))

    def batch_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text.  The blank-separated pieces of plain texts are encoded once;
        texts that hold an added token (in any case) go to the library as they are."""
        lower = [t.lower() for t in texts]
        found: list[np.ndarray | None] = [
            None if t and not NOT_PLAIN.search(t) and not any(a in low for a in self.added) else self.encode_long(t)
            for t, low in zip(texts, lower)]
        plain = [i for i, ids in enumerate(found) if ids is None]
        if not plain:
            return found
        split = pc.ascii_split_whitespace(pa.array([lower[i] for i in plain], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        rare = {k for k, p in enumerate(pieces) if len(p) > LONGEST}
        table_ids, sizes = self.ids_at(self.codes_of(["" if k in rare else p for k, p in enumerate(pieces)] if rare else pieces))
        first = np.cumsum(sizes) - sizes
        for k in rare:  # long pieces are not kept
            own = self.encode_long(pieces[k])
            first[k], sizes[k] = len(table_ids), len(own)
            table_ids = np.concatenate([table_ids, own])
        at = coded.indices.to_numpy()
        ids, sizes = gathered(table_ids, first[at], sizes[at])
        bounds = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for i, low, high in zip(plain, bounds[:-1], bounds[1:]):
            found[i] = ids[low:high]
        return found


_WORKERS: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    """The encoder of this Python worker; a reused worker keeps its words."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    if path not in _WORKERS:
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def token_pieces(docs: DataFrame, cut: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): documents cut at multiples of ``cut`` tokens.

    ``ids`` are little-endian unsigned 32-bit ids; every document ends with ``END_ID``.
    ``vocabulary`` is the path of a `tokenizers` file with end-of-word marks."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary)
        for b in batches:
            rows, start, length, ids, tokens = [], [], [], [], []
            for i, found in enumerate(encoder.batch_ids([t or "" for t in b.column("text").to_pylist()])):
                own = np.append(found, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(own), cut):
                    part = own[at:at + cut]
                    rows.append(i), start.append(at), length.append(len(part)), tokens.append(len(own))
                    ids.append(part.tobytes())
            long = [pa.array(x, pa.int64()) for x in (start, length, tokens)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), long[0], long[1],
                                              pa.array(ids, pa.binary()), long[2]],
                                             ["doc_id", "start", "length", "ids", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


# --- plan ----------------------------------------------------------------------------------------

class Slot(NamedTuple):
    """Pieces numbered ``low`` to ``high`` (exclusive) of a length: ``copies`` of them in
    each sequence from ``sequence`` on, the first at token ``at``."""

    length: int
    low: int
    high: int
    copies: int
    sequence: int
    at: int


def patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first over the histogram: (packs, [(length, copies), ...]) for each pattern.

    Each turn ends a length or moves a whole pattern, and only the end of a length
    splits one or opens new ones: at most three more patterns for each length."""
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    most: list[int] = []  # a heap of the negated rooms

    def keep(free: int, packs: int, content: tuple) -> None:
        if not room[free]:
            heapq.heappush(most, -free)
        room[free].append((packs, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room[-most[0]]:
                heapq.heappop(most)
            free = -most[0] if most else 0
            if free >= length:  # the shortest pack takes one more piece
                packs, content = room[free].pop()
                taken = min(left, packs)
                if packs > taken:
                    room[free].append((packs - taken, content))
                before, last, copies = content
                more = (before, last, copies + 1) if last == length else (content, length, 1)
                keep(free - length, taken, more)
                left -= taken
            else:  # new packs, which are the shortest until they are full of this length
                copies = size // length
                for packs, n in ((left // copies, copies), (1, left % copies)):
                    if packs and n:
                        keep(size - n * length, packs, (None, length, n))
                left = 0
    found = []
    for free in sorted(room):
        for packs, content in room[free]:
            pieces = []
            while content is not None:
                content, length, copies = content
                pieces.append((length, copies))
            found.append((packs, pieces[::-1]))
    return found


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> list[Slot]:
    """Number the sequences, and give each pattern its share of every length's pieces."""
    out, used, sequence = [], Counter(), 0
    for packs, pieces in found:
        at = 0
        for length, copies in pieces:
            low = used[length]
            used[length] += packs * copies
            out.append(Slot(length, low, used[length], copies, sequence, at))
            at += length * copies
        sequence += packs
    return out


def padding(found: list[tuple[int, list[tuple[int, int]]]], size: int = SEQUENCE) -> float:
    """Share of padding tokens; a sequence whose length is a power of two has none."""
    total = pad = 0
    for packs, pieces in found:
        used = sum(length * copies for length, copies in pieces)
        padded = used if used & (used - 1) == 0 else size
        total, pad = total + packs * padded, pad + packs * (padded - used)
    return pad / total if total else 0.0


def shorter(histogram: dict[int, int], cut: int) -> dict[int, int]:
    """The histogram after cutting every piece at multiples of ``cut``."""
    out: Counter[int] = Counter()
    for length, n in histogram.items():
        out[cut] += length // cut * n
        out[length % cut] += n
    return {k: n for k, n in out.items() if k and n}


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[int, list[tuple[int, list[tuple[int, int]]]]]:
    """The longest cut with little padding (else the one with least), and its patterns."""
    best = None
    cut = size
    while cut >= min(LEAST_CUT, size):
        found = patterns(shorter(histogram, cut), size)
        pad = padding(found, size)
        if best is None or pad < best[0]:
            best = (pad, cut, found)
        if pad <= GOOD_PADDING:
            break
        cut //= 2
    return best[1], best[2]


# --- pieces to sequences -------------------------------------------------------------------------

def length_histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces of each length: at most one entry for each length up to the sequence's."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def numbered(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with ``nth``, counting the pieces of each length from 0 without gaps.

    Each length has salted buckets by its count; a bucket numbers its own pieces and
    begins where the ones before it end.  Rows that are equal in all columns may
    change places, others may not, so a lost task gives the same numbers when it runs
    again.  The broadcast has a row per length, which the sequence length bounds."""
    spark = pieces.sparkSession
    buckets = F.broadcast(spark.createDataFrame(
        [(length, max(1, n // BUCKET_ROWS)) for length, n in sorted(counts.items())], "b_length long, buckets long"))
    salted = (pieces.join(buckets, F.col("length") == F.col("b_length"))
              .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets"))))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", *[c for c in pieces.columns
                                                                               if c not in ("doc_id", "start", "length")])
    own = salted.withColumn("own", F.row_number().over(order) - 1)
    return (own.join(begins, ["length", "bucket"]).withColumn("nth", F.col("own") + F.col("begin"))
            .drop("b_length", "buckets", "bucket", "own", "begin"))


def placed(pieces: DataFrame, found: list[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """``pieces`` with sequence_id and offset, joined to the patterns by rank.

    The slots are broadcast: patterns are at most three for each length, and the
    distinct lengths of one pattern add up to a sequence at most."""
    spark = pieces.sparkSession
    own_slots = slots(found)
    counts: Counter[int] = Counter()
    for slot in own_slots:
        counts[slot.length] += slot.high - slot.low
    table_of_slots = F.broadcast(spark.createDataFrame(
        own_slots, "s_length long, low long, high long, copies long, sequence long, at long"))
    r = F.col("nth") - F.col("low")
    return (numbered(pieces, counts)
            .join(table_of_slots, (F.col("length") == F.col("s_length")) & (F.col("nth") >= F.col("low"))
                  & (F.col("nth") < F.col("high")))
            .withColumn("sequence_id", F.col("sequence") + F.floor(r / F.col("copies")))
            .withColumn("offset", F.col("at") + r % F.col("copies") * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def digests(pieces: DataFrame) -> DataFrame:
    """Token pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")


def pack(docs: DataFrame, payload=digests, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    ``payload`` maps token pieces to what is kept of them; ``lambda p: p`` keeps the ids."""
    pieces = materialise(payload(token_pieces(docs, size, vocabulary)), "pieces")
    cut, found = plan(length_histogram(pieces), size)
    if cut < size:
        pieces = materialise(payload(token_pieces(docs, cut, vocabulary)), "pieces")
    return placed(pieces, found)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document, placed in sequences."""
    return pack(docs)


QUERIES = {"op2_packing": op2_packing}
