"""SentencePiece encoding and decoding.

The pieces of a SentencePiece model form an Aho-Corasick automaton.  A text is
normalised (blanks become the mark U+2581, and one is put in front), and one Viterbi
pass over it follows the automaton: at each position the output links name every piece
that ends there, and each of them relaxes the best score of that position.  A character
that no piece ends on is spelt by its UTF-8 byte pieces, or is the unknown piece where
the model has none.

In a unigram model a path scores the sum of its pieces; of equal scores the longest last
piece wins.  In a model trained by merges the scores are ranks of merges and a sum of
them means nothing, so there a step costs nothing if the merges leave the two pieces
beside each other as they are, and is ruled out otherwise.  Merges are settled pair by
pair, so exactly one path is left at each position, and it is the library's encoding.
Pairs are judged once, by applying the merges to the two pieces, and remembered.

No piece has the mark after another character, so the best path of a text is made of
the best paths of its words (marks with the characters up to the next mark), and a
worker keeps the paths of words that it has seen.  The model is checked for that when
it is read.

Decoding joins pieces, turns byte pieces back into bytes and marks into blanks.  It
returns the text itself unless the text had the mark U+2581, which becomes a blank.

Defined results: null text gives null ids and null text; an empty text has no ids.
Repeated rows are encoded alike.  An empty table gives an empty result.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import short_batches, table
from webweft.llm.pieces import PieceStore, gathered

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Longest word kept by a worker, and pairs of pieces that it keeps.
LONGEST, PAIRS = 48, 150_000
# Rows of an Arrow batch: ids and bytes are gathered batch by batch.
ROWS = 512
WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0
# Letters after which, and signs before which, words may fall apart.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = "\n\t!\"#$%&'()*+,-./:;<=>?@[]_{|}~"


class Codec(PieceStore):
    """Pieces of a model file, and their automaton."""

    def __init__(self, path: str, merges: bool | None = None):
        """``merges`` tells how the model was trained; by default whole numbers for scores mean merges."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.unknown = model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        self.bytes_of = [b"" if model.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.bytes_of[self.unknown] = " \u2047 ".encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.floor = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece crosses words: the model was trained without splitting at blanks")
        # signs that no piece has after a letter: words fall apart there
        signs = [c for c in SIGNS if not any(a.isalpha() and b == c for i in plain for a, b in pairwise(self.pieces[i]))]
        self.crossed = re.compile(f"(?<=[{LETTERS}])(?=[{re.escape(''.join(signs))}])" if signs else "(?!)")
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), scores[i]))
        self.automaton.make_automaton()
        self.number, self.score = ({self.pieces[i]: x for i, x in own} for own in (((i, i) for i in plain), scores.items()))
        self.merges = all(x == int(x) for x in scores.values()) if merges is None else merges
        self.pairs: dict[tuple[str, str], bool] = {}
        super().__init__()
        table = [np.frombuffer(b, np.uint8) for b in self.bytes_of]
        self.bytes_size = np.array([len(b) for b in table])
        self.bytes_first, self.bytes_flat = np.cumsum(self.bytes_size) - self.bytes_size, np.concatenate(table)

    def spelt(self, char: str) -> tuple[int, ...]:
        """A character without a piece: its bytes, or the unknown piece."""
        if len(self.byte_ids) == 256:
            return tuple(self.byte_ids[b] for b in char.encode("utf-8"))
        return (self.unknown,)

    def best_path(self, word: str) -> tuple[int, ...]:
        """Viterbi over the automaton's matches, which come in the order of their ends."""
        last = self.last_by_merges(word) if self.merges else self.last_by_scores(word)
        out, at = [], len(word)
        while at:
            size = last[at] or 1
            piece = word[at - size:at]
            out.append((self.number[piece],) if piece in self.number else self.spelt(piece))
            at -= size
        return tuple(chain.from_iterable(reversed(out)))

    def last_by_scores(self, word: str) -> list[int]:
        """Length of the last piece of the best path to each position; 0 where no piece ends."""
        best: list[float | None] = [0.0] + [None] * len(word)
        last = [0] * (len(word) + 1)
        for end, (size, score) in self.automaton.iter(word):
            end += 1
            before = best[end - size]
            if before is None:
                before = self.reach(best, end - size)
            total, held = before + score, best[end]
            if held is None or total > held or total == held and size > last[end]:
                best[end], last[end] = total, size
        return last

    def reach(self, best: list[float | None], at: int) -> float:
        """The score of a position where no piece ends: the last one before it and spelt characters."""
        low = at
        while best[low] is None:
            low -= 1
        for k in range(low + 1, at + 1):
            best[k] = best[k - 1] + self.floor
        return best[at]

    def last_by_merges(self, word: str) -> list[int]:
        """Length of the last piece at each position that the merges leave beside the one before."""
        last = [0] + [1] * len(word)
        done, pairs = 0, self.pairs
        for end, (size, _) in self.automaton.iter(word):
            end += 1
            if size > 1 and end > done:
                at = end - size
                key = (word[at - last[at]:at], word[at:end])
                stays = pairs.get(key)
                if stays or stays is None and self.judge(key):
                    last[end], done = size, end
        return last

    def judge(self, key: tuple[str, str]) -> bool:
        """Whether merges keep two neighbours apart, and each of them whole."""
        stays = self.merged("".join(key)) == [x for x in key if x]
        if len(self.pairs) < PAIRS:
            self.pairs[key] = stays
        return stays

    def merged(self, text: str) -> list[str]:
        """A short text by merges: the best neighbours first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                score = self.score.get(a + b)
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def learn(self, pieces: list[str]) -> None:
        """Keep new words: the best paths of their parts, which no piece crosses, put together."""
        paths: dict[str, tuple[int, ...]] = {}
        own_ids = []
        for word in pieces:
            parts = self.crossed.split(word)
            for part in parts:
                if part not in paths:
                    paths[part] = self.known_path(part)
            own_ids.append(paths[word] if len(parts) == 1 else tuple(chain.from_iterable(paths[p] for p in parts)))
        # parts that stand alone are words of other texts
        extra = [p for p in paths if p not in self.code and len(p) <= LONGEST]
        rows = {**{p: paths[p] for p in extra}, **dict(zip(pieces, own_ids))}
        rows = {w: ids for w, ids in rows.items() if w not in self.code}
        self.keep(list(rows), np.fromiter(chain.from_iterable(rows.values()), dtype=np.uint32),
                  np.array([len(ids) for ids in rows.values()], dtype=np.int64))

    def known_path(self, part: str) -> tuple[int, ...]:
        at = self.code.get(part)
        if at is None:
            return self.best_path(part)
        return tuple(self.ids_of[self.first[at]:self.first[at + 1]].tolist())

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and how many each has."""
        counts = np.zeros(len(texts), dtype=np.int64)
        single = [i for i, t in enumerate(texts) if t and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t]
        chosen = set(single)
        split = pc.split_pattern(pa.array([texts[i] for i in single], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        pieces = [MARK + w for w in coded.dictionary.to_pylist()]
        at = [coded.indices.to_numpy()]
        counts[single] = np.diff(split.offsets.to_numpy())
        for i, t in enumerate(texts):  # runs of blanks stay together
            if i not in chosen and t:
                words = WORD.findall(MARK + t.replace(" ", MARK))
                at.append(len(pieces) + np.arange(len(words)))
                pieces += words
                counts[i] = len(words)
        order = [*single, *(i for i, t in enumerate(texts) if i not in chosen and t)]
        ids, sizes, first = self.table_of(pieces)
        at = np.concatenate(at).astype(np.int64)
        flat, each = gathered(ids, first[at], sizes[at])
        bounds = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(counts[order])))]
        found = {i: flat[a:b] for i, a, b in zip(order, bounds[:-1], bounds[1:])}
        none = np.zeros(0, dtype=np.uint32)
        rows = [found.get(i, none) for i in range(len(texts))]
        return np.concatenate([none, *rows]).astype(np.int32), np.array([len(r) for r in rows], dtype=np.int64)

    def table_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, sizes and places of words; long ones are not kept."""
        long = {k for k, p in enumerate(pieces) if len(p) > LONGEST}
        ids, sizes = self.ids_at(self.codes_of([MARK if k in long else p for k, p in enumerate(pieces)] if long else pieces))
        first = np.cumsum(sizes) - sizes
        sizes = sizes.copy()
        extra, used = [ids], len(ids)
        for k in long:
            own = [self.known_path(p) for p in self.crossed.split(pieces[k])]
            own = np.fromiter(chain.from_iterable(own), dtype=np.uint32)
            first[k], sizes[k] = used, len(own)
            extra.append(own)
            used += len(own)
        return np.concatenate(extra), sizes, first

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_batch([text])[0]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; control pieces have no text."""
        raw, sizes = gathered(self.bytes_flat, self.bytes_first[ids], self.bytes_size[ids])
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        whole = raw.tobytes()
        return [whole[a:b].decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]


_WORKERS: dict[str, Codec] = {}


def codec(path: str | None) -> Codec:
    """The codec of this Python worker; a reused worker keeps its words."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    if path not in _WORKERS:
        _WORKERS[path] = Codec(path)
    return _WORKERS[path]


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; ``model`` is the path of a SentencePiece file."""
    short_batches(docs.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            values, counts = own.encode_batch([t or "" for t in texts])
            starts = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            nulls = pa.array([t is None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(starts, pa.array(values), mask=nulls)],
                                             ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids)."""
    short_batches(encoded.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            ids = b.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            texts = pa.array(own.decode_batch(ids.flatten().to_numpy().astype(np.int64), counts), pa.string())
            texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, texts],
                                             ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text decoded from them."""
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
