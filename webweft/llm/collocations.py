"""Phrase collocations by stripes.

Each prefix of one or two words keys a stripe: an associative counter of the word that
follows it.  Every word of a piece of text adds one to exactly one counter: that of its
own word and the next one (the prefix) at the word after them, or at the end of the piece
where that comes sooner.  A task counts the stripes of a million words before it sends
them on (so a frequent phrase is one entry), stripes are shuffled by language and
prefix and merged elementwise.  Everything else is read from the merged stripes:

* a counter's entry is the frequency of a three-word phrase (an extension of its prefix);
* the sum of a stripe is the frequency of its prefix, and the sums of all stripes with the
  same first word are that word's frequency;
* the greatest frequent entry of a stripe is the greatest phrase that extends its prefix to
  the right, and the greatest entry over prefixes that end alike extends to the left.

Stripes travel in blobs of many prefixes, one for each of a number of buckets that grows
with the text, so a task holds one bucket at a time.  What a bucket gives on are only
words, pairs and triples that reach the least frequency, and partial sums of words.
Scores are whole-number decimals of 38 digits, so they are exact.

Defined results: null and blank texts have no words; a null language is ``und``; repeated
rows count again; an empty table gives an empty result.  Columns other than text and lang
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import arrow_rows, materialise, short_batches, table
from webweft.operators.sizing import fits_broadcast

LEAST_COUNT, COVER_PERCENT, TOP, SCALE = 10, 50, 2000, 1_000_000
# Words that a task counts before it sends stripes on, and bytes of text per bucket.
WORDS_AT_ONCE, BUCKET_BYTES = 1_000_000, 8 << 20
# Lines of one blob, and bytes of lines that a task merges at once.
BLOB_LINES, MERGE_BYTES = 1 << 15, 32 << 20
# Frequencies (as JSON text) that may be sent to every task; larger tables are joined by shuffles.
LOOKUP_BYTES = 16 << 20
UNKNOWN = "und"

# piece ends become a full stop, which no word holds; other white space is a blank
_SIGNS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_BITS = 21  # of a word's number within one count, which has at most twice WORDS_AT_ONCE words


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in ASCII lower case, with ``.`` where a piece ends."""
    return text.lower().translate(_SIGNS).replace(b".", b" . ").split()


def stripe_entries(tokens: list[bytes], counted: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, and (first, second, next, count) of every counter; number 0 stands for the end of a piece.

    ``tokens`` ends with a piece end; the words among the first ``counted`` are counted."""
    number = {b".": 0}
    codes = np.array([number.setdefault(t, len(number)) for t in tokens], dtype=np.int64)
    at = np.nonzero(codes[:counted])[0]
    first, second = codes[at], codes[at + 1]
    third = np.where(second == 0, 0, codes[np.minimum(at + 2, len(codes) - 1)])
    keys, counts = np.unique(first << 2 * _BITS | second << _BITS | third, return_counts=True)
    low = (1 << _BITS) - 1
    return list(number), keys >> 2 * _BITS, keys >> _BITS & low, keys & low, counts


def _blobs(lang: str, tokens: list[bytes], counted: int, buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """The stripes of some text as (bucket, lang, lines); a line is prefix, next word and count."""
    words, first, second, third, counts = stripe_entries(tokens, counted)
    words[0] = b""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    mixed = hashes[first] * np.uint64(0x9E3779B97F4A7C15) + hashes[second]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    bucket = ((mixed ^ np.uint64(xxhash.xxh64_intdigest(lang))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    names = pa.array([w.decode() for w in words], pa.string())
    joined = pc.binary_join_element_wise
    prefix = joined(names.take(pa.array(first[order])), names.take(pa.array(second[order])), " ")
    lines = joined(prefix, names.take(pa.array(third[order])), pa.array(counts[order]).cast(pa.string()), "\t").to_pylist()
    starts = np.nonzero(np.diff(bucket, prepend=-1))[0].tolist()
    for low, high in zip(starts, [*starts[1:], len(lines)]):
        for at in range(low, high, BLOB_LINES):
            yield int(bucket[low]), lang, "\n".join(lines[at:min(at + BLOB_LINES, high)]).encode()


def partial_stripes(docs: DataFrame, buckets: int, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(bucket, lang, lines): the stripes of a task's text, sent on whenever ``at_once`` words are counted."""
    short_batches(docs.sparkSession)

    def batches_of(rows: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, 32)):
            bucket, lang, lines = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(lang, pa.string()),
                                              pa.array(lines, pa.binary())], ["bucket", "lang", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        words = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                tokens = words_of(text)
                # all but the end of a very long text is counted at once, with the two words after the cut in sight
                cuts = range(0, len(tokens) - at_once, at_once)
                for at in cuts:
                    yield from batches_of(_blobs(lang, [*tokens[at:at + at_once + 2], b"."], at_once, buckets))
                rest = tokens[len(cuts) * at_once:]
                held.setdefault(lang, []).extend([*rest, b"."])
                words += len(rest) + 1
                if words > at_once:
                    for lang in list(held):
                        tokens = held.pop(lang)
                        yield from batches_of(_blobs(lang, tokens, len(tokens), buckets))
                    words = 0
        for lang, tokens in held.items():
            yield from batches_of(_blobs(lang, tokens, len(tokens), buckets))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "bucket long, lang string, lines binary")


# --- merging -----------------------------------------------------------------------------------

def _read(lines: list[bytes]) -> pa.Table:
    data = b"\n".join(lines)
    return pa.csv.read_csv(
        pa.BufferReader(data),
        pa.csv.ReadOptions(column_names=["prefix", "next", "n"], use_threads=False, block_size=len(data) + 1),
        pa.csv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False),
        pa.csv.ConvertOptions(column_types={"prefix": pa.string(), "next": pa.string(), "n": pa.int64()},
                              strings_can_be_null=False, null_values=[]))


_MERGED = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()),
                     ("n", pa.int64()), ("longer", pa.int64())])


def _merge(tables: list[pa.Table]) -> pa.Table:
    """Elementwise sum of stripes."""
    both = pa.concat_tables(tables).group_by(["prefix", "next"], use_threads=False).aggregate([("n", "sum")])
    return both.rename_columns(["prefix", "next", "n"])


def _finished(lang: str, stripes: pa.Table, least: int) -> pa.RecordBatch:
    """Of a bucket's merged stripes: triples and pairs with ``least`` or more, and sums of first words."""
    stripes = stripes.filter(pc.not_equal(stripes["n"], 0))
    pair = pc.not_equal(pc.utf8_slice_codeunits(stripes["prefix"], -1), " ")  # else: the piece ends after one word
    extends = pc.and_(pair, pc.and_(pc.not_equal(stripes["next"], ""), pc.greater_equal(stripes["n"], least)))
    stripes = stripes.append_column("longer", pc.if_else(extends, stripes["n"], 0))
    sums = stripes.group_by("prefix", use_threads=False).aggregate([("n", "sum"), ("longer", "max")])
    cut = pc.split_pattern(sums["prefix"], " ", max_splits=1)
    sums = pa.table({"w1": pc.list_element(cut, 0), "w2": pc.list_element(cut, 1), "n": sums["n_sum"], "longer": sums["longer_max"]})
    words = sums.group_by("w1", use_threads=False).aggregate([("n", "sum")])
    pairs = sums.filter(pc.and_(pc.not_equal(sums["w2"], ""), pc.greater_equal(sums["n"], least)))
    triples = stripes.filter(extends)
    parts = pc.split_pattern(triples["prefix"], " ", max_splits=1)
    none, zero = pa.nulls, lambda n: pa.array(np.zeros(n, dtype=np.int64))
    tables = [
        pa.table({"w1": words["w1"], "w2": none(len(words), pa.string()), "w3": none(len(words), pa.string()),
                  "n": words["n_sum"], "longer": zero(len(words))}),
        pa.table({"w1": pairs["w1"], "w2": pairs["w2"], "w3": none(len(pairs), pa.string()), "n": pairs["n"], "longer": pairs["longer"]}),
        pa.table({"w1": pc.list_element(parts, 0), "w2": pc.list_element(parts, 1), "w3": triples["next"], "n": triples["n"],
                  "longer": zero(len(triples))})]
    out = pa.concat_tables([t.cast(pa.schema(list(_MERGED)[1:])) for t in tables]).combine_chunks()
    columns = [pa.array([lang] * len(out), pa.string()), *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out.columns]]
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_MERGED)


def merged_stripes(partial: DataFrame, least: int) -> DataFrame:
    """(lang, w1, w2, w3, n, longer): partial sums of words (w2 null), pairs (w3 null) and triples.

    ``longer`` is a pair's greatest frequent extension to the right, or 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tables, lines, size = None, [], [], 0

        def folded() -> None:
            nonlocal lines, size
            if lines:
                tables.append(_read(lines))
                tables[:] = [_merge(tables)]
                lines, size = [], 0

        for b in batches:
            for bucket, lang, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "lang", "lines"))):
                if (bucket, lang) != key:
                    folded()
                    if tables:
                        yield _finished(key[1], tables[0], least)
                    key, tables = (bucket, lang), []
                lines.append(text)
                size += len(text)
                if size > MERGE_BYTES:
                    folded()
        folded()
        if tables:
            yield _finished(key[1], tables[0], least)

    by_bucket = partial.repartition("bucket").sortWithinPartitions("bucket", "lang")
    return by_bucket.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n long, longer long")


# --- phrases -----------------------------------------------------------------------------------

def _small(df: DataFrame) -> DataFrame:
    """Frequencies that others look up: sent to every task only if their measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df, LOOKUP_BYTES) else df


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (l r)) in whole decimals: 37 digits at most."""
    x, y, z = (f"cast({c} as decimal(14,0))" for c in (a, left, right))
    return F.expr(f"{x} * {x} * cast({SCALE} as decimal(7,0)) div ({y} * {z})")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    with arrow_rows(spark, 32):
        merged = materialise(merged_stripes(partial_stripes(docs, max(16, size // BUCKET_BYTES)), least), "stripes")
    sums = materialise(merged.filter("w2 is null").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "stripe_words")
    totals = F.broadcast(sums.groupBy("lang").agg(F.sum("n").alias("n")))  # a row per language
    words = sums.filter(F.col("n") >= least)
    pairs = merged.filter("w2 is not null and w3 is null").drop("w3")
    triples = merged.filter("w3 is not null").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))

    first = _small(words.select("lang", "w1", F.col("n").alias("f1")))
    last = _small(words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("f2")))
    leftward = triples.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("leftward"))
    two = (pairs.withColumnRenamed("n", "a").join(first, ["lang", "w1"]).join(last, ["lang", "w2"])
           .join(leftward, ["lang", "w1", "w2"], "left")
           .filter(100 * F.greatest("longer", F.coalesce("leftward", F.lit(0))) < cover_percent * F.col("a"))
           .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   _score("a", "f1", "f2").alias("score")))

    whole = _small(pairs.select("lang", "w1", "w2", F.col("n").alias("f12")))
    end = _small(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("f23")))
    third = last.withColumnsRenamed({"w2": "w3", "f2": "f3"})
    cuts = F.when(F.col("s2") < F.col("s1"), F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), F.col("s2").alias("score"))) \
        .otherwise(F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), F.col("s1").alias("score")))
    three = (triples.join(whole, ["lang", "w1", "w2"]).join(end, ["lang", "w2", "w3"])
             .join(first, ["lang", "w1"]).join(third, ["lang", "w3"])
             .withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3")).withColumn("cut", cuts)
             .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (two.unionByName(three).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = {"op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST_COUNT}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut.place, array_to_string(w[1:cut.place], ' ') AS first_part,
         array_to_string(w[cut.place + 1:], ' ') AS rest
  FROM cand c, (VALUES (1), (2)) AS cut(place) WHERE cut.place < c.k),
scored AS (
  SELECT c.*, p.n AS l, q.n AS r,
         cast((c.a::HUGEINT * c.a * {SCALE}) // (p.n::HUGEINT * q.n) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = c.first_part AND p.k = c.place
              JOIN f q ON q.lang = c.lang AND q.phrase = c.rest AND q.k = c.k - c.place),
least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
covers AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3),
kept AS (
  SELECT s.* FROM least s LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM covers GROUP BY ALL) c
    ON s.k = 2 AND c.lang = s.lang AND c.phrase = s.phrase
  WHERE longer IS NULL OR 100 * longer < {COVER_PERCENT} * s.a),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN total t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""}
QUERIES = {"op12_collocations": op12_collocations}
