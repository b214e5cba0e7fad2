"""N-gram Jaccard join, size-aware: subsets of small sets, inverted lists of large ones.

A document is the set of its 3-word shingles; two documents are linked when their sets'
Jaccard similarity is 0.9 or more, that is when they share at least need(a, b) =
ceil(9 (a + b) / 19) shingles, a and b being their sizes.

*Small sets* (up to a boundary) enumerate their subsets of every fixed size c from
ceil(0.9 s) to s.  Sets that meet under a subset of size c share c shingles, so those with
need(a, b) <= c are linked without more ado.  The smallest set of a subset's list takes part
in all its links, so each list gives a star and not its pairs.

*Large sets* (at least one of a pair above the boundary) are dealt into blocks by the
shingles' hashes.  Linked sets differ in at most H shingles, so of H + 1 + E blocks at least
1 + E are equal.  A set is posted in the inverted list of each of its non-empty blocks; sets
with more than E empty blocks are posted under these too, so no link is lost.  Sets that
meet in a list are candidates, and candidates (joined transitively) are brought together
with their shingles: there inverted lists over the single shingles are scanned and the exact
overlaps counted, breadth first.  A set that has been reached leaves the lists, so a group of
near copies costs about one scan of its lists and not one for each pair.  A group with many
shingles is dealt over tasks as tiles: each tile with itself and with the first, then only
sets outside the group's largest part with every tile.

The boundary is chosen by cost from the histogram of sizes: a set of size s costs its
number of subsets if small, else its postings and a scan of its shingles.

Postings are combined before the shuffle: of the sets that one task holds, an inverted list
sends on its smallest member and links the others to it, so a list that a third of all
documents share is sent on a few times a task.

Shingles are 64-bit hashes (a pair of texts with s shingles each miscounts with odds of
about s * s / 2^64), equal sets are told by 128-bit digests.

Defined results: null, empty and blank texts have no shingle and are linked with nothing,
their component is their own doc_id; a text with fewer words than a shingle is one
shingle.  A null doc_id is never the smallest, and is the component only where no other is
in it; rows that repeat a doc_id keep their own texts.  An empty table gives an empty
result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import materialise, short_batches, table
from webweft.llm.simhash import components

SHINGLE = 3
# Similarity PART / WHOLE; two sets share at least PART / (PART + WHOLE) of the sum of their sizes.
PART, WHOLE = 9, 10
# Boundaries between small and large sets that are weighed against each other.
BOUNDARIES = (9, 19, 29, 39, 49)
# Shingles of a tile, and postings that a task combines before it sends them on.
TILE_SHINGLES, POSTINGS_AT_ONCE = 1 << 20, 1 << 20

_U = np.uint64
_MULTIPLIERS = (_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))


def need(a, b):
    """Least number of common shingles of linked sets with these sizes."""
    return -(-PART * (a + b) // (PART + WHOLE))


def least_size(s: int) -> int:
    """Least size of a set that can be linked with one of size ``s``."""
    return -(-PART * s // WHOLE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> _U(27))) * _MULTIPLIERS[2]
    return x ^ (x >> _U(31))


# --- sets ----------------------------------------------------------------------------------------

def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, ascending, of the shingles of a text given by the hashes of its words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=_U)
    for i in range(width):
        out = mixed(out * _MULTIPLIERS[0] + words[i:len(words) - width + 1 + i])
    return np.unique(out)


class _WordHashes(dict):
    """XXH64 of words; each is hashed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def text_sets(texts: list[bytes | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle set of each text."""
    known = _WordHashes()
    for text in texts:
        words = (text or b"").lower().split()
        yield shingle_hashes(np.array([known[w] for w in words], dtype=_U), width)


def size_classes(upto: int) -> list[int]:
    """Lower ends of the size classes: a set's partners lie in its class or a neighbouring one."""
    ends = [1]
    while ends[-1] <= upto:
        ends.append(ends[-1] * 13 // 10 + 1)
    return ends


def blocks_of(size_class: int, ends: list[int]) -> tuple[int, int]:
    """Blocks of a class's sets, and how many of them may be empty without being posted."""
    largest = ends[size_class + 1] - 1
    differing = (largest + largest * WHOLE // PART) * (WHOLE - PART) // (WHOLE + PART)
    empty = 1 + differing // 32
    return differing + 1 + empty, empty


def block_keys(hashes: np.ndarray, ends: list[int]) -> np.ndarray:
    """Keys of the inverted lists that a set is posted in: its blocks, for its own class and the one below."""
    s = len(hashes)
    own = int(np.searchsorted(ends, s, side="right")) - 1
    again = mixed(hashes)
    out = []
    for k in (own, own - 1):
        if k < 0 or s > (ends[k + 1] - 1) * WHOLE // PART:
            continue
        blocks, empty = blocks_of(k, ends)
        block = (again >> _U(16)) % _U(blocks)
        order = np.argsort(block, kind="stable")
        first = np.nonzero(np.diff(block[order].astype(np.int64), prepend=-1))[0]
        sums, held = np.add.reduceat(again[order], first), block[order][first]
        if blocks - len(held) > empty:
            missing = np.setdiff1d(np.arange(blocks, dtype=_U), held)
            held, sums = np.concatenate([held, missing]), np.concatenate([sums, np.zeros(len(missing), dtype=_U)])
        out.append(mixed(mixed(sums + held * _MULTIPLIERS[0]) + _U((k + 1) * int(_MULTIPLIERS[1]) & (1 << 64) - 1)))
    return np.concatenate(out).view(np.int64)


def subset_keys(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(key, subset size) of every subset of at least 0.9 of a set."""
    again = mixed(hashes ^ _MULTIPLIERS[2])
    total, s = int(again.sum(dtype=_U)), len(hashes)
    values = again.tolist()
    for out in range(s - least_size(s) + 1):
        salt = (s - out) * 0x9E3779B97F4A7C15
        for gone in combinations(values, out):
            key = (total - sum(gone) + salt) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
            key ^= key >> 32
            yield key - (1 << 64) if key >> 63 else key, s - out


_SET = "doc_id long, n long, set binary, small binary, keys array<long>"


def shingle_sets(docs: DataFrame, width: int = SHINGLE, content: bool = False) -> DataFrame:
    """(doc_id, n, set) and what the set is posted under: its hashes if small enough, its blocks' keys.

    ``set`` is the set's digest, null for an empty one.  With ``content``: (set, hashes) only."""
    short_batches(docs.sparkSession)
    ends = size_classes(1 << 40)
    most = max(BOUNDARIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, small, keys = [], [], [], []
            for h in text_sets(b.column("text").to_pylist(), width):
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                if content:
                    small.append(h.tobytes())
                    continue
                small.append(h.tobytes() if least_size(10) <= len(h) <= most else None)
                keys.append(block_keys(h, ends) if len(h) >= least_size(10) else np.zeros(0, dtype=np.int64))
            sets = pa.array(digest, pa.binary())
            if content:
                yield pa.RecordBatch.from_arrays([sets, pa.array(n, pa.int64()), pa.array(small, pa.binary())], ["set", "n", "hashes"])
                continue
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), sets, pa.array(small, pa.binary()), lists],
                                             ["doc_id", "n", "set", "small", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "set binary, n long, hashes binary" if content else _SET)


def boundary(sets: DataFrame) -> int:
    """The size up to which sets count as small: the least cost over the sizes that are weighed."""
    sizes = sets.filter(F.col("n").between(10, max(BOUNDARIES))).groupBy("n").agg(F.count_distinct("set").alias("sets")).collect()
    ends = size_classes(100)

    def cost(n: int, limit: int) -> int:
        if n <= limit:
            return sum(comb(n, out) for out in range(n - least_size(n) + 1))
        k = int(np.searchsorted(ends, n, side="right")) - 1
        return 2 * blocks_of(k, ends)[0] + n

    return min(BOUNDARIES, key=lambda limit: sum(r["sets"] * cost(r["n"], limit) for r in sizes))


# --- inverted lists ------------------------------------------------------------------------------

def _star(key: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of postings sorted by (key, n): the place of the first in each one's list, and whether it is linked to that."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    linked = ~new & ((c == 0) | (need(n, n[head]) <= c))
    return head, linked


def list_links(sets: DataFrame, limit: int) -> DataFrame:
    """(src, dst, sure): sets that meet in an inverted list, a star to the smallest set of each list.

    Links of small sets' subsets are sure; those of blocks are candidates."""
    lowest = least_size(limit + 1)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        digests: dict[bytes, int] = {}
        waiting = 0

        def sent() -> Iterator[pa.RecordBatch]:
            key, c, n, who = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((who, n, key))
            key, c, n, who = key[order], c[order], n[order], who[order]
            head, linked = _star(key, n, c)
            names = pa.array(list(digests), pa.binary())
            pairs = np.unique(np.stack([who[linked], who[head[linked]], c[linked] > 0]), axis=1)
            for at in range(0, pairs.shape[1], 1 << 16):
                a, b, sure = pairs[:, at:at + (1 << 16)]
                yield _posts(None, np.where(sure > 0, 1, 0), None, names.take(pa.array(a)), names.take(pa.array(b)))
            rest = np.nonzero(~linked)[0]
            for at in range(0, len(rest), 1 << 16):
                part = rest[at:at + (1 << 16)]
                yield _posts(key[part], c[part], n[part], names.take(pa.array(who[part])), None)

        for b in batches:
            lists = b.column("keys")
            flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            starts = starts - starts[0]
            for i, (digest, n, small) in enumerate(zip(b.column("set").to_pylist(), b.column("n").to_pylist(), b.column("small").to_pylist())):
                if digest in digests:
                    continue
                me = digests[digest] = len(digests)
                parts = []
                if n <= limit and small is not None:
                    key, c = (np.array(x, dtype=np.int64) for x in zip(*subset_keys(np.frombuffer(small, dtype=_U))))
                    parts.append((key, c))
                if n >= lowest:
                    key = flat[starts[i]:starts[i + 1]]
                    parts.append((key, np.zeros(len(key), dtype=np.int64)))
                for key, c in parts:
                    held.append((key, c, np.full(len(key), n), np.full(len(key), me)))
                    waiting += len(key)
                if waiting > POSTINGS_AT_ONCE:
                    yield from sent()
                    held, digests, waiting = [], {}, 0
        if held:
            yield from sent()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, n and set of the list that the batch before ended in
        for b in batches:
            edge = b.column("key").is_null().to_numpy(zero_copy_only=False)
            ready = b.filter(pa.array(edge))
            if len(ready):
                yield pa.RecordBatch.from_arrays([ready.column("set"), ready.column("other"),
                                                  pa.array(ready.column("c").to_numpy() > 0)], ["src", "dst", "sure"])
            posted = b.filter(pa.array(~edge))
            if not len(posted):
                continue
            key, c, n = (posted.column(x).to_numpy() for x in ("key", "c", "n"))
            who = posted.column("set")
            carried = last is not None and last[0] == key[0]
            if carried:
                key, c, n = (np.concatenate([[x], y]) for x, y in zip((last[0], 0, last[1]), (key, c, n)))
                who = pa.concat_arrays([pa.array([last[2]], pa.binary()), who])
            head, linked = _star(key, n, c)
            last = (int(key[-1]), int(n[head[-1]]), who[int(head[-1])].as_py())
            a, z = who.take(pa.array(np.nonzero(linked)[0])), who.take(pa.array(head[linked]))
            sure = pa.array(c[linked] > 0)
            out = pa.RecordBatch.from_arrays([a, z, sure], ["src", "dst", "sure"])
            out = out.filter(pc.not_equal(out.column("src"), out.column("dst")))
            if len(out):
                yield out

    ready = sets.filter(F.col("n") >= least_size(10)).select("set", "n", "small", "keys")
    posts = ready.mapInArrow(postings, "key long, c long, n long, set binary, other binary")
    # finished links need no meeting place: they are dealt by their sets
    place = F.coalesce("key", F.xxhash64("set", "other"))
    by_key = posts.repartition(place).sortWithinPartitions("key", "n", "set")
    found = by_key.mapInArrow(links, "src binary, dst binary, sure boolean")
    return found.groupBy(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).agg(F.max("sure").alias("sure"))


def _posts(key, c, n, who, other) -> pa.RecordBatch:
    size = len(who)
    columns = [pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (key, c, n)]
    other = pa.nulls(size, pa.binary()) if other is None else other
    return pa.RecordBatch.from_arrays([*columns, who, other], ["key", "c", "n", "set", "other"])


# --- exact overlaps ------------------------------------------------------------------------------

def tile_forest(hashes: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (i, j) of a tile, breadth first: a spanning forest of the links between sets that are
    in ``left`` and sets that are in ``right``.  Sets with one ``label`` count as reached from each other.

    Overlaps are counted by scanning the inverted lists of a set's shingles; lists hold only
    sets that have not been reached."""
    sizes = np.array([len(h) for h in hashes])
    owner = np.repeat(np.arange(len(hashes)), sizes)
    flat = np.concatenate(hashes)
    _, token = np.unique(flat, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    waiting = np.ones(len(hashes), dtype=bool)
    members: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(i)

    def lists() -> tuple[np.ndarray, np.ndarray]:
        live = waiting[owner]
        order = np.argsort(token[live], kind="stable")
        starts = np.zeros(token.max() + 2, dtype=np.int64)
        np.cumsum(np.bincount(token[live], minlength=len(starts) - 1), out=starts[1:])
        return owner[live][order], starts

    posted, starts = lists()
    indexed = len(hashes)
    for root in range(len(hashes)):
        if not waiting[root]:
            continue
        queue = members[int(label[root])]
        waiting[queue] = False
        left_waiting = int(waiting.sum())
        at = 0
        queue = list(queue)
        while at < len(queue) and left_waiting:
            if left_waiting * 2 < indexed:  # the lists are half empty
                posted, starts = lists()
                indexed = left_waiting
            i = queue[at]
            at += 1
            mine = token[begin[i]:begin[i + 1]]
            runs = starts[mine + 1] - starts[mine]
            before = np.cumsum(runs) - runs
            hit = posted[np.repeat(starts[mine] - before, runs) + np.arange(int(runs.sum()))]
            common = np.bincount(hit, minlength=len(hashes))
            near = waiting & (common >= need(sizes, sizes[i])) & (left[i] & right | right[i] & left)
            for j in np.nonzero(near)[0].tolist():
                if waiting[j]:
                    yield i, j
                    more = members[int(label[j])]
                    waiting[more] = False
                    queue += more
            left_waiting = int(waiting.sum())
        if not left_waiting:
            return


def tile_links(dealt: DataFrame) -> DataFrame:
    """(src, dst) of the links found in each tile pair (root, a, b) of sets with their hashes.

    Rows: root, a, b, first and second (in the tile pair's first or second tile), label, set, hashes."""
    sorted_rows = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> Iterator[pa.RecordBatch]:
            names, first, second, labels, hashes = zip(*rows)
            number: dict[bytes, int] = {}
            label = np.array([number.setdefault(x, len(number)) for x in labels])
            pairs = list(tile_forest([np.frombuffer(h, dtype=_U) for h in hashes], np.array(first), np.array(second), label))
            if pairs:
                src, dst = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in src], pa.binary()),
                                                  pa.array([names[j] for j in dst], pa.binary())], ["src", "dst"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("root", "a", "b", "set", "first", "second", "label", "hashes")]
            for root, x, y, *row in zip(*columns):
                if (root, x, y) != key:
                    if len(rows) > 1:
                        yield from found()
                    key, rows = (root, x, y), []
                rows.append(row)
        if len(rows) > 1:
            yield from found()

    return sorted_rows.mapInArrow(run, "src binary, dst binary")


def _verified(group: DataFrame, tile: int) -> DataFrame:
    """Links of candidate groups (set, root, n, hashes) as (src, dst): a spanning set of them."""
    totals = group.groupBy("root").agg((F.floor((F.sum("n") - 1) / tile) + 1).cast("int").alias("g"))
    tiled = group.join(totals, "root").withColumn("t", F.pmod(F.xxhash64("set"), F.col("g")).cast("int"))
    # each tile by itself, and all sets of every other tile together with the first tile
    with_first = F.when((F.col("t") == 0) & (F.col("g") > 1), F.sequence(F.lit(1), F.col("g") - 1)).otherwise(F.array("t"))
    alone = (tiled.withColumn("b", F.explode(with_first))
             .select("root", F.lit(0).alias("a"), "b", F.lit(True).alias("first"), F.lit(True).alias("second"),
                     F.col("set").alias("label"), "set", "hashes"))
    links = materialise(tile_links(alone), "jaccard_links")
    hot = tiled.filter("g > 1")
    if hot.isEmpty():
        return links
    parts = components(links).withColumnRenamed("id", "set").withColumnRenamed("root", "label")
    labelled = materialise(hot.join(parts, "set", "left").withColumn("label", F.coalesce("label", "set")), "jaccard_hot")
    per_part = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("part_n"))
    largest = (per_part.groupBy("root").agg(F.max(F.struct("sets", "label", "part_n")).alias("k"), F.sum("part_n").alias("all_n"))
               .select("root", F.col("k.label").alias("largest"), F.col("k.part_n").alias("largest_n"), "all_n"))
    rest_tiles = (F.floor((F.col("all_n") - F.col("largest_n") - 1) / tile) + 1).cast("int")
    marked = (labelled.join(largest.filter("all_n > largest_n").select("root", "largest", rest_tiles.alias("rg")), "root")
              .withColumn("outside", F.col("label") != F.col("largest"))
              .withColumn("rt", F.pmod(F.xxhash64("set"), F.col("rg")).cast("int")))
    # sets outside the largest part meet every tile of their group
    first = (marked.filter("outside").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("root", F.col("rt").alias("a"), "b", F.lit(True).alias("first"), (F.col("t") == F.col("b")).alias("second"),
                     "label", "set", "hashes"))
    second = (marked.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rg") - 1)))
              .filter(~(F.col("outside") & (F.col("rt") == F.col("a"))))
              .select("root", "a", F.col("t").alias("b"), F.lit(False).alias("first"), F.lit(True).alias("second"),
                      "label", "set", "hashes"))
    return links.unionByName(materialise(tile_links(first.unionByName(second)), "jaccard_links_across"))


def jaccard_components(docs: DataFrame, width: int = SHINGLE, tile: int = TILE_SHINGLES, limit: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, set, component_id) of every document; ``set`` is null without a shingle."""
    docs = docs.select("doc_id", "text")
    sets = materialise(shingle_sets(docs, width), "shingle_sets")
    links = materialise(list_links(sets, boundary(sets) if limit is None else limit), "jaccard_lists")
    groups = components(links.filter(~F.col("sure"))).withColumnRenamed("id", "set")
    groups = materialise(groups.unionByName(groups.select(F.col("root").alias("set"), "root").distinct()), "jaccard_groups")
    # the shingles of candidates only, once for each set
    wanted = sets.select("doc_id", "set").join(groups.select("set"), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.join(wanted.select("doc_id").distinct().hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    held = shingle_sets(texts, width, content=True).join(groups, "set").dropDuplicates(["set"])
    checked = _verified(materialise(held, "jaccard_held"), tile)
    roots = components(checked.unionByName(links.filter("sure").select("src", "dst"))).withColumnRenamed("id", "set")
    rooted = sets.select("doc_id", "n", "set").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (rooted.join(least, "root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), "set",
                    F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op11_jaccard_join": op11_jaccard_join}
