"""SimHash near-dedup by bit-sliced comparison.

A document's fingerprint has 64 bits: its words (ASCII lower case, split on ASCII
white space) form 3-word shingles, and a bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).  Fingerprints that differ in at most 3 bits are
linked, and a document's component is the smallest doc_id it can reach.

Equal fingerprints are folded first.  The 64 bits are then cut into 5 blocks; two
fingerprints within 3 bits agree on at least two whole blocks, so each fingerprint
is posted under its 10 block pairs and only equal posts are compared: no pair is
lost.  Posts of one key are compared in tiles.  A tile stores its fingerprints as
bit planes (plane b holds bit b of 64 fingerprints in each word) and compares one
fingerprint with 64 others by word operations: the planes of differing bits are
summed by carry-save counters, and a block of lanes is abandoned as soon as all of
its lanes exceed the radius.  A key with many posts is dealt over many tasks as
pairs of tiles; a task returns a spanning forest of the links in its tile pair, not
every pair.  Components come from alternating large-star and small-star steps,
each written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, which is linked
like any other.  A text with fewer words than a shingle has its whole word sequence
as one shingle.  A null doc_id is the largest id; repeated rows are equal
fingerprints.  An empty table gives an empty result.  Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm.common import materialise, set_aside, short_batches, table, with_locator

BITS, SHINGLE, RADIUS, SEED = 64, 3, 3, 42
# Two whole blocks of these widths stay equal when at most 3 bits differ.
BLOCKS = (13, 13, 13, 13, 12)
# Fingerprints in a tile: two tiles are compared by one task at a time.
TILE = 4096
# Lanes of one word: smaller groups share words with other groups.
LANES = 64


# --- fingerprints --------------------------------------------------------------------------------

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), and the locator ``_doc_at`` where ``docs`` has it; ``fp`` is a signed long."""
    short_batches(docs.sparkSession)
    locator = [c for c in docs.columns if c == "_doc_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)),
                                              *map(b.column, locator)], ["doc_id", "fp", *locator])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *locator)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", _doc_at struct<file:string,row:long>" * len(locator))


# --- bit-sliced links ----------------------------------------------------------------------------

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Planes (64, words): bit i of word w of plane b is bit b of fingerprint 64 w + i."""
    lanes = np.zeros((len(fps) + 63) // 64 * 64, dtype=np.uint64)
    lanes[:len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T.copy(), axis=1, bitorder="little")).view(np.uint64)


def within_radius(planes: np.ndarray, probes: np.ndarray, order: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Mask (probes, words): lane i of word w is set if fingerprint 64 w + i is within ``radius``.

    Counters of the differing bits are kept vertically too: three planes and the
    carries are added with exclusive-or and and, and lanes that pass the radius are
    latched.  Blocks whose 64 lanes have all passed it are dropped from the scan."""
    width = radius.bit_length()
    n, words = len(probes), planes.shape[1]
    rows, cols = np.divmod(np.arange(n * words), words)
    counters = [np.zeros(n * words, dtype=np.uint64) for _ in range(width)]
    over = np.zeros(n * words, dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    probe_bits = [np.where((probes >> np.uint64(b)) & np.uint64(1), full, np.uint64(0)) for b in range(BITS)]
    for step, b in enumerate(order):
        carry = planes[b][cols] ^ probe_bits[b][rows]
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry  # the counter wrapped: above the radius for good
        if radius + 1 != 1 << width:
            over |= _exceeds(counters, radius)
        if step % 8 == 7:
            alive = over != full
            if not alive.all():
                rows, cols, over = rows[alive], cols[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(rows):
                    break
    out = np.zeros((n, words), dtype=np.uint64)
    out[rows, cols] = ~over
    return out


def lanes_within(differing: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each word of differing bits, whether it has at most ``radius`` of them."""
    if not len(differing):
        return np.zeros(0, dtype=bool)
    mask = within_radius(bit_planes(differing), np.zeros(1, dtype=np.uint64), np.arange(BITS), radius)[0]
    return np.unpackbits(mask.view(np.uint8), bitorder="little")[:len(differing)].astype(bool)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``radius``."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | equal & counters[k]
            equal = equal & ~counters[k]
    return above


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``left``, into ``right``) of fingerprints within the radius."""
    planes = bit_planes(right)
    ones = np.bitwise_count(planes).sum(axis=1)
    # the most balanced planes first: they tell most fingerprints apart soonest
    order = np.argsort(np.abs(ones.astype(np.int64) * 2 - len(right)), kind="stable")
    step = max(1, (1 << 18) // planes.shape[1])
    for at in range(0, len(left), step):
        mask = within_radius(planes, left[at:at + step], order, radius)
        r, w = np.nonzero(mask)
        if not len(r):
            continue
        bits = np.unpackbits(mask[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(bits)
        i, j = at + r[k], w[k] * 64 + lane
        real = j < len(right)
        yield i[real], j[real]


def spanning_edges(ids: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id of its part): one for each row that is not the least of its part."""
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    label = np.arange(len(ids))
    for i, j in links:
        a, b = label[place[i]], label[place[j]]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            a, b = label[a], label[b]
    moved = np.nonzero(label != np.arange(len(ids)))[0]
    return ids[by_id[moved]], ids[by_id[label[moved]]]


def _posts(nodes: DataFrame, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """Each fingerprint under each of its block pairs: (pair, key, id, fp)."""
    masks, low = [], 0
    for width in blocks:
        masks.append(((1 << width) - 1) << low)
        low += width
    pairs = [a | b for i, a in enumerate(masks) for b in masks[i + 1:]]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                     for i, m in enumerate(signed)])
    return nodes.select("id", "fp", F.explode(keys).alias("k")).select("k.pair", "k.key", "id", "fp")


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A spanning set of links (src > dst) between nodes (id, fp) with distinct fingerprints."""
    posts = _posts(nodes)
    sizes = posts.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = posts.join(sizes, ["pair", "key"])
    # a key with n posts has g tiles; tile pair (a, b), a <= b, goes to a task of its own
    g = F.ceil(F.col("n") / tile).cast("int")
    dealt = (shared.withColumn("g", g)
             .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("pair", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                     (F.col("mine") <= F.col("other")).alias("first"),
                     (F.col("mine") >= F.col("other")).alias("second"), "id", "fp"))
    # many small groups share a task: rows arrive sorted by group
    by_group = dealt.repartition("pair", "key", "a", "b").sortWithinPartitions("pair", "key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, first, second, ids, fps in _whole_groups(batches):
            sizes = np.bincount(group)
            small = sizes[group] < LANES
            found = [_small_group_edges(group[small], ids[small], fps[small], radius)]
            ends = np.cumsum(sizes)
            for k in np.nonzero(sizes >= LANES)[0]:
                at = slice(ends[k] - sizes[k], ends[k])
                found.append(_large_group_edges(first[at], second[at], ids[at], fps[at], radius))
            src, dst = (np.concatenate(x) for x in zip(*found))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    edges = by_group.mapInArrow(run, "src long, dst long")
    return edges.distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The sorted rows of a task in runs of whole groups: (group number, first, second, id, fp).

    Rows of a group that the next batch may go on with are held back; a group is at
    most two tiles."""
    names = ["pair", "key", "a", "b", "first", "second", "id", "fp"]
    rest: list[np.ndarray] | None = None

    def numbered(cols: list[np.ndarray], new: np.ndarray) -> tuple[np.ndarray, ...]:
        return (np.cumsum(new), *cols[4:7], np.ascontiguousarray(cols[7]).view(np.uint64))

    for b in batches:
        cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        last = np.nonzero(new)[0][-1] if new.any() else 0
        if last:
            yield numbered([c[:last] for c in cols], new[:last])
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield numbered(rest, np.zeros(len(rest[0]), dtype=bool))


def _small_group_edges(group: np.ndarray, ids: np.ndarray, fps: np.ndarray,
                       radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Many groups at once: all their pairs share the lanes of one bit-sliced pass."""
    left, shift = [np.zeros(0, dtype=np.int64)], 1
    while shift < len(group) and (same := np.nonzero(group[shift:] == group[:-shift])[0]).size:
        left.append(same)
        shift += 1
    i = np.concatenate(left)
    j = i + np.repeat(np.arange(len(left)), [len(x) for x in left])
    near = lanes_within(fps[i] ^ fps[j], radius)
    return spanning_edges(ids, [(i[near], j[near])])


def _large_group_edges(first: np.ndarray, second: np.ndarray, ids: np.ndarray, fps: np.ndarray,
                       radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One group: the rows of its first tile against the planes of its second."""
    left, right = np.nonzero(first)[0], np.nonzero(second)[0]
    links = tile_links(fps[left], fps[right], radius)
    return spanning_edges(ids, ((left[i], right[j]) for i, j in links))


# --- components ----------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked id can reach.

    Large-star links every larger neighbour of a node to its least neighbour,
    small-star the smaller ones; both keep components whole.  Least neighbours are
    partial aggregates, and each round is a table in the shared folder."""
    edges = materialise(links.select("src", "dst"), "links")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = (both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                 .distinct())
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                 .unionByName(least.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct())
        edges = materialise(small, "star")
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every id has one link, to an id that has none: each part is then a star."""
    n, ids = edges.agg(F.count(F.lit(1)), F.count_distinct("src")).first()
    if n != ids:
        return False
    return edges.join(edges.select(F.col("src").alias("dst")), "dst", "left_semi").isEmpty()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id, root) for every document, and ``_doc_at`` where ``docs`` has it.

    ``root`` is the component's least fingerprint."""
    rows = materialise(fingerprints(docs, shingle), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_nodes")
    roots = components(near_links(nodes.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("id", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    homes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return (rows.join(homes.select("fp", "root", "component_id"), "fp")
            .select("doc_id", "fp", "component_id", "root", *rows.columns[2:]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays.

    A null id comes last, and of rows with the same id the smallest locator stays."""
    apart, back = set_aside(docs, "_doc_at")
    full = with_locator(apart)
    out = simhash_components(full.select("doc_id", "text", "_doc_at"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_doc_at"))
    kept = out.groupBy("root").agg(first.alias("k")).select("k._doc_at")
    return full.join(kept.hint("shuffle_hash"), "_doc_at", "left_semi").select(*back)


QUERIES = {"op4_simhash": op4_simhash}
