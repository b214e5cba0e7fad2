"""Secret scans with multipart credential linking, on DataFrame and SQL functions only.

Three base kinds are reported wherever they match: ``assign`` (a key word, a sign and
a value of 12 or more characters), ``access`` (AKIA key ids of 18 or more) and ``hex``
(runs of 16 or more hex digits).  Three weak kinds say little alone: ``ident`` (a user
or client id), ``blob`` (a mixed token of 20 or more characters) and ``endpoint`` (a
URL or a host with a port).  A part's scope reaches ``SCOPE`` code points to both
sides.  An interval join of scopes and parts, on the cells they cover, reports a weak
candidate only where its scope holds a complementary part: an ident needs a secret
(assign, hex or blob), a blob an identifier (access or ident), an endpoint an access
id or an assigned secret.  The complementary part is another stretch of text: one that
overlaps the candidate is the same token read twice and complements nothing.

Each pattern is leftmost and non-overlapping in its kind.  Matches are marked in the
text, the text is split at the marks, and the pieces' lengths give positions in code
points; only lengths, never texts, are shuffled.  A document's parts meet by cell,
which bounds them, so a very long document is dealt over many tasks.

Defined results: null text counts as empty; a document without spans has counts of
zero, the digest of the empty string and an empty span list.  Repeated rows are
scanned one by one.  An empty table gives an empty result.  Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.llm.common import materialise, set_aside, table, with_locator

# The patterns of the kinds.  ``group`` is the value whose length counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
IDENT = r"""(?i)(user|username|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)"""
BLOB = r"([A-Za-z0-9+/_=-]{20,})"
ENDPOINT = (r"((?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+(?::[0-9]{2,5})?"
            r"|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5})(?:/[A-Za-z0-9._/-]*)?)")


@dataclass(frozen=True)
class Kind:
    """A pattern: ``hints`` are texts of which every match holds one; ``group`` must have
    ``least`` characters and hold a match of each of ``holds``.  ``roles`` are what the part
    offers to others, ``needs`` is what a weak part must find in its scope."""

    name: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    needs: str | None = None


KINDS = (
    Kind("assign", ASSIGN, 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key"),
         roles=("secret", "strong")),
    Kind("access", ACCESS, 1, 18, ("akia",), roles=("identifier", "strong")),
    Kind("hex", HEX, 1, 16, roles=("secret",)),
    Kind("ident", IDENT, 2, 3, ("user", "login", "client", "account", "access"), roles=("identifier",), needs="secret"),
    Kind("blob", BLOB, 1, 20, holds=("[0-9]", "[A-Z]", "[a-z]"), roles=("secret",), needs="identifier"),
    Kind("endpoint", ENDPOINT, 1, 1, (":",), needs="strong"),
)
BASE = ("assign", "access", "hex")
SCOPE = 200
MARK, UNMARK = "\x01", "\x02"
REDACTED = "<SECRET>"


def _pieces(kind: Kind) -> Column:
    """The text split around its matches: gap, match, value, gap, match, value, ..., rest."""
    marked = F.regexp_replace("text", kind.pattern, f"{MARK}$0{MARK}${kind.group}{MARK}")
    pieces = F.split(marked, MARK)
    if not kind.hints:
        return pieces
    hinted = F.lit(False)
    for hint in kind.hints:
        hinted = hinted | F.col("lower").contains(hint)
    return F.when(hinted, pieces)


def _matches(kind: Kind) -> Column:
    """Array of (gap, size, ok): code points since the last match and in this one.

    ``ok`` tells whether the match is kept; a dropped one still parts its neighbours."""
    def at(i: Column, offset: int) -> Column:
        return F.element_at(kind.name, (i * 3 + offset + 1).cast("int"))

    def entry(i: Column) -> Column:
        ok = F.length(at(i, 2)) >= kind.least
        for pattern in kind.holds:
            ok = ok & at(i, 2).rlike(pattern)
        return F.struct(F.length(at(i, 0)).alias("gap"), F.length(at(i, 1)).alias("size"), ok.alias("ok"))

    n = ((F.size(kind.name) - 1) / 3).cast("int")
    return F.when(F.size(kind.name) > 1, F.transform(F.sequence(F.lit(0), n - 1), entry))


def scan(located: DataFrame) -> DataFrame:
    """(_doc_at, doc_id, one array column per kind) of documents with their locator; written once.

    One projection per step, so that no text is matched twice."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(UNMARK))
    keys, names = ["_doc_at", "doc_id"], [k.name for k in KINDS]
    rows = located.select(*keys, text.alias("text"), F.lower(text).alias("lower"))
    rows = rows.select(*keys, *[_pieces(k).alias(k.name) for k in KINDS])
    rows = rows.select(*keys, *[_matches(k).alias(k.name) for k in KINDS])
    kept = [F.when(F.exists(c, lambda m: m["ok"]), F.col(c)).alias(c) for c in names]
    return materialise(rows.select(*keys, *kept), "secret_scan")


def parts(scanned: DataFrame) -> DataFrame:
    """One row (_doc_at, rank, start, end) for each kept match; ``rank`` is the kind's place in KINDS."""
    by_kind = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(k.name).alias("found")) for i, k in enumerate(KINDS)])
    rows = (scanned.select("_doc_at", F.explode(by_kind).alias("k")).filter("k.found is not null")
            .select("_doc_at", "k.rank", F.posexplode("k.found").alias("i", "m"))
            .select("_doc_at", "rank", "i", F.col("m.gap").cast("long").alias("gap"),
                    F.col("m.size").cast("long").alias("size"), "m.ok"))
    so_far = Window.partitionBy("_doc_at", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return placed.filter("ok").select("_doc_at", "rank", (F.col("end") - F.col("size")).alias("start"), "end")


def _by_rank(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("rank") + 1)


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The reported parts: base kinds, and weak ones with a complement in their scope.

    Interval join: scopes and parts are posted under the cells of ``scope`` code points
    that they cover, and meet on document, cell and role; a semi join emits no pairs."""
    needs = _by_rank([F.lit(k.needs).cast("string") for k in KINDS])
    roles = _by_rank([F.array(*[F.lit(r) for r in k.roles]).cast("array<string>") for k in KINDS])

    def cells(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))

    weak = found.withColumn("role", needs).filter("role is not null")
    scopes = (weak.withColumn("low", F.greatest(F.col("start") - scope, F.lit(0))).withColumn("high", F.col("end") + scope)
              .withColumn("cell", cells(F.col("low"), F.col("high"))))
    offers = (found.withColumn("role", F.explode(roles)).withColumn("cell", cells(F.col("start"), F.col("end")))
              .select("_doc_at", "cell", "role", F.col("start").alias("o_start"), F.col("end").alias("o_end")))
    # both sides are shuffled: their files are far smaller than the rows made of them
    s, o = scopes.alias("s"), offers.hint("merge").alias("o")
    meet = ((F.col("s._doc_at") == F.col("o._doc_at")) & (F.col("s.cell") == F.col("o.cell"))
            & (F.col("s.role") == F.col("o.role")) & (F.col("o_start") < F.col("high")) & (F.col("o_end") > F.col("low"))
            & ((F.col("o_end") <= F.col("s.start")) | (F.col("o_start") >= F.col("s.end"))))
    linked = s.join(o, meet, "left_semi").select("_doc_at", "rank", "start", "end").distinct()
    return found.filter(F.col("rank") < len(BASE)).unionByName(linked)


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """All documents as (_doc_at, doc_id, ...) rows, and the reported parts as (_doc_at, rank, start, end)."""
    scanned = scan(with_locator(docs.select("doc_id", "text")))
    return scanned, link(materialise(parts(scanned), "secret_parts"), scope)


def span_lists(reported: DataFrame) -> DataFrame:
    """(_doc_at, spans): each document's parts as an array of (start, rank, end), in that order."""
    return reported.groupBy("_doc_at").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, reported = find_secrets(table(spark, sf_dir, "documents"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    rows = (scanned.select("_doc_at", "doc_id").join(span_lists(reported).hint("shuffle_hash"), "_doc_at", "left")
            .withColumn("spans", F.coalesce("spans", none)))
    names = F.array(*[F.lit(k.name) for k in KINDS])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return rows.select("doc_id", *[count(i).alias(f"n_{name}") for i, name in enumerate(BASE)],
                       F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def merged(reported: DataFrame) -> DataFrame:
    """(_doc_at, cuts): each document's reported intervals, overlapping ones joined, in order."""
    order = Window.partitionBy("_doc_at").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = reported.withColumn("new", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_doc_at", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("_doc_at").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every reported span becomes ``<SECRET>``; n_chars follows the text."""
    apart, back = set_aside(docs, "_doc_at", "cuts")
    full = with_locator(apart)
    located = full.select("_doc_at", "doc_id", "text")
    cuts = merged(link(materialise(parts(scan(located)), "secret_parts")))
    joined = full.join(cuts.hint("shuffle_hash"), "_doc_at", "left")
    text, n = F.col("text"), F.size("cuts")

    def piece(i: Column) -> Column:
        """The text between cut i - 1 and cut i."""
        low = F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["end"]).cast("int")
        high = F.when(i == n, F.length(text)).otherwise(F.element_at("cuts", F.least(i + 1, n))["start"]).cast("int")
        return F.substring(text, low + 1, high - low)

    clean = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), REDACTED)
    hit = F.col("cuts").isNotNull()
    out = joined.withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        as_before = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(as_before)).otherwise(F.col("n_chars")))
    return out.select(*back)


# Fixed values again: the oracle states the patterns for another regex engine.
SQL = {"op8_secrets": r"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
kind(rank, name, least) AS (VALUES (0, 'assign', 12), (1, 'access', 18), (2, 'hex', 16),
                                 (3, 'ident', 3), (4, 'blob', 20), (5, 'endpoint', 1)),
p AS (
  SELECT doc_id, 0 AS rank, string_split(regexp_replace(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', chr(1) || '\0' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS x FROM d
  UNION ALL SELECT doc_id, 1, string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\0' || chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 2, string_split(regexp_replace(t, '([0-9a-f]+)', chr(1) || '\0' || chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 3, string_split(regexp_replace(t, '(?i)(user|username|login|client_?id|account|access_?key_?id)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9_.@+-]+)', chr(1) || '\0' || chr(1) || '\2' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 4, string_split(regexp_replace(t, '([A-Za-z0-9+/_=-]{20,})', chr(1) || '\0' || chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d
  UNION ALL SELECT doc_id, 5, string_split(regexp_replace(t, '((?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+(?::[0-9]{2,5})?|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5})(?:/[A-Za-z0-9._/-]*)?)', chr(1) || '\0' || chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM d),
m AS (SELECT doc_id, rank, i, length(x[3 * i + 1]) AS gap, length(x[3 * i + 2]) AS size, x[3 * i + 3] AS value
      FROM p, unnest(range((len(x) - 1) // 3)) AS u(i)),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM m),
part AS (SELECT doc_id, rank, name, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed JOIN kind USING (rank)
         WHERE length(value) >= least AND (rank <> 4 OR (regexp_matches(value, '[0-9]')
               AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))),
span AS (SELECT * FROM part a WHERE rank < 3 OR EXISTS (
  SELECT 1 FROM part b WHERE b.doc_id = a.doc_id AND b.start < a.stop + 200 AND b.stop > greatest(a.start - 200, 0)
  AND (b.stop <= a.start OR b.start >= a.stop)
  AND CASE a.rank WHEN 3 THEN b.rank IN (0, 2, 4) WHEN 4 THEN b.rank IN (1, 3) ELSE b.rank IN (0, 1) END)),
listed AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
                  count(*) FILTER (rank = 2) AS n_hex,
                  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
                  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
           FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""}
QUERIES = {"op8_secrets": op8_secrets}
