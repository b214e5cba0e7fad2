"""Blocklist rules: text source, classification, snapshots and URL verdicts.

Rule tables are small next to URL tables.  Host and path rules are folded into one
row per host and matched with one left join on the host (a broadcast hash join when
the folded table passes a size check in bytes, a shuffled join otherwise); paths are
joined to path rules by their prefixes, and URLs to regex rules by pieces of the text that
a rule's matches must hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webweft.functions.text import not_blank, ws_trim
from webweft.functions.urls import extract_domain, lower_path
from webweft.operators.sizing import sized_broadcast
from webweft.session import cut_lineage

# --- fixed values (rule syntax) ------------------------------------------------
REGEX_RULE = r"^/(.+)/$"
WILDCARD_RULE = r"^\*://\*\.([^/]+)/\*$"
EXACT_RULE = r"^\*://([^/]+)/\*$"
PATH_RULE = r"^\*://(\*\.)?(.+?)(/.+)$"
RULE_CLASSES = ["regex", "wildcard", "exact", "path"]
# ------------------------------------------------------------------------------

RULE_COLUMNS = ["source", "line_no", "rule_class", "is_allow", "host", "path", "is_prefix", "pattern"]


def read_rule_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S5 source: subscription text files → ``(source, line_no, line)``.

    ``line_no`` is the position inside the file: lines keep their order in a
    block, and blocks are ordered by where they start."""
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    # lines are numbered in their block of the file; blocks are offset by the lines of those before
    # them, so a file is not sorted as a whole
    block = Window.partitionBy("source", "_at").orderBy("_row")
    before = Window.partitionBy("source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (raw.groupBy("source", "_at").agg(F.count(F.lit(1)).alias("_n"))
               .select("source", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return (raw.withColumn("_i", F.row_number().over(block)).join(offsets, ["source", "_at"])
            .select("source", (F.col("_off") + F.col("_i")).cast("int").alias("line_no"), "line"))


def read_sources(spark: SparkSession, sources: list[str]) -> tuple[DataFrame, list[str]]:
    """The lines of every source that can be read, and the sources that cannot: one
    missing list does not stop the others from loading."""
    good, failed = [], []
    for source in sources:
        try:
            spark.read.text(source)  # checks that the path exists
            good.append(source)
        except AnalysisException:
            failed.append(source)
    if good:
        return read_rule_text(spark, good), failed
    return spark.createDataFrame([], "source string, line_no int, line string"), failed


def subscription_list(configured: DataFrame, extra_lines: DataFrame) -> DataFrame:
    """Configured URLs plus lines of a list file (trimmed, blank and ``#``
    dropped), distinct."""
    extra = (extra_lines.select(ws_trim("line").alias("url"))
             .filter(not_blank("url") & ~F.col("url").startswith("#")))
    return configured.select(ws_trim("url").alias("url")).unionByName(extra).distinct()


def parse_lines(lines: DataFrame) -> DataFrame:
    """Trim, skip blank / ``!`` / ``#`` lines, strip a leading ``@``."""
    t = ws_trim("line")
    kept = lines.select("source", "line_no", t.alias("t")).filter(
        not_blank("t") & ~F.col("t").startswith("!") & ~F.col("t").startswith("#"))
    is_allow = F.col("t").startswith("@")
    return kept.select("source", "line_no", is_allow.alias("is_allow"),
                       F.when(is_allow, ws_trim(F.substring("t", 2, 1 << 30))).otherwise(F.col("t")).alias("rule"))


def regex_compiles(pattern: Column) -> Column:
    """True when the JVM regex engine (the one ``rlike`` uses) accepts the
    pattern case-insensitively: ``try_reflect`` turns the syntax error of
    ``Pattern.matches`` into null.  No Python round trip."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"),
                         F.concat(F.lit("(?i)"), pattern), F.lit("")).isNotNull()


def classify(parsed: DataFrame, validate_regex: bool = True) -> DataFrame:
    """First matching form wins; unsupported lines are dropped.  ``@`` is
    honoured for every class (D2).  Invalid regexes are dropped at load."""
    r = F.col("rule")
    cls = (F.when(r.rlike(REGEX_RULE), F.lit("regex"))
           .when(r.rlike(WILDCARD_RULE), F.lit("wildcard"))
           .when(r.rlike(EXACT_RULE), F.lit("exact"))
           .when(r.rlike(PATH_RULE), F.lit("path")))
    c = F.col("rule_class")
    p = F.col("_p")
    out = (parsed.withColumn("rule_class", cls).filter(c.isNotNull())
           .withColumn("_p", F.when(c == "path", F.regexp_extract(r, PATH_RULE, 3)))
           .select(
               "source", "line_no", "rule_class", "is_allow",
               F.when(c == "wildcard", F.lower(F.regexp_extract(r, WILDCARD_RULE, 1)))
                .when(c == "exact", F.lower(F.regexp_extract(r, EXACT_RULE, 1)))
                .when(c == "path", F.lower(F.regexp_extract(r, PATH_RULE, 2))).alias("host"),
               F.lower(F.when(p.endswith("/*"), F.expr("substring(_p, 1, length(_p) - 2)"))
                       .otherwise(p)).alias("path"),
               p.endswith("/*").alias("is_prefix"),
               F.when(c == "regex", F.regexp_extract(r, REGEX_RULE, 1)).alias("pattern")))
    if validate_regex:
        out = out.filter((c != "regex") | regex_compiles(F.col("pattern")))
    return out


def dedupe(rules: DataFrame) -> DataFrame:
    """Union of sources; hosts compared case-insensitively (already
    lower-cased); path and regex rules de-duplicated too."""
    return rules.dropDuplicates(["rule_class", "is_allow", "host", "path", "is_prefix", "pattern"])


def load_rules(lines: DataFrame, validate_regex: bool = True) -> DataFrame:
    """Lines → de-duplicated rule table (S5 → U1 → U2)."""
    return dedupe(classify(parse_lines(lines), validate_regex))


def rule_counts(rules: DataFrame) -> DataFrame:
    """A5: count per class; allow rules counted on their own."""
    k = F.when(F.col("is_allow"), F.lit("allow")).otherwise(F.col("rule_class"))
    return rules.groupBy(k.alias("rule_class")).agg(F.count(F.lit(1)).alias("n_rules"))


def swap_snapshot(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """With no block rule at all in ``new`` keep ``old``.  Otherwise path and
    regex rules are replaced, and so is each host set (wildcard or exact, block or
    allow) that ``new`` has rules for; a host set without new rules stays."""
    if old is None:
        return new
    if new.filter(~F.col("is_allow")).isEmpty():
        return old
    present = new.select("rule_class", "is_allow").distinct()
    kept_old = old.filter(F.col("rule_class").isin("wildcard", "exact")).join(present, ["rule_class", "is_allow"], "left_anti")
    return new.unionByName(kept_old)


# --- verdicts -------------------------------------------------------------------

def fold_hosts(rules: DataFrame) -> DataFrame:
    """One row per rule host: which classes name it, and the lengths of its path rules
    (at most as many as a path has characters; the paths themselves are joined)."""
    c, allow = F.col("rule_class"), F.col("is_allow")

    def named(cls: str, kind: Column) -> Column:
        return F.coalesce(F.max((c == cls) & kind), F.lit(False))

    return (rules.filter(F.col("host").isNotNull()).groupBy(F.col("host").alias("r_host"))
            .agg(named("wildcard", allow).alias("r_wild_allow"), named("exact", allow).alias("r_exact_allow"),
                 named("wildcard", ~allow).alias("r_wild"), named("exact", ~allow).alias("r_exact"),
                 F.max(c == "path").alias("r_has_paths"),
                 F.collect_set(F.when((c == "path") & F.col("is_prefix"), F.length("path"))).alias("r_lengths")))


def path_flags(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(bl_host, bl_path, path_allow, path_block) of the paths that a path rule of their host matches.

    ``asked``: bl_host, bl_path, r_lengths.  A path is looked up whole and by its prefixes of
    the lengths that its host's rules have: an equi-join, however many rules a host has."""
    exact = F.array(F.struct(F.lit(False).alias("is_prefix"), F.col("bl_path").alias("path")))
    prefixes = F.transform(F.filter("r_lengths", lambda n: n <= F.length("bl_path")),
                           lambda n: F.struct(F.lit(True).alias("is_prefix"), F.substring("bl_path", F.lit(1), n).alias("path")))
    keys = asked.distinct().select("bl_host", "bl_path", F.explode(F.concat(exact, prefixes)).alias("k"))
    sub = rules.filter(F.col("rule_class") == "path").select(F.col("host").alias("bl_host"), "is_prefix", "path", "is_allow").distinct()
    hit = keys.select("bl_host", "bl_path", "k.is_prefix", "k.path").join(sub, ["bl_host", "is_prefix", "path"])
    return hit.groupBy("bl_host", "bl_path").agg(F.max("is_allow").alias("path_allow"), F.max(~F.col("is_allow")).alias("path_block"))


def _suffix_flag(df: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """``include_subdomains``: a wildcard rule also matches every subdomain.
    The (few) distinct URL hosts are exploded into their suffixes and
    equi-joined with the rule hosts; the matched hosts are joined back."""
    sub = sized_broadcast(rules.select(F.col("host").alias("_rule")).distinct())
    hosts = df.select(F.col("bl_host").alias("_h")).distinct()
    matched = (hosts.select("_h", F.explode(host_suffixes(F.col("_h"))).alias("_sfx"))
               .join(sub, F.col("_sfx") == F.col("_rule"), "left_semi")
               .select(F.col("_h").alias(name + "_h")).distinct().withColumn(name, F.lit(True)))
    out = df.join(matched, df["_key"] == matched[name + "_h"], "left").drop(name + "_h")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` → ``[a.b.c, b.c, c]``."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


# A pattern with one of these means something else beside other patterns: references
# to groups, group names, flags, look-around and quoting.
NOT_FOLDABLE = r"\\[1-9kQE]|\(\?(?!:)"
# Bytes of patterns that one pass over the URLs tests as literal conditions.
MAX_PATTERN_BYTES = 8 << 20
# Length of the pieces of text under which patterns are posted.
GRAM = 4
_BREAK, _DOT = "\x01", "\x02"


def required_text(pattern: Column) -> Column:
    """The longest text (lower case) that every match of a pattern must hold; empty if none is certain.

    Alternatives, look-around, flags and quoting make nothing certain; classes, groups, other
    escapes and optional characters break the text."""
    p = F.lower(pattern)
    p = F.regexp_replace(p, r"\\([./\-_:=&%])", _DOT + "$1")             # escaped signs are themselves
    p = F.regexp_replace(p, r"\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\[pc0].*|\\.", _BREAK)
    p = F.regexp_replace(p, r"\[[^\[\]]*\]", _BREAK)
    for _ in range(4):                                                   # groups, from the inside
        p = F.regexp_replace(p, r"\((?:\?:)?[^()|]*\)", _BREAK)
    p = F.regexp_replace(p, f"{_DOT}?[^{_DOT}](?:[?*]|\\{{[^}}]*\\}})", _BREAK)  # may be missing
    p = F.regexp_replace(p, f"(?<!{_DOT})[.^$+*?]", _BREAK)
    risky = pattern.rlike(r"[|]|\(\?(?!:)|\\[QEk]")

    def longest(text: Column) -> Column:
        pieces = F.split(F.replace(text, F.lit(_DOT), F.lit("")), _BREAK)
        by_length = F.array_sort(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
        return F.when(risky | text.rlike(r"[()\[\]{}\\]"), F.lit("")).otherwise(F.element_at(by_length, -1)["x"])

    # as the one element of an array the text is a variable, and made once
    return F.get(F.transform(F.array(p), longest), F.lit(0))


def _grams(text: Column) -> Column:
    n = F.length(text) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                      lambda i: F.substring(text, i, F.lit(GRAM)))))


def regex_flags(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rx_allow, rx_block) of the distinct URLs (column ``url``) that a regex rule matches.

    A pattern is posted under one piece of the text that its matches must hold, the one that
    fewest URLs hold; URLs are joined by their pieces, and only the patterns that they meet are
    run.  Patterns without such a text are tested as literal conditions, in passes of bounded size."""
    urls = cut_lineage(urls.select("url").distinct(), "rule_urls")
    sub = cut_lineage(rules.filter(F.col("rule_class") == "regex").select("is_allow", "pattern").distinct()
                      .withColumn("text", required_text(F.col("pattern"))).withColumn("grams", _grams(F.col("text"))), "rule_patterns")
    posted = sub.filter("grams is not null").select("is_allow", "pattern", F.explode("grams").alias("gram"))
    held = urls.select("url", F.explode(_grams(F.lower("url"))).alias("gram"))
    counts = held.join(sized_broadcast(posted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (posted.join(counts, "gram", "left").groupBy("is_allow", "pattern")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k")).filter("k.n > 0")
              .select("is_allow", "pattern", F.col("k.gram").alias("gram")))
    met = held.join(sized_broadcast(cut_lineage(rarest, "pattern_index")), "gram").filter(F.expr("url rlike concat('(?i)', pattern)"))
    hits = [met.select("url", "is_allow")]
    for allow in (True, False):
        for tests in _passes(sub.filter(F.col("grams").isNull() & (F.col("is_allow") == allow))):
            flag = F.lit(False)
            for t in tests:
                flag = flag | F.col("url").rlike(f"(?i){t}")
            hits.append(urls.filter(flag).select("url", F.lit(allow).alias("is_allow")))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return found.groupBy("url").agg(F.max("is_allow").alias("rx_allow"), F.max(~F.col("is_allow")).alias("rx_block"))


def _passes(patterns: DataFrame, chunk: int = 200) -> Iterator[list[str]]:
    """Patterns as conditions, in lists of at most MAX_PATTERN_BYTES: plain ones folded into alternations,
    others alone, so no rule changes the meaning of another."""
    plain, tests, size = [], [], 0
    rows = patterns.select("pattern", F.col("pattern").rlike(NOT_FOLDABLE).alias("alone")).orderBy("alone", "pattern")
    for r in rows.toLocalIterator():
        if size + len(r["pattern"]) > MAX_PATTERN_BYTES:
            yield tests + ["|".join(plain)] * bool(plain)
            plain, tests, size = [], [], 0
        size += len(r["pattern"])
        if r["alone"]:
            tests.append(r["pattern"])
            continue
        plain.append(f"(?:{r['pattern']})")
        if len(plain) == chunk:
            tests.append("|".join(plain))
            plain = []
    if plain or tests:
        yield tests + ["|".join(plain)] * bool(plain)


def blocklist_verdict(df: DataFrame, rules: DataFrame, url_col: str = "url",
                      include_subdomains: bool = False, enabled: bool = True) -> DataFrame:
    """Adds ``bl_host``, ``bl_path``, ``bl_allowed`` and ``bl_rule``
    (which class blocked the URL, or null).  Allow rules of any class win;
    then wildcard, exact, path, regex in that order.  A disabled list blocks
    and allows nothing.

    The rules are matched with the distinct URLs, and what they match is written
    once; the rows themselves are joined once, to the URLs that some rule names."""
    out = df.withColumn("bl_host", extract_domain(F.col(url_col))) \
            .withColumn("bl_path", lower_path(F.col(url_col)))
    if not enabled:
        return out.withColumn("bl_allowed", F.lit(False)).withColumn("bl_rule", F.lit(None).cast("string"))
    urls = cut_lineage(df.select(F.col(url_col).alias("url")).filter("url is not null").distinct(), "rule_urls")
    named = cut_lineage(_verdicts(urls, rules, include_subdomains), "verdicts").withColumnsRenamed(
        {"url": "_bl_url", "bl_allowed": "_bl_allowed"})
    out = out.join(named, F.col(url_col) == F.col("_bl_url"), "left")
    return out.withColumn("bl_allowed", F.coalesce("_bl_allowed", F.lit(False))).select(
        *[F.col(f"`{c}`") for c in df.columns], "bl_host", "bl_path", "bl_allowed", "bl_rule")


def _verdicts(urls: DataFrame, rules: DataFrame, include_subdomains: bool) -> DataFrame:
    """(url, bl_allowed, bl_rule) of the distinct URLs that some rule allows or blocks."""
    rules = cut_lineage(rules, "rules")  # read by every class below: parsed once
    out = urls.withColumn("bl_host", extract_domain("url")).withColumn("bl_path", lower_path("url"))
    folded = sized_broadcast(cut_lineage(fold_hosts(rules), "folded_rules"))
    # URLs without a host match no rule: spread keys keep them apart in a shuffled join
    key = F.coalesce("bl_host", F.concat(F.lit(" "), F.pmod(F.xxhash64("url"), F.lit(1024)).cast("string")))
    out = out.withColumn("_key", key).join(folded, F.col("_key") == F.col("r_host"), "left")
    flag = {c: F.coalesce(f"r_{c}", F.lit(False)) for c in ("wild_allow", "exact_allow", "wild", "exact")}
    if include_subdomains:
        wild = rules.filter(F.col("rule_class") == "wildcard")
        for name, kind in (("wild_allow", F.col("is_allow")), ("wild", ~F.col("is_allow"))):
            out = _suffix_flag(out, wild.filter(kind), "_sub_" + name)
            flag[name] = flag[name] | F.col("_sub_" + name)
    told = {name: F.lit(False) for name in ("path_allow", "path_block", "rx_allow", "rx_block")}
    if not rules.filter(F.col("rule_class") == "path").isEmpty():
        paths = path_flags(out.filter("r_has_paths").select("bl_host", "bl_path", "r_lengths"), rules)
        paths = paths.withColumnsRenamed({"bl_host": "_ph", "bl_path": "_pp"})
        out = out.join(paths, (F.col("_key") == F.col("_ph")) & (F.col("bl_path") == F.col("_pp")), "left")
        told |= {c: F.coalesce(F.col(c), F.lit(False)) for c in ("path_allow", "path_block")}
    if not rules.filter(F.col("rule_class") == "regex").isEmpty():
        out = out.join(regex_flags(urls, rules).withColumnRenamed("url", "_rx_url"), F.col("url") == F.col("_rx_url"), "left")
        told |= {c: F.coalesce(F.col(c), F.lit(False)) for c in ("rx_allow", "rx_block")}
    allowed = flag["wild_allow"] | flag["exact_allow"] | told["path_allow"] | told["rx_allow"]
    out = out.withColumn("bl_allowed", F.col("bl_host").isNotNull() & allowed)
    rule = (F.when(F.col("bl_allowed") | F.col("bl_host").isNull(), F.lit(None))
            .when(flag["wild"], F.lit("wildcard")).when(flag["exact"], F.lit("exact"))
            .when(told["path_block"], F.lit("path")).when(told["rx_block"], F.lit("regex")))
    return out.withColumn("bl_rule", rule).filter(F.col("bl_allowed") | F.col("bl_rule").isNotNull()).select("url", "bl_allowed", "bl_rule")


def as_url_filter(rules: DataFrame, **kw):
    """X2 adapter: ``fn(df, url_col) -> df + blocked flag column``."""
    def _filter(df: DataFrame, url_col: str) -> DataFrame:
        v = blocklist_verdict(df, rules, url_col, **kw)
        return v.withColumn("blocked", F.col("bl_rule").isNotNull()).drop(
            "bl_host", "bl_path", "bl_allowed", "bl_rule")
    return _filter


def lines_from_rows(spark: SparkSession, source: str, lines: Iterable[str]) -> DataFrame:
    """Helper for tests and small configured lists."""
    rows = [(source, i + 1, s) for i, s in enumerate(lines)]
    return spark.createDataFrame(rows, "source string, line_no int, line string")
