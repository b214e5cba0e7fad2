"""S5, U1-U3, A5 and the verdict joins J2-J6 on crafted rule lines."""

from pyspark.sql import functions as F

from webweft.operators import blocklist as B

LINES = [
    "! comment", "# comment", "   ", "",
    "*://*.spam.example/*",            # wildcard
    "*://*.SPAM.example/*",            # duplicate by case
    "*://Exact.Example/*",             # exact (lower-cased)
    "*://paths.example/foo/*",         # path prefix
    "*://*.paths.example/bar",         # exact path (leading *. allowed)
    "/casino|pills/",                  # regex
    "/(unclosed/",                     # invalid regex: dropped
    "/abc/i",                          # regex with flags: ignored
    "plain.example",                   # plain host: ignored
    "@*://*.allowed.example/*",        # allow (wildcard)
    "@*://allowed2.example/*",         # allow (exact) - D2
    "*://*.allowed.example/*",         # blocked too, but allow wins
    "  @ *://*.spaced.example/*  ",    # allow after trim
    "*://*.cheap-pills.example/*",
]


def _rules(spark):
    return B.load_rules(B.lines_from_rows(spark, "test", LINES))


def test_classify_and_counts(spark):
    counts = {r["rule_class"]: r["n_rules"] for r in B.rule_counts(_rules(spark)).collect()}
    assert counts == {"wildcard": 3, "exact": 1, "path": 2, "regex": 1, "allow": 3}


def test_verdicts(spark):
    urls = spark.createDataFrame([
        (1, "https://spam.example/x"), (2, "https://sub.spam.example/x"), (3, "http://exact.example/a"),
        (4, "http://paths.example/foo/bar"), (5, "http://paths.example/foobar"), (6, "http://paths.example/BAR?q=1"),
        (7, "http://paths.example/bar/x"), (8, "http://x.example/casino"), (9, "http://allowed.example/casino"),
        (10, "http://allowed2.example/pills"), (11, "http://clean.example/"), (12, "notaurl with space"),
        (13, "https://www.cheap-pills.example/p"),
    ], "id int, url string")
    got = {r["id"]: r["bl_rule"] for r in B.blocklist_verdict(urls, _rules(spark)).collect()}
    assert got == {1: "wildcard", 2: None, 3: "exact", 4: "path", 5: "path", 6: "path", 7: None,
                   8: "regex", 9: None, 10: None, 11: None, 12: None, 13: "regex"}
    sub = {r["id"]: r["bl_rule"] for r in
           B.blocklist_verdict(urls, _rules(spark), include_subdomains=True).collect()}
    assert sub[2] == "wildcard" and sub[13] == "wildcard"


def test_regex_rules_do_not_change_each_other(spark):
    lines = [r"/(?<n>casino)\.a/", r"/(?<n>pills)\.b/", r"/(x)(y)\2\1z/", r"/\Qa.b(c\E/", r"/(?-i)CaseOnly/", "/plain[0-9]+/", "@/(good)-\\1/"]
    rules = B.load_rules(B.lines_from_rows(spark, "s", lines))
    assert rules.count() == 7
    urls = ["http://h.example/casino.a", "http://h.example/pills.b", "http://h.example/xyyxz", "http://h.example/xyxyz",
            "http://h.example/a.b(c", "http://h.example/axb(c", "http://h.example/CaseOnly", "http://h.example/caseonly",
            "http://h.example/PLAIN7", "http://h.example/plain7?good-good", "http://h.example/good"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r["id"] for r in B.blocklist_verdict(df, rules).filter("bl_rule = 'regex'").collect()}
    assert got == {0, 1, 2, 4, 6, 8}
    assert B.blocklist_verdict(df, rules, enabled=False).filter("bl_rule is not null or bl_allowed").isEmpty()


def test_snapshot_swap(spark):
    old = _rules(spark)
    allow_only = B.load_rules(B.lines_from_rows(spark, "s", ["@*://*.a.example/*"]))
    assert B.swap_snapshot(old, allow_only) is old
    only_exact = B.load_rules(B.lines_from_rows(spark, "s", ["*://new.example/*"]))
    merged = B.swap_snapshot(old, only_exact)
    counts = {r["rule_class"]: r["n_rules"] for r in B.rule_counts(merged).collect()}
    assert counts == {"exact": 1, "wildcard": 3, "allow": 3}  # path and regex rules are replaced by none


def test_a_missing_source_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "a.txt").write_text("*://*.a.example/*\n")
    lines, failed = B.read_sources(spark, [str(tmp_path / "a.txt"), str(tmp_path / "missing.txt")])
    assert B.load_rules(lines).count() == 1 and failed == [str(tmp_path / "missing.txt")]
    none, failed = B.read_sources(spark, [str(tmp_path / "missing.txt")])
    assert none.count() == 0 and len(failed) == 1


def test_text_source(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("! header\n*://*.a.example/*\n\n@*://b.example/*\n")
    lines = B.read_rule_text(spark, str(p))
    got = sorted((r["line_no"], r["line"]) for r in lines.collect())
    assert got[1] == (2, "*://*.a.example/*") and got[3] == (4, "@*://b.example/*")
    counts = {r["rule_class"]: r["n_rules"] for r in B.rule_counts(B.load_rules(lines)).collect()}
    assert counts == {"wildcard": 1, "allow": 1}


def test_subscription_list(spark):
    configured = spark.createDataFrame([("https://lists.example/a.txt",), (" https://lists.example/b.txt ",)], "url string")
    extra = B.lines_from_rows(spark, "f", ["# comment", "", "https://lists.example/b.txt", "https://lists.example/c.txt"])
    got = sorted(r["url"] for r in B.subscription_list(configured, extra).collect())
    assert got == ["https://lists.example/a.txt", "https://lists.example/b.txt", "https://lists.example/c.txt"]


def test_line_numbers_of_a_file_read_in_many_parts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 37)}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        df = B.read_rule_text(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 1
        rows = [tuple(r) for r in df.select("source", "line_no", "line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3002
    assert all(line.startswith(f"line {n - 1} ") for s, n, line in rows if s.endswith("a.txt"))
    assert sorted((n, line) for s, n, line in rows if s.endswith("b.txt")) == [(1, "one"), (2, "two")]


PATTERNS = [r"ads?\.example\.com", r"track(er|ing)/[0-9]+", r"^https://pay\.", r"casino|poker", r"foo.*bar", r"a{2,3}banner", r"\bpromo\d{2}\b",
            r"x[yz]+wall", r"(?:img|pic)\.host\.net/\w+", r"\Qa.b\E", r"(ab)\1cd", r"utm_source=[^&]+", r"UPPER\.case", r"end\.html$",
            r"opt(ional)?part", r"colou?rs", r"((deep)(er))est", r"\x61dvert", r"p\.{2}q", r"(?=look)ahead", r"\/sl\/ash\-es", r"z*", r"k.l.m.n"]
URLS = ["https://ads.example.com/a", "http://AD.EXAMPLE.com", "https://x/track/9", "https://x/tracker/9", "https://x/tracking/77", "https://pay.me/",
        "http://pay.me", "http://poker.io", "http://x/foo/1/bar", "http://x/aabanner", "http://x/aaaabanner", "http://x/abanner", "http://x/promo12",
        "http://x/promo123", "http://x/xyzywall", "http://img.host.net/q", "http://pic.host.net/", "http://a.b/", "http://a-b/", "http://x/ababcd",
        "http://x?utm_source=q", "http://upper.CASE/", "http://x/end.html", "http://x/end.html?", "http://x/optpart", "http://x/optionalpart",
        "http://x/colors", "http://x/colours", "http://x/deeperest", "http://x/advert", "http://x/p..q", "http://x/sl/ash-es", "http://x/k1l2m3n", None, ""]


def test_pattern_index_equals_running_every_pattern(spark):
    rules = spark.createDataFrame([("regex", i % 3 == 0, p) for i, p in enumerate(PATTERNS)], "rule_class string, is_allow boolean, pattern string")
    urls = spark.createDataFrame([(u,) for u in URLS if u is not None], "url string")
    got = {r["url"]: (r["rx_allow"], r["rx_block"]) for r in B.regex_flags(urls, rules).collect()}
    every = urls.crossJoin(rules).filter(F.expr("url rlike concat('(?i)', pattern)")).groupBy("url").agg(
        F.max("is_allow").alias("a"), F.max(~F.col("is_allow")).alias("b")).collect()  # all pairs: a small fixture
    assert got == {r["url"]: (r["a"], r["b"]) for r in every}


def test_required_text(spark):
    want = {r"ads?\.example\.com": ".example.com", r"casino|poker": "", r"foo.*bar": "foo", r"a{2,3}banner": "banner", r"\Qa.b\E": "",
            r"utm_source=[^&]+": "utm_source=", r"UPPER\.case": "upper.case", r"opt(ional)?part": "part", r"(?=look)ahead": "",
            r"track(er|ing)/[0-9]+": "", r"pp\.{2}q": "pp", r"\bpromo\d{2}\b": "promo", r"\/sl\/ash\-es": "/sl/ash-es"}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", B.required_text(F.col("p")).alias("t"))
    assert {r["p"]: r["t"] for r in df.collect()} == want


def test_many_patterns_and_path_rules(spark):
    """Far more rules than conditions or one row could hold: only those that a URL meets are looked at."""
    n = 20_000
    lines = spark.range(n).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("line_no"), F.when(
        F.col("id") % 2 == 0, F.concat(F.lit("/tracker-"), "id", F.lit(r"\.[a-z]+/pixel/"))).otherwise(
        F.concat(F.lit("*://hot.example.com/area-"), "id", F.lit("/*"))).alias("line"))
    rules = B.load_rules(lines)
    urls = ["https://tracker-4242.net/pixel", "https://tracker-4243.net/pixel", "http://hot.example.com/area-77/deep/page",
            "http://hot.example.com/area-8/x", "http://hot.example.com/area-7", "http://cold.example.com/area-77/"]
    out = B.blocklist_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert {r["url"]: r["bl_rule"] for r in out.collect()} == dict(zip(urls, ["regex", None, "path", None, "path", None]))
