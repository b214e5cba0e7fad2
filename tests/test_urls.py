"""P1-P5, P3 guard with the DNS join (J11), crafted URL cases."""

from pyspark.sql import functions as F

from webweft.functions import urls as U
from webweft.operators.guard import guard

CASES = [
    # url, domain, lower path, robots url
    ("https://Example.COM:8080/A/B?q=1#f", "example.com", "/a/b", "https://example.com/robots.txt"),
    ("http://user:pw@host.example.org/x", "host.example.org", "/x", "http://host.example.org/robots.txt"),
    ("example.com/path", "example.com", "/path", None),
    ("host:8080/x", "host", "/x", None),
    ("http://my_host.example.com/", "my_host.example.com", "/", "http://my_host.example.com/robots.txt"),
    ("http://a.com", "a.com", "/", "http://a.com/robots.txt"),
    ("http://a.com/x/../y/./z", "a.com", "/y/z", "http://a.com/robots.txt"),
    ("http://a.com/x/..", "a.com", "/", "http://a.com/robots.txt"),
    ("http://[::1]:80/p", "[::1]", "/p", "http://[::1]/robots.txt"),
    ("", None, None, None),
]


def test_domain_path_robots(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    out = df.select("url", U.extract_domain("url").alias("d"), U.lower_path("url").alias("p"),
                    U.robots_url("url").alias("r")).collect()
    got = {r["url"]: (r["d"], r["p"], r["r"]) for r in out}
    for url, d, p, r in CASES:
        assert got[url] == (d, p, r), url


def test_public_ip(spark):
    cases = {"10.1.2.3": False, "172.16.0.1": False, "172.32.0.1": True, "192.168.1.1": False,
             "169.254.1.1": False, "127.0.0.1": False, "0.1.2.3": False, "8.8.8.8": True,
             "100.64.0.1": True, "[::1]": False, "::1": False, "0:0:0:0:0:0:0:1": False,
             "fe80::1": False, "fec0::1": False, "2001:db8::1": True, "example.com": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r["h"]: r["p"] for r in df.select("h", U.is_public_ip("h").alias("p")).collect()}
    assert got == cases


def test_guard_with_dns(spark):
    reqs = spark.createDataFrame([
        (1, None), (2, "   "), (3, "not a url"), (4, "ftp://a.com/x"), (5, "http://a.com/x/../y"),
        (6, "http://10.0.0.1/"), (7, "http://8.8.8.8/"), (8, "http://private.example/"),
        (9, "http://mixed.example/"), (10, "http://public.example/"), (11, "http://unknown.example/"),
        (12, "https://[::1]/x")], "id int, url string")
    dns = spark.createDataFrame([
        ("private.example", "192.168.0.5", 1), ("mixed.example", "8.8.4.4", 1), ("mixed.example", "127.0.0.2", 2),
        ("public.example", "1.1.1.1", 1)], "host string, ip string, pos int")
    got = {r["id"]: (r["url_ok"], r["url_error"]) for r in guard(reqs, dns).collect()}
    assert got[1] == (False, "URL is required")
    assert got[2] == (False, "URL is required")
    assert got[3] == (False, "Invalid URL format")
    assert got[4] == (False, "Scheme 'ftp' not allowed")
    assert got[5] == (False, "Path traversal not allowed")
    assert got[6] == (False, "Internal IP addresses are not allowed")
    assert got[7] == (True, None)
    assert got[8] == (False, "Host 'private.example' resolves to internal IP (192.168.0.5)")
    assert got[9] == (False, "Host 'mixed.example' resolves to internal IP (127.0.0.2)")
    assert got[10] == (True, None)
    assert got[11] == (True, None)
    assert got[12] == (False, "Internal IP addresses are not allowed")
