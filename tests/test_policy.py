"""P13-P16 curves (checked values), jitter bounds and monotonicity."""

from pyspark.sql import functions as F

from webweft.functions import policy as P

TTL = [60, 120, 155.0978, 180, 360, 720, 1440, 2880, 5760, 10080]
BLOCK = {1: 10, 2: 12.9248, 3: 15, 4: 30, 5: 60, 6: 120, 7: 240, 8: 480, 9: 960, 10: 1920, 11: 3840,
         12: 7680, 13: 10080}


def test_curves(spark):
    df = spark.range(0, 16).withColumnRenamed("id", "n")
    rows = df.select("n", F.round(P.cache_ttl_minutes("n"), 4).alias("ttl"),
                     F.round(P.block_minutes("n"), 4).alias("blk"),
                     P.stability_reset("n").alias("rst"),
                     P.jitter_factor(F.col("n").cast("string")).alias("j")).orderBy("n").collect()
    for r in rows:
        if r["n"] < len(TTL):
            assert abs(r["ttl"] - TTL[r["n"]]) < 1e-3
        if r["n"] in BLOCK:
            assert abs(r["blk"] - BLOCK[r["n"]]) < 1e-3
        assert r["rst"] == max(1, min(r["n"] // 5, 6))
        assert 0.85 <= r["j"] < 1.15
    ttls = [r["ttl"] for r in rows]
    blks = [r["blk"] for r in rows]
    assert ttls == sorted(ttls) and blks == sorted(blks)
