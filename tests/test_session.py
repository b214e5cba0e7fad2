"""Shared work folder: refused off local masters, one per application, removable."""

import pytest

from webweft import session as S


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            S.local_work_folder(master)
    for master in ("local", "local[4]", "local[*]"):
        assert S.local_work_folder(master)


def test_tables_lie_below_the_application_and_can_be_cleared(spark, monkeypatch):
    root = S.work_root(spark)
    assert spark.sparkContext.applicationId in root and S.work_path(spark, "x").startswith(root)
    monkeypatch.setattr(S, "work_root", lambda s: root + "-test")
    df = S.cut_lineage(spark.range(3), "cleared")
    assert df.count() == 3 and f"{root}-test/tables/cleared" in df.inputFiles()[0].replace("file://", "file:").replace("file:///", "file:/")
    S.clear_work(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root + "-test")
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_sizes_are_measured_in_bytes(spark):
    from pyspark.sql import functions as F
    from webweft.operators.sizing import fits_broadcast, table_bytes
    one = spark.range(1).select(F.repeat(F.lit("x"), 5000).alias("t"))
    assert 5000 < table_bytes(one) < 5100 and fits_broadcast(one) and not fits_broadcast(one, 1000)
    assert table_bytes(one.limit(0)) == 0
