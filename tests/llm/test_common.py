import os
from types import SimpleNamespace

import pytest

from punctual.llm import common

F = common.F


def folder_of(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_lean_tables_keep_their_rows_and_leave_the_setting(spark):
    before = spark.conf.get(common._CLEAN_UP)
    kept = common.stored_lean(spark.range(100).groupBy(F.col("id") % 7).agg(F.sum("id").alias("n")))
    assert kept.agg(F.sum("n")).first()[0] == 4950 and kept.groupBy("n").count().count() == 7
    assert spark.conf.get(common._CLEAN_UP) == before


def test_forgotten_tables_are_gone(spark):
    one, other = common.stored_lean(spark.range(5)), common.stored_lean(spark.range(0))
    folder = folder_of(one)
    assert os.path.isdir(folder)
    common.forget(one)
    common.forget(other)
    assert not os.path.exists(folder) and os.path.isdir(os.path.dirname(folder))


def test_a_cluster_must_name_its_shared_folder():
    settings = SimpleNamespace(get=lambda name, default=None: default)
    cluster = SimpleNamespace(conf=settings, sparkContext=SimpleNamespace(getConf=lambda: settings, master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)
