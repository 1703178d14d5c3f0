"""The shared folder is the one the cluster names; only local sessions get their own."""

from types import SimpleNamespace

import pytest

from kinfold.plans.staging import shared_dir, stage, stage_path


def session(named, master, current=None):
    option = SimpleNamespace(isDefined=lambda: current is not None, get=lambda: current)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=context)


def test_named_folder_wins():
    assert shared_dir(session("hdfs://host/shared/", "yarn")) == "hdfs://host/shared"
    assert stage_path(session("file:///x", "local[2]"), "a").startswith("file:///x/kinfold-a-")


def test_cluster_without_a_folder_raises():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(None, master))
    assert shared_dir(session(None, "yarn", "hdfs://host/set")) == "hdfs://host/set"


def test_staged_tables_keep_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1.5], None), (None, None, "x")], "a long, b array<double>, c string")
    back = stage(df, "t")
    assert back.dtypes == df.dtypes and sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)
    assert stage(df.limit(0), "t").count() == 0


def test_staged_tables_are_deleted(spark):
    import os

    from kinfold.plans import staging

    where = lambda df: df.staged_path.removeprefix("file:")
    with staging.scratch(spark):
        one = staging.stage(spark.range(5), "one")
        with staging.scratch(spark):
            two = staging.stage(one, "two")
            assert two.count() == 5
        assert os.path.isdir(where(one)) and not os.path.isdir(where(two))
        staging.unstage(one)
        assert not os.path.isdir(where(one))
    assert not staging.exists(spark, one.staged_path)
