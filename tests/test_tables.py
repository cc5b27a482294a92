import os

import pytest
from pyspark.sql import functions as F

from sparkquill import tables


def test_written_and_scratch(spark):
    keep = []
    with tables.scratch(keep):
        gone = tables.written(spark.range(10), "gone")
        kept = tables.written(gone.filter("id > 4"), "kept")
        keep.append(kept)
    assert kept.count() == 5
    files = [f.removeprefix("file://") for f in gone.inputFiles()]
    assert files and not any(os.path.exists(f) for f in files)
    assert tables.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_spread(spark):
    one = spark.range(100).coalesce(1)
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 500)
    assert tables.spread(many) is many
    assert tables.spread(one).agg(F.sum("id")).first()[0] == 4950


def test_settled(spark):
    parts = []

    def make():
        parts.append(tables.written(spark.range(10), "gone"))
        return tables.written(parts[0].filter("id > 4"), "kept").filter("id > 5")

    assert tables.settled(make).count() == 4
    assert not os.path.exists(parts[0].inputFiles()[0].removeprefix("file://"))


def test_shared_dir_is_never_local_to_a_machine():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Empty:
        isDefined = staticmethod(lambda: False)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Empty)}))})

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.shared_dir(type("Session", (), {"conf": Conf, "sparkContext": Context}))
