"""Reading the tables of a data folder, and the one shared folder that cuts of lineage go to."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes a query's shuffle files at its end.
DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of `sf_dir`; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out evenly if it is read in fewer splits than there are cores, as small files with one row group are.

    So many splits are a small input, and moving it costs little; a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset a folder of our own is chosen, in local mode; a
    cluster's machines share none, so there it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            named = f"/tmp/checkpoints/sparkquill-{uuid.uuid4().hex}"
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Tables written inside go at the end, but those that a DataFrame in `keep` reads."""
    start = len(_made)
    try:
        yield
    finally:
        kept = {f for df in keep for f in df.inputFiles()}
        for spark, path in _made[start:]:
            if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in kept):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made[start:] = [m for m in _made[start:] if any(f"/{m[1].rsplit('/', 1)[1]}/" in f for f in kept)]


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s result, without the working tables that it doesn't read."""
    keep: list[DataFrame] = []
    with scratch(keep):
        keep.append(make())
    return keep[0]


def _counted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    _made.append((spark, path))


def _new(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for working files: `scratch` deletes it where it is no longer read, the application's end otherwise."""
    path = _new(spark, label)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    _counted(spark, path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffles goes from the disks when it ends; else it stays until the driver collects its garbage."""
    before = spark.conf.get(DROP, None)
    spark.conf.set(DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP) if before is None else spark.conf.set(DROP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read again: lineage is cut, and losing an executor loses nothing.

    The table is a working table, deleted as `scratch_dir` says."""
    path = _new(df.sparkSession, label)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    _counted(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
