"""Session-level helpers: reading tables, cutting lineage, spreading work and joining under skew."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 50_000  # rows of one key that a single task joins without harm
MOST_HOT = 256  # keys that are salted at most: any other key holds less than 1/256 of the rows
SALTS = 64

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A session of one process (``local[n]``) that names none gets a folder of this machine; on a cluster that is an error,
    since executors elsewhere could neither write nor find it.
    """
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    context = spark.sparkContext
    if not (current := context.getCheckpointDir()):
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, local, True)
        context.setCheckpointDir(f"file://{local}")
        current = context.getCheckpointDir()
    return current.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder if it is there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """One small file from the driver, on whatever file system the path names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file to the driver; None where there is none."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop_path):
        return None
    stream = system.open(hadoop_path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a file or folder; false where there is none."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(old) and system.rename(old, new)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed by ``discard``, ``intermediates`` or when the driver's process ends."""
    path = f"{shared_dir(spark)}/corpusloom-{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within the block remove their shuffle files as they end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote for these, once nothing reads them any more."""
    for df in frames:
        if (path := getattr(df, "_corpusloom_path", None)) in _written:
            remove(_written.pop(path), path)


@contextmanager
def intermediates() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Everything written to the shared folder within the block is removed at its end: use the results inside.

    The block gets a function that keeps a materialised DataFrame for longer.
    """
    before = set(_written)

    def keep(df: DataFrame) -> DataFrame:
        before.add(getattr(df, "_corpusloom_path", ""))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _written if p not in before]:
            remove(_written.pop(path), path)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; nothing to report to
            if path.startswith("file:/"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few, small files as many partitions as there are cores.

    Inputs that already fill the cluster keep their partitions, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than that and one."""
    return df.limit(most + 1).count() <= most


def hot_keys(df: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame | None:
    """``(key)``: the up to ``MOST_HOT`` most frequent keys with more than ``least`` rows; None where there is none.

    Counts combine before the shuffle. The list is bounded by its length, whatever the size of the data.
    """
    with brief_shuffles(df.sparkSession):
        counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
        top = counts.filter(F.col("rows_of_key") > least).orderBy(F.desc("rows_of_key")).limit(MOST_HOT).select(key).collect()
    return df.sparkSession.createDataFrame(top, df.select(key).schema) if top else None


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = SALTS, least: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right``; a key that floods ``left`` is spread over tasks.

    ``left`` should be materialised: it is read once for counting and once for joining. Rows of cold keys are neither
    copied nor moved more than in a plain join; those of ``right`` are copied once a salt for hot keys only. Null keys
    match nothing. ``how`` is inner, left, left_semi or left_anti.
    """
    hot = hot_keys(left, key, least)
    if hot is None:
        return left.join(right, key, how)
    hot = hot.withColumn("is_hot", F.lit(True))
    mark = lambda df: df.join(F.broadcast(hot), key, "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    salt: Column = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*(c for c in left.columns if c != key)), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = mark(left).withColumn("salt", salt).drop("is_hot")
    every = mark(right).withColumn("salt", F.explode(copies)).drop("is_hot")
    # the planner doesn't count the copies: a side that seems small would be broadcast at many times its size
    return salted.join(every.hint("merge"), [key, "salt"], how).drop("salt")


def salted_semi_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose ``key`` is among those of ``right``, hot keys spread as in ``salted_join``."""
    return salted_join(left, right.select(key).distinct(), key, "left_semi").select(*left.columns)


def numbered(df: DataFrame, key: str, order: str, parts: int = 64) -> DataFrame:
    """``df`` with ``place``, the number from 1 of a row among those of its ``key`` in the order of the numeric ``order``.

    Rows are numbered within ranges of ``order`` and lifted by what stands before, so a flooding key is split. ``df``
    should be materialised; ``order`` should be unique within a key. Null keys are one group.
    """
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("part_no", part)
    # at most ``parts`` rows a key
    before = W.partitionBy(key).orderBy("part_no").rowsBetween(W.unboundedPreceding, -1)
    lift = cut.groupBy(key, "part_no").agg(F.count(F.lit(1)).alias("n")).withColumn("lift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    lift = lift.select(F.col(key).alias("key_of_lift"), F.col("part_no").alias("part_of_lift"), "lift")
    ranked = cut.withColumn("place", F.row_number().over(W.partitionBy(key, "part_no").orderBy(order)))
    joined = ranked.join(lift, F.col(key).eqNullSafe(F.col("key_of_lift")) & (F.col("part_no") == F.col("part_of_lift")))
    return joined.withColumn("place", F.col("place") + F.col("lift")).drop("part_no", "key_of_lift", "part_of_lift", "lift")
