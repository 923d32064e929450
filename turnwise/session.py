"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package benefits from. All are run-time settings, so they also
# apply to a session the caller has already started.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Word lists expand on reading: do not merge small shuffles into fewer tasks than cores.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may be split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Two tables laid out by conversation join on (conversation, term) where they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


BUCKET_BYTES = 1 << 26  # of written rows

# What this process has written and not released: per application, tables and folders.
_made: dict[str, list[tuple[str, str]]] = {}


def local_session(cores: str = "*", app: str = "turnwise", **conf: str) -> SparkSession:
    """A local session for tests, the bench and notebooks. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Where neither is done the
    session must be local (one machine is then all there is); a distributed session is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnwise-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _note(spark: SparkSession, kind: str, name: str) -> str:
    _made.setdefault(spark.sparkContext.applicationId, []).append((kind, name))
    return name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; :func:`release` deletes it."""
    return _note(spark, "folder", os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a folder."""
    system, place = _files(spark, path)
    return system.getContentSummary(place).getLength()


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`scratch_path` that no table reads any more."""
    system, place = _files(spark, path)
    system.delete(place, True)
    made = _made.get(spark.sparkContext.applicationId, [])
    if ("folder", path) in made:
        made.remove(("folder", path))


def _drop(spark: SparkSession, kind: str, name: str) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    else:
        system, place = _files(spark, name)
        system.delete(place, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Drop the tables and folders that this package has written in the shared folder.

    Results that read them must be saved before. ``since`` keeps the first ones (:func:`scratch` uses it).
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    for kind, name in made[since:]:
        _drop(spark, kind, name)
    del made[since:]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block is deleted at its end; save the results before."""
    since = len(_made.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written rows.

    Use it for a table that several later steps read and that is dear to compute, such as the
    tokenised turns: the copy survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets for so many written bytes; at least as many as a shuffle has partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def lay_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Write ``df`` to the shared folder, bucketed by ``keys``, and continue from the written table.

    Like :func:`cut_lineage`, and every later grouping or join that includes the keys finds its rows in
    place. Columns nobody asks for are not read again. The rows are written as they come first, as
    only their size, not an estimate from the plan, tells how many buckets they need.
    """
    spark = df.sparkSession
    flat = scratch_path(spark, "rows")
    df.write.parquet(flat)
    buckets = bucket_count(spark, written_bytes(spark, flat))
    placed = spark.read.schema(df.schema).parquet(flat).repartition(buckets, *keys)
    path = scratch_path(spark, "table")
    name = _note(spark, "table", f"turnwise_{uuid.uuid4().hex}")
    writer = placed.write.format("parquet").bucketBy(buckets, *keys)
    writer.option("path", path).saveAsTable(name)
    delete_scratch(spark, flat)
    return spark.table(name)
