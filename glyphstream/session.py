"""Session defaults and shared storage for intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster, use the session that is there."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glyphstream")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Where it is unset, a session of this machine alone takes a temporary one; a cluster's
    is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    if (named := sc.getCheckpointDir()) is not None:
        return named
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = os.path.join(tempfile.gettempdir(), "glyphstream-checkpoints")
    sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by an eager checkpoint in the shared folder, so that a lost executor costs one read."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write to a Parquet table in the shared checkpoint folder and read it back: cuts the lineage and keeps column pruning.

    The tables stay until ``drop_stored``, as results that are still lazy may read them."""
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def release(df: DataFrame) -> None:
    """Delete the table that ``stored`` returned, once nothing lazy reads it any more."""
    if (path := df.stored_at) in _stored:
        _stored.remove(path)
        _delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any Hadoop file system."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written in this process."""
    while _stored:
        _delete(spark, _stored.pop())


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need not find it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_glyphstream_shipped", False):
        return
    package = Path(__file__).parent
    place = Path(tempfile.mkdtemp(prefix="glyphstream-")) / "glyphstream.zip"
    atexit.register(shutil.rmtree, place.parent, ignore_errors=True)
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(place))
    sc._glyphstream_shipped = True


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and lower the size of Arrow batches from Spark's default (64 MB) to BATCH_BYTES, as a worker holds a batch of long texts
    several times over; another setting of the session stays."""
    ship(spark)
    if spark.conf.get(_BATCH, None) == "67108864b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
