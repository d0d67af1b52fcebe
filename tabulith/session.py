"""Session helpers: the shared folder, written intermediate tables and the size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A written table of up to this many bytes (compressed, in its files) may be broadcast; beyond it it is shuffled.
BROADCAST_BYTES = 8 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); only where it is unset, as in tests, a folder of this machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("tabulith.shared.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tabulith-")
        spark.conf.set("tabulith.shared.dir", root)
    return root.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and the path as Hadoop's type."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_new(spark: SparkSession, path: str, data: bytes) -> None:
    """Create a file that appears whole or not at all; ``FileExistsError`` if it is there already, also if two callers try at a time.

    On a local disk a hard link decides, on object stores of the s3a scheme a conditional put (a store that has none refuses), elsewhere a rename
    that never overwrites, which is atomic on HDFS.
    """
    fs, p = hadoop_fs(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme == "file":
        target = urlparse(path).path if "://" in path or path.startswith("file:") else path
        part = f"{target}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, target)
        finally:
            os.unlink(part)
        return
    jvm = spark.sparkContext._jvm
    try:
        if scheme == "s3a":
            stream = fs.createFile(p).overwrite(False).recursive().must("fs.option.create.conditional.overwrite", True).build()
            stream.write(bytearray(data))
            stream.close()
            return
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(data))
        stream.close()
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, p, none)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(f"{path} exists") from e
        raise


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is removed when Python ends."""
    path = f"{shared_dir(spark)}/tabulith-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def intermediate_tables() -> Iterator[None]:
    """Remove the tables that were written within the block at its end: results must have been consumed, or written elsewhere, by then. Without it they
    stay until Python ends."""
    start = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[start:]:
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)
        del _written[start:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if what it reads comes in fewer parts, as a file of one row group does; else, and where it was shuffled anyway, as it is. For work on
    rows that takes far longer than moving them."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; of a written table it is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(written: DataFrame) -> DataFrame:
    """A written table marked for broadcast if its files are small, else as it is: the join then shuffles."""
    return F.broadcast(written) if plan_bytes(written) <= BROADCAST_BYTES else written


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None:
                continue
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended; its folder goes with it
            return
