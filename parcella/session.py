"""The session's shared folder, and ways to cut lineage that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the
    master is local (tests). Where it is unset on a cluster there is no such folder: an error."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="parcella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        return "file://" + own
    return os.path.dirname(spark.sparkContext._jsc.sc().getCheckpointDir().get())


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df, cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager)
    give_back(df.sparkSession)
    return out


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is deleted when the JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def give_back(spark: SparkSession) -> str | None:
    """Gives back to the system what the driver's JVM has freed outside its heap, compilers' work memory mostly, of which the C
    library otherwise keeps some hundred MB. What the JVM says of it; None where it doesn't know the command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    # by reflection, as the class of the server isn't an open one
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
    try:
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        return None


#: Paths of the tables that stored() has written within passing(); nothing is held outside of it.
_held: list[list[str]] = []
#: Removes a write's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again; keep: it outlives passing()."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if _held and not keep:
        _held[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What stored() writes meanwhile is deleted at the end, unless it is to be kept."""
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
