"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_CLAIMED: dict[str, list[str]] = {}
#: Seconds from one collection of the driver's garbage to the next, at least; short runs never pay for one.
TIDY_S = 5.0
_TIDIED: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in local mode, where it is unset, a folder in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def claim(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`release` or the end of the application removes."""
    app = spark.sparkContext.applicationId
    top = f"{shared_dir(spark)}/pairlens-{app}"
    if app not in _CLAIMED:
        folder = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    _CLAIMED.setdefault(app, []).append(path)
    return path


def tidy(spark: SparkSession) -> bool:
    """Have the driver collect its garbage, if it last did :data:`TIDY_S` ago; whether it did.

    Plans, broadcasts and shuffles of finished jobs otherwise stay until the heap is full, and it grows with the tasks that ran.
    What compilers and codecs have freed outside the heap goes back to the system too.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _TIDIED.setdefault(app, now) < TIDY_S:
        return False
    spark._jvm.System.gc()
    trim(spark)
    _TIDIED[app] = time.monotonic()
    return True


def trim(spark: SparkSession) -> bool:
    """Have the C library of the driver's JVM return memory that is free; whether the JVM can."""
    java = spark._jvm.java.lang
    try:
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the interface's method: the class of the server is not open to reflection
        kinds = spark.sparkContext._gateway.new_array(java.Class, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = java.Class.forName(kind)
        given = spark.sparkContext._gateway.new_array(java.Object, 4)
        given[0], given[1] = name, "systemTrimNativeHeap"
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:  # other JVMs and C libraries have no such command
        return False
    return True


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again; it survives lost executors."""
    path = claim(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def claimed(spark: SparkSession) -> list[str]:
    return list(_CLAIMED.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, *kept: str) -> None:
    """Remove this application's claimed paths but those to keep.  Frames that read them are of no use afterwards."""
    for path in [p for p in claimed(spark) if p not in kept]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _CLAIMED[spark.sparkContext.applicationId].remove(path)
