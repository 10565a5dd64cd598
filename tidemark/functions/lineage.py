"""Cutting the lineage of intermediate results that several later stages read."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Seconds between two calls of trim() at least, and when the last one was.
TRIM_EVERY = 5.0
_trimmed = [-TRIM_EVERY]


def trim_if_due(spark: SparkSession) -> None:
    if time.monotonic() - _trimmed[0] >= TRIM_EVERY:
        trim(spark)
        _trimmed[0] = time.monotonic()


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM return to the system the native memory that it has freed, by the command that jcmd calls System.trim_native_heap.

    A driver's many short threads and compilations leave freed memory in glibc's arenas, which keep it. False where the JVM has no
    such command.
    """
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values = new(jvm.java.lang.Object, 4)
    values[0], values[1], values[2], values[3] = bean, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    try:
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        return bool(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values))
    except Py4JError:
        return False


_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, until release()."""
    trim_if_due(spark)
    _given.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def given() -> int:
    """How many paths scratch() has given that are not released."""
    return len(_given)


def release(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> None:
    """Delete what was written to the paths that scratch() gave after the first ``since``; for when the results that need it are written.

    Checkpoints are Spark's own: set spark.cleaner.referenceTracking.cleanCheckpoints to have them go with their last reference.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _given[since:] if p not in but]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _given.remove(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read from there by all that follows."""
    shared_folder(df.sparkSession)
    trim_if_due(df.sparkSession)
    return df.checkpoint()
