"""What operators need of the cluster: shared scratch tables and shipped code.

Iterative operators cut their lineage by writing a table to the folder named by
``spark.checkpoint.dir`` (shared by all executors), so a lost executor costs a
task's work and never the table.  Only where no folder is set (as in tests) a
temporary one is made.
"""

from __future__ import annotations

import atexit
import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()

SAVES = 4  # tables written between two releases


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jvm_dir = sc._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lacuna-")
    sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="lacuna-code-")
    target = os.path.join(folder, f"{root.name}.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def _trim(spark: SparkSession) -> None:
    """Give the driver's freed native memory back to the system, where its Java can do that (17.0.9 and later)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    array = lambda kind, *values: _filled(gateway.new_array(kind, len(values)), values)
    kind = jvm.java.lang.Class.forName
    try:
        at = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        types = array(jvm.java.lang.Class, *map(kind, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        invoke = kind("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, at, "systemTrimNativeHeap", None, None))
    except Py4JError:
        pass


def _filled(array, values):
    for i, v in enumerate(values):
        array[i] = v
    return array


class Folder:
    """Small files of a folder on the cluster's file system, for what must be there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.path = str(self._fs.makeQualified(p).toString()).rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def write(self, name: str, text: str) -> None:
        """A new file; one that exists is an error.  It appears under its name only when it is whole."""
        draft, final = self._at(f".draft-{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.path}/{name}")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if not n.startswith("."))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Scratch:
    """Tables of one operator call in the shared folder, removed when Python ends.

    Every SAVES tables of a session the driver lets go of what it no longer needs:
    many small jobs otherwise leave it plans, shuffle files and compiled code's
    working memory by the hundred MB before it collects its garbage by itself.
    """

    saves = 0

    def __init__(self, spark: SparkSession, name: str = "op"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df now and return the written table, which has no lineage."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._lacuna_path = path  # keeps the path with the object
        Scratch.saves += 1
        if Scratch.saves % SAVES == 0:
            self.release()
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing will read again."""
        if path := getattr(df, "_lacuna_path", None):
            self._delete(path)

    def release(self) -> None:
        """Let go of the shuffle files of what is no longer referenced, which otherwise stay until the driver happens to collect its garbage."""
        gc.collect()
        jvm = self.spark.sparkContext._jvm
        jvm.System.gc()
        _trim(self.spark)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None or sc._jsc.sc().isStopped():
                if path.startswith("file:"):
                    import shutil

                    shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """df with its 1-based place in a total order, without bringing it into one task.

    A global sort is written once; a row's place is its place in its partition
    plus the rows of the partitions before, of which there is one number each.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    x = scratch.save(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "sorted")
    sizes = x.groupBy(F.shiftright("at_", 33).alias("part_")).agg(F.count("*").alias("n_"))
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))  # one row a partition
    x = x.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(before), "part_")
    return x.withColumn(name, (F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("at_", "part_", "before_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
