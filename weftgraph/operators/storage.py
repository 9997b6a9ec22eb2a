"""Versioned tables: each write is a new folder of Parquet, made current by one small pointer file."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStore:
    """Tables under a root folder, in any store that Hadoop's file systems reach. A table exists once it has a pointer, of which
    that of the highest number holds: a write adds one and removes none, so one that fails at any point leaves
    the version before. The pointer also keeps a fingerprint of the configuration. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        found = [re.fullmatch(r"_current-(\d+)\.json", x.getPath().getName()) for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for m in found if m)

    def _pointer(self, name: str, number: int):
        return self._path(f"{self.root}/{name}/_current-{number:09d}.json")

    def _read_pointer(self, name: str) -> dict | None:
        if not (numbers := self._pointers(name)):
            return None
        stream = self._fs.open(self._pointer(name, numbers[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self, name: str, config: dict | None = None) -> bool:
        """Whether the table is complete, and written with `config` if one is given."""
        at = self._read_pointer(name)
        return at is not None and (config is None or at["config"] == json.loads(json.dumps(config, sort_keys=True)))

    def read(self, name: str) -> DataFrame:
        at = self._read_pointer(name)
        if at is None:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        paths = [f"{self.root}/{name}/{v}" for v in at["versions"]]
        return self.spark.read.parquet(*paths)

    def _publish(self, name: str, versions: list[str], config: dict | None) -> None:
        temporary = self._path(f"{self.root}/{name}/_next-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(json.dumps({"versions": versions, "config": json.loads(json.dumps(config, sort_keys=True))}).encode()))
        finally:
            out.close()
        if not self._fs.rename(temporary, self._pointer(name, max(self._pointers(name), default=0) + 1)):
            raise OSError(f"{name} could not be published")

    def _write(self, df: DataFrame, name: str) -> str:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def overwrite(self, df: DataFrame, name: str, config: dict | None = None) -> DataFrame:
        self._publish(name, [self._write(df, name)], config)
        return self.read(name)

    def append(self, df: DataFrame, name: str) -> DataFrame:
        at = self._read_pointer(name) or {"versions": [], "config": None}
        self._publish(name, [*at["versions"], self._write(df, name)], at["config"])
        return self.read(name)

    def compact(self, name: str, partitions: int | None = None) -> DataFrame:
        """Rewrite a table's versions as one, in `partitions` files if given."""
        df, at = self.read(name), self._read_pointer(name)
        self._publish(name, [self._write(df.repartition(partitions) if partitions else df, name)], at["config"])
        return self.read(name)

    def vacuum(self, name: str) -> int:
        """Delete pointers but the last and the versions that it doesn't name; how many versions."""
        at, gone = self._read_pointer(name), 0
        for number in self._pointers(name)[:-1]:
            self._fs.delete(self._pointer(name, number), False)
        for entry in self._fs.listStatus(self._path(f"{self.root}/{name}")) if at else []:
            leaf = entry.getPath().getName()
            if leaf.startswith(("v-", "_next-")) and leaf not in at["versions"]:
                self._fs.delete(entry.getPath(), True)
                gone += 1
        return gone

    def save_state(self, name: str, state: dict) -> None:
        """A small JSON document, such as timings by phase; keys that are lists are kept as such by the caller."""
        out = self._fs.create(self._path(f"{self.root}/{name}.json"), True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()

    def load_state(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and Spark is local, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weft-')}"
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def trim_jvm(spark: SparkSession) -> str | None:
    """What the driver's JVM has freed in the C heap, such as its compilers' arenas, goes back to the system. Its answer; null from a JVM that can't."""
    jvm = spark._jvm
    server, command = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    try:
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface: the server's own class is not exported.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(server, command)
    except Py4JError:
        return None


#: Share of the driver's largest heap from which relieve() collects garbage; seconds that lie between two calls at least.
HEAP, PAUSE = 0.5, 5.0
_due = 0.0


def collect_garbage(spark: SparkSession) -> None:
    """Each executor's JVM collects its garbage and gives what it held back to the system: one task a core, which all start at once where the cores are idle."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def relieve(spark: SparkSession) -> None:
    """The driver's JVM and the executors' give back what they have no more use for: hundreds of small plans leave garbage and freed memory, by which the driver grows
    from query to query; an executor's heap grows with what is shuffled, and stays beside the Python workers that come after. Takes some 1/20 of the time at most."""
    global _due
    if (began := time.monotonic()) < _due:
        return
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim_jvm(spark)
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        collect_garbage(spark)
    now = time.monotonic()
    _due = now + max(PAUSE, 20 * (now - began))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of saved() that nothing will read again."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._weft_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
