"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table and reading it back, so a lost
executor costs the tasks of one step only. The folder comes from ``spark.checkpoint.dir``; where that
is unset, one under the system's temporary folder is used, but only if the master is local: elsewhere that is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; set here only where it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return root.rstrip("/")


class Scratch:
    """Tables of one operator call; each can be dropped as soon as nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self._remove)  # results may read the tables until the session ends

    def _remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def save(self, df: DataFrame, sorted_numbers: bool = False) -> DataFrame:
        """Write ``df`` and return it as a plain scan; ``sorted_numbers`` are stored as differences."""
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").option("parquet.writer.version", "v2" if sorted_numbers else "v1").option("parquet.enable.dictionary", str(not sorted_numbers).lower()).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = self.paths.pop(id(df), None)
            if path:
                self._delete(path)
        self.sweep()

    def sweep(self) -> None:
        """Let Spark's cleaner remove what finished steps have left behind."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files go as soon as the query that wrote them has ended: nothing reads a saved table's again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
