"""Session helpers: table access and durable (lineage-cutting) intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset and the session runs in one process (tests, local mode) a folder of our own is made; on a
    cluster a folder of the driver's machine would lose what the executors write, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="codexmill-")
    return _OWN_DIRS[app]


class Scratch:
    """Written intermediate tables of one operator run.

    ``cut`` writes a DataFrame as parquet to the shared folder and reads it back: the lineage ends there, a lost
    executor costs at most a re-read, and later stages get column pruning and real sizes. ``drop`` removes a table that
    no later plan reads; whatever is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._held: list[tuple[DataFrame, str]] = []  # the tables themselves: an id alone could be used again
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._held.append((out, path))
        return out

    def drop(self, df: DataFrame | None) -> None:
        for at, (kept, path) in enumerate(self._held):
            if kept is df:
                del self._held[at]
                self._delete(path)
                return

    def clear(self) -> None:
        self._held.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
