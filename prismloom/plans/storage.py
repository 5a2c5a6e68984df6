"""Tables written between steps of iterative operators.

Lineage is cut by writing to the folder all executors share, named by
``spark.checkpoint.dir``. Only a local session without that setting (tests, notebooks) gets
a temporary folder; a cluster without it is an error. Losing an executor never loses such a table.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where a local session names none."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{_KEY} must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="prismloom-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def read_note(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file of the shared folder, None where there is none."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """Written aside and renamed, so that a reader finds the old note or the new one, whole."""
    fs, target = _at(spark, path)
    _, draft = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(note).encode()))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"could not write {path}")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over, which else stay until the driver happens to
    collect its garbage."""
    spark._jvm.System.gc()


class Workspace:
    """A private folder under the shared root for the tables of one run."""

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/prismloom/{label}-{uuid.uuid4().hex[:12]}"
        self._run = uuid.uuid4().hex[:6] if path else ""  # a folder that is opened again keeps what it holds
        self._serial = 0

    def fresh(self, name: str) -> str:
        self._serial += 1
        return f"{self.path}/{name}-{self._run}{self._serial:04d}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and read it back: the plan below it is cut here."""
        target = self.fresh(name)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, path: str | None = None) -> None:
        """Delete a table of this workspace that is not needed any more, or the whole folder."""
        path = path or self.path
        if not path.startswith(self.path):
            raise ValueError(f"{path} is not in {self.path}")
        delete(self.spark, path)
