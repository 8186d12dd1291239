"""Tables in the folder that the cluster shares, used to cut lineage.

A written table survives the loss of executors, which cached blocks and local
checkpoints do not.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a local session has a temporary folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="graphprop-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


#: Rows for which a task is meant where ``tasks`` names their number.
TASK_ROWS = 400_000


def tasks(df: DataFrame, task_rows: int = TASK_ROWS) -> int | None:
    """How many tasks to deal ``df`` over, so that one task's share does not grow with it; None where the session's partitions will do.

    Counting a table of files reads their footers only. Of rows that pack well
    the planner makes tasks by bytes, far too few for what a join gives of them.
    """
    rows = df.count()
    return None if rows <= task_rows else max(-(-rows // task_rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` over ``n`` tasks by its keys; as it is where ``n`` is None."""
    return df if n is None else df.repartition(n, *keys)


#: A written list of up to this many rows may go to all tasks through the driver.
LIST_ROWS = 100_000


def listed(df: DataFrame) -> DataFrame:
    """A written table for a join: above ``LIST_ROWS`` it is sorted instead of sent through the driver, however small its files are."""
    return df if df.count() <= LIST_ROWS else df.hint("merge")


class Scratch:
    """A folder of intermediate tables in the shared folder; Hadoop deletes it when the driver's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/graphprop-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """``keep``, and then delete what was kept under ``name`` before: for loops, whose plans read the last table only."""
        before = self.n
        out = self.keep(df, name)
        self.drop(name, before)
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs; it does when the driver has collected their objects."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str, last: int | None = None) -> None:
        """Delete the tables kept under ``name``, or the first ``last`` of all; only for tables that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path):
            number, _, own = status.getPath().getName().partition("-")
            if own == name and (last is None or int(number) <= last):
                fs.delete(status.getPath(), True)
