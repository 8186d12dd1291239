"""Update batches as a stream: each micro-batch repairs the state and writes its next version.

Toggles are not idempotent, so a version is named by its batch and the pointer
to it moves last: a batch that is replayed after a failure finds its version
and is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphprop.operators.dynamic import Graph
from graphprop.session import Params
from graphprop.sources.files import edge_lines

UPDATE_SCHEMA = "seq long, src long, dst long"


@dataclass
class StateStore:
    """Versions of (edges, state) under ``path``; features do not change.

    The last ``versions`` ones stay, at least two, for a replayed batch reads the
    one before. Those before them are deleted once a newer one is complete.
    """

    spark: SparkSession
    path: str
    features: DataFrame
    versions: int = 3

    def __post_init__(self):
        if self.versions < 2:
            raise ValueError("at least 2 versions have to stay")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The last complete version, -1 for none."""
        fs, root = self._fs("done")
        if not fs.exists(root):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(root)), default=-1)

    def save(self, version: int, edges: DataFrame, state: DataFrame) -> None:
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/{version}")
        state.write.mode("overwrite").parquet(f"{self.path}/state/{version}")
        fs, mark = self._fs(f"done/{version}")
        fs.mkdirs(mark)
        _, root = self._fs("done")
        for old in sorted(int(s.getPath().getName()) for s in fs.listStatus(root)):
            if old <= version - self.versions:
                # the mark goes last, so that what a failure leaves is deleted after the next batch
                for name in (f"edges/{old}", f"state/{old}", f"done/{old}"):
                    fs.delete(self._fs(name)[1], True)

    def load(self, version: int | None = None) -> Graph:
        v = self.version() if version is None else version
        return Graph(self.spark.read.parquet(f"{self.path}/edges/{v}"), self.features, self.spark.read.parquet(f"{self.path}/state/{v}"))


def apply_batch(store: StateStore, updates: DataFrame, batch_id: int, params: Params = Params()) -> bool:
    """Batch ``batch_id`` makes version ``batch_id + 1`` out of the one before; false if it was there already."""
    if store.version() > batch_id:
        return False
    batch = updates.select("src", "dst").persist()  # a micro-batch is read several times
    after = store.load(batch_id).update(batch, params)
    store.save(batch_id + 1, after.edges, after.state)
    batch.unpersist()
    return True


def follow(spark: SparkSession, source: str, store: StateStore, checkpoint: str, params: Params = Params(), files_per_batch: int = 1, once: bool = True, text: bool = False) -> StreamingQuery:
    """Follow a folder of Parquet update files, or with ``text`` of files of ``src dst`` lines; with ``once`` until all that is there is applied.

    A text file is taken in when it first is seen, so it has to be moved to the folder whole.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    stream = edge_lines(reader.text(source)) if text else reader.schema(UPDATE_SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, k: apply_batch(store, df, k, params) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
