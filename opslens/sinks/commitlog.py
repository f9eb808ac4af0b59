"""Upsert sink with a commit log, for batches and the micro-batches of a stream.

A batch writes its rows as Parquet into a folder of its own and then one manifest entry that names
the folder and the batch; the entry appears whole, by a rename. Readers take the folders that the
log names and nothing else, so a batch that stopped midway is not seen, and a batch that runs again
finds its entry and changes nothing. The newest row of a key wins: the one of the latest batch, in a
batch the one that stands last by the ``order`` columns. ``compact`` writes the rows as they
are read into one folder and logs it in place of the entries it covers; older entries and their
folders stay for readers that began before, until ``vacuum`` deletes them.

A null key is a key of its own. One writer at a time is assumed, as a stream's checkpoint has it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = "_batch"


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("_log").getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """The committed entries in order; those that a later compaction covers are left out."""
        if not self._fs.exists(self._at("_log")):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("_log")))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return []
        texts = self.spark.read.text([f"{self.path}/_log/{n}" for n in names], wholetext=True).collect()
        found = sorted((json.loads(r["value"]) for r in texts), key=lambda e: (e["batch"], e["compacted"]))
        whole = max((k for k, e in enumerate(found) if e["compacted"]), default=0)
        return found[whole:]

    def _commit(self, batch: int, folder: str, compacted: bool) -> None:
        name = f"{batch:020d}{'-compacted' if compacted else ''}.json"
        own = self._at(f"_log/.{name}.{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at("_log"))
        out = self._fs.create(own, True)
        out.write(json.dumps({"batch": batch, "folder": folder, "compacted": compacted}).encode())
        out.close()
        if not self._fs.exists(self._at(f"_log/{name}")) and not self._fs.rename(own, self._at(f"_log/{name}")):
            raise OSError(f"batch {batch} could not be committed")

    def committed(self, batch: int) -> bool:
        return self._fs.exists(self._at(f"_log/{batch:020d}.json")) or any(
            e["compacted"] and e["batch"] >= batch for e in self.entries())

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Write a batch (numbered from 0 on, ascending); False if it was there already."""
        if self.committed(batch):
            return False
        folder = f"data/batch-{batch:020d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(batch, folder, False)
        return True

    def sink(self):
        """``foreachBatch`` function of a stream."""
        return lambda rows, batch_id: self.write(rows, batch_id)

    def read(self, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame | None:
        """The newest committed row of each key; None if nothing is committed."""
        every = None
        for e in self.entries():
            own = self.spark.read.parquet(f"{self.path}/{e['folder']}").withColumn(BATCH, F.lit(e["batch"]).cast("long"))
            every = own if every is None else every.unionByName(own, allowMissingColumns=True)
        if every is None:
            return None
        newest = Window.partitionBy(*keys).orderBy(F.col(BATCH).desc(), *[F.col(c).desc() for c in order])
        return every.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn", BATCH)

    def compact(self, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        """One folder of the rows as read now, logged in place of what it was read from."""
        found = self.entries()
        if len(found) < 2:
            return
        batch = found[-1]["batch"]
        folder = f"data/compacted-{batch:020d}-{uuid.uuid4().hex[:12]}"
        self.read(keys, order).write.parquet(f"{self.path}/{folder}")
        self._commit(batch, folder, True)

    def vacuum(self) -> int:
        """Delete folders that no entry in force names (also of batches that stopped midway); their count.
        Not while a batch is being written."""
        if not self._fs.exists(self._at("data")):
            return 0
        kept = {e["folder"] for e in self.entries()}
        gone = [f.getPath() for f in self._fs.listStatus(self._at("data")) if f"data/{f.getPath().getName()}" not in kept]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
