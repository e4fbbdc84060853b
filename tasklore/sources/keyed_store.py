"""Tables that grow by batches: each batch adds a folder of changes, some batches later all are merged into a new base.

A manifest names the base and the changes that are in force. It is written after the rows, under the next number, so a reader sees
a whole state, a failed write is never named, and a batch that is delivered again changes nothing. Compaction writes the
merged table, names it in a new manifest, and deletes what no manifest in force names, so the number of files has a bound that does
not depend on the number of batches. One query writes a store at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFESTS = 2  # manifests in force: the newest, and the one a reader may have opened before


class Folder:
    """The few file operations a store needs, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file that appears whole; an error if it is there."""
        draft = self._at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            raise FileExistsError(f"{self.path}/{name} was written by another query")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    base: str | None = None
    upto: int = -1  # the last batch inside the base
    changes: dict[str, str] = field(default_factory=dict)  # batch: folder

    def holds(self, batch: int) -> bool:
        return batch <= self.upto or str(batch) in self.changes

    def folders(self) -> set[str]:
        return {*self.changes.values(), *([self.base] if self.base else [])}


class KeyedStore:
    """One row a key. ``merge`` says how values of one key become one: an aggregate per column; without it the newest batch wins.

    ``keep`` says which rows a compaction takes over; others are forgotten. ``apply`` may be called for every micro-batch of a stream, with the number of the batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str],
                 merge: dict[str, Callable[[str], Column]] | None = None, compact_every: int = 16, keep: Column | None = None):
        self._spark, self._schema, self._keys, self._merge, self._every, self._keep = spark, schema, keys, merge, compact_every, keep
        self._values = [name for name in schema.names if name not in keys]
        self._folder = Folder(spark, path)

    def manifest(self) -> Manifest:
        names = [name for name in self._folder.names("manifest") if name.endswith(".json")]
        return Manifest(**json.loads(self._folder.read(f"manifest/{names[-1]}"))) if names else Manifest()

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Add the rows of a batch; False if it was added before."""
        now = self.manifest()
        if now.holds(batch):
            return False
        name = self._write(rows.select(*self._schema.names), "changes")
        self._commit(Manifest(now.number + 1, now.base, now.upto, {**now.changes, str(batch): name}))
        if len(now.changes) + 1 >= self._every:
            self.compact()
        return True

    def read(self) -> DataFrame:
        """The whole table, or no rows before the first batch."""
        return self._merged(self.manifest())

    def next_batch(self) -> int:
        """A number after all batches so far, for writers that are no streams."""
        now = self.manifest()
        return max([now.upto, *map(int, now.changes)]) + 1

    def compact(self) -> None:
        """Merge everything into a new base and delete what is out of force."""
        now = self.manifest()
        if now.changes:
            merged = self._merged(now)
            name = self._write(merged if self._keep is None else merged.filter(self._keep), "base")
            self._commit(Manifest(now.number + 1, name, max(map(int, now.changes)), {}))
        numbers = [name for name in self._folder.names("manifest") if name.endswith(".json")]
        kept = [Manifest(**json.loads(self._folder.read(f"manifest/{name}"))) for name in numbers[-MANIFESTS:]]
        named = {folder for manifest in kept for folder in manifest.folders()}
        for part in ("base", "changes"):
            for name in self._folder.names(part):
                if f"{part}/{name}" not in named:
                    self._folder.delete(f"{part}/{name}")
        for name in numbers[:-MANIFESTS]:
            self._folder.delete(f"manifest/{name}")

    def _write(self, rows: DataFrame, part: str) -> str:
        name = f"{part}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._folder.path}/{name}")
        return name

    def _commit(self, manifest: Manifest) -> None:
        self._folder.create(f"manifest/{manifest.number:010d}.json", json.dumps(vars(manifest)))

    def _merged(self, now: Manifest) -> DataFrame:
        rows = None
        for batch, name in [(now.upto, now.base), *((int(key), value) for key, value in now.changes.items())]:
            if name:
                part = self._spark.read.schema(self._schema).parquet(f"{self._folder.path}/{name}").withColumn("applied_batch", F.lit(batch))
                rows = part if rows is None else rows.unionAll(part)
        if rows is None:
            return self._spark.createDataFrame([], self._schema)
        if not self._values:
            return rows.select(*self._keys).distinct()
        if self._merge is None:
            newest = rows.groupBy(*self._keys).agg(F.max_by(F.struct(*self._values), "applied_batch").alias("newest"))
            merged = newest.select(*self._keys, "newest.*")
        else:
            merged = rows.groupBy(*self._keys).agg(*[self._merge[name](name).alias(name) for name in self._values])
        return merged.select(*[F.col(one.name).cast(one.dataType).alias(one.name) for one in self._schema.fields])
