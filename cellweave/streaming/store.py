"""A keyed store that batches are put into once: a stream's replayed or reordered batches change nothing.

A batch is written as a table of its own, its latest row of each key, and then named in a new manifest. Manifests are
numbered and made by a rename, so a switch is atomic. A number that is taken is not taken again: of two writers the later
one tries again on what it then finds. On file systems whose rename replaces files (a local one), two that rename in the
same instant are not told apart; there, one writer at a time is meant. Readers see the tables of one manifest. Which row of a key is the latest
follows from the rows' own order, so batches may come in any order. Now and then the tables are put together to one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Manifest:
    """What a store holds: its tables, and which batches of each source are in them, as inclusive ranges."""

    number: int = 0
    tables: list[str] = field(default_factory=list)
    applied: dict[str, list[list[int]]] = field(default_factory=dict)
    schema: str | None = None

    def has(self, source: str, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.applied.get(source, []))

    def ranges_with(self, source: str, batch: int) -> dict[str, list[list[int]]]:
        out: list[list[int]] = []
        for a, b in sorted([*self.applied.get(source, []), [batch, batch]]):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return self.applied | {source: out}


class Store:
    """``path``: a folder of any file system that Spark reads. ``order``: columns whose largest values make a row the latest
    of its key; rows that agree in all of them are told apart by their other values, so the outcome is always the same."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], compact_after: int = 8):
        self.spark, self.path, self.key, self.order, self.compact_after = spark, path.rstrip("/"), key, order, compact_after
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._place(f"{self.path}/manifests"))

    def manifest(self) -> Manifest:
        """The one with the largest number."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._place(f"{self.path}/manifests"))]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return Manifest()
        stream = self._files.open(self._place(f"{self.path}/manifests/{max(numbers)}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _switch(self, made: Manifest) -> bool:
        """Whether the manifest took effect: not if its number is taken."""
        held, final = self._place(f"{self.path}/manifests/.{uuid4().hex}"), self._place(f"{self.path}/manifests/{made.number}")
        stream = self._files.create(held)
        stream.write(bytearray(json.dumps(asdict(made)).encode()))
        stream.close()
        if not self._files.exists(final) and self._files.rename(held, final):
            return True
        self._files.delete(held, False)
        return False

    def latest(self, rows: DataFrame) -> DataFrame:
        """The latest row of each key."""
        rest = sorted(c for c in rows.columns if c not in self.key and c not in self.order)
        row = F.struct(*[F.col(c) for c in rows.columns])
        return rows.groupBy(*self.key).agg(F.max_by(row, F.struct(*self.order, *rest)).alias("_r")).select("_r.*").select(*rows.columns)

    def put(self, rows: DataFrame, batch: int, source: str = "batches") -> bool:
        """Put a batch in, unless it is there already. Its columns may be fewer or more than the store's."""
        if self.manifest().has(source, batch):
            return False
        table = f"{self.path}/tables/{uuid4().hex}"
        self.latest(rows).write.parquet(table)
        while True:
            now = self.manifest()
            if now.has(source, batch):
                return False  # another writer was first
            if self._switch(Manifest(now.number + 1, [*now.tables, table], now.ranges_with(source, batch))):
                break
        if len(now.tables) + 1 >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> bool:
        """Put all tables together to one; not if a batch came meanwhile. Readers of older manifests keep their tables."""
        now = self.manifest()
        table = f"{self.path}/tables/{uuid4().hex}"
        self.read(now).write.parquet(table)
        return self._switch(Manifest(now.number + 1, [table], now.applied))

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The latest rows of the store; nothing if no batch is in it."""
        tables = (manifest or self.manifest()).tables
        made = None
        for t in tables:
            one = self.spark.read.parquet(t)
            made = one if made is None else made.unionByName(one, allowMissingColumns=True)
        return made if made is None or len(tables) == 1 else self.latest(made)

    def follow(self, stream: DataFrame, checkpoint: str, source: str = "stream"):
        """Put a stream's batches in; a restart replays the last one, which changes nothing."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.put(rows, batch, source)).option("checkpointLocation", checkpoint).start()
