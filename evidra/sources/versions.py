"""A versioned table of keyed rows: batches are written aside, and one small manifest after the other says which count.

    <path>/batches/<batch>-<random>/   rows of one batch, never changed once written
    <path>/manifests/000000000007      version 7: the batches in order, each with its folder, rows and checksum

A manifest is created only if its number is free, so of two writers one wins and the other reads the new version and tries
the next number. Whatever a killed writer leaves behind is in no manifest and therefore not in the table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import named

ORDER = "_batch_order"


@dataclass(frozen=True)
class Batch:
    """The names it stands for (several once compacted), folder, rows, and the sum of the rows' hashes as text."""

    names: tuple[str, ...]
    folder: str
    rows: int
    checksum: str


class VersionedTable:
    """Rows keyed by one column; of a key that several batches hold, the latest batch's row is the table's.

    ``partition`` names a column by whose values the folders of a batch are split, so that a reader of one company reads
    its files alone.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", partition: str | None = None) -> None:
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition
        self._jvm = spark._jvm
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}" if rest else self.path)

    def versions(self) -> list[int]:
        place = self._path("manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []
        return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))

    def batches(self, version: int | None = None) -> list[Batch]:
        """The batches of a version in order; of the latest unless told. none if nothing was ever published."""
        known = self.versions()
        if not known:
            return []
        place = self._path(f"manifests/{known[-1] if version is None else version:012d}")
        reader = self._jvm.java.util.Scanner(self._files.open(place), "UTF-8").useDelimiter("\\A")
        try:
            return [Batch(tuple(b["names"]), b["folder"], b["rows"], b["checksum"]) for b in json.loads(reader.next())]
        finally:
            reader.close()

    def _publish(self, batches: Iterable[Batch], version: int) -> bool:
        """Writes the manifest under a name of its own and gives it its number only if that is free."""
        whole = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._files.create(whole, False)
        out.write(bytearray(json.dumps([asdict(b) for b in batches]).encode()))
        out.close()
        target = self._path(f"manifests/{version:012d}")
        done = not self._files.exists(target) and self._files.rename(whole, target)
        if not done:
            self._files.delete(whole, False)
        return bool(done)

    def _change(self, change: Callable[[list[Batch]], list[Batch] | None]) -> None:
        """Publishes what change makes of the latest batches (None: nothing to do), anew when another writer was first."""
        while True:
            known = self.versions()
            following = change(self.batches(known[-1]) if known else [])
            if following is None or self._publish(following, (known[-1] if known else 0) + 1):
                return

    def measure(self, rows: DataFrame) -> tuple[int, str]:
        """Number of rows and the sum of their hashes, whatever their order."""
        columns = sorted(c for c in rows.columns if c != ORDER)
        n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*[named(c) for c in columns]))).cast("decimal(38,0)"))).first()
        return n, str(total or 0)

    def _write(self, rows: DataFrame, name: str) -> Batch:
        folder = f"batches/{re.sub(r'[^0-9A-Za-z_-]+', '_', name)}-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/{folder}")
        return Batch((name,), folder, *self.measure(self._rows(folder)))

    def _rows(self, folder: str) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/{folder}")
        return read.parquet(f"{self.path}/{folder}")

    def commit(self, rows: DataFrame, name: str, expected: int | None = None) -> Batch:
        """Adds the rows as the batch of that name, once: a name that the table has is left as it is, so a rerun adds nothing.

        Of rows that repeat a key the largest by the other columns counts; null keys are refused. With ``expected`` the
        number of different keys must be that, or nothing is published.
        """
        for b in self.batches():
            if name in b.names:
                return b
        rest = [c for c in rows.columns if c != self.key]
        checked = rows.withColumn(self.key, F.when(named(self.key).isNull(), F.raise_error(F.lit("a row has no key"))).otherwise(named(self.key)))
        once = checked.groupBy(named(self.key)).agg(F.max(F.struct(*[named(c) for c in rest])).alias("_row")).select(named(self.key), *[named(c, "_row").alias(c) for c in rest])
        made = self._write(once, name)
        if expected is not None and made.rows != expected:
            raise ValueError(f"batch {name} holds {made.rows} keys, {expected} are expected")
        self._change(lambda known: None if any(name in b.names for b in known) else [*known, made])
        return next(b for b in self.batches() if name in b.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: one for each key, from the latest batch that has it."""
        batches = self.batches(version)
        if not batches:
            raise ValueError(f"{self.path} has no version")
        if len(batches) == 1:
            return self._rows(batches[0].folder)
        parts = [self._rows(b.folder).withColumn(ORDER, F.lit(k)) for k, b in enumerate(batches)]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rest = [c for c in every.columns if c not in (self.key, ORDER)]
        last = every.groupBy(named(self.key)).agg(F.max_by(F.struct(*[named(c) for c in rest]), ORDER).alias("_row"))
        return last.select(named(self.key), *[named(c, "_row").alias(c) for c in rest])

    def verify(self) -> list[str]:
        """Folders of batches whose files no longer hold what was published."""
        return [b.folder for b in self.batches() if self.measure(self._rows(b.folder)) != (b.rows, b.checksum)]

    def compact(self) -> None:
        """Makes one batch of those there are; batches that others add meanwhile stay behind it. Old names stay known."""
        old = self.batches()
        if len(old) < 2:
            return
        made = self._write(self.read(self.versions()[-1]), "compacted")

        def swapped(known: list[Batch]) -> list[Batch] | None:
            if known[: len(old)] != old:  # someone else compacted these
                return None
            names = tuple(n for b in old for n in b.names)
            return [Batch(names, made.folder, made.rows, made.checksum), *known[len(old) :]]

        self._change(swapped)

    def rebuild(self, shards: dict[str, Callable[[], DataFrame]], expected: int | None = None) -> DataFrame:
        """Commits every shard that the table lacks, in order of their names, and returns the table.

        A run that was killed goes on behind the last shard that was published. With ``expected`` the table must hold so
        many keys in the end.
        """
        for name in sorted(shards):
            if all(name not in b.names for b in self.batches()):
                self.commit(shards[name](), name)
        table = self.read()
        if expected is not None and (found := table.count()) != expected:
            raise ValueError(f"the table holds {found} keys, {expected} are expected")
        return table

    def sweep(self, keep: int = 1) -> list[str]:
        """Deletes folders and manifests that none of the last ``keep`` versions needs; to be run when nobody writes."""
        known = self.versions()
        live = {b.folder for v in known[-keep:] for b in self.batches(v)}
        place = self._path("batches")
        gone = [f"batches/{s.getPath().getName()}" for s in self._files.listStatus(place)] if self._files.exists(place) else []
        gone = [f for f in gone if f not in live] + [f"manifests/{v:012d}" for v in known[:-keep]]
        for f in gone:
            self._files.delete(self._path(f), True)
        return gone
