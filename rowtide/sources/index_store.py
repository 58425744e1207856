"""The secondary index: (spec_id, partition_key, pk) to (data_file_path, pos), kept in a bucketed base and appended deltas."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions.keys import identifier_text
from rowtide.operators import lookup
from rowtide.sources.table_log import Conflict

SCHEMA = "spec_id int, partition_key string, pk string, data_file_path string, pos bigint, seq bigint"
KEYS = ("spec_id", "partition_key", "pk")
ORDER = ("seq", "data_file_path", "pos")
#: Deltas beyond which an append compacts.
DELTAS = 20


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    every: bool = False
    base: str | None = None
    deltas: list[str] = field(default_factory=list)


class Index:
    """One index; all of it is in its folder, so any session opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path)
        self._warm: tuple[int, DataFrame] | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, table_name: str, buckets: int = 1, every: bool = False) -> Index:
        """Opens the index of a table, or makes it; the name is made fit for a folder.

        With ``every`` it keeps all entries of a key, for tables in which a key may have several live rows; else the
        last one counts. That is decided when the index is made.
        """
        i = cls(spark, os.path.join(root, identifier_text(table_name)))
        os.makedirs(os.path.join(i.path, "log"), exist_ok=True)
        if not i._numbers():
            try:
                i._put(Version(1, buckets, every))
            except Conflict:
                pass
        return i

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in os.listdir(os.path.join(self.path, "log")) if n.endswith(".json"))

    def version(self) -> Version:
        with open(os.path.join(self.path, "log", f"v{self._numbers()[-1]}.json")) as f:
            return Version(**json.load(f))

    def _put(self, v: Version) -> Version:
        tmp = os.path.join(self.path, "log", f".{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(asdict(v), f)
        try:
            os.link(tmp, os.path.join(self.path, "log", f"v{v.number}.json"))
        except FileExistsError:
            raise Conflict(f"index version {v.number} exists") from None
        finally:
            os.unlink(tmp)
        return v

    def append(self, rows: DataFrame) -> Version:
        """Adds entries; the same rows twice change nothing. Returns when they are durable."""
        v = self.version()
        name = uuid.uuid4().hex
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).sortWithinPartitions("pk").write.parquet(os.path.join(self.path, name))
        v = self._put(replace(v, number=v.number + 1, deltas=[*v.deltas, name]))
        return self.compact() if len(v.deltas) > DELTAS else v

    def _base(self, v: Version) -> DataFrame:
        name = f"rowtide_index_{v.base}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (pk) SORTED BY (pk) INTO {v.buckets} BUCKETS LOCATION '{self.path}/{v.base}'")
        return self.spark.table(name)

    def entries(self) -> DataFrame:
        """All entries, older ones of a key included."""
        v = self.version()
        if self._warm is not None and self._warm[0] == v.number:
            return self._warm[1]
        return self._read(v)

    def warm(self) -> int:
        """Keeps the present version in the executors' memory (and on their disks where it is full), as a standing job does; returns its entries.

        Later versions are read from storage until warmed again.
        """
        self.cool()
        v = self.version()
        self._warm = v.number, self._read(v).persist()
        return self._warm[1].count()

    def cool(self) -> None:
        if self._warm is not None:
            self._warm[1].unpersist()
            self._warm = None

    def _read(self, v: Version) -> DataFrame:
        parts = [self._base(v)] if v.base else []
        if v.deltas:
            parts.append(self.spark.read.schema(SCHEMA).parquet(*[os.path.join(self.path, d) for d in v.deltas]))
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def rows(self) -> DataFrame:
        """The entry of each key: the last one written in walk order."""
        return lookup.latest(self.entries(), KEYS, ORDER)

    def compact(self) -> Version:
        """Base and deltas become one bucketed, sorted base: lookups by key then read only their buckets."""
        v = self.version()
        name = uuid.uuid4().hex
        rows = (self.entries().distinct() if v.every else self.rows()).repartition(v.buckets, "pk")
        rows.write.format("parquet").bucketBy(v.buckets, "pk").sortBy("pk").option("path", f"{self.path}/{name}").saveAsTable(f"rowtide_index_{name}")
        return self._put(replace(v, number=v.number + 1, base=name, deltas=[]))

    def vacuum(self) -> list[str]:
        """Removes folders that the newest version does not use; no reader may be on an older one."""
        v = self.version()
        old = [d for d in os.listdir(self.path) if d != "log" and d != v.base and d not in v.deltas]
        for d in old:
            self.spark.sql(f"DROP TABLE IF EXISTS rowtide_index_{d}")
            shutil.rmtree(os.path.join(self.path, d), ignore_errors=True)
        return old

    def find(self, probe: DataFrame, how: str | None = None) -> DataFrame:
        """KEYS, data_file_path, pos of the probe's keys (KEYS columns), misses left out.

        The last entry of a key, or all of them if the index keeps every one. Older entries are sorted out after the
        match, of matched keys only.
        """
        hits = lookup.lookup(probe, self.entries(), KEYS, "pk", how)
        out = hits.distinct() if self.version().every else lookup.latest(hits, KEYS, ORDER)
        return out.select(*KEYS, "data_file_path", "pos")
