"""Merge-on-read tables: immutable versions in a log, each put in place atomically.

A table is a folder. ``metadata/vN.json`` is version N: properties, snapshot, and the
folders of manifest rows that are valid for it. Manifests are Parquet, written by
executors; a version only points at them. A version is created by linking a finished file to its name,
which fails if another writer was first. Output, watermark and processed version are one commit.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.keys import key_hex
from rowtide.operators import lookup, manifest_diff
from rowtide.plans import config
from rowtide.plans.config import TableConfig
from rowtide.session import cut
from rowtide.sources import scans

#: One row of a manifest: a file that a version adds or removes.
ENTRY = "action string, content string, path string, format string, spec_id int, partition_key string, field_ids array<int>, referenced string, offset bigint, size bigint, records bigint, bytes bigint, seq bigint"
#: Manifest folders of a version beyond which a commit rewrites them into one.
FOLDERS = 50


class Conflict(RuntimeError):
    """Another writer got in between; plan again from the new head."""


@dataclass(frozen=True)
class Meta:
    version: int
    format_version: int
    schema: dict
    specs: list[list[str]]
    spec_id: int
    properties: dict[str, str]
    seq: int = 0
    snapshot_id: int | None = None
    parent_id: int | None = None
    summary: dict[str, str] = field(default_factory=dict)
    manifests: list[str] = field(default_factory=list)
    written_ms: int = 0

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def key_struct(self) -> T.StructType:
        s = self.struct
        return T.StructType([s[c] for c in TableConfig.of(self.properties).primary_keys])

    def field_ids(self, names: Sequence[str]) -> list[int]:
        order = self.struct.names
        return sorted(order.index(n) + 1 for n in names)

    def partition_struct(self, spec_id: int | None = None) -> T.StructType:
        s = self.struct
        # partition values are optional whatever the column is
        return T.StructType([T.StructField(c, s[c].dataType, True) for c in self.specs[self.spec_id if spec_id is None else spec_id]])


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path)
        self._listing: tuple[tuple[str, ...], DataFrame] | None = None

    # -- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str] = (), properties: Mapping[str, str] | None = None, format_version: int = 3) -> Table:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        t = cls(spark, path)
        for d in ("metadata", "manifests", "data", "deletes"):
            os.makedirs(os.path.join(path, d), exist_ok=True)
        t._put(Meta(1, format_version, schema.jsonValue(), [list(partition_by)], 0, dict(properties or {})))
        return t

    def _file(self, version: int) -> str:
        return os.path.join(self.path, "metadata", f"v{version}.json")

    def _put(self, meta: Meta) -> Meta:
        meta = replace(meta, written_ms=int(time.time() * 1000))
        tmp = os.path.join(self.path, "metadata", f".{uuid.uuid4().hex}.tmp")
        with open(tmp, "w") as f:
            json.dump(asdict(meta), f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, self._file(meta.version))
        except FileExistsError:
            raise Conflict(f"version {meta.version} of {self.path} exists") from None
        finally:
            os.unlink(tmp)
        return meta

    def versions(self) -> list[int]:
        names = os.listdir(os.path.join(self.path, "metadata"))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def meta(self, version: int | None = None) -> Meta:
        with open(self._file(version or self.versions()[-1])) as f:
            return Meta(**json.load(f))

    def snapshots(self) -> list[Meta]:
        """One version for each snapshot, oldest first: versions that only set properties repeat a snapshot."""
        out: dict[int | None, Meta] = {}
        for v in self.versions():
            m = self.meta(v)
            if m.snapshot_id is not None:
                out.setdefault(m.snapshot_id, m)
        return list(out.values())

    def close(self) -> None:
        """Gives up the cached listing; the table can still be used."""
        if self._listing is not None:
            self._listing[1].unpersist()
            self._listing = None

    # -- files

    def files(self, meta: Meta | None = None, content: str | Sequence[str] | None = None) -> DataFrame:
        """The live files of a version: of the entries of one file (path, referenced) the last, if it adds.

        Manifests never change, so the listing of the version used last stays cached.
        """
        meta = meta or self.meta()
        if not meta.manifests:
            return self.spark.createDataFrame([], ENTRY + ", version bigint").drop("action")
        key = tuple(meta.manifests)
        if self._listing is None or self._listing[0] != key:
            self.close()
            df = self.spark.read.schema(ENTRY + ", version bigint").parquet(*[os.path.join(self.path, "manifests", m) for m in key])
            w = Window.partitionBy("path", "referenced").orderBy(F.col("version").desc(), F.col("action"))
            live = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and action = 'add'").drop("_rn", "action")
            self._listing = key, live.persist()
        df = self._listing[1]
        return df if content is None else df.where(F.col("content").isin(*([content] if isinstance(content, str) else content)))

    def commit(self, base: Meta, adds: DataFrame | None = None, removes: DataFrame | None = None, properties: Mapping[str, str] | None = None, summary: Mapping[str, str] | None = None, new_seq: bool = True, must_keep: bool = True, expect: int | None = None, **changes) -> Meta:
        """The next version after the head: ``adds`` and ``removes`` are ENTRY rows without action (adds without seq get the new one).

        If the head is not ``base`` any more, the commit goes on top of it only if every removed file is
        still live and no new vector or file-scoped delete names a file that ``adds`` brings one for; else Conflict. Data files that
        vanished meanwhile are no conflict. Without adds, removes, properties or changes nothing is written. With ``expect`` the new version
        follows that version and no other: the link fails if anybody committed since.
        """
        if adds is None and removes is None and not properties and not changes:
            return base
        head = self.meta()
        if expect is not None and head.version != expect:
            raise Conflict(f"{self.path} is at version {head.version}, not {expect}")
        seq = head.seq + 1 if new_seq and (adds is not None or removes is not None) else head.seq
        version = head.version + 1
        manifests = list(head.manifests)
        if adds is not None or removes is not None:
            rows = None
            for df, action in ((adds, "add"), (removes, "remove")):
                if df is None:
                    continue
                have = {**{c: F.lit(None) for c in T.StructType.fromDDL(ENTRY).names}, **{c: F.col(c) for c in df.columns}, "action": F.lit(action)}
                types = {f.name: f.dataType for f in T.StructType.fromDDL(ENTRY).fields}
                part = df.select(*[have[c].cast(types[c]).alias(c) for c in types]).withColumn("seq", F.coalesce("seq", F.lit(seq)).cast("bigint")).withColumn("version", F.lit(version).cast("bigint"))
                rows = part if rows is None else rows.unionByName(part)
            name = f"{version:08d}-{uuid.uuid4().hex}"
            rows.write.parquet(os.path.join(self.path, "manifests", name))
            written = self.spark.read.schema(ENTRY + ", version bigint").parquet(os.path.join(self.path, "manifests", name))
            if must_keep or head.version != base.version:
                self._check(base, head, written)
            manifests.append(name)
            if len(manifests) > FOLDERS:
                manifests = [self._fold(replace(head, manifests=manifests), version)]
        meta = replace(
            head, version=version, seq=seq, manifests=manifests, properties={**head.properties, **(properties or {})},
            **({"snapshot_id": uuid.uuid4().int >> 65, "parent_id": head.snapshot_id, "summary": dict(summary or {})} if adds is not None or removes is not None else {}), **changes,
        )
        return self._put(meta)

    def _fold(self, meta: Meta, version: int) -> str:
        """All live files in one manifest folder; removed ones are forgotten."""
        name = f"{version:08d}-{uuid.uuid4().hex}-all"
        self.files(meta).withColumn("action", F.lit("add")).write.parquet(os.path.join(self.path, "manifests", name))
        return name

    def _check(self, base: Meta, head: Meta, written: DataFrame) -> None:
        live = self.files(head).select("path", "referenced", "content", "version")
        same = [F.col("a.path") == F.col("b.path"), F.col("a.referenced").eqNullSafe(F.col("b.referenced"))]
        gone = written.where("action = 'remove'").alias("a").join(live.alias("b"), same, "left_anti")
        if gone.limit(1).count():
            raise Conflict("a file to be removed is gone")
        if head.version != base.version:
            new = live.where(F.col("content").isin("dv", "pos") & (F.col("version") > base.version) & F.col("referenced").isNotNull())
            if written.where("action = 'add' and referenced is not null").join(new, "referenced", "left_semi").limit(1).count():
                raise Conflict("a data file got other deletes meanwhile")

    # -- writing rows

    def _write_files(self, df: DataFrame, folder: str, columns: Sequence[str], meta: Meta, fmt: str = "parquet") -> DataFrame:
        """Files of ``df`` by partition, none across two; returns ENTRY rows without content. Empty input gives none."""
        spec = meta.specs[meta.spec_id]
        name = uuid.uuid4().hex
        out = os.path.join(self.path, folder, name)
        copies = {f"_p_{i}": F.col(c) for i, c in enumerate(spec)}
        w = df.select(*columns, *[c.alias(n) for n, c in copies.items()])
        writer = (w.repartition(*copies.keys()) if copies else w).write.format(fmt)
        (writer.partitionBy(*copies) if copies else writer).save(out)
        key = key_hex(meta.partition_struct())
        if next(Path(out).rglob(f"*.{fmt}"), None) is None:
            return self.spark.createDataFrame([], ENTRY).drop("action", "content", "seq")
        # the folder is new, so all of it is read; a file holds one partition, so any of its rows tells it
        want = T.StructType([meta.struct[c] for c in columns])
        df = self.spark.read.schema(want).format(fmt).option("recursiveFileLookup", "true").load(out)
        df = df.select(scans.scanned_path().alias("path"), F.col("_metadata.file_size").alias("bytes"), *[F.col(c) for c in spec])
        g = df.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.max("bytes").alias("bytes"), *[F.first(c).alias(c) for c in spec])
        return g.select("path", F.lit(fmt).alias("format"), F.lit(meta.spec_id).alias("spec_id"), key.alias("partition_key"), "records", "bytes")

    def append(self, df: DataFrame, properties: Mapping[str, str] | None = None, **how) -> Meta:
        return self.write(df, None, properties=properties, **how)

    def write(self, df: DataFrame | None = None, delete_keys: DataFrame | None = None, delete_columns: Sequence[str] | None = None, properties: Mapping[str, str] | None = None, fmt: str = "parquet", positions: DataFrame | None = None) -> Meta:
        """One commit of new rows, equality deletes and position deletes.

        ``delete_keys`` has the columns of the deletes (the primary key unless ``delete_columns`` says
        otherwise) and those of the partition spec; it deletes equal rows of earlier commits. ``positions`` has
        data_file_path and pos of rows that are there; a file's earlier position deletes are merged with them.
        """
        meta = self.meta()
        adds, removes = [], None
        if df is not None:
            adds.append(self._write_files(df, "data", meta.struct.names, meta, fmt).withColumn("content", F.lit("data")))
        if delete_keys is not None:
            names = list(delete_columns or TableConfig.of(meta.properties).primary_keys)
            columns = names + [c for c in meta.specs[meta.spec_id] if c not in names]
            ids = F.array(*[F.lit(i) for i in meta.field_ids(names)])
            adds.append(self._write_files(delete_keys.distinct(), "deletes", columns, meta).withColumn("content", F.lit("eq")).withColumn("field_ids", ids))
        if positions is not None:
            from rowtide.sources import delete_writers

            merged, removes = delete_writers.merged(self, meta, self.files(meta), positions)
            adds.append(merged)
        rows = None
        for a in adds:
            rows = a if rows is None else rows.unionByName(a, allowMissingColumns=True)
        return self.commit(meta, rows, removes, properties, must_keep=removes is not None)

    def upsert(self, df: DataFrame, order: Sequence[str] = (), properties: Mapping[str, str] | None = None) -> Meta:
        """New versions of rows: the last of each key by ``order``, and equality deletes of the keys, in one commit."""
        keys = list(TableConfig.of(self.meta().properties).primary_keys)
        by = list(dict.fromkeys([*keys, *self.meta().specs[self.meta().spec_id]]))
        w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order] or [F.lit(1)])
        last = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        return self.write(last, last.select(*by), properties=properties)

    def set_properties(self, properties: Mapping[str, str]) -> Meta:
        return self.commit(self.meta(), properties=properties)

    def evolve_partitioning(self, partition_by: Sequence[str]) -> Meta:
        m = self.meta()
        return self.commit(m, specs=[*m.specs, list(partition_by)], spec_id=len(m.specs))

    # -- reading rows

    def scan(self, files: DataFrame, meta: Meta, columns: Sequence[str] | None = None) -> DataFrame:
        return scans.rows(self.spark, files, meta.struct, columns)

    def visible(self, meta: Meta | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows a reader sees: data less positions, vectors and equality deletes of later commits."""
        meta = meta or self.meta()
        columns = list(columns or meta.struct.names)
        return self.live(self.files(meta), meta, columns).select(*columns)

    def live(self, every: DataFrame, meta: Meta, columns: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """data_file_path, pos, ``carry`` columns of the listing and ``columns`` of the rows of the data files in ``every`` that no delete in ``every`` hits.

        Position deletes and vectors are tested in the task that scans the file (see ``scans.rows``), so they cost no shuffle of rows. Equality deletes
        are joined on their key, the last delete of each; they are broadcast while their measured size allows.
        """
        from rowtide.sources import delete_writers

        columns = list(columns or meta.struct.names)
        eq = every.where("content = 'eq'")
        kinds = every.select("content", "field_ids", F.col("referenced").isNull().alias("loose")).distinct().collect()
        sets = sorted({tuple(r.field_ids) for r in kinds if r.content == "eq"})
        names = meta.struct.names
        need = list(dict.fromkeys([*columns, *[names[i - 1] for s in sets for i in s]]))
        data, dead = every.where("content = 'data'"), every.where("content in ('pos', 'dv')")
        named = dead.where("referenced is not null").select("content", "path", "referenced", "offset", "size")
        if any(r.content == "pos" and r.loose for r in kinds):
            named = named.unionByName(delete_writers.as_vectors(self, meta, data, dead.where("referenced is null")))
        elif not any(r.content in ("pos", "dv") for r in kinds):
            named = None
        own = [c for c in ("spec_id", "partition_key", "seq") if sets and c not in carry]
        # the listing's columns under names that no table column has
        place = [*carry, *own]
        listed = data.select("path", "format", *[F.col(c).alias(f"_f_{c}") for c in place])
        r = scans.rows(self.spark, listed, meta.struct, need, [f"_f_{c}" for c in place], named)
        for ids in sets:
            key = T.StructType([meta.struct[names[i - 1]] for i in ids])
            keys = scans.equality_deletes(self.spark, eq.where(F.col("field_ids") == F.array(*[F.lit(i) for i in ids])), key)
            last = keys.groupBy(F.col("spec_id").alias("_spec"), F.col("partition_key").alias("_part"), F.struct(*key.names).alias("_k")).agg(F.max("seq").alias("_dead"))
            # any later delete is one later than the last, so one row a key decides
            same = (F.col("_f_spec_id") == F.col("_spec")) & (F.col("_f_partition_key") == F.col("_part")) & (F.struct(*key.names) == F.col("_k"))
            r = r.join(lookup.broadcast_if_small(last), same, "left").where("_dead is null or _dead <= _f_seq").drop("_dead", "_k", "_spec", "_part")
        return r.select("data_file_path", "pos", *[F.col(f"_f_{c}").alias(c) for c in carry], *columns)


def _touched(spark: SparkSession, was: DataFrame, now: DataFrame) -> DataFrame:
    """path of every data file whose live rows may differ between two listings.

    Files added, removed or with another number of deleted positions are the diff of the manifests; besides, files that a
    delete in one listing only may hit: the files it names, of an equality delete the older files of its partition.
    """
    data = lambda m: m.where("content = 'data'").select(F.lit(0).alias("table_id"), F.col("path").alias("file_id"), F.col("records").alias("record_count"))
    gone = lambda m: m.where("content <> 'data' and referenced is not null").groupBy("referenced").agg(F.sum("records").alias("deleted")).select(F.lit(0).alias("table_id"), F.col("referenced").alias("file_id"), "deleted")
    changed = manifest_diff.diff(data(was), data(now), gone(was), gone(now)).select(F.col("file_id").alias("path"))
    deletes = lambda m: m.where("content <> 'data'").select("content", "path", "format", "referenced", "offset", "size", "spec_id", "partition_key", "seq")
    moved = deletes(now).exceptAll(deletes(was)).unionByName(deletes(was).exceptAll(deletes(now)))
    named = moved.where("referenced is not null").select(F.col("referenced").alias("path"))
    loose = scans.position_deletes(spark, moved.where("content = 'pos' and referenced is null")).select(F.col("data_file_path").alias("path"))
    last = moved.where("content = 'eq'").groupBy("spec_id", "partition_key").agg(F.max("seq").alias("_last"))
    hit = now.where("content = 'data'").join(last, ["spec_id", "partition_key"]).where("seq < _last").select("path")
    return changed.unionByName(named).unionByName(loose).unionByName(hit).distinct()


def process_new(spark: SparkSession, source: Table, sink: Table, transform, name: str = "source") -> Meta | None:
    """One incremental step: carries what changed in ``source`` since the version the sink has processed into the sink.

    The live rows of the files that differ between both versions are compared by file and position. Rows that came are
    transformed and added. Rows that went, with their file or by a vector, position or equality delete, are transformed and
    retracted: as many equal rows of the sink as went get position deletes (rows the sink no longer holds are
    passed over). So after each step the sink holds ``transform`` of the rows visible in the source, if ``transform``
    treats each row by itself and alike at every step. New equality deletes cost a scan of the older files of their partitions,
    retractions one of the sink. Files removed from the source must still be readable.

    The processed version is a property of the sink, saved in the commit of the output: a step that fails leaves both as
    they were, a repeated one finds nothing to do. Returns None if nothing is new. A concurrent step loses with Conflict.
    """
    from rowtide.sources import delete_writers

    prop = f"rowtide.processed.{name}"
    base, head = sink.meta(), source.meta()
    done = int(base.properties.get(prop, 0))
    if head.version == done:
        return None
    processed = source.meta(done) if done else head
    # the table keeps one listing in memory: the older one is written down
    was = cut(source.files(processed)) if done else None
    now = source.files(head)
    was = now.limit(0) if was is None else was
    touched = cut(_touched(spark, was, now).select(F.col("path").alias("_p")))

    def rows(every: DataFrame, meta: Meta) -> DataFrame:
        # equality deletes and those that name no file may hit any
        of = F.when(F.col("content") == "data", F.col("path")).otherwise(F.col("referenced"))
        own = every.withColumn("_p", of).join(touched, "_p", "left_semi").drop("_p")
        return source.live(own.unionByName(every.where("content <> 'data' and referenced is null")), meta)

    place = ["data_file_path", "pos"]
    before, after = rows(was, processed), rows(now, head)
    came = after.join(before.select(*place), place, "left_anti").drop(*place)
    went = cut(before.join(after.select(*place), place, "left_anti").drop(*place)) if done else None
    adds = sink._write_files(transform(came), "data", base.struct.names, base).withColumn("content", F.lit("data"))
    removes = None
    if went is not None and went.limit(1).count():
        merged, removes = delete_writers.merged(sink, base, sink.files(base), cut(_equal_rows(sink, base, transform(went))))
        adds = adds.unionByName(merged, allowMissingColumns=True)
    return sink.commit(base, adds, removes, {prop: str(head.version)}, {"processed": f"{name}:{head.version}"}, expect=base.version)


def _equal_rows(table: Table, meta: Meta, rows: DataFrame) -> DataFrame:
    """data_file_path, pos of visible rows of ``table`` that equal ``rows``, nulls too, each as often as it is in ``rows``."""
    s = meta.struct
    counted = rows.select(*[F.col(c).cast(s[c].dataType).alias(c) for c in s.names]).groupBy(*s.names).agg(F.count(F.lit(1)).alias("_n"))
    held, counted = table.live(table.files(meta), meta).alias("a"), counted.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in s.names]
    w = Window.partitionBy(*s.names).orderBy("data_file_path", "pos")
    return held.join(counted, same).select("a.*", "b._n").withColumn("_rn", F.row_number().over(w)).where("_rn <= _n").select("data_file_path", "pos")


def tables(spark: SparkSession, root: str, log=print) -> list[Table]:
    """Tables under ``root``, at any depth, that opt in by their primary keys; unreadable ones are reported and passed over."""
    out = []
    for d, folders, _ in os.walk(root):
        if "metadata" not in folders:
            continue
        folders.clear()
        try:
            t = Table(spark, d)
            if config.PRIMARY_KEYS in t.meta().properties:
                out.append(t)
        except Exception as e:  # noqa: BLE001
            log(f"{d}: {e}")
    return sorted(out, key=lambda t: t.path)
