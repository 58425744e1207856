"""The conversion loop: one run after another, each ending in one commit."""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, fields
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions.keys import identifier_text, key_hex, setting_name
from rowtide.plans import config, planner, runs
from rowtide.plans.config import TableConfig
from rowtide.session import cut
from rowtide.sources import delete_writers, scans
from rowtide.sources.index_store import Index
from rowtide.sources.table_log import Conflict, Meta, Table, tables


class Metrics:
    """Override what is wanted; by default nothing is recorded."""

    def run_done(self, table: str, run: runs.Run, seconds: float) -> None: ...

    def run_failed(self, table: str, error: Exception) -> None: ...

    def idle(self, table: str) -> None: ...


class KeyIndex(Protocol):
    """What the loop needs of an index; ``sources.index_store.Index`` is one, any other may take its place."""

    def append(self, rows: DataFrame) -> object:
        """Makes entries (spec_id, partition_key, pk, data_file_path, pos, seq) durable; repeating it changes nothing."""

    def find(self, probe: DataFrame, how: str | None = None) -> DataFrame:
        """spec_id, partition_key, pk, data_file_path, pos of the keys of ``probe``."""


def index_rows(table: Table, meta: Meta, run: runs.Run) -> DataFrame:
    """Index entries of a DATA run's files: their rows, less positions deleted up to the end of the run."""
    deletes = table.files(meta).where("content in ('pos', 'dv')")
    dead = planner.run_deletes(run.files.withColumn("max_seq", F.lit(run.max_seq)), deletes)
    every = run.files.select("content", "path", "format", "referenced", "offset", "size", "field_ids", "spec_id", "partition_key", "seq")
    every = every.unionByName(dead.select(*every.columns))
    key = meta.key_struct()
    live = table.live(every, meta, key.names, carry=["spec_id", "partition_key", "seq"])
    # a key column may be named like one of the listing
    places = [F.col(c).alias(c) for c in ("data_file_path", "pos")]
    listed = live.toDF(*["data_file_path", "pos", "_spec", "_part", "_at"], *key.names)
    return listed.select(F.col("_spec").alias("spec_id"), F.col("_part").alias("partition_key"), key_hex(key).alias("pk"), *places, F.col("_at").alias("seq"))


def probes(table: Table, meta: Meta, run: runs.Run) -> DataFrame:
    """KEYS of an EQ_DEL run's rows."""
    key = meta.key_struct()
    return scans.equality_deletes(table.spark, run.files, key).select("spec_id", "partition_key", key_hex(key).alias("pk"))


def converted(table: Table, meta: Meta, run: runs.Run, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the commit of an EQ_DEL run adds and removes, given the positions of its keys."""
    adds, replaced = delete_writers.merged(table, meta, table.files(meta), found)
    return planner.assemble(adds, run.files, replaced)


def process_next_run(table: Table, index: KeyIndex, how: str | None = None, indexer: Callable[[Table, Meta, runs.Run], DataFrame] = index_rows, converter: Callable[[Table, Meta, runs.Run, DataFrame], tuple[DataFrame, DataFrame]] = converted) -> runs.Run | None:
    """Plans and carries out one run; None if there was nothing to do.

    A DATA run makes its index entries durable, then advances the watermark. An EQ_DEL run finds the rows, merges them with
    the delete files that are there, and commits new delete files, removed ones and the watermark together.
    Everything may be repeated: index entries of the same rows are the same, and delete files that were not
    committed are orphans. Conflict means: call again. ``indexer`` and ``converter`` may be replaced, as may the index.
    """
    meta = table.meta()
    run = runs.plan_next(table, meta)
    if run is None:
        return None
    marks = {**run.state.properties(), config.LAST_VERSION: str(meta.version), **TableConfig.of(meta.properties).pinned()}
    if run.kind == 1:
        index.append(indexer(table, meta, run))
        table.commit(meta, properties=marks)
        return run
    # looked up once, used by the merge and the writer
    found = cut(index.find(probes(table, meta, run), how))
    adds, removes = converter(table, meta, run, found)
    table.commit(meta, adds, removes, marks, {config.CONVERTED: "true"})
    return run


def process_all(table: Table, index: Index, most: int | None = None, **how) -> int:
    """Runs until nothing is left; a conflict is planned again. Returns the number of runs."""
    done = 0
    while most is None or done < most:
        try:
            if process_next_run(table, index, **how) is None:
                break
            done += 1
        except Conflict:
            continue
    return done


@dataclass(frozen=True)
class Settings:
    """Of the supervisor; ``from_env`` reads PREFIX_NAME variables, dots and dashes as underscores.

    PREFIX_OPTION_a_b=v sets the free-form option a.b, a Spark setting the supervisor applies to its session when it starts.
    """

    root: str = "."
    index_root: str = "./index"
    #: Rest between two looks at the catalog while nothing happens.
    poll_seconds: float = 5.0
    #: How long a table without work, and one that failed, is left alone.
    idle_seconds: float = 30.0
    retry_seconds: float = 30.0
    #: A run that takes longer is cancelled and tried again; 0 is no limit.
    run_seconds: float = 0.0
    #: How long a stop waits for runs under way before it cancels them.
    grace_seconds: float = 10.0
    workers: int = 4
    #: Runs of one table in one turn, before others get theirs.
    runs_per_turn: int = 1
    every_entry: bool = False
    #: Keep each index in memory between runs.
    warm_index: bool = False
    #: Remove index folders that no version uses after a table came to rest.
    vacuum: bool = False
    #: Regular expressions on the path below the root; empty ones take all, or none away.
    include: str = ""
    exclude: str = ""
    #: How keys are looked up; empty is measured.
    lookup: str = ""
    options: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "ROWTIDE_") -> Settings:
        env = os.environ if env is None else env
        given = {setting_name(k, prefix): v for k, v in env.items() if k.startswith(prefix)}
        out: dict = {}
        for f in fields(cls):
            if f.name != "options" and (v := given.get(f.name.replace("_", "."))) is not None:
                kind = type(f.default)
                out[f.name] = v.lower() in ("1", "true", "yes") if kind is bool else kind(v)
        # the names of options keep their letters
        options = {k.removeprefix(f"{prefix}OPTION_").replace("_", "."): v for k, v in env.items() if k.startswith(f"{prefix}OPTION_")}
        return cls(**out, options=options)


class Supervisor:
    """Sweeps the catalog and keeps every opted-in table moving, one run of a table at a time.

    Tables are served in parallel, each in a fair scheduler pool and a job group of its own, and none waits for another: as soon as one
    table's turn ends, whatever is due gets the next. A table without work is left alone for ``idle_seconds``; one whose run failed
    or was cancelled is reported and taken up again after ``retry_seconds``. Stopping cancels what still runs.
    """

    def __init__(self, spark: SparkSession, settings: Settings, metrics: Metrics | None = None, log: Callable[[str], None] = print, make_index: Callable[[Table], KeyIndex] | None = None):
        self.spark, self.settings, self.metrics, self.log = spark, settings, metrics or Metrics(), log
        self.make_index = make_index or self._index
        self.stop = threading.Event()
        self._tables: dict[str, Table] = {}
        self._indexes: dict[str, KeyIndex] = {}
        self._rest_until: dict[str, float] = {}
        self._began: dict[str, float] = {}
        self._lock = threading.Lock()
        for name, value in settings.options.items():
            spark.conf.set(name, value)

    def _index(self, table: Table) -> KeyIndex:
        conf, s = TableConfig.of(table.meta().properties), self.settings
        return Index.create(self.spark, s.index_root, os.path.relpath(table.path, s.root), conf.buckets, s.every_entry)

    def sweep(self, now: float | None = None) -> list[Table]:
        """Tables that are due: opted in, not in work, not resting. A table keeps its object, so its listing is cached once."""
        now, s = time.monotonic() if now is None else now, self.settings
        found = {}
        for t in tables(self.spark, s.root, self.log):
            name = os.path.relpath(t.path, s.root)
            if re.search(s.include, name) and not (s.exclude and re.search(s.exclude, name)):
                found[t.path] = self._tables.get(t.path, t)
        with self._lock:
            for path in set(self._tables) - set(found) - set(self._began):
                self._forget(path)
            self._tables.update(found)
            return [t for t in found.values() if t.path not in self._began and self._rest_until.get(t.path, 0) <= now]

    def _forget(self, path: str) -> None:
        self._tables.pop(path).close()
        index = self._indexes.pop(path, None)
        if isinstance(index, Index):
            index.cool()

    def _rest(self, path: str, seconds: float) -> None:
        self._rest_until[path] = time.monotonic() + seconds

    def serve(self, table: Table) -> bool:
        """One turn of one table; whether it did a run."""
        path, s = table.path, self.settings
        with self._lock:
            if path in self._began:
                return False
            self._began[path] = time.monotonic()
        sc, worked = self.spark.sparkContext, False
        try:
            sc.setLocalProperty("spark.scheduler.pool", identifier_text(path))
            sc.setJobGroup(self._group(path), path, True)
            index = self._indexes.get(path) or self._indexes.setdefault(path, self.make_index(table))
            for _ in range(max(1, s.runs_per_turn)):
                began = time.monotonic()
                run = process_next_run(table, index, s.lookup or None)
                if run is None:
                    self._idle(table, index)
                    break
                worked = True
                if s.warm_index and run.kind == 1 and isinstance(index, Index):
                    index.warm()
                self.metrics.run_done(path, run, time.monotonic() - began)
            return worked
        except Conflict:
            return True
        except Exception as e:  # noqa: BLE001
            self.metrics.run_failed(path, e)
            self.log(f"{path}: {e}")
            self._rest(path, s.retry_seconds)
            return worked
        finally:
            with self._lock:
                self._began.pop(path, None)

    def _idle(self, table: Table, index: KeyIndex) -> None:
        self._rest(table.path, self.settings.idle_seconds)
        table.close()
        if self.settings.vacuum and isinstance(index, Index):
            index.vacuum()
        self.metrics.idle(table.path)

    def _group(self, path: str) -> str:
        return f"rowtide-{id(self)}-{path}"

    def _cancel(self, longer_than: float = 0.0) -> None:
        now = time.monotonic()
        with self._lock:
            late = [p for p, began in self._began.items() if now - began >= longer_than]
        for path in late:
            self.spark.sparkContext.cancelJobGroup(self._group(path))

    def run(self, sweeps: int | None = None) -> None:
        """Works until :attr:`stop` is set, or for so many sweeps, each of which waits for one turn to end."""
        s, pending = self.settings, {}
        with ThreadPoolExecutor(s.workers) as pool:
            while not self.stop.is_set() and (sweeps is None or sweeps > 0):
                waiting = set(pending.values())
                pending.update({pool.submit(self.serve, t): t.path for t in self.sweep() if t.path not in waiting})
                sweeps = None if sweeps is None else sweeps - 1
                done = set()
                while pending and not done and not self.stop.is_set():
                    done = wait(pending, s.poll_seconds, FIRST_COMPLETED).done
                    if s.run_seconds:
                        self._cancel(s.run_seconds)
                    if sweeps is None:
                        break
                for f in done:
                    pending.pop(f)
                if not any(f.result() for f in done):
                    self.stop.wait(0 if pending else s.poll_seconds)
            if self.stop.is_set():
                for f in pending:
                    f.cancel()
                wait(pending, s.grace_seconds)
                self._cancel()
        for path in list(self._tables):
            self._forget(path)
