"""What a table's next run is: its files, resolved from the head of the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.plans import config, planner
from rowtide.plans.config import State, TableConfig


@dataclass(frozen=True)
class Run:
    kind: int
    max_seq: int
    files: DataFrame
    count: int
    records: int

    @property
    def state(self) -> State:
        return State(self.max_seq, self.kind)


def walkable(table, meta) -> DataFrame:
    """Data files and convertible equality deletes of a version, with their kind."""
    key_ids = F.array(*[F.lit(i) for i in meta.field_ids(TableConfig.of(meta.properties).primary_keys)])
    specs = F.create_map(*[x for i, s in enumerate(meta.specs) for x in (F.lit(i), F.lit(bool(s)))])
    files = table.files(meta).where("content in ('data', 'eq')")
    ok = planner.convertible(F.lit("EQUALITY_DELETES"), F.col("field_ids"), key_ids, specs[F.col("spec_id")], F.lit(bool(meta.specs[meta.spec_id])))
    return files.withColumn("kind", F.when(F.col("content") == "data", 1).when(ok, 0)).where("kind is not null")


def plan_next(table, meta) -> Run | None:
    """The first run after the watermark; None if all is processed. Unfit or drifted tables raise ConfigError, files that came too late LateCommit."""
    config.check_version(meta.format_version)
    conf = TableConfig.of(meta.properties)
    conf.check_stable(meta.properties)
    state, walk = State.of(meta.properties), walkable(table, meta)
    if processed := int(meta.properties.get(config.LAST_VERSION, 0)):
        if missed := walk.where(planner.late(state, F.col("version"), processed)).limit(1).collect():
            raise config.LateCommit(f"{missed[0].path} has sequence number {missed[0].seq}, the watermark is {state.seq}")
    files = planner.next_run(walk, state)
    first = files.agg(F.max("kind").alias("kind"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.sum("records").alias("records")).first()
    return Run(first.kind, first.seq, files, first.n, first.records or 0) if first.n else None
