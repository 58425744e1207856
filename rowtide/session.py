"""Session defaults and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter brings its own."""
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine;
    elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rowtide-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_rows(spark: SparkSession, rows: Sequence, schema: T.StructType) -> DataFrame:
    """Rows that the driver has already, as a relation in the plan itself: no job is needed to broadcast them."""
    names = schema.names
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return spark.createDataFrame(pa.Table.from_pydict(columns, to_arrow_schema(schema)), schema)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a session; needed where it is not installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_rowtide_shipped", False):
        return
    here = Path(__file__).resolve().parent
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if shared.startswith(("/", "file:")):
        folder = os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"rowtide-{uuid.uuid4().hex}")
        os.makedirs(folder)
    else:
        folder = tempfile.mkdtemp(prefix="rowtide-")  # the driver's; Spark sends the file from there
    path = os.path.join(folder, "rowtide.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)
    sc._rowtide_shipped = True
