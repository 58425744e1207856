"""Writers of per-file deletes: file-scoped position deletes (version 2) and deletion vectors (version 3)."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.functions import bitmaps
from rowtide.plans import config, planner
from rowtide.session import cut, shared_dir
from rowtide.sources import avro_file, scans, vectors

OUT = "content string, path string, format string, spec_id int, partition_key string, referenced string, offset bigint, size bigint, records bigint, bytes bigint"


def located(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions with the spec and partition of their data file; those of files that are gone are dropped, their rows are gone too."""
    data = files.where("content = 'data'").select(F.col("path").alias("data_file_path"), "spec_id", "partition_key")
    return positions.select("data_file_path", "pos").join(data, "data_file_path")


def write(table, meta, positions: DataFrame, folder: str | None = None) -> DataFrame:
    """The delete files for each data file named in ``positions`` (data_file_path, pos, spec_id, partition_key); returns ENTRY rows.

    The positions of a file are a set: repeats collapse. Version 3 gets one vector a data file, version 2 position deletes in the table's
    delete format, one file or, beyond the target size, several. Positions are shuffled once, by their file; there they become bitmaps of 32768
    positions in the JVM, and Python gets those, at most 4 KB each. The work of a task is bounded by the rows of its file. Files are
    written under a new name each time, so a repeated task leaves an orphan, never a wrong file. The result is materialised: files are written once.
    """
    config.check_version(meta.format_version)
    folder = folder or os.path.join(table.path, "deletes", uuid.uuid4().hex)
    os.makedirs(folder, exist_ok=True)
    fmt, target = config.delete_format(meta.properties), config.delete_target(meta.properties)
    if meta.format_version == 2 and fmt not in _WRITERS:
        raise NotImplementedError(f"position deletes in {fmt}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable")
        path = pdf["data_file_path"].iloc[0]
        # bucket b holds positions from (b - 1) * BUCKET on: see functions.bitmaps
        parts = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (b - 1) * bitmaps.BUCKET for b, bits in zip(pdf["bucket"], pdf["bits"])]
        positions = np.concatenate(parts).astype(np.int64)
        made = [_vector(folder, path, positions)] if meta.format_version == 3 else _position_files(folder, path, positions, fmt, target)
        return pd.DataFrame([{**out, "spec_id": pdf["spec_id"].iloc[0], "partition_key": pdf["partition_key"].iloc[0], "referenced": path} for out in made])[[c.split()[0] for c in OUT.split(", ")]]

    by = ["data_file_path", "spec_id", "partition_key"]
    sets = bitmaps.position_sets(positions.repartition("data_file_path"), by)
    return cut(sets.groupBy("data_file_path").applyInPandas(run, OUT))


def merged(table, meta, files: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete files for the data files in ``positions``, with the positions that their present delete files hold; and those, now to be removed.

    Only present deletes of the files that get new positions are read: vectors of version 3, file-scoped
    deletes of version 2. Each replaced one comes once, by its location.
    """
    new = located(files, positions)
    touched = new.select("spec_id", "partition_key").distinct()
    # positions combine to their files where they are, so a hot file is one row a task
    paths = new.select(F.col("data_file_path").alias("referenced")).distinct()
    old = planner.existing_deletes(files, touched, meta.format_version).join(paths, "referenced", "left_semi")
    every = positions.select("data_file_path", "pos").unionByName(scans.position_deletes(table.spark, old).select("data_file_path", "pos"))
    return write(table, meta, located(files, every)), old.dropDuplicates(["path", "referenced"])


def _vector(folder: str, path: str, positions: np.ndarray) -> dict:
    data, places = vectors.write_puffin({path: positions})
    out = os.path.join(folder, f"{uuid.uuid4().hex}.puffin")
    with open(out, "wb") as f:
        f.write(data)
    offset, size, _ = places[path]
    return {"content": "dv", "path": out, "format": "puffin", "offset": offset, "size": size, "bytes": len(data), "records": len(positions)}


def _parquet(out: str, path: str, positions: np.ndarray) -> None:
    pq.write_table(pa.table({"file_path": pa.array([path] * len(positions)), "pos": pa.array(positions)}), out)


def _orc(out: str, path: str, positions: np.ndarray) -> None:
    from pyarrow import orc

    orc.write_table(pa.table({"file_path": pa.array([path] * len(positions)), "pos": pa.array(positions)}), out)


def _avro(out: str, path: str, positions: np.ndarray) -> None:
    avro_file.write(out, [("file_path", "string"), ("pos", "long")], ((path, p) for p in positions.tolist()))


_WRITERS = {"parquet": _parquet, "orc": _orc, "avro": _avro}
#: Bytes that a position takes in a delete file, at least: by this, positions are divided into files of the target size.
POSITION_BYTES = 8


def _position_files(folder: str, path: str, positions: np.ndarray, fmt: str, target: int) -> list[dict]:
    made, each = [], max(1, target // POSITION_BYTES)
    for i in range(0, len(positions), each):
        part, out = positions[i : i + each], os.path.join(folder, f"{uuid.uuid4().hex}.{fmt}")
        _WRITERS[fmt](out, path, part)
        made.append({"content": "pos", "path": out, "format": fmt, "offset": None, "size": None, "bytes": os.path.getsize(out), "records": len(part)})
    return made


def as_vectors(table, meta, files: DataFrame, deletes: DataFrame) -> DataFrame:
    """Position deletes that name no file, as vectors of the data files they hit, in the shared folder: LOCATION rows.

    The deletes are shuffled, by the file they hit; the data rows are not.
    """
    hit = scans.position_deletes(table.spark, deletes)
    folder = os.path.join(scans.local(shared_dir(table.spark)), f"vectors-{uuid.uuid4().hex}")
    return write(table, replace(meta, format_version=3), located(files, hit), folder).select("content", "path", "referenced", "offset", "size")
