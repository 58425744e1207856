"""Row scans with positions, of Parquet, ORC and Avro files, and scans of deletes.

Data rows are never shuffled here. What a row needs to know of its file (partition, sequence number, deletes) is carried onto it in the task
that reads it, from a broadcast map of the listing. That map has a bound; a longer listing is read in several parts, each with its own map.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.session import cut, local_rows
from rowtide.sources import avro_file, vectors

FORMATS = ("parquet", "orc", "avro")
POSITIONED = T.StructType([T.StructField("data_file_path", T.StringType()), T.StructField("pos", T.LongType())])
#: Bytes of listing that one broadcast map of files may have.
MAP_BYTES = 64 << 20
#: Where a delete of one data file is stored.
LOCATION = "content string, path string, referenced string, offset bigint, size bigint"


def local(path: str) -> str:
    """A path as Python opens it."""
    return path.removeprefix("file://").removeprefix("file:")


def scanned_path():
    """The path of a scanned row's file as listings spell it: decoded, without the scheme of local files."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def parquet(spark: SparkSession, files: DataFrame, schema: T.StructType) -> DataFrame:
    """A Parquet scan of the paths in ``files``. They go from the listing to Spark's own file index inside the JVM, which holds them anyway."""
    jvm = spark.sparkContext._jvm
    paths = getattr(files.select("path").distinct()._jdf, "as")(jvm.org.apache.spark.sql.Encoders.STRING()).collectAsList()
    if not paths.size():
        return _empty(spark, schema).select("*", F.lit(None).cast("struct<file_path:string,row_index:bigint>").alias("_metadata"))
    return DataFrame(spark.read.schema(schema)._jreader.parquet(jvm.PythonUtils.toSeq(paths)), spark)


def _scan(spark: SparkSession, files: dict[str, list[str]], want: T.StructType) -> DataFrame | None:
    """data_file_path, pos and the columns of ``want`` of the rows of ``files``, paths by format."""
    out = None
    for kind, paths in sorted(files.items()):
        if kind == "parquet":
            df = spark.read.schema(want).parquet(*paths).select(scanned_path().alias("data_file_path"), F.col("_metadata.row_index").alias("pos"), *want.names)
        else:
            parts, reader = (_stripes, _read_stripe) if kind == "orc" else (_blocks, _read_block)
            listing = local_rows(spark, [(p,) for p in paths], T.StructType([T.StructField("path", T.StringType())])).repartition(len(paths), "path")
            each = cut(listing.mapInPandas(_split(parts), "path string, part bigint, first bigint"))
            # as many tasks as parts, so one large file is not one task's
            df = each.repartition(max(1, each.count()), "path", "part").mapInPandas(_per_part(reader, want), T.StructType(POSITIONED.fields + want.fields))
        out = df if out is None else out.unionByName(df)
    return out


def size_in_bytes(columns: Sequence[str], kinds: dict[str, str]) -> Column:
    """About how many bytes a row of these columns takes: texts as long as they are, everything else 16."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string") if kinds[c] not in ("string", "binary") else F.col(c)), F.lit(0)) + 16 for c in columns]
    out = F.lit(16)
    for s in sizes:
        out = out + s
    return out


def rows(spark: SparkSession, files: DataFrame, schema: T.StructType, columns: Sequence[str] | None = None, carry: Sequence[str] = (), dead: DataFrame | None = None) -> DataFrame:
    """Rows of ``files`` (path, format): data_file_path, pos (from 0 in each file), ``carry`` columns of the listing, and ``columns``.

    Parquet keeps the reader's own row index, so files are split and positions are right. ORC and Avro
    have none; they are split into stripes and blocks, whose first rows are counted from their headers. Only the columns asked for are read. An unknown
    format is an error. A column that a file lacks is null. A path counts once.

    ``dead`` (LOCATION columns) are the deletes that name their data file: rows at their positions are left out. They are read by the task
    that scans the file, once a task and file; rows of files without deletes do not pass through Python.
    No row is shuffled: the carried columns and the places of deletes are a broadcast map of at most MAP_BYTES, and
    a listing beyond that is scanned in as many parts as it takes. The driver holds one part at a time.
    """
    want = T.StructType([f for f in schema.fields if columns is None or f.name in columns])
    want = want if columns is None else T.StructType([want[c] for c in columns])
    carried = [f"_c{i}" for i in range(len(carry))]
    here = files.select(F.lit(False).alias("_dead"), "path", F.lower("format").alias("_format"), F.col("path").alias("_of"), *[F.col(c).alias(n) for c, n in zip(carry, carried)])
    if dead is not None:
        d = dead.select(F.lit(True).alias("_dead"), "path", F.col("content").alias("_format"), F.col("referenced").alias("_of"), "offset", "size")
        here = here.unionByName(d, allowMissingColumns=True)
    sizes = here.groupBy("_dead", "_format").agg(F.sum(size_in_bytes(here.columns, dict(here.dtypes))).alias("bytes")).collect()
    if unknown := {r._format for r in sizes if not r._dead} - set(FORMATS):
        raise NotImplementedError(f"no reader for {sorted(map(str, unknown))}")
    parts = -(-sum(r.bytes for r in sizes) // MAP_BYTES) or 1
    kinds = here.schema
    out = None
    for i in range(parts if any(not r._dead for r in sizes) else 0):
        # bounded by MAP_BYTES
        found = (here if parts == 1 else here.where(F.pmod(F.xxhash64("_of"), F.lit(parts)) == i)).collect()
        for df in _part(spark, found, want, [kinds[n] for n in carried]):
            out = df if out is None else out.unionByName(df)
    if out is None:
        out = _empty(spark, T.StructType([*POSITIONED.fields, *[kinds[n] for n in carried], *want.fields]))
    return out.select("data_file_path", "pos", *[F.col(n).alias(c) for c, n in zip(carry, carried)], *want.names)


def _part(spark: SparkSession, found: Sequence, want: T.StructType, carried: Sequence[T.StructField]) -> Iterator[DataFrame]:
    """The scans of one part of a listing: of the files without deletes, and of those with."""
    files = {r.path: r for r in found if not r._dead}
    places: dict[str, list[tuple]] = {}
    for r in found:
        if r._dead and r._of in files:
            places.setdefault(r._of, []).append((r._format, r.path, r.offset, r.size))
    for own in (sorted(places), sorted(set(files) - set(places))):
        by: dict[str, list[str]] = {}
        for p in own:
            by.setdefault(files[p]._format, []).append(p)
        if (scan := _scan(spark, by, want)) is None:
            continue
        fields = [T.StructField("data_file_path", T.StringType()), *carried]
        hit = bool(own) and own[0] in places
        if hit:
            fields.append(T.StructField("_file", T.IntegerType()))
        if len(fields) > 1:
            values = [(p, *[files[p][f.name] for f in carried], *([n] if hit else [])) for n, p in enumerate(own)]
            scan = scan.join(F.broadcast(local_rows(spark, values, T.StructType(fields))), "data_file_path")
        yield scan.where(_alive(spark, own, places)("_file", "pos")).drop("_file") if hit else scan


def _alive(spark: SparkSession, paths: Sequence[str], places: Mapping[str, Sequence[tuple]]):
    """A pandas UDF of (number of the file in ``paths``, position): whether no delete at the file's ``places`` hits it."""
    known = spark.sparkContext.broadcast([(tuple(sorted(places[p], key=str)), p) for p in paths])

    @F.pandas_udf("boolean")
    def alive(file: pd.Series, pos: pd.Series) -> pd.Series:
        keep, at = np.ones(len(pos), dtype=bool), pos.to_numpy(np.int64)
        for n in file.unique():
            own, gone = (file == n).to_numpy(), _deleted(*known.value[n])
            if len(gone):
                keep[own] = gone[np.minimum(np.searchsorted(gone, at[own]), len(gone) - 1)] != at[own]
        return pd.Series(keep)

    return alive


@lru_cache(maxsize=8)
def _deleted(places: tuple, referenced: str) -> np.ndarray:
    """Sorted positions of one data file that the deletes at ``places`` state; a few files are kept in each Python worker."""
    out = [np.empty(0, np.int64)]
    for content, path, offset, size in places:
        if content == "dv":
            with open(local(path), "rb") as f:
                f.seek(int(offset))
                out.append(vectors.read_vector(f.read(int(size))))
        else:
            out += [p.loc[p["file_path"] == referenced, "pos"].to_numpy(np.int64) for p in _position_file(path)]
    return np.unique(np.concatenate(out))


def _position_file(path: str) -> Iterator[pd.DataFrame]:
    kind = path.rpartition(".")[2].lower()
    if kind == "orc":
        from pyarrow import orc

        f = orc.ORCFile(local(path))
        for i in range(f.nstripes):
            yield pd.DataFrame(f.read_stripe(i, columns=["file_path", "pos"]).to_pydict())
    elif kind == "avro":
        yield pd.DataFrame(avro_file.read(local(path)), columns=["file_path", "pos"])
    else:
        import pyarrow.parquet as pq

        yield pq.read_table(local(path), columns=["file_path", "pos"]).to_pandas()


def _split(parts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield pd.DataFrame([(path, part, first) for part, first in parts(local(path))], columns=["path", "part", "first"])

    return run


def _per_part(reader, want: T.StructType):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, part, at in b.itertuples(index=False, name=None):
                for some in reader(local(path), part, want.names):
                    some = some.reindex(columns=want.names).astype(object).where(lambda x: x.notna(), None)
                    some.insert(0, "pos", range(at, at + len(some)))
                    some.insert(0, "data_file_path", path)
                    at += len(some)
                    yield some

    return run


def _stripes(path: str) -> Iterator[tuple[int, int]]:
    """Each stripe of an ORC file and its first row; one column is read, since the number of rows is not offered otherwise."""
    from pyarrow import orc

    f, row = orc.ORCFile(path), 0
    for i in range(f.nstripes):
        yield i, row
        row += f.read_stripe(i, columns=f.schema.names[:1]).num_rows


def _read_stripe(path: str, part: int, names: Sequence[str]) -> Iterator[pd.DataFrame]:
    from pyarrow import orc

    f = orc.ORCFile(path)
    have = [n for n in names if n in f.schema.names]
    stripe = f.read_stripe(part, columns=have or f.schema.names[:1])
    yield pd.DataFrame(stripe.to_pydict() if have else None, index=range(stripe.num_rows))


def _blocks(path: str) -> Iterator[tuple[int, int]]:
    for offset, first, _ in avro_file.blocks(path):
        yield offset, first


def _read_block(path: str, part: int, names: Sequence[str]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame([{n: row.get(n) for n in names} for row in avro_file.read(path, part)], columns=list(names), dtype=object)


def position_deletes(spark: SparkSession, deletes: DataFrame) -> DataFrame:
    """data_file_path, pos, source_file of position-delete files and vectors: ``deletes`` has content, path, format, referenced, offset, size.

    Both kinds come out alike, so what follows does not care which it was. A vector must be intact, else the
    query fails. Repeats are kept.
    """
    pos = deletes.where("content = 'pos'")
    schema = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("pos", T.LongType())])
    df = parquet(spark, pos.where("lower(format) = 'parquet'"), schema)
    a = df.select(F.col("file_path").alias("data_file_path"), "pos", scanned_path().alias("source_file"))
    empty = "data_file_path string, pos bigint, source_file string"

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                for p in _position_file(path):
                    yield pd.DataFrame({"data_file_path": p["file_path"], "pos": p["pos"], "source_file": path})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, referenced, offset, size in b.itertuples(index=False, name=None):
                with open(local(path), "rb") as f:
                    f.seek(int(offset))
                    positions = vectors.read_vector(f.read(int(size)))
                yield pd.DataFrame({"data_file_path": referenced, "pos": positions, "source_file": path})

    rest = pos.where("lower(format) <> 'parquet'").select("path").distinct().mapInPandas(other, empty)
    dv = deletes.where("content = 'dv' and size > 0").select("path", "referenced", "offset", "size")
    return a.unionByName(rest).unionByName(dv.mapInPandas(read, empty))


def equality_deletes(spark: SparkSession, deletes: DataFrame, key: T.StructType) -> DataFrame:
    """Key rows of equality-delete files with spec_id, partition_key, seq and source_file; duplicates are kept, they are harmless."""
    return rows(spark, deletes, key, carry=["spec_id", "partition_key", "seq"]).drop("pos").withColumnRenamed("data_file_path", "source_file")


def without_positions(scan: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows of a scan whose (data_file_path, pos) is not deleted."""
    return scan.join(positions.select("data_file_path", "pos"), ["data_file_path", "pos"], "left_anti")
