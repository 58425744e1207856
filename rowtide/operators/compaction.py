"""Consolidating many tiny files into few, by joining their bytes.

Files are never parsed: newline-delimited files are joined at line ends, with
one header; zstandard files frame by frame. Lengths and checksums of every
member are checked in the joined bytes.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.functions import canon
from rowtide.operators import skew
from rowtide.session import cut

#: Rows of one delete file that go into one frame; a file with more becomes several frames.
FRAME_ROWS = 100_000
ZSTD_MAGIC = 0xFD2FB528


def plan_outputs(members: DataFrame, group: Sequence[str], size: str, target: str, order: Sequence[str] = ("file_id",), least: int = 2) -> DataFrame:
    """``members`` with ``out_no``, the output file of its group each one goes to.

    A group of n bytes becomes round(n / target) files, one at least, cut at
    equal distances of the running sum of sizes; a member belongs where it begins,
    so none is divided and each output is within half of the largest member of
    its even share. Groups under ``least`` members give no row.
    ``target`` is the same on all rows of a group. Sizes must not be null;
    negative ones count as 0. Nulls in ``group`` are equal.

    The running sum is taken in pieces of the hash of ``order``, as many as leave skew.ROWS members in each: a window
    in each piece, and one over the sums of the pieces. So a group with most
    members is not the work of one task.
    """
    pieces = skew.pieces_of(members.count())
    g = F.struct(*group).alias("_g")
    rows = members.withColumn("_g", g).withColumn("_size", F.greatest(F.col(size), F.lit(0)).cast("bigint")).withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sums = rows.groupBy("_g", "_piece").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("c"), F.max(target).alias("_target"))
    whole = Window.partitionBy("_g")
    upto = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "_g", "_piece", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("_offset"), F.sum("s").over(whole).alias("_total"),
        F.sum("c").over(whole).alias("_members"), F.max("_target").over(whole).alias("_goal"),
    ).where(F.col("_members") >= least)
    local = Window.partitionBy("_g", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_offset") + F.coalesce(F.sum("_size").over(local), F.lit(0))
    outs = F.greatest(F.round(F.col("_total") / F.greatest(F.col("_goal"), F.lit(1))), F.lit(1)).cast("bigint")
    no = F.when(F.col("_total") == 0, F.lit(0)).otherwise(F.least(F.floor(begin * outs / F.col("_total")), outs - 1)).cast("int")
    return rows.join(sums, ["_g", "_piece"]).withColumn("out_no", no).select(*members.columns, "out_no")


def _compress(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)


def frame_udf(level: int = 3):
    """A pandas UDF: each text as one complete zstandard frame."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        c = _compress(level)
        return s.map(lambda t: None if t is None else c.compress(t.encode()))

    return pack


def zstd_end(data: bytes, at: int = 0) -> int:
    """Where the frame that begins at ``at`` ends, read from its headers only; ValueError if it is not complete.

    Layout as in RFC 8878: magic, frame header, blocks of three header bytes
    and their content, an optional checksum. Skippable frames are accepted.
    """
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic != ZSTD_MAGIC:
            raise ValueError("not a zstandard frame")
        else:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = 0
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data):
                    raise ValueError("a block is cut off")
                last, kind, n = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError("a reserved block type")
                end += 3 + (1 if kind == 1 else n)
            end += 4 * (flags >> 2 & 1)
    except (struct.error, IndexError) as e:
        raise ValueError("a header is cut off") from e
    if end > len(data):
        raise ValueError("a frame is cut off")
    return end


def join_frames(parts: Sequence[bytes]) -> bytes:
    """Complete zstandard frames one after another; each part must be a whole number of frames."""
    for p in parts:
        at = 0
        while at < len(p):
            at = zstd_end(p, at)
    return b"".join(parts)


def join_lines(parts: Sequence[bytes], header_lines: int = 0) -> bytes:
    """Newline-delimited parts in one: a missing last newline is added, the header is that of the first part.

    Every part must begin with the same ``header_lines`` lines, else ValueError.
    Empty parts add nothing.
    """
    out, head = [], None
    for p in parts:
        if not p:
            continue
        at = 0
        for _ in range(header_lines):
            at = p.find(b"\n", at) + 1 or len(p)
        if head is None:
            head = p[:at] if p[:at].endswith(b"\n") or not at else p[:at] + b"\n"
            out.append(head)
        elif p[:at].rstrip(b"\n") != head.rstrip(b"\n"):
            raise ValueError("the headers differ")
        body = p[at:]
        out.append(body if body.endswith(b"\n") or not body else body + b"\n")
    return b"".join(out)


MEMBER = "struct<file_id:bigint,piece:int,offset:bigint,length:bigint,crc:bigint>"
JOINED = f"members array<{MEMBER}>, bytes bigint, crc bigint, payload binary"


def concatenate(parts: DataFrame, output: Sequence[str], totals: Mapping[str, Column] | None = None) -> DataFrame:
    """One row an output: its columns ``output``, ``totals`` (aggregates over its parts), members, bytes, crc, payload.

    ``parts`` has file_id, piece and frame. The frames of an output are joined in the order of file id and piece. Before that, each
    must be complete; after it, the slice of every member must have its
    length and checksum, and the lengths must add up; otherwise the task fails.
    A member with a null frame is an error, never left out. Outputs are planned on the lengths of the frames, so one
    fits in memory; frames of one file follow each other, in several outputs if they are many.
    """
    totals = dict(totals or {})
    sent = parts.withColumns({"_o": F.struct(*output), "_p": F.struct("file_id", "piece", "frame", F.crc32("frame").alias("crc"))})
    grouped = sent.groupBy("_o").agg(F.array_sort(F.collect_list("_p")).alias("_ps"), *[c.alias(n) for n, c in totals.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ps = row.pop("_ps")
                if any(p["frame"] is None for p in ps):
                    raise ValueError("a member has no bytes")
                joined = join_frames([p["frame"] for p in ps])
                members, at, view = [], 0, memoryview(joined)
                for p in ps:
                    n = len(p["frame"])
                    if zlib.crc32(view[at : at + n]) != p["crc"]:
                        raise ValueError(f"checksum of file {p['file_id']}")
                    members.append({"file_id": p["file_id"], "piece": p["piece"], "offset": at, "length": n, "crc": p["crc"]})
                    at += n
                if at != len(joined):
                    raise ValueError("lengths do not add up")
                # one output at a time: no more than one payload is held
                yield pa.RecordBatch.from_pylist([{**row, "members": members, "bytes": at, "crc": zlib.crc32(joined), "payload": joined}], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in grouped.schema.fields if f.name != "_ps"]
    schema = StructType([*kept, *StructType.fromDDL(JOINED).fields])
    target = to_arrow_schema(schema)
    return grouped.mapInArrow(run, schema).select(*[F.col(f"_o.{c}").alias(c) for c in output], *totals, "members", "bytes", "crc", "payload")


GROUP = ("table_id", "spec_id", "partition_key", "content", "ids")


def small_delete_files(delete_files: DataFrame, tables: DataFrame, default_target: int = 16384) -> DataFrame:
    """The live delete files, deletion vectors aside, of known size below half of their table's target, that share their group with another.

    One row a file: file_id, GROUP, path, size, target, records, referenced. Values are the largest that any listing states; a file
    is gone if any listing says so. Files of unknown tables have the default target.
    """
    files = delete_files.groupBy("file_id").agg(
        F.max("table_id").alias("table_id"), F.max("spec_id").alias("spec_id"), F.max(canon.partition_key("partition_key")).alias("partition_key"), F.max(canon.label("content")).alias("content"),
        F.max(canon.label("file_format")).alias("format"), F.max(canon.id_set("equality_ids")).alias("ids"), F.max(canon.file_path("file_path")).alias("path"), F.max("file_size_in_bytes").alias("size"),
        F.max("record_count").alias("records"), F.max(canon.file_path("referenced_data_file")).alias("referenced"), F.max("removed_at").alias("removed_at"),
    )
    targets = tables.groupBy("table_id").agg(F.max("target_delete_file_bytes").alias("target"))
    live = files.where("removed_at is null and size is not null and coalesce(format, '') <> 'PUFFIN'")
    with_target = live.join(targets, "table_id", "left").withColumn("target", F.coalesce("target", F.lit(default_target)).cast("bigint"))
    small = cut(with_target.where("size * 2 < target").drop("removed_at", "format").withColumn("_g", F.struct(*GROUP)))
    shared = small.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("_g")
    return skew.join(small, shared, ["_g"], ["file_id"], "left_semi").drop("_g")


def delete_frames(small: DataFrame, eq_delete_rows: DataFrame) -> DataFrame:
    """The columns of ``small`` with piece, frame, length: the content of each file as complete zstandard frames.

    A line states path, content, record_count and referenced file (in the first piece); then, of equality deletes on the key,
    comes a line for each delivered row: rows delivered twice once (the largest of differing deliveries), keys repeated within the file as often
    as they are, rows without row_id each. A file with more than FRAME_ROWS rows has several pieces. Lines
    are sorted, so the bytes do not depend on the order of the rows.

    Rows are shuffled once, by file, and meet the listing there. The result is materialised.
    """
    on = ["table_id", "path"]
    line = F.to_json(F.struct("spec_id", canon.partition_key("partition_key").alias("partition_key"), canon.hex_key("pk").alias("pk")), {"ignoreNullFields": "false"})
    # a row without id is one of its own
    own = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())
    rows = eq_delete_rows.select("table_id", canon.file_path("file_path").alias("path"), F.struct("row_id", own.alias("own"), line.alias("line")).alias("_r"))
    hot = skew.hot_keys(rows, on, FRAME_ROWS)
    files = small.withColumn("piece", F.explode(skew.all_pieces(on, hot)))
    if hot:
        rows = rows.withColumn("piece", skew.piece(on, ["_r.row_id", "_r.own"], hot))
        on = [*on, "piece"]
    held = rows.groupBy(*on).agg(F.array_sort(F.collect_list("_r")).alias("_rs"))
    # sorted by row: a row is its last delivery
    last = F.filter("_rs", lambda r, i: (i + 1 == F.size("_rs")) | F.struct(F.get("_rs", i + 1)["row_id"], F.get("_rs", i + 1)["own"]).eqNullSafe(F.struct(r["row_id"], r["own"])).__invert__())
    lines = F.array_sort(F.transform(last, lambda r: r["line"]))
    head = F.to_json(F.struct("path", "content", F.col("records").alias("record_count"), "referenced"), {"ignoreNullFields": "false"})
    text = F.concat(F.when(F.col("piece") == 0, F.concat(head, F.lit("\n"))).otherwise(""), F.coalesce(F.concat(F.array_join(lines, "\n"), F.lit("\n")), F.lit("")))
    framed = files.join(held, on, "left").select(*small.columns, "piece", frame_udf()(text).alias("frame"))
    return cut(framed.withColumn("length", F.octet_length("frame").cast("bigint")))


def compact_delete_files(delete_files: DataFrame, eq_delete_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """The small delete files joined into outputs near their table's target.

    The members are :func:`delete_frames` of :func:`small_delete_files`; outputs are planned on the lengths of the frames.
    Rows: GROUP, out_no, files (that begin here), records (sum of their known record counts), members, bytes, crc, payload.
    """
    parts = delete_frames(small_delete_files(delete_files, tables), eq_delete_rows)
    planned = plan_outputs(parts, GROUP, "length", "target", ("file_id", "piece"))
    first = F.col("piece") == 0
    return concatenate(planned, [*GROUP, "out_no"], {"files": F.count(F.when(first, F.lit(1))), "records": F.sum(F.when(first, F.col("records")))})


def _bodies(parts: Iterator[bytes], kind: str, header_lines: int) -> Iterator[bytes]:
    """What each part adds to the joined file: its frames, or its lines without a header that was there already."""
    head = None
    for p in parts:
        if kind == "zstd":
            yield join_frames([p])
            continue
        joined = join_lines([p], header_lines)
        top = join_lines([b"\n".join(joined.split(b"\n", header_lines)[:header_lines])], 0) if header_lines else b""
        if head is None:
            head = top
            yield joined
        elif top != head:
            raise ValueError("the headers differ")
        else:
            yield joined[len(head) :]


def compact_paths(spark: SparkSession, listing: DataFrame, out_dir: str, kind: str = "zstd", header_lines: int = 0, target: int = 128 << 20) -> DataFrame:
    """Joins real files: ``listing`` has path and length, and may have crc; outputs go to a new folder in ``out_dir``, which all executors share.

    ``kind`` is zstd or lines. Empty files are left out of the outputs (they hold no records). Members are read and written one at a time;
    each must have its listed length and, where listed, its crc32. Then the output is read again, and what each member
    added must be there with its checksum. Rows: out_no, out_path, files, bytes, members (path, offset, length, crc of what it added).

    Every run has a folder of its own, and an output is written under another name and renamed: so neither a lost or repeated task nor an earlier
    run leaves a file that is read by mistake. What counts is the returned listing, which is materialised.
    """
    crc = F.col("crc").cast("bigint") if "crc" in listing.columns else F.lit(None).cast("bigint")
    sized = cut(listing.where("length > 0").select("path", "length", crc.alias("crc"), F.lit(0).alias("all"), F.lit(target).alias("target")))
    planned = plan_outputs(sized, ["all"], "length", "target", ("path",), least=1)
    folder = os.path.join(out_dir, uuid.uuid4().hex)
    os.makedirs(folder)

    def read(paths, lengths, crcs) -> Iterator[bytes]:
        for p, n, c in zip(paths, lengths, crcs):
            with open(p.removeprefix("file:"), "rb") as f:
                data = f.read()
            if len(data) != n:
                raise ValueError(f"{p}: {len(data)} bytes, listed with {n}")
            if c is not None and not pd.isna(c) and zlib.crc32(data) != c:
                raise ValueError(f"{p}: the checksum differs from the listed one")
            yield data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for no, paths, lengths, crcs in zip(b["out_no"], b["paths"], b["lengths"], b["crcs"]):
                out = os.path.join(folder, f"part-{no:06d}")
                tmp, members, at = f"{out}.{uuid.uuid4().hex}.tmp", [], 0
                with open(tmp, "wb") as f:
                    for p, body in zip(paths, _bodies(read(paths, lengths, crcs), kind, header_lines)):
                        f.write(body)
                        members.append({"path": p, "offset": at, "length": len(body), "crc": zlib.crc32(body)})
                        at += len(body)
                with open(tmp, "rb") as f:
                    for m in members:
                        if zlib.crc32(f.read(m["length"])) != m["crc"]:
                            raise ValueError(f"{m['path']}: the checksum differs in {out}")
                    if f.read(1):
                        raise ValueError(f"{out} is longer than its members")
                os.replace(tmp, out)
                yield pd.DataFrame([(no, out, len(members), at, members)], columns=["out_no", "out_path", "files", "bytes", "members"])

    grouped = planned.groupBy("out_no").agg(F.array_sort(F.collect_list(F.struct("path", "length", "crc"))).alias("m")).select("out_no", F.col("m.path").alias("paths"), F.col("m.length").alias("lengths"), F.col("m.crc").alias("crcs"))
    return cut(grouped.mapInPandas(run, "out_no int, out_path string, files bigint, bytes bigint, members array<struct<path:string,offset:bigint,length:bigint,crc:bigint>>"))
