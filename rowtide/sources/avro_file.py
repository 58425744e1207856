"""Avro object container files of flat records, for clusters without an Avro reader on the class path."""

from __future__ import annotations

import datetime as dt
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

from rowtide.functions.keys import EPOCH, EPOCH_TS, _read_long, _zigzag

# Fixed value of the format.
MAGIC = b"Obj\x01"


def _bytes(b: bytes, at: int) -> tuple[bytes, int]:
    n, at = _read_long(b, at)
    return b[at : at + n], at + n


def _value(b: bytes, at: int, kind):
    if isinstance(kind, list):
        i, at = _read_long(b, at)
        return _value(b, at, kind[i])
    logical = kind.get("logicalType") if isinstance(kind, dict) else None
    name = kind["type"] if isinstance(kind, dict) else kind
    if name == "null":
        return None, at
    if name == "boolean":
        return b[at] == 1, at + 1
    if name in ("int", "long"):
        n, at = _read_long(b, at)
        if logical == "date":
            return EPOCH + dt.timedelta(days=n), at
        if logical in ("timestamp-micros", "local-timestamp-micros"):
            return EPOCH_TS + dt.timedelta(microseconds=n), at
        if logical in ("timestamp-millis", "local-timestamp-millis"):
            return EPOCH_TS + dt.timedelta(milliseconds=n), at
        return n, at
    if name == "float":
        return struct.unpack_from("<f", b, at)[0], at + 4
    if name == "double":
        return struct.unpack_from("<d", b, at)[0], at + 8
    if name in ("string", "bytes"):
        raw, at = _bytes(b, at)
        return (raw.decode() if name == "string" else raw), at
    raise ValueError(f"type {kind} is not supported")


def _header(f) -> tuple[list[dict], str, bytes]:
    """fields, codec and sync marker of an open file, which is left at its first block."""
    b, at = b"", 0

    def need(n: int) -> None:
        nonlocal b
        while len(b) - at < n:
            more = f.read(1 << 16)
            if not more:
                raise ValueError("an Avro header is cut off")
            b += more

    def number() -> int:
        nonlocal at
        k = 1
        while True:
            need(k)
            if not b[at + k - 1] & 128:
                break
            k += 1
        n, at = _read_long(b, at)
        return n

    def raw() -> bytes:
        nonlocal at
        n = number()
        need(n)
        out, at = b[at : at + n], at + n
        return out

    need(4)
    if b[:4] != MAGIC:
        raise ValueError("no Avro file")
    at, meta = 4, {}
    while n := number():
        if n < 0:
            n = -n
            number()
        for _ in range(n):
            key = raw().decode()
            meta[key] = raw()
    need(16)
    sync, at = b[at : at + 16], at + 16
    f.seek(at)
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"codec {codec} is not supported")
    return json.loads(meta["avro.schema"])["fields"], codec, sync


def _block(f) -> tuple[int, int] | None:
    """Rows and bytes of the block that begins here, None at the end; the file is left at its content."""
    at = f.tell()
    head = f.read(20)
    if not head:
        return None
    n, k = _read_long(head, 0)
    size, k = _read_long(head, k)
    f.seek(at + k)
    return n, size


def blocks(path: str) -> Iterator[tuple[int, int, int]]:
    """offset, first row and rows of each block, from the headers of the blocks only: contents are passed over."""
    with open(path, "rb") as f:
        _, _, sync = _header(f)
        row = 0
        while True:
            at = f.tell()
            if (head := _block(f)) is None:
                return
            n, size = head
            f.seek(size, os.SEEK_CUR)
            if f.read(16) != sync:
                raise ValueError(f"{path} is damaged")
            yield at, row, n
            row += n


def read(path: str, offset: int | None = None) -> Iterator[dict]:
    """The records of one file in their order, or of the one block that begins at ``offset``; one block is held at a time."""
    with open(path, "rb") as f:
        fields, codec, sync = _header(f)
        if offset is not None:
            f.seek(offset)
        while (head := _block(f)) is not None:
            n, size = head
            block = f.read(size)
            if len(block) != size or f.read(16) != sync:
                raise ValueError(f"{path} is damaged")
            block = zlib.decompress(block, -15) if codec == "deflate" else block
            p = 0
            for _ in range(n):
                row = {}
                for x in fields:
                    row[x["name"]], p = _value(block, p, x["type"])
                yield row
            if offset is not None:
                return


_PLAIN = {"long": _zigzag, "int": _zigzag, "string": lambda v: _zigzag(len(v.encode())) + v.encode(), "bytes": lambda v: _zigzag(len(v)) + v, "boolean": lambda v: b"\1" if v else b"\0", "double": lambda v: struct.pack("<d", v)}


def write(path: str, fields: list[tuple[str, str]], rows: Iterable[tuple], codec: str = "deflate", block_rows: int = 10_000) -> None:
    """Rows of optional fields; ``fields`` are names and primitive Avro types."""
    schema = {"type": "record", "name": "row", "fields": [{"name": n, "type": ["null", t]} for n, t in fields]}
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    sync = os.urandom(16)
    rows = list(rows)
    with open(path, "wb") as f:
        f.write(MAGIC + _zigzag(len(meta)))
        for k, v in meta.items():
            f.write(_zigzag(len(k)) + k.encode() + _zigzag(len(v)) + v)
        f.write(b"\0" + sync)
        for i in range(0, len(rows), block_rows):
            part = rows[i : i + block_rows]
            block = b"".join(b"\0" if v is None else b"\2" + _PLAIN[t](v) for r in part for v, (_, t) in zip(r, fields))
            if codec == "deflate":
                c = zlib.compressobj(wbits=-15)
                block = c.compress(block) + c.flush()
            f.write(_zigzag(len(part)) + _zigzag(len(block)) + block + sync)
