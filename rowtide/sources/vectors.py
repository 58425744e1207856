"""Deletion vectors: 64-bit portable roaring bitmaps in puffin files, written from the public format descriptions."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np

# Fixed values of the formats.
VECTOR_MAGIC = bytes((0xD1, 0xD3, 0x39, 0x64))
PUFFIN_MAGIC = b"PFA1"
BLOB_TYPE = "deletion-vector-v1"
NO_RUNS, WITH_RUNS = 12346, 12347
ARRAY_MOST = 4096
ALWAYS_OFFSETS = 4


def _write32(low: np.ndarray) -> bytes:
    """Sorted unique uint32 values as a portable 32-bit bitmap of array and bitset containers."""
    high = (low >> 16).astype(np.uint16)
    keys, starts = np.unique(high, return_index=True)
    ends = np.append(starts[1:], len(low))
    descriptions, bodies = [], []
    for k, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist()):
        part = (low[a:b] & 0xFFFF).astype("<u2")
        descriptions.append(struct.pack("<HH", k, b - a - 1))
        if b - a <= ARRAY_MOST:
            bodies.append(part.tobytes())
        else:
            bits = np.zeros(1 << 16, dtype=np.uint8)
            bits[part] = 1
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
    head = struct.pack("<II", NO_RUNS, len(keys)) + b"".join(descriptions)
    at, offsets = len(head) + 4 * len(keys), []
    for body in bodies:
        offsets.append(struct.pack("<I", at))
        at += len(body)
    return head + b"".join(offsets) + b"".join(bodies)


def _read32(b: bytes, at: int) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", b, at)
    at += 4
    if cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        flags = np.unpackbits(np.frombuffer(b, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
    elif cookie == NO_RUNS:
        (n,) = struct.unpack_from("<I", b, at)
        flags = np.zeros(n, dtype=np.uint8)
        at += 4
    else:
        raise ValueError("not a roaring bitmap")
    described = np.frombuffer(b, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if cookie == NO_RUNS or n >= ALWAYS_OFFSETS:
        at += 4 * n
    parts = []
    for (key, less_one), run in zip(described.tolist(), flags.tolist()):
        if run:
            (k,) = struct.unpack_from("<H", b, at)
            pairs = np.frombuffer(b, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            values = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs]) if k else np.empty(0, np.int64)
            at += 2 + 4 * k
        elif less_one + 1 <= ARRAY_MOST:
            values = np.frombuffer(b, "<u2", less_one + 1, at).astype(np.int64)
            at += 2 * (less_one + 1)
        else:
            values = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        parts.append(values + (key << 16))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), at


def write_bitmap(positions: np.ndarray) -> bytes:
    """The 64-bit portable form: a 32-bit bitmap for each upper half."""
    p = np.unique(np.asarray(positions, dtype=np.int64))
    if len(p) and p[0] < 0:
        raise ValueError("positions are not negative")
    high = p >> 32
    keys, starts = np.unique(high, return_index=True)
    ends = np.append(starts[1:], len(p))
    out = [struct.pack("<Q", len(keys))]
    for k, a, b in zip(keys.tolist(), starts.tolist(), ends.tolist()):
        out += [struct.pack("<I", k), _write32((p[a:b] & 0xFFFFFFFF).astype(np.uint32))]
    return b"".join(out)


def read_bitmap(b: bytes, at: int = 0) -> np.ndarray:
    (n,) = struct.unpack_from("<Q", b, at)
    at += 8
    parts = []
    for _ in range(n):
        (key,) = struct.unpack_from("<I", b, at)
        low, at = _read32(b, at + 4)
        parts.append(low + (key << 32))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def write_vector(positions: np.ndarray) -> bytes:
    """The blob: length of magic and bitmap, both, and their checksum; lengths and checksum big-endian."""
    body = VECTOR_MAGIC + write_bitmap(positions)
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def read_vector(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from(">I", blob)
    body = blob[4 : 4 + n]
    if len(blob) != n + 8 or body[:4] != VECTOR_MAGIC:
        raise ValueError("not a deletion vector")
    if struct.unpack_from(">I", blob, 4 + n)[0] != zlib.crc32(body):
        raise ValueError("the checksum of a deletion vector is wrong")
    return read_bitmap(body, 4)


def write_puffin(vectors: dict[str, np.ndarray], field_ids: tuple[int, ...] = (2147483645,)) -> tuple[bytes, dict[str, tuple[int, int, int]]]:
    """A puffin file of one vector for each data file; and (offset, size, cardinality) of each."""
    out, blobs, places = bytearray(PUFFIN_MAGIC), [], {}
    for path, positions in vectors.items():
        blob = write_vector(positions)
        n = len(np.unique(positions))
        places[path] = len(out), len(blob), n
        blobs.append({"type": BLOB_TYPE, "fields": list(field_ids), "snapshot-id": -1, "sequence-number": -1, "offset": len(out), "length": len(blob), "properties": {"referenced-data-file": path, "cardinality": str(n)}})
        out += blob
    payload = json.dumps({"blobs": blobs}).encode()
    out += PUFFIN_MAGIC + payload + struct.pack("<i", len(payload)) + bytes(4) + PUFFIN_MAGIC
    return bytes(out), places


def puffin_blobs(data: bytes) -> list[dict]:
    """The blobs a puffin file declares in its footer."""
    if len(data) < 16 or data[:4] != PUFFIN_MAGIC or data[-4:] != PUFFIN_MAGIC:
        raise ValueError("not a puffin file")
    (n,) = struct.unpack_from("<i", data, len(data) - 12)
    if data[-8:-4] != bytes(4):
        raise ValueError("compressed footers are not supported")
    start = len(data) - 12 - n
    if start < 8 or data[start - 4 : start] != PUFFIN_MAGIC:
        raise ValueError("the footer of a puffin file is damaged")
    return json.loads(data[start : start + n])["blobs"]
