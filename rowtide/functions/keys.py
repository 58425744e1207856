"""Key codecs: hex text, Avro binary of key structs, bucket numbers, identifiers.

Keys inside the engine are hex of the Avro binary of their struct: a
required field is its value, an optional one a union with null first, so null
keys are equal to each other and to nothing else. The encoder is a JVM expression;
types without one there, and decoding, go through Arrow.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
import struct as pack
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = dt.date(1970, 1, 1)
EPOCH_TS = dt.datetime(1970, 1, 1)


def to_hex(b: Column | str) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column | str) -> Column:
    """Strict inverse of :func:`to_hex`: an odd length or a foreign character is an error; null stays null."""
    c = F.col(s) if isinstance(s, str) else s
    bad = (F.length(c) % 2 != 0) | ~c.rlike("^[0-9a-fA-F]*$")
    return F.when(bad, F.raise_error(F.concat(F.lit("not hex: "), c)).cast("binary")).otherwise(F.unhex(c))


# SQL text, since an expression of a few hundred nodes is one call to the JVM that way and a few hundred otherwise


def _byte(n: str) -> str:
    return f"lpad(lower(hex({n})), 2, '0')"


def _varint(z: str) -> str:
    """Hex of an unsigned 64-bit number in groups of seven bits, lowest first."""
    parts = []
    for i in range(10):
        rest = f"shiftrightunsigned({z}, {7 * i})"
        more = f"shiftrightunsigned({z}, {7 * (i + 1)})" if i < 9 else "0L"
        byte = _byte(f"({rest} & 127) + if({more} <> 0, 128, 0)")
        parts.append(byte if i == 0 else f"if({rest} <> 0, {byte}, '')")
    return f"concat({', '.join(parts)})"


def _long(c: str) -> str:
    return _varint(f"(shiftleft(cast({c} as bigint), 1) ^ shiftright(cast({c} as bigint), 63))")


def _value(c: str, kind: T.DataType) -> str | None:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _long(c)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"concat({_long(f'octet_length({c})')}, lower(hex(cast({c} as binary))))"
    if isinstance(kind, T.BooleanType):
        return f"if({c}, '01', '00')"
    if isinstance(kind, T.DateType):
        return _long(f"unix_date({c})")
    if isinstance(kind, T.TimestampType):
        return _long(f"unix_micros({c})")
    if isinstance(kind, T.TimestampNTZType):
        return _long(f"unix_micros(from_utc_timestamp(cast(cast({c} as string) as timestamp), 'UTC'))")
    return None


ALLOWED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.FloatType, T.DoubleType)


def check_key(schema: T.StructType) -> T.StructType:
    """Key columns must be primitive; interval, map, array and struct keys are refused."""
    for f in schema.fields:
        if not isinstance(f.dataType, ALLOWED):
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} cannot be part of a key")
    return schema


def key_hex(schema: T.StructType) -> Column:
    """Hex of the Avro binary of the columns of ``schema``, in its order; ``''`` for an empty schema."""
    check_key(schema)
    if not schema.fields:
        return F.lit("")
    parts = []
    for f in schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        v = _value(name, f.dataType)
        if v is None:
            return encode_udf(schema)(F.struct(*[F.col(x.name) for x in schema.fields]))
        parts.append(f"if({name} is null, '00', concat('02', {v}))" if f.nullable else v)
    return F.expr(f"concat({', '.join(parts)})")


# -- the codec in Python: for types without an expression, for decoding, and for tests


def _zigzag(n: int) -> bytes:
    z, out = (n << 1) ^ (n >> 63), bytearray()
    z &= (1 << 64) - 1
    while z > 127:
        out.append(z & 127 | 128)
        z >>= 7
    out.append(z)
    return bytes(out)


def _read_long(b: bytes, at: int) -> tuple[int, int]:
    z = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("a number is cut off")
        z |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if not b[at - 1] & 128:
            return (z >> 1) ^ -(z & 1), at


def _encode(v, kind: T.DataType) -> bytes:
    if isinstance(kind, T.BooleanType):
        return b"\1" if v else b"\0"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _zigzag(int(v))
    if isinstance(kind, T.DateType):
        return _zigzag((v - EPOCH).days)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        d = v.replace(tzinfo=None) - EPOCH_TS
        return _zigzag((d.days * 86400 + d.seconds) * 10**6 + d.microseconds)
    if isinstance(kind, T.FloatType):
        return pack.pack("<f", v)
    if isinstance(kind, T.DoubleType):
        return pack.pack("<d", v)
    if isinstance(kind, T.DecimalType):
        n = int(decimal.Decimal(v).scaleb(kind.scale))
        return n.to_bytes(_decimal_bytes(kind.precision), "big", signed=True)
    raw = v.encode() if isinstance(v, str) else bytes(v)
    return _zigzag(len(raw)) + raw


def _decimal_bytes(precision: int) -> int:
    """The fewest bytes that hold every number of so many digits."""
    n = 1
    while 2 ** (8 * n - 1) <= 10**precision - 1:
        n += 1
    return n


def _decode(b: bytes, at: int, kind: T.DataType):
    if isinstance(kind, T.BooleanType):
        return b[at] == 1, at + 1
    if isinstance(kind, T.FloatType):
        return pack.unpack_from("<f", b, at)[0], at + 4
    if isinstance(kind, T.DoubleType):
        return pack.unpack_from("<d", b, at)[0], at + 8
    if isinstance(kind, T.DecimalType):
        n = _decimal_bytes(kind.precision)
        return decimal.Decimal(int.from_bytes(b[at : at + n], "big", signed=True)).scaleb(-kind.scale), at + n
    n, at = _read_long(b, at)
    if isinstance(kind, T.DateType):
        return EPOCH + dt.timedelta(days=n), at
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return EPOCH_TS + dt.timedelta(microseconds=n), at
    if isinstance(kind, (T.StringType, T.BinaryType)):
        if n < 0 or at + n > len(b):
            raise ValueError("a value is cut off")
        raw = b[at : at + n]
        return (raw.decode() if isinstance(kind, T.StringType) else raw), at + n
    return n, at


def encode_row(values, schema: T.StructType) -> bytes:
    out = b""
    for v, f in zip(values, schema.fields):
        if f.nullable:
            out += b"\0" if v is None else b"\2" + _encode(v, f.dataType)
        elif v is None:
            raise ValueError(f"{f.name} is required")
        else:
            out += _encode(v, f.dataType)
    return out


def decode_row(raw: bytes, schema: T.StructType) -> tuple:
    at, out = 0, []
    for f in schema.fields:
        if f.nullable:
            branch, at = _read_long(raw, at)
            if branch == 0:
                out.append(None)
                continue
        v, at = _decode(raw, at, f.dataType)
        out.append(v)
    if at != len(raw):
        raise ValueError("bytes are left over")
    return tuple(out)


def encode_udf(schema: T.StructType):
    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        clean = [[None if pd.isna(v) else v for v in r] for r in rows.itertuples(index=False, name=None)]
        return pd.Series([encode_row(r, schema).hex() for r in clean], dtype=object)

    return run


def decode_udf(schema: T.StructType):
    """Hex text back to the key struct; malformed text fails the query, null gives null fields."""

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = (None,) * len(schema.fields)
        for s in batches:
            yield pd.DataFrame([none if h is None else decode_row(bytes.fromhex(h), schema) for h in s], columns=schema.names)

    return run


def bucket(pk: Column | str, buckets: int) -> Column:
    """The bucket of a key: the hash that bucketed tables use, so both sides agree."""
    return F.pmod(F.hash(pk), F.lit(buckets))


# -- names and settings


def comma_list(text: str | None) -> list[str]:
    """Names separated by commas, trimmed, blanks skipped, order kept."""
    return [x for x in (p.strip() for p in (text or "").split(",")) if x]


def comma_array(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def identifier(c: Column | str) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def identifier_text(name: str) -> str:
    return re.sub("[^a-zA-Z0-9_]", "_", name)


def setting_name(variable: str, prefix: str) -> str:
    """An environment variable's setting: prefix off, lower case, underscores are dots."""
    return variable.removeprefix(prefix).lower().replace("_", ".")
