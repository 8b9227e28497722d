"""Scalar functions, as column expressions where Spark's own can say them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW32 = 0xFFFFFFFF
#: Fixed values of the 64-bit FNV hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 1099511628211
_BASIS = FNV_BASIS - (1 << 64)
_RECORD = T.StructType().add("key", T.BinaryType()).add("value", T.BinaryType()).add("type", T.IntegerType())
UPPER_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _fnv_step(x: Column) -> Column:
    """x times the FNV prime, modulo 2**64: the prime is 2**40 + 435, and halves of 32 bits keep the products small."""
    low, high = x.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(x, 32)
    p = low * 435
    top = (high * 435 + F.shiftrightunsigned(p, 32) + low * 256).bitwiseAND(F.lit(LOW32))
    return F.shiftleft(top, 32).bitwiseOR(p.bitwiseAND(F.lit(LOW32)))


def fnv64(value: Column) -> Column:
    """The absolute value of the FNV hash of a 64-bit integer's octets, least first; no Python, no overflow."""
    octets = F.transform(F.array(*[F.lit(8 * i) for i in range(8)]), lambda s: F.call_function("shiftright", value.cast("long"), s).bitwiseAND(F.lit(255).cast("long")))
    h = F.aggregate(octets, F.lit(_BASIS).cast("long"), lambda a, o: _fnv_step(a.bitwiseXOR(o)))
    return F.when(h == F.lit(-(2**63)), h).otherwise(F.abs(h))


def key_name(number: Column, padding: int = 1, ordered: bool = False, prefix: str = "user") -> Column:
    """prefix and the number, or its hash unless `ordered`, with zeros before it up to `padding` digits; longer ones stay."""
    s = (number if ordered else fnv64(number)).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < padding, F.lpad(s, padding, "0")).otherwise(s))


def java_hash(text: Column) -> Column:
    """The 32-bit hash of a string's UTF-16 units, times 31 and added up."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda a, u: (a * 31 + u).bitwiseAND(F.lit(LOW32))
    above = lambda u: u - 0x10000
    both = lambda a, u: F.when(u < 0x10000, step(a, u)).otherwise(
        step(step(a, F.lit(0xD800) + F.shiftright(above(u), 10)), F.lit(0xDC00) + above(u).bitwiseAND(F.lit(1023)))
    )
    h = F.aggregate(units, F.lit(0).cast("long"), both)
    return F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int")


def series_check(tags: Column, ts: Column) -> Column:
    """What a generated point must hold: the hash of its tags' names and values in order of name, XOR its time."""
    pairs = F.array_sort(F.map_entries(tags))
    joined = F.array_join(F.transform(pairs, lambda e: F.concat(e.key, e.value)), "")
    return java_hash(joined).cast("long").bitwiseXOR(ts.cast("long"))


def _hash_of(s: str) -> int:
    h = 0
    for b in struct.unpack(f">{len(s.encode('utf-16-be')) // 2}H", s.encode("utf-16-be")):
        h = (h * 31 + b) & LOW32
    return h - (1 << 32) if h >> 31 else h


@F.pandas_udf(T.StringType())
def field_value(key: pd.Series, name: pd.Series, size: pd.Series) -> pd.Series:
    """The value that a field of a generated row must hold: key:name, then hashes of all so far, cut to size."""

    def one(k: str, f: str, n: int) -> str:
        out = f"{k}:{f}"
        while len(out) < n:
            out += f":{_hash_of(out)}"
        return out[:n]

    return pd.Series([one(*x) for x in zip(key, name, size, strict=True)])


def printable(number: Column, length: int, letters: str = UPPER_LOWER) -> Column:
    """The number-th string of `length` letters, as an odometer whose last letter turns fastest."""
    n = len(letters)
    digit = lambda i: F.substring(F.lit(letters), (F.floor(number / F.lit(float(n) ** i)) % n + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(length))])


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 10, 4KB, 1MB, 2GB or 1TB."""
    number = F.regexp_extract(text, r"^\s*(\d+)", 1).cast("long")
    unit = F.upper(F.regexp_extract(text, r"([KMGTkmgt]?)[Bb]?\s*$", 1))
    return number * F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a string key: the absolute value of its Java hash, modulo their number."""
    return F.abs(java_hash(key).cast("long")) % shards


def long_to_bytes(value: Column) -> Column:
    """8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def bytes_to_long(value: Column) -> Column:
    """The first 8 bytes as a signed integer."""
    part = lambda i: F.conv(F.hex(F.substring(value, i, 4)), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(5))


@F.pandas_udf(T.BinaryType())
def double_to_bytes(value: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else struct.pack(">d", v) for v in value])


@F.pandas_udf(T.DoubleType())
def bytes_to_double(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else struct.unpack(">d", bytes(v[:8]))[0] for v in value])


def _take(buffer: bytes, at: int, order: str) -> tuple[bytes, int]:
    (n,) = struct.unpack_from(order + "i", buffer, at)
    if n < 0 or at + 4 + n > len(buffer):
        raise ValueError("a row is cut short")
    return buffer[at + 4 : at + 4 + n], at + 4 + n


@F.pandas_udf(T.BinaryType())
def encode_row(fields: pd.Series) -> pd.Series:
    """A map of fields as bytes: for each, length and name, length and value; lengths of 4 bytes, most significant first."""
    part = lambda s: struct.pack(">i", len(b := s.encode() if isinstance(s, str) else bytes(s))) + b
    return pd.Series([None if f is None else b"".join(part(k) + part(v) for k, v in (f.items() if isinstance(f, dict) else f)) for f in fields])


@F.pandas_udf(T.MapType(T.StringType(), T.BinaryType()))
def decode_row(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> dict | None:
        if b is None:
            return None
        out, at = {}, 0
        while at < len(b):
            name, at = _take(b, at, ">")
            out[name.decode()], at = _take(b, at, ">")
        return out

    return pd.Series([one(b) for b in data])


@F.pandas_udf(T.BinaryType())
def encode_entry(key: pd.Series, value: pd.Series, op: pd.Series) -> pd.Series:
    """A replayed log's entry: length and key, length and value (4 bytes, least significant first), one byte of operation."""
    part = lambda b: struct.pack("<I", len(b)) + bytes(b)
    return pd.Series([part(k) + part(v) + bytes([o]) for k, v, o in zip(key, value, op, strict=True)])


@F.pandas_udf(T.StructType().add("key", T.BinaryType()).add("value", T.BinaryType()).add("op", T.IntegerType()))
def decode_entry(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in data:
        out = []
        for b in s:
            key, at = _take(bytes(b), 0, "<")
            value, at = _take(bytes(b), at, "<")
            out.append((key, value, b[at]))
        yield pd.DataFrame(out, columns=["key", "value", "op"])


def _varint(buffer: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(buffer) or shift > 28:
            raise ValueError("a length is cut short")
        out |= (buffer[at] & 127) << shift
        shift += 7
        at += 1
        if not buffer[at - 1] & 128:
            return out, at


def _varint_bytes(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(b: bytes) -> tuple[bytes, bytes | None, int]:
    """key = field 1 (required), value = field 2, type = field 3 of a record's message."""
    got: dict[int, object] = {}
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 0:
            got[tag >> 3], at = _varint(b, at)
        elif tag & 7 == 2:
            n, at = _varint(b, at)
            if at + n > len(b):
                raise ValueError("a field is cut short")
            got[tag >> 3] = b[at : at + n]
            at += n
        else:
            raise ValueError("an unknown wire type")
    if 1 not in got:
        raise ValueError("a record without a key")
    return got[1], got.get(2), int(got.get(3, 1))


@F.pandas_udf(T.StructType().add("ok", T.BooleanType()).add("records", T.ArrayType(_RECORD)))
def decode_messages(data: pd.Series) -> pd.DataFrame:
    """The records of a buffer of messages, each after its length; a buffer that is corrupt anywhere gives none and ok = false."""

    def one(b: bytes) -> tuple[bool, list]:
        out, at = [], 0
        try:
            while at < len(b):
                n, at = _varint(b, at)
                if at + n > len(b):
                    return False, []
                out.append(dict(zip(("key", "value", "type"), _message(b[at : at + n]), strict=True)))
                at += n
        except ValueError:
            return False, []
        return True, out

    return pd.DataFrame([(False, []) if b is None else one(bytes(b)) for b in data], columns=["ok", "records"])


@F.pandas_udf(T.BinaryType())
def encode_message(key: pd.Series, value: pd.Series, type_: pd.Series) -> pd.Series:
    """A record's message after its length."""

    def one(k: bytes, v: bytes | None, t: int) -> bytes:
        body = b"\x0a" + _varint_bytes(len(k)) + bytes(k)
        body += b"" if v is None else b"\x12" + _varint_bytes(len(v)) + bytes(v)
        body += b"\x18" + _varint_bytes(int(t))
        return _varint_bytes(len(body)) + body

    return pd.Series([one(*x) for x in zip(key, value, type_, strict=True)])


@F.pandas_udf(T.BinaryType())
def separator(low: pd.Series, high: pd.Series) -> pd.Series:
    """A short string from low on and below high, for an index between two blocks; low itself if none is shorter."""

    def one(a: bytes, b: bytes) -> bytes:
        a, b = bytes(a), bytes(b)
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        if i < min(len(a), len(b)) and a[i] < 255 and a[i] + 1 < b[i]:
            return a[:i] + bytes([a[i] + 1])
        return a

    return pd.Series([one(*x) for x in zip(low, high, strict=True)])


@F.pandas_udf(T.BinaryType())
def successor(key: pd.Series) -> pd.Series:
    """A short string from key on: up to the first byte that can grow, grown by one."""

    def one(b: bytes) -> bytes:
        b = bytes(b)
        i = next((i for i, x in enumerate(b) if x < 255), None)
        return b if i is None else b[:i] + bytes([b[i] + 1])

    return pd.Series([one(b) for b in key])


def duration(seconds: Column) -> Column:
    """Seconds in words: days and hours, or hours and minutes below a day, or seconds below a minute; a space ends it.

    The unit of seconds is singular for numbers of one digit, whatever the digit.
    """
    days, hours, minutes = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    part = lambda n, unit: F.when(n == 1, f"1 {unit} ").when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}s "))).otherwise("")
    long = F.concat(part(days, "day"), part(hours, "hour"), F.when(days < 1, part(minutes, "minute")).otherwise(""))
    short = F.concat(seconds.cast("string"), F.when(F.length(seconds.cast("string")) == 1, " second ").otherwise(" seconds "))
    return F.when(long == "", short).otherwise(long)
