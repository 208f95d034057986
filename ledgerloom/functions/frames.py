"""Codecs of framed updates and awareness records, as Arrow-batched functions: the byte layouts have no built-in expression."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

#: The largest length that a frame may state.
LARGEST = (1 << 53) - 1


def write_varuint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varuint(data: bytes, at: int) -> tuple[int | None, int | str]:
    """The number and the place after it, or None and what is wrong."""
    value = shift = 0
    while at < len(data):
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return (value, at) if value <= LARGEST else (None, "invalid")
        shift += 7
        if shift > 56:
            return None, "invalid"
    return None, "truncated"


def split_frames(data: bytes) -> list[tuple[bytes | None, str | None]]:
    """(frame, None) for each frame; the last may be (None, error)."""
    out, at = [], 0
    while at < len(data):
        n, after = read_varuint(data, at)
        if n is None:
            return [*out, (None, after)]
        if after + n > len(data):
            return [*out, (None, "truncated")]
        out.append((data[after : after + n], None))
        at = after + n
    return out


def read_awareness(data: bytes) -> list[tuple[int | None, int | None, str | None, str | None]]:
    """(client, clock, state, None) for each client of a record, or one row with an error; nothing may follow the last."""
    count, at = read_varuint(data, 0)
    bad = [(None, None, None, "invalid")]
    if count is None:
        return bad
    out = []
    for _ in range(count):
        values = []
        for _ in range(3):
            n, at = read_varuint(data, at) if isinstance(at, int) else (None, at)
            if n is None:
                return bad
            values.append(n)
        if at + values[2] > len(data):
            return bad
        out.append((values[0], values[1], data[at : at + values[2]].decode("utf-8", "replace"), None))
        at += values[2]
    return out if at == len(data) else bad


@F.pandas_udf(BinaryType())
def frame(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else write_varuint(len(d)) + bytes(d))


@F.pandas_udf(ArrayType(StructType([StructField("data", BinaryType()), StructField("error", StringType())])))
def parse_frames(data: pd.Series) -> pd.Series:
    return data.map(lambda d: [] if d is None else [{"data": f, "error": e} for f, e in split_frames(bytes(d))])


@F.pandas_udf(BinaryType())
def encode_awareness(client: pd.Series, clock: pd.Series, state: pd.Series) -> pd.Series:
    def one(c: int, k: int, s: str) -> bytes:
        raw = s.encode()
        return b"\x01" + write_varuint(int(c)) + write_varuint(int(k)) + write_varuint(len(raw)) + raw

    return pd.Series([one(*row) for row in zip(client, clock, state, strict=True)])


@F.pandas_udf(ArrayType(StructType([StructField("client_id", LongType()), StructField("clock", LongType()), StructField("state", StringType()), StructField("error", StringType())])))
def decode_awareness(data: pd.Series) -> pd.Series:
    names = ("client_id", "clock", "state", "error")
    return data.map(lambda d: [] if d is None else [dict(zip(names, row, strict=True)) for row in read_awareness(bytes(d))])
