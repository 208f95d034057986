"""Byte-preserving JSON splitting, rendering of bytes, and JSON pages, as Arrow-batched functions; no built-in keeps the bytes."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: Bytes shown in hexadecimal at most, as the inspection pages do.
HEX_BYTES = 32


def split_array(text: str) -> tuple[list[str], str | None]:
    """Elements of a JSON array with their own bytes (outer white space gone), or one element for any other value, and an error."""
    try:
        value = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return [], "invalid_json"
    if not isinstance(value, list):
        return [text.strip(" \t\r\n")], None
    if not value:
        return [], "empty_array"
    inner, parts, depth, quoted, start, at = text.strip(" \t\r\n")[1:-1], [], 0, False, 0, 0
    while at < len(inner):
        c = inner[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(inner[start:at])
            start = at + 1
        at += 1
    return [p.strip(" \t\r\n") for p in [*parts, inner[start:]]], None


def render(raw: bytes) -> str:
    """Valid UTF-8 in quotes with escapes; other bytes as their printable ASCII start and the rest in hexadecimal."""
    try:
        return json.dumps(raw.decode("utf-8"), ensure_ascii=False)
    except UnicodeDecodeError:
        n = next((i for i, b in enumerate(raw) if not 32 <= b < 127), len(raw))
        rest = raw[n : n + HEX_BYTES].hex() + ("..." if len(raw) - n > HEX_BYTES else "")
        return f"{json.dumps(raw[:n].decode())} {rest}" if n else rest


def whole_characters(raw: bytes) -> bytes:
    """raw without the parts of UTF-8 characters that a byte range has cut at its ends."""
    at = 0
    while at < min(3, len(raw)) and raw[at] & 0xC0 == 0x80:
        at += 1
    raw = raw[at:]
    for cut in range(1, min(3, len(raw)) + 1):
        lead = raw[-cut]
        if lead & 0xC0 == 0xC0:
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return raw[:-cut] if need > cut else raw
        if lead & 0xC0 != 0x80:
            break
    return raw


def page_value(value: object) -> object:
    """A value as pages show it: printable text as it is, other bytes tagged, keys that start with $ doubled."""
    if isinstance(value, bytes):
        try:
            text = value.decode("utf-8")
            return text if text.isprintable() else {"$bytes": value.hex()}
        except UnicodeDecodeError:
            return {"$bytes": value.hex()}
    if isinstance(value, dict):
        return {("$" + k if k.startswith("$") else k): page_value(v) for k, v in value.items()}
    return [page_value(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StructType([StructField("items", ArrayType(StringType())), StructField("error", StringType())]))
def json_items(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([([], "invalid_json") if t is None else split_array(t) for t in text], columns=["items", "error"])


@F.pandas_udf(StringType())
def render_bytes(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else render(bytes(r)))


@F.pandas_udf(BinaryType())
def trim_partial(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else whole_characters(bytes(r)))


@F.pandas_udf(StringType())
def json_row(key: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([json.dumps({"key": page_value(bytes(k)), "value": page_value(bytes(v))}, separators=(",", ":"), ensure_ascii=False) for k, v in zip(key, value, strict=True)])
