"""Scalar codecs as column expressions: offsets, keys, media types, durations, base64url, hashes."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the offset token's format.
TOKEN_HEAD = "0000000000000000_"
TOKEN_PATTERN = "^0{16}_[0-9]{16}$"
#: The default media type.
OCTET_STREAM = "application/octet-stream"
#: 2024-10-09T00:00:00Z, from which wire cursors count intervals of 20 seconds.
CURSOR_EPOCH_MS, CURSOR_STEP_MS = 1_728_432_000_000, 20_000


def offset_token(offset: Column) -> Column:
    """The 33 characters that sort as the offset does; longer numbers are not cut."""
    digits = offset.cast("string")
    return F.concat(F.lit(TOKEN_HEAD), F.when(F.length(digits) >= 16, digits).otherwise(F.lpad(digits, 16, "0")))


def parse_offset(token: Column) -> Column:
    """struct(kind, value): start, now, offset with its number, or bad_offset."""
    number = F.when(token.rlike(TOKEN_PATTERN), F.substring(token, 18, 16).cast("long"))
    kind = F.when(token.isin("start", "now"), token).when(number.isNotNull(), "offset").otherwise("bad_offset")
    return F.struct(kind.alias("kind"), number.alias("value"))


def media_type(value: Column) -> Column:
    """Lower case, without parameters; the default for null and empty."""
    bare = F.lower(F.trim(F.substring_index(value, ";", 1)))
    return F.when(F.coalesce(bare, F.lit("")) == "", OCTET_STREAM).otherwise(bare)


def duration_ms(value: Column) -> Column:
    """Milliseconds of a number with ms, s, m or h; null if malformed."""
    unit = F.regexp_extract(value, "^[0-9]+(ms|s|m|h)$", 1)
    number = F.regexp_extract(value, "^([0-9]+)(ms|s|m|h)$", 1)
    factor = F.when(unit == "ms", 1).when(unit == "s", 1_000).when(unit == "m", 60_000).when(unit == "h", 3_600_000)
    return F.when(unit != "", F.try_to_number(number, F.lit("999999999999")).cast("long") * factor)


def base64url(value: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(value), "[=\\r\\n]", ""), "+/", "-_")


def unbase64url(value: Column) -> Column:
    """Bytes, or null unless encoding them gives value again."""
    padded = F.concat(F.translate(value, "-_", "+/"), F.substring(F.lit("==="), 1, F.pmod(-F.length(value), F.lit(4)).cast("int")))
    raw = F.when(value.rlike("^[A-Za-z0-9_-]*$") & (F.length(value) % 4 != 1), F.unbase64(padded))
    return F.when(base64url(raw) == value, raw)


def kv_key(partition: Column, key: Column) -> Column:
    """Hex of: length of the partition in two bytes, partition, key."""
    return F.lower(F.concat(F.lpad(F.hex(F.octet_length(partition).cast("long")), 4, "0"), F.hex(partition.cast("binary")), F.hex(key.cast("binary"))))


def parse_kv_key(raw: Column) -> Column:
    """struct(partition, key) of a key in hex."""
    size = F.conv(F.substring(raw, 1, 4), 16, 10).cast("int")
    text = lambda part: F.decode(F.unhex(part), "UTF-8")
    return F.struct(text(raw.substr(F.lit(5), size * 2)).alias("partition"), text(raw.substr(size * 2 + 5, F.length(raw))).alias("key"))


def u64_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value.cast("long")), 16, "0"))


def placement_key(path: Column) -> Column:
    """The path before its first component that starts with a dot."""
    return F.substring_index(path, "/.", 1)


def wire_cursor(ms: Column) -> Column:
    return F.floor((ms - CURSOR_EPOCH_MS) / CURSOR_STEP_MS)


@F.pandas_udf(LongType())
def xxh64(value: pd.Series) -> pd.Series:
    """XXH64 with seed 0 of UTF-8 text, as a signed number. Spark's own xxhash64 function is fixed to seed 42."""
    return value.map(lambda v: None if v is None else int(np.uint64(xxhash.xxh64_intdigest(v.encode())).astype(np.int64))).astype("Int64")


def unsigned_mod(signed: Column, n: int) -> Column:
    """The remainder of a 64-bit value read as unsigned."""
    return F.pmod(F.pmod(signed, F.lit(n)) + F.when(signed < 0, (1 << 64) % n).otherwise(0), F.lit(n))


def cut_order(cut: Column, size: Column, bound: Column) -> Column:
    """gt, lt, eq or unknown: how a key of size bytes that begins with cut stands to bound. Bytes order keys; cut has whole characters."""
    known = F.octet_length(cut)
    head = F.substring(bound.cast("binary"), F.lit(1), F.least(known, F.octet_length(bound)))
    whole = F.when(cut > bound, "gt").when(cut < bound, "lt").otherwise("eq")
    part = F.when(cut.cast("binary") > head, "gt").when(cut.cast("binary") < head, "lt").when(F.octet_length(bound) <= known, "gt").otherwise("unknown")
    return F.when(size == known, whole).otherwise(part)


def header_integer(header: Column) -> Column:
    """A struct of outcome (absent, ok, bad_request) and number: non-negative decimal digits without leading zeros."""
    fits = header.rlike("\\A(0|[1-9][0-9]*)\\z")
    outcome = F.when(header.isNull(), "absent").when(fits, "ok").otherwise("bad_request")
    return F.struct(outcome.alias("outcome"), F.when(fits, header.try_cast("long")).alias("number"))
