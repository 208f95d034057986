"""Helpers shared by the operators of this subpackage: tables, shared storage and vectorised text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import discard, materialise, shared_dir  # noqa: F401  (for the other modules here)

#: Rows and bytes of one Arrow batch. Texts may be very long, so that batches hold few of them.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Rows up to which a checked, two or three column table is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a worker never holds thousands of long texts at once."""
    # One value for the whole subpackage, so that it doesn't matter which operator set it last before a lazy plan runs.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if it has at most so many rows; it should be a materialised, narrow table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores put before it until no column (in any case) has it."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


# --- vectorised words -------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Words over so many bytes are hashed one by one.
_LONG = 256
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(words: str) -> np.ndarray:
    """Which bytes belong to words: 'ascii_alnum' takes [0-9a-z] and every byte over 0x7F, 'space' all but [\\x20\\t-\\r]."""
    member = np.ones(256, dtype=bool)
    if words == "space":
        member[[0x20, *range(0x09, 0x0E)]] = False
    else:
        member[:0x80] = False
        member[0x30:0x3A] = member[0x61:0x7B] = True
    return member


class Words:
    """The words of a batch of texts, A-Z lowered: 64-bit hashes, and the document of each.

    Null texts have no words. Words never cross texts.
    """

    def __init__(self, texts: list[str | None], kind: str):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = buffer = _LOWER[np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        stops = np.cumsum(lengths + 1) - 1
        inside = byte_table(kind)[buffer]
        inside[stops] = False
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = span_hashes(buffer, self.starts, self.ends)
        self.doc = np.searchsorted(stops, self.starts)
        #: The words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.doc, np.arange(len(raw) + 1))

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buffer[start:end]; equal bytes have equal hashes wherever they lie. No span is empty.

    Eight bytes at a time go through a chain of scrambles, so that hashes of words of up to eight bytes and one length are all
    different, and no structure of longer ones makes hashes equal. Spans over _LONG bytes are hashed by xxhash.
    """
    lengths = ends - starts
    padded = np.append(buffer, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(buffer),), "<u8", buffer=padded.data, strides=(1,))
    out = mix(lengths.astype(np.uint64) * _ODD)
    open_spans, at = np.flatnonzero(lengths <= _LONG), 0
    while len(open_spans):
        lane = lanes[starts[open_spans] + at] & _MASKS[np.minimum(8, lengths[open_spans] - at)]
        out[open_spans] = mix((out[open_spans] ^ lane) * _ODD + _M1)
        at += 8
        open_spans = open_spans[lengths[open_spans] > at]
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]].tobytes())
    return out


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values (len - k + 1 of them); order matters."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n] + np.uint64(k)
    for j in range(1, k):
        total = mix(total * _ODD + hashes[j : j + n])
    return mix(total)


def frames(batches: Iterator, bytes_each: int = 4 << 20, text: str = "text") -> Iterator:
    """Batches cut or kept so that one holds about bytes_each of text at most (a single longer text stays whole)."""
    for batch in batches:
        sizes = batch[text].map(lambda t: 0 if t is None else len(t)).to_numpy()
        part = (np.cumsum(sizes) - sizes) // bytes_each if len(sizes) else sizes
        for p in np.unique(part):
            yield batch[part == p].reset_index(drop=True)


def shards(batches: Iterator, bytes_each: int = 2 << 20, text: str = "text") -> Iterator:
    """Batches put together, or cut, so that each holds about bytes_each of text (a single longer text stays whole)."""
    held, size = [], 0
    for part in frames(batches, bytes_each, text):
        held.append(part)
        size += int(part[text].map(lambda t: 0 if t is None else len(t)).sum())
        if size >= bytes_each:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
