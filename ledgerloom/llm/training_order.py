"""Training-order materialisation: every sequence gets a global slot by a keyed permutation, and lies there in a shard file.

A Feistel network over an even number of bits, walked along its cycle until it falls below the number of sequences, is a
permutation of all sequence numbers that needs no table. Range partitions of slots become shards of a fixed number of sequences;
each sequence takes the same number of bytes, so slot s is read at a known place and a reader resumes anywhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix, shared_dir, small_batches
from .packing import END
from .tokens import worker_encoder

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def feistel(values: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. total - 1, keyed by key, applied to values (all below total)."""
    half = np.uint64(max(1, (max(1, total - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * _GOLD + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << half) | right

    out = once(values.astype(np.uint64))
    while (outside := out >= np.uint64(total)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int, vocabulary: str | None) -> DataFrame:
    """doc_id, the task that read it, the number of sequences before it in that task, its number of ids, and ids (unsigned, of the encoder's width).

    A task's output is committed whole, so its numbers stay right when it is run again on another executor.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, before = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode([t or "" for t in batch["text"]]), strict=True):
                rows.append((doc_id, task, before, len(ids) + 1, np.append(ids, END).astype(encoder.dtype).tobytes()))
                before += -(-(len(ids) + 1) // length)
            yield pd.DataFrame(rows, columns=["doc_id", "task", "before", "n_ids", "ids"])

    return docs.select("doc_id", "text").mapInPandas(encode, f"doc_id {id_type}, task int, before long, n_ids long, ids binary")


def materialise_order(docs: DataFrame, path: str, length: int = 2048, shard_sequences: int = 256, key: int = 20_240_501, pad: int = 50256, vocabulary: str | None = None) -> DataFrame:
    """Write shards of docs (doc_id, text) under path and return where each sequence lies.

    A document's ids and the end id are cut into sequences of length ids, the last padded; null text is the end id alone. Result:
    doc_id, seq (from 0), n_ids (without padding), slot, shard, byte_offset in the shard, ids_crc32 (as unsigned 32-bit ids, without
    padding). Repeated rows and null identifiers get sequences of their own. An empty table writes no shard and returns no row.
    The Parquet table at path has one row for each shard: shard, first_slot, n_sequences, payload (fixed stride; unsigned
    16-bit ids, or 32-bit ones for a vocabulary of over 65,536). Parquet compresses a payload as a whole, so a shard is what is read at once.
    """
    spark = docs.sparkSession
    encoded = materialise(token_sequences(docs, length, vocabulary), "order-tokens")
    totals = encoded.groupBy("task").agg(F.max(F.col("before") + F.ceil(F.col("n_ids") / length)).alias("n")).orderBy("task").collect()  # a row for each task
    starts, total = {}, 0
    for row in totals:
        starts[row.task], total = total, total + row.n
    kind = worker_encoder(vocabulary).dtype
    stride = kind.itemsize * length
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, task, before, n, ids in batch.itertuples(index=False):
                first = starts[task] + before
                for seq in range(-(-n // length)):
                    rows.append((doc_id, seq, min(length, n - seq * length), first + seq, ids[seq * stride : (seq + 1) * stride]))
            out = pd.DataFrame(rows, columns=["doc_id", "seq", "n_ids", "number", "ids"])
            out["slot"] = feistel(out["number"].to_numpy(), total, key) if len(out) else out["number"]
            out["ids_crc32"] = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in out["ids"]]
            yield out.drop(columns="number")

    placed = encoded.mapInPandas(place, f"doc_id {id_type}, seq int, n_ids int, ids binary, slot long, ids_crc32 long")
    placed = placed.withColumn("shard", F.expr(f"slot div {shard_sequences}"))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Slots come in order; a shard is given out as soon as the next begins. A shard never spans two partitions."""
        open_shard, parts, meta = None, [], []

        def row():
            return (open_shard, open_shard * shard_sequences, len(parts), b"".join(parts), meta)

        for batch in batches:
            done = []
            for doc_id, seq, n, ids, slot, crc, shard in batch[["doc_id", "seq", "n_ids", "ids", "slot", "ids_crc32", "shard"]].itertuples(index=False):
                if shard != open_shard:
                    if parts:
                        done.append(row())
                    open_shard, parts, meta = shard, [], []
                meta.append({"doc_id": doc_id, "seq": seq, "n_ids": n, "slot": slot, "byte_offset": len(parts) * stride, "ids_crc32": crc})
                parts.append(ids + np.full(length - n, pad, kind).tobytes())
            yield pd.DataFrame(done, columns=["shard", "first_slot", "n_sequences", "payload", "contents"])
        if parts:
            yield pd.DataFrame([row()], columns=["shard", "first_slot", "n_sequences", "payload", "contents"])

    contents = f"array<struct<doc_id:{id_type},seq:int,n_ids:int,slot:bigint,byte_offset:bigint,ids_crc32:bigint>>"
    ranged = placed.repartitionByRange("shard").sortWithinPartitions("slot")
    ranged.mapInPandas(shards, f"shard long, first_slot long, n_sequences int, payload binary, contents {contents}").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).select("shard", F.explode("contents").alias("c")).select("c.doc_id", "c.seq", "c.n_ids", "c.slot", "shard", "c.byte_offset", "c.ids_crc32")


def read_slots(spark: SparkSession, path: str, first: int, last: int | None = None) -> DataFrame:
    """slot and ids (binary, padded) from slot first up to last, for resuming: only the shards that hold them are read.

    All shards but the last have as many sequences as the longest, so the bounds are bounds on first_slot alone, which reach the scan.
    """
    table = spark.read.parquet(path)
    size = table.agg(F.coalesce(F.max("n_sequences"), F.lit(1)).alias("n")).first().n
    table = table.where(F.col("first_slot") > first - size)
    if last is not None:
        table = table.where(F.col("first_slot") <= last)
    stride = (F.length("payload") / F.col("n_sequences")).cast("int")
    rows = table.select(F.explode(F.expr("sequence(0, n_sequences - 1)")).alias("i"), "first_slot", "payload", stride.alias("stride"))
    rows = rows.select((F.col("first_slot") + F.col("i")).alias("slot"), F.expr("substring(payload, i * stride + 1, stride)").alias("ids"))
    return rows.where((F.col("slot") >= first) & (F.lit(True) if last is None else F.col("slot") <= last))


def order_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
