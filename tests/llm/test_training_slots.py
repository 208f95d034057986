"""Slots follow the keyed permutation, and resuming reads no more shards than it needs."""

import zlib

import numpy as np

from ledgerloom.llm import training_order
from ledgerloom.llm.common import mix
from ledgerloom.llm.tokens import Encoder


def plain_feistel(x, total, key, rounds=6):
    """One number at a time, with Python's integers."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = x >> half, x & low
        for r in range(1, rounds + 1):
            sub = int(mix(np.array([(r * 0x9E3779B97F4A7C15 + key) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            left, right = right, left ^ (int(mix(np.array([(right + sub) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) & low)
        x = (left << half) | right
        if x < total:
            return x


def test_slots_and_checksums(spark, tmp_path):
    texts = [("word " * (40 * d + 1)).strip() for d in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/order"
    rows = sorted(training_order.materialise_order(docs, path, length=64, shard_sequences=4, key=77).collect(), key=lambda r: (r.doc_id, r.seq))
    encoder = Encoder()
    want, n = [], sum(-(-(len(encoder.encode([t])[0]) + 1) // 64) for t in texts)
    for d, t in enumerate(texts):
        ids = np.append(encoder.encode([t])[0], 0).astype("<u4")
        for seq in range(-(-len(ids) // 64)):
            part = ids[seq * 64 : (seq + 1) * 64]
            want.append((d, seq, len(part), plain_feistel(len(want), n, 77), zlib.crc32(part.tobytes())))
    assert [(r.doc_id, r.seq, r.n_ids, r.slot, r.ids_crc32) for r in rows] == want

    resumed = training_order.read_slots(spark, path, 9, 17)
    assert sorted(r.slot for r in resumed.collect()) == list(range(9, 18))
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(first_slot,5)" in plan and "LessThanOrEqual(first_slot,17)" in plan
    assert resumed.select("slot").count() == 9 and spark.read.parquet(path).where("first_slot > 5 AND first_slot <= 17").count() == 3
    assert sorted(r.slot for r in training_order.read_slots(spark, path, n - 1).collect()) == [n - 1]
