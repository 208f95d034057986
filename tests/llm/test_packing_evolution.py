"""The genetic part of packing, and that packing ends whatever the lengths are."""

import random

import pytest

from ledgerloom.llm import packing

SIZE = 2048


def lengths_of(kind, n=4096):
    r = random.Random(5)
    return {"uniform": lambda: r.randint(1, 2000), "log-normal": lambda: min(2047, max(1, int(r.lognormvariate(5.5, 1)))), "thirds": lambda: r.randint(500, 1100), "middling": lambda: r.randint(300, 800)}[kind], n


def drawn(kind, n=4096):
    draw, n = lengths_of(kind, n)
    return [draw() for _ in range(n)]


def valid(bins, lengths):
    assert sorted(i for x in bins for i in x) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in x) <= SIZE for x in bins)


@pytest.mark.parametrize(("kind", "share"), [("thirds", 0.985), ("middling", 0.985), ("uniform", 1), ("log-normal", 1)])
def test_evolution_beats_best_fit_decreasing(kind, share):
    lengths = drawn(kind)
    found = packing.founders(lengths, SIZE, 3, random.Random(1))
    best = packing.evolve(found, lengths, SIZE, 6, 4, random.Random(2))[0]
    valid(best, lengths)
    assert packing.least_bins(lengths, SIZE) <= len(best) <= share * len(found[0])


def test_refill_only_exchanges():
    rng = random.Random(8)
    for _ in range(30):
        lengths = [rng.randint(100, 1200) for _ in range(60)]
        bins, room = [], []
        packing.best_fit(list(range(50)), lengths, bins, room, SIZE)
        loose = packing.refill(bins, room, list(range(50, 60)), lengths, SIZE)
        assert sorted([*loose, *(i for x in bins for i in x)]) == list(range(60))
        assert room == [SIZE - sum(lengths[i] for i in x) for x in bins] and min(room) >= 0
        assert sum(lengths[i] for i in loose) <= sum(lengths[50:])


@pytest.mark.parametrize("kind", ["thirds", "uniform", "log-normal"])
def test_blocks_need_no_more_bins_than_best_fit(spark, kind):
    lengths = drawn(kind, 3000)
    units = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "block long, unit long, length long")
    placed = packing.pack_blocks(units, SIZE, 2, 2, 2, 1).collect()
    bins, room = [], []
    packing.best_fit(list(range(len(lengths))), lengths, bins, room, SIZE)
    own = {}
    for r in placed:
        own.setdefault(r.bin, []).append(r.unit)
    valid(list(own.values()), lengths)
    assert len(own) <= len(bins) and (kind != "thirds" or len(own) < len(bins))


def test_very_many_equal_documents_end(spark):
    text = "word " * 20
    n = len(packing.worker_encoder(None).encode([text])[0]) + 1
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"'{text}' AS text")
    rows = packing.pack_documents(docs, size=n * 5 // 2, block_units=512, generations=1, epochs=1)
    assert rows.groupBy("sequence_id").count().where("count = 2").count() == 10_000


def test_twelve_equal_documents_end(spark):
    docs = spark.createDataFrame([(d, "word " * 39) for d in range(12)], "doc_id long, text string")
    assert packing.pack_documents(docs, size=64, block_units=4).count() == 12
