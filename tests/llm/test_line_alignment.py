"""Patience diff and the overlaps that it is given."""

import random
from itertools import combinations

import by_definition
import pytest

from ledgerloom.llm import line_dedup


def test_longest_rise_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        items = [(i, rng.randrange(8)) for i in range(rng.randrange(8))]
        got = line_dedup.longest_rise(items)
        rises = [c for n in range(len(items) + 1) for c in combinations(range(len(items)), n) if all(items[a][1] < items[b][1] for a, b in zip(c, c[1:]))]
        assert len(got) == max(map(len, rises)) and tuple(got) in rises


def test_patience_aligns_between_anchors():
    # x occurs twice in both, so it doesn't anchor; between the anchors a and b it is aligned
    own, other = "axbxc", "axbxc"
    items = sorted((i, j) for i, x in enumerate(own) for j, y in enumerate(other) if x == y)
    assert [items[i] for i in line_dedup.patience(items)] == [(i, i) for i in range(5)]


def test_crossing_items_are_all_in_some_part():
    rng = random.Random(4)
    for _ in range(100):
        items = [(i, rng.randrange(10)) for i in range(rng.randrange(30))]
        parts = line_dedup.rising_parts(items)
        assert sorted(i for p in parts for i in p) == list(range(len(items)))
        assert all(items[a][1] < items[b][1] for p in parts for a, b in zip(p, p[1:]))


def test_partners_with_the_rarest_evidence_come_first_and_blocks_are_joined():
    runs = [(0, 1, 7, 10, 900), (1, 2, 7, 11, 900), (5, 5, 3, 2, 2), (2, 3, 7, 40, 900)]
    assert line_dedup.aligned_blocks(runs) == [(5, 5, 3, 2), (0, 2, 7, 10), (2, 3, 7, 40)]


def test_long_documents_in_opposite_order_are_aligned_in_time():
    n = 200_000
    assert len(line_dedup.aligned_blocks([(i, i, 1, n - i, 2) for i in range(n)])) == n
    assert len(line_dedup.aligned_blocks([(i, i, 1, 5, 2) for i in range(n)])) == n


def text(rng, lines):
    return "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))


@pytest.mark.parametrize("seed", [1, 2])
def test_every_block_of_every_earlier_document_is_deleted(spark, seed):
    rng = random.Random(seed)
    lines = [f"line {c} " + c * rng.randint(1, 45) for c in "abcdefghijkl"] + ["", "--"]
    rows = [(d, text(rng, lines)) for d in range(60)]
    # 50 and 51: doc 50 shares every other line with earlier ones; 51 equals it
    rows += [(100, "\n".join(x * 21 for x in "ABCDEFGH")), (99, "\n".join(x * 21 for x in "AxCyEzGw")), (101, "\n".join(x * 21 for x in "ABCDEFGH"))]
    want = by_definition.repeated_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.delete_repeated_lines(docs).collect()}
    for d, t in rows:
        assert out[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ())), d
    assert out[101].n_removed == 8
    texts = dict(rows)
    for d, r in out.items():  # what a block was aligned with says the same
        for b in r.blocks:
            strip = lambda t: [y for x in t if len(y := x.strip()) >= 8]
            own, other = texts[d].split("\n"), texts[b.other].split("\n")
            lines_there = strip(other)[b["at"] :]
            mine = strip(own[b.first : b.last + 1])
            assert b.other < d and lines_there[: len(mine)] == mine
