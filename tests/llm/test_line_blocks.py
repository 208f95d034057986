"""Blocks of lines that any earlier document holds."""

import random

import by_definition
from ledgerloom.llm import line_dedup


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.delete_repeated_lines(docs).collect()}


def test_blocks_whose_lines_occur_earlier_elsewhere(spark):
    a, b, c, d = (x * 20 for x in "abcd")
    rows = [(1, f"{a}\n{d}"), (2, f"{d}\n{b}"), (3, c), (4, f"{a}\n{b}\n{c}"), (5, f"{a}\n{b}\n{c}\nown line")]
    assert left(spark, rows) == {**dict(rows), 5: "own line"}


def test_blocks_in_another_order_or_repeated(spark):
    a, b, c, d = (x * 25 for x in "abcd")
    rows = [(1, f"{c}\n{d}\n{a}\n{b}"), (2, f"{a}\n{b}\n{c}\n{d}"), (3, f"{a}\n{a}\n{b}")]
    assert left(spark, rows) == {1: rows[0][1], 2: "", 3: a}


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(11)
    lines = [x * n for x, n in zip("abcdefgh", (4, 8, 12, 19, 25, 39, 40, 60))]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7)))) for d in range(150)]
    want = by_definition.repeated_lines(rows)
    assert left(spark, rows) == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ())) for d, t in rows}
    assert any(0 < len(x) < 5 for x in want.values())
