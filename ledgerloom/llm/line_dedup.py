"""Line de-duplication by pairwise alignment.

Evidence of an overlap are runs of neighbouring lines with enough text, each known by a hash: from every line on, and up to every line,
the shortest run that has enough. A document is paired with the earliest document that holds one of its runs, for every run; so
documents that share text are paired however common their lines are, and a run adds as many pairs as it has holders, not their square.
Each pair is aligned by patience diff on the runs that it was found by: those that occur once anchor, the longest sequence that rises
in both documents stays, and the stretches between its members are aligned again in the same way. What crosses that alignment (blocks
that moved) is cut into further rising sequences, so no common block is lost for its order. Partners come rarest evidence first.
Aligned blocks are deleted from the later document.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frames, materialise, small_batches


def shortest_runs(chars: list[int], least_block_chars: int) -> list[tuple[int, int]]:
    """First and last place of the shortest runs of at least least_block_chars characters that begin, and that end, at each place.

    Together they cover a line exactly if it lies in a run of that many characters, in any part of the text as in the whole.
    """
    runs, first, last, held, size = set(), 0, -1, 0, len(chars)
    for first in range(size):  # that begin
        while last < size - 1 and (held < least_block_chars or last < first):
            last += 1
            held += chars[last]
        if held < least_block_chars:
            break
        runs.add((first, last))
        held -= chars[first]
    first, held = 0, 0
    for last in range(size):  # that end
        held += chars[last]
        while first < last and held - chars[first] >= least_block_chars:
            held -= chars[first]
            first += 1
        if held >= least_block_chars:
            runs.add((first, last))
    return sorted(runs)


def evidence(text: str, least_chars: int) -> list[tuple[int, str]]:
    """Number and stripped text of the lines that have at least least_chars characters."""
    return [(i, x) for i, line in enumerate(text.split("\n")) if len(x := line.strip()) >= least_chars]


def run_rows(docs: DataFrame, least_chars: int, least_block_chars: int) -> DataFrame:
    """token, check (together a hash of 96 bits), doc_id, unit, first, last for every shortest run of docs (doc_id, unit, text).

    Runs are of stripped lines of at least least_chars characters, and first and last number these; shorter lines between them belong
    to the run, but are no part of its hash.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            rows = []
            for doc_id, unit, text in batch[["doc_id", "unit", "text"]].itertuples(index=False):
                own = evidence(text, least_chars)
                raw = [x.encode("utf-8", "surrogatepass") for _, x in own]
                runs = shortest_runs([len(x) for _, x in own], least_block_chars)
                # a run of one line says nothing of short lines between it and the next, which belong to a block of both
                beside = {(i, i + 1) for a, b in runs if a == b for i in (a - 1, a) if 0 <= i < len(own) - 1}
                for a, b in sorted({*runs, *beside}):
                    h = xxhash.xxh3_128_intdigest(b"\n".join(raw[a : b + 1]))
                    rows.append(((h >> 64) - (1 << 63), (h >> 32 & 0xFFFFFFFF) - (1 << 31), doc_id, unit, a, b))
            yield pd.DataFrame(rows, columns=["token", "check", "doc_id", "unit", "first", "last"])

    return docs.mapInPandas(emit, "token long, check int, doc_id long, unit long, first int, last int")


def longest_rise(items: list[tuple[int, int]]) -> list[int]:
    """Numbers of a longest sequence of items (place, other place) that rises in both, by patience sorting; places rise already."""
    tops: list[int] = []
    pile_of: list[int] = []
    below: list[int] = []
    last: list[int] = []
    for i, (_, other) in enumerate(items):
        pile = bisect_left(tops, other)
        below.append(last[pile - 1] if pile else -1)
        pile_of.append(pile)
        if pile == len(tops):
            tops.append(other)
            last.append(i)
        else:
            tops[pile], last[pile] = other, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def patience(items: list[tuple[int, int]]) -> list[int]:
    """Numbers of the items (place, other place, places rising) that patience diff aligns.

    Anchors are items whose places occur once; between neighbouring anchors, and before the first and after the last, the items that
    lie between them in both documents are aligned by the same rule. A stretch without anchors takes its longest rise.
    """
    out: list[int] = []
    stack = [list(range(len(items)))]
    while stack:
        some = stack.pop()
        if not some:
            continue
        own, others = Counter(items[i][0] for i in some), Counter(items[i][1] for i in some)
        single = [i for i in some if own[items[i][0]] == others[items[i][1]] == 1]
        anchors = [single[j] for j in longest_rise([items[i] for i in single])]
        if not anchors:
            out += [some[j] for j in longest_rise([(k, items[i][1]) for k, i in enumerate(some)])]
            continue
        out += anchors
        ends = [(-1, -1), *(items[i] for i in anchors), (1 << 62, 1 << 62)]
        k, gaps = 0, [[] for _ in range(len(ends) - 1)]
        for i in some:
            while items[i][0] >= ends[k + 1][0]:
                k += 1
            if ends[k][0] < items[i][0] and ends[k][1] < items[i][1] < ends[k + 1][1]:
                gaps[k].append(i)
        stack += [g for g in gaps if g]
    return sorted(out)


def rising_parts(items: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of items cut into as few sequences as possible that rise in both places."""
    tops: list[int] = []  # negated, so that they rise
    parts: list[list[int]] = []
    for i, (_, other) in enumerate(items):
        at = bisect_left(tops, 1 - other)  # the first sequence that ends before
        if at == len(parts):
            parts.append([])
            tops.append(0)
        parts[at].append(i)
        tops[at] = -other
    return parts


def aligned_blocks(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Blocks (first, last, other document, its first line) of a document's runs (first, last, other document, first line there, holders).

    Each other document is aligned for itself, those with the rarest run first.
    """
    by_other: dict[int, list[tuple]] = {}
    for run in runs:
        by_other.setdefault(run[2], []).append(run)
    blocks = []
    for other in sorted(by_other, key=lambda d: (min(r[4] for r in by_other[d]), d)):
        own = sorted(by_other[other])
        items = [(r[0], r[3]) for r in own]
        aligned = patience(items)
        inside = set(aligned)
        left = [i for i in range(len(items)) if i not in inside]
        for chain in [aligned, *([left[j] for j in part] for part in rising_parts([items[i] for i in left]))]:
            for i in chain:  # runs that overlap or touch in both are one block
                first, last, _, at, _ = own[i]
                if blocks and blocks[-1][2] == other and blocks[-1][0] <= first <= blocks[-1][1] + 1 and first - blocks[-1][0] == at - blocks[-1][3]:
                    blocks[-1] = (blocks[-1][0], max(last, blocks[-1][1]), other, blocks[-1][3])
                else:
                    blocks.append((first, last, other, at))
    return blocks


def overlaps(docs: DataFrame, least_chars: int, least_block_chars: int) -> DataFrame:
    """unit and its runs (first, last, other, at, holders) that an earlier document, other, holds too, of docs (doc_id, unit, text)."""
    runs = run_rows(docs, least_chars, least_block_chars)
    # written first, so that the join that follows can split a run with very many holders
    holders = runs.groupBy("token", "check").agg(F.min(F.struct("doc_id", "first")).alias("owner"), F.max("doc_id").alias("other_id"), F.count("*").alias("holders"))
    holders = materialise(holders.where("owner.doc_id < other_id").select("token", "check", F.col("owner.doc_id").alias("other"), F.col("owner.first").alias("at"), "holders"), "line-holders")
    common = runs.join(holders, ["token", "check"]).where("other < doc_id")
    found = common.groupBy("unit").agg(F.collect_set(F.struct("first", "last", "other", "at", "holders")).alias("runs"))
    found = materialise(found, "line-runs")
    discard(holders)
    return found


def delete_repeated_lines(docs: DataFrame, least_chars: int = 8, least_block_chars: int = 40) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left) and blocks for every row of docs (doc_id, text; integer identifiers).

    A block is first and last deleted line (from 0), the earlier document, and where the block begins there, among its lines of at
    least least_chars characters.

    Lines end at \\n and are compared without leading and trailing white space; those of fewer than least_chars characters are no
    evidence. Null text stays null with no lines; rows with a null identifier stay as they are. Of rows that share an identifier none
    is later, so they don't lose lines to each other. Repeated rows give equal results. An empty table gives an empty result; other
    columns are dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("unit", F.xxhash64("doc_id", "text"))
    found = overlaps(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long")), least_chars, least_block_chars)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            rows = []
            for doc_id, text, runs in batch[["doc_id", "text", "runs"]].itertuples(index=False):
                lines = [] if text is None else text.split("\n")
                blocks = []
                if runs is not None:
                    place = [i for i, _ in evidence(text, least_chars)]
                    found = aligned_blocks([(r["first"], r["last"], r["other"], r["at"], r["holders"]) for r in runs])
                    blocks = [(place[first], place[last], other, at) for first, last, other, at in found]
                gone = {i for first, last, _, _ in blocks for i in range(first, last + 1)}
                kept = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
                rows.append((doc_id, len(lines), len(gone), kept, [dict(zip(("first", "last", "other", "at"), b, strict=True)) for b in blocks]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_lines", "n_removed", "text", "blocks"])

    fields = f"doc_id {id_type}, n_lines long, n_removed long, text string, blocks array<struct<first:int,last:int,other:bigint,at:int>>"
    return docs.join(found, "unit", "left").mapInPandas(apply, fields)
