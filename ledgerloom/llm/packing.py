"""Best-fit packing of tokenised documents into sequences, improved by a grouping genetic algorithm.

Documents are tokenised where they lie and leave only lengths and checksums. Pieces are dealt into blocks of a few thousand; each
block is a packing problem of its own, evolved on several islands. A crossover injects whole well-filled bins of one parent into
the other, empties the bins there that hold some of the same pieces, lets what that displaced replace pieces that fill other bins
worse, and best-fits the rest. Between epochs each island's elite migrates to the next island of its block. Then the bins that
stayed underfilled in any block are dealt anew into fewer blocks, until one block is left. Where that helps no more, only the
poorest bin of each block is dealt anew.
"""

import math
import random
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .tokens import worker_encoder

#: The id that ends every document.
END = 0


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: the first may be shorter, the others are whole sequences."""
    return [n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)


def document_pieces(docs: DataFrame, size: int, vocabulary: str | None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number unique to the row (unit) for each piece of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, unit = worker_encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode([t or "" for t in batch["text"]]), strict=True):
                raw, start = np.append(ids, END).astype("<u4").tobytes(), 0
                for piece, length in enumerate(cut_lengths(len(ids) + 1, size)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), unit))
                    start += length
                    unit += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "unit"])

    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, unit long")


# --- one block: a packing is a list of bins, a bin a tuple of item numbers ---------------------------------------------


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], size: int) -> None:
    """Put items, longest first, each into the fullest bin that still holds it, else into a new one."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for b, r in enumerate(room):
        open_bins[r].append(b)
        mask |= 1 << r
    for item in sorted(items, key=lengths.__getitem__, reverse=True):
        n = lengths[item]
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask &= ~(1 << r)
            bins[b].append(item)
        else:
            b, r = len(bins), size
            bins.append([item])
            room.append(size)
        room[b] = r - n
        open_bins[r - n].append(b)
        mask |= 1 << (r - n)


def refill(bins: list[list[int]], room: list[int], loose: list[int], lengths: list[int], size: int, rounds: int = 12) -> list[int]:
    """Exchange up to two items of a bin for one or two loose ones that fill it better, best gain first; what is loose in the end.

    Every exchange leaves less loose, so the bins that the loose items need become fewer.
    """
    for _ in range(rounds):
        if not loose:
            break
        loose = sorted(loose, key=lengths.__getitem__)
        own = np.array([lengths[i] for i in loose], np.int64)
        x, y = np.triu_indices(len(own), 1)
        sums, x, y = np.append(own, own[x] + own[y]), np.append(np.arange(len(own)), x), np.append(np.full(len(own), -1), y)
        order = np.argsort(sums, kind="stable")
        order = order[: np.searchsorted(sums[order], size, side="right")]
        sums = sums[order]
        out: list[tuple[int, tuple[int, ...]]] = []
        taken: list[int] = []
        for b, held in enumerate(bins):
            if room[b]:
                few = held[:6]
                for leave in ((), *((i,) for i in few), *combinations(few, 2)):
                    out.append((b, leave))
                    taken.append(sum(lengths[i] for i in leave))
        if not out or not len(sums):
            break
        less = np.array(taken, np.int64)
        at = np.searchsorted(sums, less + np.array([room[b] for b, _ in out], np.int64), side="right") - 1
        gain = np.where(at >= 0, sums[at] - less, 0)
        best = np.flatnonzero(gain > 0)
        best = best[np.argsort(-gain[best], kind="stable")]
        used_bins: set[int] = set()
        used: set[int] = set()
        for k in best.tolist():
            b, leave = out[k]
            come = [i for i in (int(x[order[at[k]]]), int(y[order[at[k]]])) if i >= 0]
            if b in used_bins or not used.isdisjoint(come):
                continue
            used_bins.add(b)
            used.update(come)
            bins[b] = [i for i in bins[b] if i not in leave] + [loose[i] for i in come]
            room[b] -= int(gain[k])
            loose += leave
        if not used:
            break
        loose = [i for n, i in enumerate(loose) if n not in used]
    return loose


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], size: int, rng: random.Random, gifts: int = 24) -> list[list[int]]:
    """The child of a that takes whole well-filled bins of b.

    Bins of a that share an item with a gift are emptied, and so, as mutation, are some of its poorest. What that displaces is
    exchanged for items that fill the other bins worse, and the rest is best-fitted.
    """
    fill = [sum(lengths[i] for i in x) for x in b]
    of_a = {tuple(sorted(x)) for x in a}
    full = [n for n in sorted(range(len(b)), key=fill.__getitem__, reverse=True) if tuple(sorted(b[n])) not in of_a][: 4 * gifts]
    gift = [b[n] for n in rng.sample(full, min(gifts, len(full)))]
    taken = {i for x in gift for i in x}
    bins, room, displaced = [list(x) for x in gift], [size - sum(lengths[i] for i in x) for x in gift], []
    used = [sum(lengths[i] for i in x) for x in a]
    poor = set(sorted(range(len(a)), key=used.__getitem__)[: rng.randint(1, gifts)])
    for n, x in enumerate(a):
        if not taken.isdisjoint(x):
            displaced += [i for i in x if i not in taken]
        elif n in poor:
            displaced += x
        else:
            bins.append(list(x))
            room.append(size - used[n])
    displaced = refill(bins, room, displaced, lengths, size)
    best_fit(displaced, lengths, bins, room, size)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], size: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with their room in few places."""
    return -len(bins), sum((sum(lengths[i] for i in x) / size) ** 2 for x in bins)


def least_bins(lengths: list[int], size: int) -> int:
    """No packing has fewer: all are full, or each holds one item of over half the size."""
    return max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))


def evolve(population: list[list[list[int]]], lengths: list[int], size: int, generations: int, keep: int, rng: random.Random) -> list[list[list[int]]]:
    scored = sorted(((fitness(x, lengths, size), x) for x in population), key=lambda p: p[0], reverse=True)
    least = least_bins(lengths, size)
    for _ in range(generations):
        if len(scored) < 2 or -scored[0][0][0] == least:
            break
        first, second = scored[0], scored[rng.randrange(1, len(scored))]
        for a, b in ((first, second), (second, first)):
            child = crossover(a[1], b[1], lengths, size, rng)
            scored.append((fitness(child, lengths, size), child))
        scored = sorted(scored, key=lambda p: p[0], reverse=True)[:keep]
    return [x for _, x in scored]


def founders(lengths: list[int], size: int, count: int, rng: random.Random) -> list[list[list[int]]]:
    """Best-fit packings: one of all items, longest first, and others that first fill bins at random."""
    found = []
    for k in range(count):
        bins: list[list[int]] = []
        room: list[int] = []
        items = list(range(len(lengths)))
        if found and len(found[0]) == least_bins(lengths, size):
            break
        if k:
            rng.shuffle(items)
            head = items[: len(items) // 8]
            for at in range(0, len(head), 256):
                best_fit(head[at : at + 256], lengths, bins, room, size)
            items = items[len(head) :]
        best_fit(items, lengths, bins, room, size)
        found.append(bins)
    return found


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    owner = np.empty(n, dtype=np.int32)
    for b, x in enumerate(bins):
        owner[x] = b
    return owner.tobytes()


def _from_bytes(raw: bytes) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(np.frombuffer(raw, dtype=np.int32).tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


ISLAND = "block long, island int, n int, lengths binary, owner binary"


def pack_blocks(units: DataFrame, size: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """units (block, unit, length) with the number of the bin that holds each in its block. A block's units fit into one task."""

    def begin(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group.sort_values("unit")["length"].to_numpy(np.int32)
        rows = []
        for island in range(islands):
            rng = random.Random(f"{seed}/{key[0]}/{island}")
            rows += [(key[0], island, len(lengths), lengths.tobytes(), _to_bytes(x, len(lengths))) for x in founders(lengths.tolist(), size, 3, rng)]
        return pd.DataFrame(rows, columns=["block", "island", "n", "lengths", "owner"])

    def epoch(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = np.frombuffer(group["lengths"].iloc[0], dtype=np.int32).tolist()
        owners = sorted(set(group["owner"]))
        rng = random.Random(f"{seed}/{key[0]}/{key[1]}/{len(owners)}")
        best = evolve([_from_bytes(x) for x in owners], lengths, size, generations, 4, rng)
        raw = group["lengths"].iloc[0]
        rows = [(key[0], key[1], len(lengths), raw, _to_bytes(x, len(lengths))) for x in best[:2]]
        if islands > 1:  # the elite goes to the next island as well
            rows.append((key[0], (key[1] + 1) % islands, len(lengths), raw, rows[0][4]))
        return pd.DataFrame(rows, columns=["block", "island", "n", "lengths", "owner"])

    def settle(key: tuple, group: pd.DataFrame, packings: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("unit").reset_index(drop=True)
        lengths = group["length"].tolist()
        bins = max((_from_bytes(x) for x in packings["owner"]), key=lambda x: fitness(x, lengths, size))
        bin_of, offset, used = np.empty(len(group), np.int64), np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for b, x in enumerate(bins):
            own = group["length"].to_numpy(np.int64)[x]
            bin_of[x], offset[x], used[x] = b, np.cumsum(own) - own, own.sum()
        poorest = bin_of == bin_of[np.argmin(used)]
        return group.assign(bin=bin_of, offset=offset, used=used, poorest=poorest)[["unit", "length", "block", "bin", "offset", "used", "poorest"]]

    state = units.groupBy("block").applyInPandas(begin, ISLAND)
    for _ in range(epochs):
        state = state.groupBy("block", "island").applyInPandas(epoch, ISLAND)
    best = state.select("block", "owner")
    return units.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(settle, "unit long, length long, block long, bin long, offset long, used long, poorest boolean")


def fewer_blocks(units: int, blocks: int, block_units: int) -> int:
    """At most half as many blocks, but not many more units in a block than the first had."""
    fewer = max(1, min(blocks // 2, math.ceil(units / block_units)))
    return math.ceil(units / block_units) if units > 2 * block_units * fewer else fewer


def pack_documents(
    docs: DataFrame, size: int = 2048, vocabulary: str | None = None, block_units: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 4, well_filled: float = 0.998, seed: int = 11
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    A document is its ids and the end id 0; null text is empty, so its one piece is the end id. Documents over size ids are cut
    into pieces of size, the first of which may be shorter. Every piece lies whole in one sequence of at most size ids, pieces of
    a sequence follow each other without gaps. Rows are told apart by place of reading, so repeated rows and null identifiers are
    packed like others. Underfilled bins are dealt anew until one block is left. Each time there are fewer blocks or a tenth fewer
    units, so that ends: after a round without either only each block's poorest bin is dealt anew, and if that is not a tenth fewer
    units, all bins stay. Of equal packings the first by island stays. An empty table gives an empty result; other columns are dropped.
    """
    pieces = materialise(document_pieces(docs, size, vocabulary), "pack-pieces")
    whole = pieces.where(F.col("length") == size).select("unit", F.col("unit").alias("bin_unit"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size).select("unit", "length")
    done = whole
    units = rest.count()
    blocks, step = max(1, math.ceil(units / block_units)), 0
    while True:
        dealt = rest.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + step), "unit"), F.lit(blocks)))
        placed = materialise(pack_blocks(dealt, size, islands, epochs, generations, seed + step), "pack-bins")
        # a bin's name is the least of its units
        placed = placed.withColumn("bin_unit", F.min("unit").over(Window.partitionBy("block", "bin")))
        again = F.lit(False) if blocks == 1 else F.col("used") < well_filled * size
        left = placed.where(again).count()
        fewer = fewer_blocks(left, blocks, block_units)
        if fewer >= blocks and 10 * left > 9 * units:  # neither blocks nor units become fewer
            again = F.col("poorest")
            left = placed.where(again).count()
            fewer = math.ceil(left / block_units)
            if 10 * left > 9 * units:
                again, left = F.lit(False), 0
        done = done.unionByName(placed.where(~again).select("unit", "bin_unit", "offset"))
        if not left:
            break
        rest = materialise(placed.where(again).select("unit", "length"), "pack-rest")
        blocks, units, step = fewer, left, step + 1
    joined = pieces.join(done, "unit")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin_unit").alias("sequence_id"), "offset")
