"""Removal of byte strings that start more than once in a corpus, by suffix buckets sorted one at a time.

Suffixes that start with the same `length` bytes must meet. Every window of that many bytes is put into the bucket of its anchor,
the gram in it with the least hash, which equal windows share wherever they lie; so buckets are independent, and neighbouring
windows with one anchor travel as one context. Contexts whose bytes are equal as a whole, by a 128-bit hash, stand for each other: they
are repeated, and one of them is sorted for all. The suffixes of the contexts that differ are ordered bucket by bucket: a cover sample of
positions, one in every COVER bytes, is ranked first to a depth that reaches into every window, and a suffix is then told from others by
the bytes up to its next sample, that sample's rank, and the bytes after it. Suffixes that may be equal lie at the same distance from
their anchors, and anchors are laid out on sample positions; so the differences that the cover has to have are multiples of COVER, and
one residue is a difference cover of them. Memory is bounded by the bucket chunk; a bucket of more contexts than a task should hold is
refined to buckets of single windows, each of equal windows only, which are counted.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, frames, materialise, mix, small_batches

#: Bytes that texts are hashed by at a time; longer texts are cut with an overlap.
SLICE = 1 << 20
GRAM = 32
COVER = 32
_PRIME = 0x100000001B3
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    out = []
    for base in (_PRIME, inverse):
        p = np.full(2 * SLICE + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Anchors:
    """Runs of windows with one anchor, for buffers of at most 2 * SLICE bytes."""

    def __init__(self, length: int):
        self.length, self.span = length, length - GRAM + 1
        self.powers, self.inverses = _tables()

    def runs(self, buffer: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """low, high (first and last window start), anchor, gram, context and its check for texts that end at ends in buffer."""
        n, windows = len(buffer), len(buffer) - self.length + 1
        if windows <= 0:
            return {k: np.zeros(0, np.int64) for k in ("low", "high", "anchor", "gram", "context", "check")}
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[buffer] * self.powers[:n])])
        gram = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * self.inverses[: n - GRAM + 1])
        place = np.uint64((1 << 21) - 1)
        order = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
        padded = np.full(-(-len(order) // self.span) * self.span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(order)] = order
        table = padded.reshape(-1, self.span)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[self.span - 1 : self.span - 1 + windows]) & place).astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        inside = np.flatnonzero(np.arange(windows) + self.length <= np.repeat(ends, sizes)[:windows])
        if not len(inside):
            return {k: np.zeros(0, np.int64) for k in ("low", "high", "anchor", "gram", "context", "check")}
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (np.diff(inside) > 1) | (np.diff(anchor[inside]) != 0)
        first = np.flatnonzero(fresh)
        low, high = inside[first], inside[np.append(first[1:], len(inside)) - 1]
        at = anchor[low]
        raw, length = buffer.tobytes(), self.length
        # the anchor follows from the bytes, so equal bytes have it in the same place
        whole = b"".join([xxhash.xxh3_128_digest(raw[a : b + length]) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        context, check = np.frombuffer(whole, np.int64).reshape(-1, 2).T
        return {"low": low, "high": high, "anchor": at, "gram": gram[at].astype(np.int64), "context": context, "check": check}


def _slices(raw: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """buffer, ends, number of the text and its offset, for texts put together up to SLICE bytes or cut with an overlap."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def give():
        ends = np.cumsum([len(p) for _, _, p in parts])
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), ends, np.array([i for i, _, _ in parts]), np.array([o for _, o, _ in parts])

    for i, text in enumerate(raw):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            part = text[at : at + SLICE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > SLICE and parts:
                yield give()
                parts, size = [], 0
            parts.append((i, at, part))
            size += len(part)
    if parts:
        yield give()


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def context_rows(texts: DataFrame, length: int) -> DataFrame:
    """gram, context, check, unit, low, high, anchor, weight for every run of windows of texts (unit, text).

    Of equal contexts of a buffer the first stands for all (weight: their number); the others have weight 0.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Anchors(length)
        for batch in frames(batches):
            units = batch["unit"].to_numpy()
            for buffer, ends, number, offset in _slices([_bytes(t) for t in batch["text"]], length):
                run = tool.runs(buffer, ends)
                of = np.searchsorted(ends, run["low"], side="right")
                shift = offset[of] - (ends - np.diff(ends, prepend=0))[of]
                weight = np.zeros(len(of), np.int32)
                if len(of):
                    both = np.stack([run["context"], run["check"]], axis=1).view("i8,i8").ravel()
                    _, first, count = np.unique(both, return_index=True, return_counts=True)
                    weight[first] = count
                yield pd.DataFrame({"gram": run["gram"], "context": run["context"], "check": run["check"], "unit": units[number[of]], "low": run["low"] + shift, "high": run["high"] + shift, "anchor": run["anchor"] + shift, "weight": weight})

    return texts.mapInPandas(emit, "gram long, context long, check long, unit long, low long, high long, anchor long, weight int")


def cut_contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, unit, low, high, anchor, open and the bytes of each wanted context."""
    lists = wanted.groupBy("unit").agg(F.collect_list(F.struct("gram", "low", "high", "anchor", "open")).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            rows = []
            for unit, text, runs in batch[["unit", "text", "runs"]].itertuples(index=False):
                raw = _bytes(text)
                rows += [(r["gram"], unit, r["low"], r["high"], r["anchor"], r["open"], raw[r["low"] : r["high"] + length]) for r in runs]
            yield pd.DataFrame(rows, columns=["gram", "unit", "low", "high", "anchor", "open", "bytes"])

    return texts.join(lists, "unit").mapInPandas(cut, "gram long, unit long, low long, high long, anchor long, open boolean, bytes binary")


class BucketSorter:
    """Finds, for contexts of some buckets, which windows occur more than once."""

    def __init__(self, length: int):
        self.length, self.span = length, length - GRAM + 1
        self.left = -(-self.span // COVER) * COVER  # where anchors lie: a sample position
        self.width = -(-(self.left + length + 2 * COVER) // COVER) * COVER
        self.depth = (length - COVER) // 8 * 8  # of sample ranks: from the next sample, inside every window

    def layout(self, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, raw: list[bytes]) -> np.ndarray:
        table = np.zeros((len(raw), self.width), np.uint8)
        for row, a, text in zip(table, (self.left - (anchor - low)).tolist(), raw, strict=True):
            row[a : a + len(text)] = np.frombuffer(text, np.uint8)
        return table

    def sample_ranks(self, bucket: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Ranks, in each bucket, of the depth bytes from every sample position; by doubling over 8-byte words."""
        words = table.view(np.uint64).byteswap()  # big-endian words sort as their bytes do
        columns = words.shape[1]
        rank = np.empty((len(table), columns), np.int64)
        for c in range(columns):
            rank[:, c] = _pair_ranks(bucket, words[:, c])
        need, have = self.depth // 8, 1
        whole = None
        spent = 0
        while need:  # put the depth together from powers of two
            if need & 1:
                part = np.zeros_like(rank)
                part[:, : columns - spent] = rank[:, spent:]
                whole = part if whole is None else np.stack([_pair_ranks(whole[:, c], part[:, c]) for c in range(columns)], axis=1)
                spent += have
            need >>= 1
            if need:
                further = np.zeros_like(rank)
                further[:, : columns - have] = rank[:, have:]
                rank = np.stack([_pair_ranks(rank[:, c], further[:, c]) for c in range(columns)], axis=1)
                have *= 2
        return whole[:, :: COVER // 8]

    def repeated(self, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """A row for each context: which of its windows, by anchor minus start, another context of its bucket has too."""
        table = self.layout(bucket, low, high, anchor, raw)
        ranks = self.sample_ranks(bucket, table)
        most, least = anchor - low, anchor - high
        out = np.zeros((len(raw), self.span), bool)
        for x in range(self.span):
            own = np.flatnonzero((least <= x) & (x <= most))
            if len(own) < 2:
                continue
            start = self.left - x
            sample = -(-start // COVER)
            after = sample * COVER + self.depth
            head = _pack(table[own, start : sample * COVER])
            tail = _pack(table[own, after : start + self.length])
            key = _pair_ranks(_pair_ranks(bucket[own], ranks[own, sample]), _pair_ranks(head, tail))
            counts = np.bincount(key, minlength=len(own))
            out[own, x] = counts[key] > 1
        return out


def _pack(part: np.ndarray) -> np.ndarray:
    """Ranks of rows of bytes by equality, word by word."""
    padded = np.zeros((len(part), -(-max(1, part.shape[1]) // 8) * 8), np.uint8)
    padded[:, : part.shape[1]] = part
    words = padded.view(np.uint64).byteswap()
    rank = _pair_ranks(np.zeros(len(part), np.int64), words[:, 0])
    for c in range(1, words.shape[1]):
        rank = _pair_ranks(rank, words[:, c])
    return rank


def _pair_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def sort_buckets(contexts: DataFrame, length: int, chunk: int) -> DataFrame:
    """unit, low, high for the repeated windows of open contexts; rows of a bucket must fit into one task."""

    def settle(held: pd.DataFrame, tool: BucketSorter) -> pd.DataFrame:
        raw = held["bytes"].tolist()
        low, high, anchor = (held[c].to_numpy(np.int64) for c in ("low", "high", "anchor"))
        hit = tool.repeated(np.unique(held["gram"].to_numpy(), return_inverse=True)[1], low, high, anchor, raw)
        rows = []
        for i in np.flatnonzero(held["open"].to_numpy(bool) & hit.any(axis=1)):
            rows += [(held["unit"].iat[i], anchor[i] - b, anchor[i] - a) for a, b in _ranges(hit[i])]
        return pd.DataFrame(rows, columns=["unit", "low", "high"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, held = BucketSorter(length), None
        for batch in batches:  # sorted by bucket
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= chunk:
                last = held["gram"].iat[-1]
                done = held["gram"] != last
                if done.any():
                    yield settle(held[done].reset_index(drop=True), tool)
                    held = held[~done].reset_index(drop=True)
        if held is not None and len(held):
            yield settle(held, tool)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(run, "unit long, low long, high long")


def count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size, refined to single windows: these are counted by 128-bit hashes, aggregated before the shuffle."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, low, is_open, raw in batch[["unit", "low", "open", "bytes"]].itertuples(index=False):
                n = len(raw) - length + 1
                found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"window": found[:, 0], "check": found[:, 1], "unit": unit, "low": low + np.arange(n), "open": is_open})

    windows = contexts.mapInPandas(emit, "window long, check long, unit long, low long, open boolean")
    twice = windows.groupBy("window", "check").agg(F.count("*").alias("k")).where("k > 1").select("window", "check")
    return windows.where("open").join(twice, ["window", "check"], "left_semi").select("unit", "low", F.col("low").alias("high"))


def frequent_grams(texts: DataFrame, length: int, part: int = 64, least: int = 256) -> DataFrame:
    """Grams that look very common in one of `part` documents: a hint for dealing them out; results don't depend on it."""
    some = texts.where(F.pmod("unit", F.lit(part)) == 0)
    return context_rows(some, length).groupBy("gram").count().where(F.col("count") >= least).select("gram")


def repeated_windows(texts: DataFrame, length: int, chunk: int, most_bucket: int) -> DataFrame:
    """unit, low, high: starts from low to high of strings of length bytes that also start elsewhere."""
    hot = materialise(frequent_grams(texts, length), "suffix-frequent")
    rows = context_rows(texts, length).join(checked_broadcast(hot.withColumn("hot", F.lit(True))), "gram", "left")
    # rows of weight 0 are known to be repeated and need no company; they are dealt out evenly
    spread = F.when(F.col("weight") == 0, -1 - F.pmod(F.xxhash64("unit", "low"), F.lit(1 << 12))).when(F.col("hot"), F.pmod("context", F.lit(1 << 12))).otherwise(0)
    rows = rows.withColumn("salt", spread.cast("int"))
    bucket, same = Window.partitionBy("gram", "salt"), Window.partitionBy("gram", "salt", "context", "check")
    rows = rows.withColumn("n", F.count("*").over(bucket)).withColumn("k", F.sum("weight").over(same))
    rows = rows.withColumn("k", F.when(F.col("weight") == 0, 2).otherwise(F.col("k"))).where((F.col("n") > 1) | (F.col("k") > 1) | F.col("hot"))
    rows = rows.withColumn("place", F.row_number().over(same.orderBy("unit", "low")))
    # a context that occurs once in a bucket with others has to be compared with one of each of them
    rows = rows.withColumn("open", F.col("k") == 1).withColumn("unsettled", F.max("open").over(bucket))
    sent = (F.col("weight") > 0) & (F.col("place") == 1) & (F.col("unsettled") | F.col("hot").isNotNull())
    rows = materialise(rows.select("gram", "unit", "low", "high", "anchor", "open", "k", sent.alias("sent")), "suffix-runs")
    whole = rows.where("k > 1").select("unit", "low", "high")
    sent = rows.where("sent")
    large = materialise(sent.groupBy("gram").count().where(F.col("count") > most_bucket).select("gram"), "suffix-large")
    contexts = cut_contexts(texts, sent, length)
    if large.isEmpty():
        return whole.unionByName(sort_buckets(contexts, length, chunk))
    contexts = materialise(contexts, "suffix-contexts")
    rest = contexts.join(large, "gram", "left_anti")
    return whole.unionByName(sort_buckets(rest, length, chunk)).unionByName(count_windows(contexts.join(large, "gram", "left_semi"), length))


def remove_repeats(docs: DataFrame, length: int = 200, chunk: int = 8192, most_bucket: int = 32_768) -> DataFrame:
    """doc_id, n_bytes, spans (merged, start and end in UTF-8 bytes) and kept (the other bytes) for every row of docs (doc_id, text).

    A byte is removed if it lies in a string of `length` bytes that also starts anywhere else in the corpus, the same text included.
    Matches never cross texts and are judged on the input. Null text is empty; texts shorter than length keep all. Repeated rows repeat
    each other's strings, so that both lose them; they get equal results. An empty table gives an empty result; other columns are
    dropped. Rows are told apart by a hash of identifier and text.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("unit", F.xxhash64("doc_id", "text", F.length("text")))
    texts = docs.select("unit", "text").where(F.octet_length("text") >= length)
    found = repeated_windows(texts, length, chunk, most_bucket)
    lists = found.groupBy("unit").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            rows = []
            for doc_id, text, runs in batch[["doc_id", "text", "runs"]].itertuples(index=False):
                raw, spans, kept, at = _bytes(text), [], [], 0
                for low, end in sorted((r["low"], r["high"] + length) for r in (runs if runs is not None else [])):
                    if spans and low <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], end)
                    else:
                        spans.append({"start": low, "end": end})
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                rows.append((doc_id, len(raw), spans, b"".join([*kept, raw[at:]])))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return docs.join(lists, "unit", "left").mapInPandas(apply, f"doc_id {id_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def removal_report(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats' rows."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
