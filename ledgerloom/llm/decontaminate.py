"""Benchmark decontamination: an FM-index of each training shard is searched for every window of benchmark words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, materialise, shards, small_batches
from .fm_index import FMIndex


@dataclass
class Phrases:
    """Distinct windows as rows of symbols, right-aligned, and the items that have each."""

    vocabulary: np.ndarray  # sorted word hashes; word i is symbol i + 2
    words: list[bytes]  # of each window, a space between them
    symbols: np.ndarray
    lengths: np.ndarray
    owner_first: np.ndarray  # the items of window w are owners[owner_first[w]:owner_first[w + 1]]
    owners: np.ndarray
    item_ids: list[str]


#: Bytes of benchmark text that are sent to the tasks at once; their windows take about a hundred times as much memory.
MOST_BYTES = 4 << 20
#: Bytes of text that one index holds.
SHARD = 1 << 20
#: The symbol of text breaks and of words that no item has.
BREAK = 1


def benchmark_phrases(benchmark: DataFrame, window: int = 10, most_bytes: int = MOST_BYTES) -> Phrases:
    """The windows of benchmark (item_id, text). An item of fewer words is one window; one without words has none.

    Its size is checked before it is sent to the tasks; `contamination` takes a larger benchmark in parts.
    """
    size = _bytes_of(benchmark)
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; give it in parts of at most {most_bytes}")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").collect()
    words = Words([r.text for r in rows], "ascii_alnum")
    vocabulary = np.unique(words.hashes)
    ids = np.searchsorted(vocabulary, words.hashes) + 2
    item_ids = sorted({r.item_id for r in rows if r.item_id is not None})
    number = {x: i for i, x in enumerate(item_ids)}
    windows: dict[bytes, set[int]] = {}
    of_window: dict[bytes, np.ndarray] = {}
    for i, r in enumerate(rows):
        own = ids[words.first[i] : words.first[i + 1]]
        raw = [words.word(j) for j in range(words.first[i], words.first[i + 1])]
        for a in range(max(1, len(own) - window + 1) if len(own) else 0):
            key = b" ".join(raw[a : a + window])
            of_window[key] = own[a : a + window]
            windows.setdefault(key, set()).add(number.get(r.item_id, -1))
    symbols, lengths = np.zeros((len(windows), window), np.int64), np.zeros(len(windows), np.int64)
    owners = []
    for w, (raw, of) in enumerate(windows.items()):
        own = of_window[raw]
        symbols[w, window - len(own) :], lengths[w] = own, len(own)
        owners.append(sorted(of - {-1}))
    first = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
    return Phrases(vocabulary, list(windows), symbols, lengths, first, np.array([i for o in owners for i in o], np.int64), item_ids)


def _bytes_of(benchmark: DataFrame) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def benchmark_parts(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> list[tuple[DataFrame, int]]:
    """benchmark as parts of about most_bytes, with the bytes of each. A single text of more is a part of its own size."""
    total = _bytes_of(benchmark)
    if total <= most_bytes:
        return [(benchmark, total)]
    buckets = -(-4 * total // most_bytes)
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(buckets))
    sizes = benchmark.where("text IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.sum(F.octet_length("text")).alias("n")).orderBy("bucket").collect()
    ranges = []  # first bucket, last bucket, bytes
    for b, n in sizes:
        if ranges and ranges[-1][2] + n <= most_bytes:
            ranges[-1][1:] = [b, ranges[-1][2] + n]
        else:
            ranges.append([b, b, n])
    return [(benchmark.where(bucket.between(first, last)), n) for first, last, n in ranges]


def shard_sequence(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard as symbols, and the word at each (-1 at breaks). A run of words outside the vocabulary is one break."""
    if not len(words.hashes):
        return np.array([BREAK]), np.array([-1])
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), max(0, len(vocabulary) - 1))
    known = vocabulary[at] == words.hashes if len(vocabulary) else np.zeros(len(at), bool)
    inside = np.flatnonzero(known)
    if not len(inside):
        return np.array([BREAK]), np.array([-1])
    gap = np.ones(len(inside), bool)
    gap[1:] = (np.diff(inside) > 1) | (np.diff(words.doc[inside]) > 0)
    place = np.arange(len(inside)) + np.cumsum(gap)
    symbols, word = np.full(place[-1] + 1, BREAK, np.int64), np.full(place[-1] + 1, -1, np.int64)
    symbols[place], word[place] = at[inside] + 2, inside
    return symbols, word


RUNS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_id, n_words, item_ids and runs of hit words (numbers of the first and last word, start and end in bytes)."""
    small_batches(docs.sparkSession)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in shards(batches, SHARD):
            words = Words(list(batch["text"]), "ascii_alnum")
            hit = np.zeros(len(words.hashes) + 1, np.int64)
            doc_items = np.zeros((0, 2), np.int64)
            symbols, word = shard_sequence(words, phrases.vocabulary)
            if len(phrases.lengths) and len(symbols) > 1:
                index = FMIndex(symbols, len(phrases.vocabulary) + 1)
                low, high = index.search(phrases.symbols, phrases.lengths)
                count = high - low
                which = np.repeat(np.arange(len(count)), count)
                rows = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                start = word[index.locate(rows)]
                # equal hashes are no proof: the words themselves decide
                same = np.fromiter((b" ".join(map(words.word, range(a, a + phrases.lengths[w]))) == phrases.words[w] for a, w in zip(start.tolist(), which.tolist(), strict=True)), bool, len(start))
                start, which = start[same], which[same]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + phrases.lengths[which], -1)
                pairs = np.unique(np.stack([words.doc[start], which], axis=1), axis=0)
                n = phrases.owner_first[pairs[:, 1] + 1] - phrases.owner_first[pairs[:, 1]]
                item = phrases.owners[np.repeat(phrases.owner_first[pairs[:, 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                doc_items = np.unique(np.stack([np.repeat(pairs[:, 0], n), item], axis=1), axis=0)
            covered = np.cumsum(hit[:-1]) > 0
            per_doc = np.searchsorted(doc_items[:, 0], np.arange(len(batch) + 1))
            text_start = np.cumsum([0, *((0 if t is None else len(t.encode("utf-8", "surrogatepass"))) + 1 for t in batch["text"])])
            rows_out = []
            for i, doc_id in enumerate(batch["doc_id"]):
                a, b = words.first[i], words.first[i + 1]
                own = covered[a:b]
                runs = []
                if own.any():
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) + a
                    runs = [{"first": int(x - a), "last": int(y - a) - 1, "start": int(words.starts[x] - text_start[i]), "end": int(words.ends[y - 1] - text_start[i])} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                items = sorted(phrases.item_ids[k] for k in doc_items[per_doc[i] : per_doc[i + 1], 1])
                rows_out.append((doc_id, int(b - a), items, runs))
            yield pd.DataFrame(rows_out, columns=["doc_id", "n_words", "item_ids", "runs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(search, f"doc_id {id_type}, n_words long, item_ids array<string>, runs {RUNS}")


def _report_columns() -> list[Column]:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return [F.col("doc_id"), F.col("n_words"), n_hit.alias("n_hit"), F.col("item_ids"), spans.alias("spans")]


def find_contamination(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) and spans (merged, in UTF-8 bytes) for every row of docs (doc_id, text).

    Words are case-folded for A-Z and split at ASCII characters other than letters and digits. A word is hit if it lies in any
    occurrence of a window. Null and empty texts have no words, items without identifier are hit but not listed. Repeated rows give
    repeated results, an empty table or benchmark gives no hits; other columns are dropped.
    """
    return _search(docs, phrases).select(*_report_columns())


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row of all parts' rows of a text: overlapping and adjacent runs of words become one."""
    for batch in batches:
        rows = []
        for unit, n_words, found in batch[["unit", "n_words", "found"]].itertuples(index=False):
            runs = []
            for r in sorted(((r["first"], r["last"], r["start"], r["end"]) for f in found for r in f["runs"])):
                if runs and r[0] <= runs[-1]["last"] + 1:
                    runs[-1].update(last=max(runs[-1]["last"], r[1]), end=max(runs[-1]["end"], r[3]))
                else:
                    runs.append(dict(zip(("first", "last", "start", "end"), r, strict=True)))
            rows.append((unit, n_words, sorted({i for f in found for i in f["item_ids"]}), runs))
        yield pd.DataFrame(rows, columns=["unit", "n_words", "item_ids", "runs"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of find_contamination for benchmark (item_id, text) of any size.

    A benchmark of over most_bytes is searched part by part, each in a pass of its own over docs, so neither the driver nor a task
    holds more than one part; the runs of the passes are merged by a hash of identifier and text. All else is as find_contamination says.
    """
    parts = benchmark_parts(benchmark, most_bytes)
    if len(parts) == 1:
        return find_contamination(docs, benchmark_phrases(parts[0][0], window, parts[0][1]))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.length("text")).alias("unit"))
    texts = rows.select(F.col("unit").alias("doc_id"), "text")
    passes = []
    for number, (part, size) in enumerate(parts):
        found = _search(texts, benchmark_phrases(part, window, size))
        found = found if number == 0 else found.where(F.size("runs") > 0)  # the first pass tells the words of all
        passes.append(materialise(found.groupBy(F.col("doc_id").alias("unit")).agg(F.first("n_words").alias("n_words"), F.first(F.struct("item_ids", "runs")).alias("found")), "benchmark-part"))
    union = passes[0]
    for table in passes[1:]:
        union = union.unionByName(table)
    merged = union.groupBy("unit").agg(F.max("n_words").alias("n_words"), F.collect_list("found").alias("found"))
    merged = merged.mapInPandas(_merge, f"unit long, n_words long, item_ids array<string>, runs {RUNS}")
    return rows.select("doc_id", "unit").join(merged, "unit").select(*_report_columns())


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of find_contamination's rows."""
    listed = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
