"""Similarity join of documents on the Jaccard index of their word n-grams, and the classes that its links form.

Equal n-gram sets are one class from the start. N-grams are ordered rare first, by a sketch of their document counts, and a set's
first few (its prefix) must meet the prefix of any similar set. Prefix n-grams are joined; length and position rule out most pairs.
The suffix filter bounds the difference of two sets from below by splitting both at a pivot, again and again, and adding up how far the
sizes of the parts differ. It works twice: on the leaves of a recursion with fixed pivots, for which every set carries the parities of
its counts in 512 parts of the hash space, before whole sets are fetched; and on the sets themselves, with one set's medians as pivots,
before they are intersected. Each pair is verified once.

Each n-gram names the most central of its sets as pivot. First every set is compared with the one pivot that most of its n-grams name;
then, of all pairs that meet, those that links don't connect yet. N-grams and words are told apart by 64-bit hashes.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checked_broadcast, discard, materialise, mix, rolled, shards, small_batches
from .components import connected_components

SKETCH_BLOCK = 4096
#: Bytes of text whose n-grams a task holds at once.
SHARD = 1 << 20
#: Parts that the rows of a hot token are dealt into.
SALTS = 1 << 16
#: Parts of the hash space whose parities the suffix filter compares, and the columns that hold them.
PARTS = 512
PARITIES = [f"s{i}" for i in range(PARTS // 64)]
#: Sets that are compared with one copy of a pivot, and rows of a token that are joined with one copy of its others.
PART_ROWS = 64


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted. Fewer than k words are one n-gram; no words give none."""
    words = Words(texts, "space")
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        own = words.hashes[a:b]
        yield np.unique(rolled(own, min(k, len(own)))) if len(own) else own


def set_key(grams: np.ndarray) -> int:
    """Equal for equal sets: a signed 64-bit sum of scrambled hashes."""
    return int(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(grams) else 0


def parities(grams: np.ndarray) -> list[int]:
    """Which of PARTS parts of the hash space hold an odd number of n-grams, as 64-bit words."""
    odd = np.bincount((grams >> np.uint64(64 - 9)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, unit, n, a (set_key) and parities for every row of docs (doc_id, unit, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in shards(batches, SHARD):
            rows = [(len(g), set_key(g), *parities(g)) for g in shingle_sets(list(batch["text"]), k)]
            out = pd.DataFrame(rows, columns=["n", "a", *PARITIES])
            yield batch[["doc_id", "unit"]].join(out)

    return docs.mapInPandas(describe, f"doc_id {id_type}, unit long, n int, a long, {', '.join(f'{c} long' for c in PARITIES)}")


def count_sketch(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """For each of 2 ** bits buckets of n-grams a byte: 8 times the logarithm of how many (document, n-gram) pairs it has.

    Tasks send compressed blocks of counts, which are added up as they stream by; the sum is 2 ** bits bytes, whatever the corpus.
    """
    shift = np.uint64(64 - bits)
    blocks = max(1, (1 << bits) // SKETCH_BLOCK)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in shards(batches, SHARD):
            grams = [*shingle_sets(list(batch["text"]), k), np.zeros(0, np.uint64)]
            np.add.at(total, (np.concatenate(grams) >> shift).astype(np.int64), 1)
        pack = zstandard.ZstdCompressor(level=1)
        for at in range(0, blocks, 64):
            rows = [(b, pack.compress(total[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].tobytes())) for b in range(at, min(blocks, at + 64)) if total[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].any()]
            yield pd.DataFrame(rows, columns=["block", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, raw in batch.itertuples(index=False):
                part = np.frombuffer(unpack.decompress(raw), np.uint32).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        rows = [(b, np.minimum(255, np.ceil(8 * np.log2(np.maximum(1, s)))).astype(np.uint8).tobytes()) for b, s in sums.items()]
        yield pd.DataFrame(rows, columns=["block", "levels"])

    sums = docs.mapInPandas(count, "block int, counts binary").repartition("block").mapInPandas(add, "block int, levels binary")
    table = np.zeros(1 << bits, np.uint8)
    for row in sums.collect():
        own = np.frombuffer(row.levels, np.uint8)
        table[row.block * SKETCH_BLOCK : row.block * SKETCH_BLOCK + len(own)] = own
    return table


def rare_first(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """n-grams as signed numbers whose order is rare first: the level in the top byte, then the hash."""
    bits = np.uint64(64 - (len(levels).bit_length() - 1))
    level = levels[(grams >> bits).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(55)) | (grams >> np.uint64(9))).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix_grams(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """token, a, n, pos for the prefix of every set, once in each task for equal sets."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** sketch_bits bytes

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # at most a key for each row of this task's part of the input
        for batch in shards(batches, SHARD):
            tokens, keys, sizes, places = [], [], [], []
            for grams in shingle_sets(list(batch["text"]), k):
                if (n := len(grams)) and (key := set_key(grams)) not in seen:
                    seen.add(key)
                    p = prefix_length(n, percent)
                    tokens.append(rare_first(grams, shared.value)[:p])
                    keys.append(np.full(p, key))
                    sizes.append(np.full(p, n, np.int32))
                    places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "a": np.concatenate(keys), "n": np.concatenate(sizes), "pos": np.concatenate(places)})

    return docs.mapInPandas(emit, "token long, a long, n int, pos int")


def _overlap_needed(nx: Column, ny: Column, percent: int) -> Column:
    """The least intersection of similar sets of these sizes."""
    return F.ceil(percent * (nx + ny) / (100 + percent))


def _candidates(x: DataFrame, y: DataFrame, percent: int, more: Column, on: list[str] | tuple[str, ...] = ("token",)) -> DataFrame:
    """Pairs, one for each token that they meet in, of rows (token, a, n, pos, ...) that pass the length and position filters and more."""
    y = y.select(*on, *(F.col(c).alias(f"{c}2") for c in y.columns if c not in on))
    need = _overlap_needed(F.col("n"), F.col("n2"), percent)
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    reach = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    return x.join(y, list(on)).where((F.col("a") != F.col("a2")) & (100 * small >= percent * large) & (reach >= need) & more)


def _near(percent: int) -> Column:
    """The suffix filter, for rows with n and parities of both sets."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in PARITIES), F.lit(0))
    return differ <= F.col("n") + F.col("n2") - 2 * _overlap_needed(F.col("n"), F.col("n2"), percent)


def _most_named(pairs: DataFrame) -> DataFrame:
    """For each a the a2 that most of its tokens name (of equals the least)."""
    counts = pairs.groupBy("a", "a2").agg(F.count("*").alias("k"))
    return counts.groupBy("a").agg(F.max_by("a2", F.struct("k", -F.col("a2"))).alias("a2"))


def suffix_difference(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of how many n-grams only one of two sorted sets has; the recursion ends early once it is over most."""
    gap = abs(len(x) - len(y))
    if not depth or gap > most or not len(x) or not len(y):
        return gap
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    met = at < len(x) and x[at] == y[middle]
    left, right = (x[:at], y[:middle]), (x[at + met :], y[middle + 1 :])
    far = abs(len(right[0]) - len(right[1])) + (not met)
    near = suffix_difference(*left, most - far, depth - 1)
    if near + far > most:
        return near + far
    return near + (not met) + suffix_difference(*right, most - near - (not met), depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int, depth: int = 3) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets of which none is empty."""
    total = len(x) + len(y)
    most = total - 2 * -(-percent * total // (100 + percent))
    if most < 0 or suffix_difference(x, y, most, depth) > most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (total - both)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar.

    v is the pivot of its pairs: sets are sent to it once for each pair, and it to every PART_ROWS of them, so a task holds one pivot
    and streams through the sets that are compared with it.
    """
    fans = materialise(pairs.groupBy("v").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "ngram-fans")
    members = pairs.join(fans, "v").select(F.col("u").alias("a"), "v", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"), F.lit(True).alias("member"))
    heads = fans.select(F.col("v").alias("a"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    wanted = materialise(members.unionByName(heads).join(classes.select("a", "unit"), "a"), "ngram-wanted")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in shards(batches, SHARD):
            sets = list(shingle_sets(list(batch["text"]), k))
            out = batch[["a", "v", "part", "member"]].assign(grams=[g.tobytes() for g in sets])
            yield out[[set_key(g) == a for g, a in zip(sets, batch["a"], strict=True)]]  # of rows with one unit all but equal ones go

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for a, v, member, grams in batch[["a", "v", "member", "grams"]].itertuples(index=False):
                if not member:
                    pivot, own = v, np.frombuffer(grams, np.uint64)
                elif v == pivot and similar(np.frombuffer(grams, np.uint64), own, percent):
                    rows.append((a, v))
            yield pd.DataFrame(rows, columns=["u", "v"])

    sets = docs.join(checked_broadcast(wanted), "unit").mapInPandas(fetch, "a long, v long, part int, member boolean, grams binary")
    found = sets.repartition("v", "part").sortWithinPartitions("v", "part", "member").mapInPandas(compare, "u long, v long")
    found = materialise(found.distinct(), "ngram-links")
    discard(fans, wanted)
    return found


def _pivots(shared: DataFrame) -> DataFrame:
    """One row of each token: that of the most central set.

    A set of which many prefix n-grams are met by others has few of its own, so it is similar to more of its group than others are.
    """
    met = shared.withColumn("met", F.count("*").over(Window.partitionBy("a")))  # as many rows as the set's prefix has
    best = F.min_by(F.struct("a", "n", "pos"), F.struct(-F.col("met") / F.col("n"), "a"))
    return met.groupBy("token").agg(best.alias("p")).select("token", "p.*")


def _shared_tokens(docs: DataFrame, k: int, percent: int, levels: np.ndarray, most_group: int) -> DataFrame:
    """token, a, n, pos of prefix n-grams that a set shares with another of similar length, written as a table."""
    rows = prefix_grams(docs, k, percent, levels)
    # A token's level bounds its documents from above, so unsalted groups have most_group sets at most.
    hot = F.shiftrightunsigned("token", 55) > math.floor(8 * math.log2(most_group))
    rows = rows.withColumn("salt", F.when(hot, F.pmod("a", F.lit(SALTS)).cast("int") + 1).otherwise(0))  # 0: not hot
    rows = rows.repartition("token", "salt").groupBy("token", "salt", "a", "n").agg(F.min("pos").alias("pos"))
    by_length = Window.partitionBy("token", "salt").orderBy("n", "a")
    near = (100 * F.lag("n").over(by_length) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_length))
    kept = rows.withColumn("near", near).where(F.col("near") | (F.col("salt") != 0))
    return materialise(kept.select("token", "a", "n", "pos"), "ngram-shared")


def _near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that pass the suffix filter on parities; pairs is a written table."""
    ends = materialise(pairs.select(F.explode(F.array("u", "v")).alias("a")).distinct(), "ngram-ends")
    traits = classes.select("a", "n", *PARITIES).join(checked_broadcast(ends), "a", "left_semi")
    both = pairs.join(traits.withColumnRenamed("a", "u"), "u")
    both = both.join(traits.select(F.col("a").alias("v"), *(F.col(c).alias(f"{c}2") for c in ("n", *PARITIES))), "v")
    return both.where(_near(percent)).select("u", "v")


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of tokens that several components have: token, a, n, pos, root, minor (not of the token's largest component), parts."""
    rooted = shared.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    counts = rooted.groupBy("token", "root").agg(F.count("*").alias("sets"))
    counts = counts.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("sets", "root")).alias("main"), (F.sum("sets") - F.max("sets")).alias("others"))
    # written first, so that the join that follows can split a token with very many rows
    split = materialise(counts.where("roots > 1").select("token", "main", F.ceil(F.col("others") / PART_ROWS).cast("int").alias("parts")), "ngram-split")
    return rooted.join(split, "token").select("token", "a", "n", "pos", "root", (F.col("root") != F.col("main")).alias("minor"), "parts")


def _cross_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs u > v of different components that meet in a token and pass the length and position filters.

    Of two components one is not the token's largest, so the largest is never joined with itself; a token with many other sets is dealt
    out by them, PART_ROWS to a copy of its rows.
    """
    minor = apart.where("minor").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int")).drop("minor", "parts")
    every = apart.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("minor", "parts")
    met = _candidates(minor, every, percent, F.col("root") != F.col("root2"), ["token", "part"])
    return met.select(F.greatest("a", "a2").alias("u"), F.least("a", "a2").alias("v")).distinct()


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, sketch_bits: int = 23, most_group: int = 4000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; integer identifiers).

    Words are what white space separates, A-Z lowered; k words make an n-gram, fewer than k make one. Documents link when
    100 * intersection >= percent * union. component_id is the smallest identifier that links lead to. Null and empty texts and those
    without words link with nothing and are their own component. Rows with equal sets are linked, so repeated rows share a component;
    a null identifier is ignored unless a component has no other. An empty table gives an empty result; other columns are dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("unit"), "text")
    sets = materialise(document_sets(docs, k), "ngram-sets")
    classes = materialise(sets.where("n > 0").groupBy("a", "n").agg(F.min("doc_id").alias("least"), F.min("unit").alias("unit"), *(F.first(c).alias(c) for c in PARITIES)), "ngram-classes")
    shared = _shared_tokens(docs, k, percent, count_sketch(docs, k, sketch_bits), most_group)

    # first every set with the one pivot that most of its n-grams name
    pivots = materialise(_pivots(shared), "ngram-pivots")
    named = _most_named(_candidates(shared, pivots, percent, F.lit(True)).select("a", "a2"))
    # two sets that name each other are one pair
    pairs = named.groupBy(F.greatest("a", "a2").alias("x"), F.least("a", "a2").alias("y")).agg(F.min("a2").alias("v"))
    pairs = materialise(pairs.select(F.when(F.col("v") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("u"), "v"), "ngram-named")
    checked = materialise(_near_pairs(pairs, classes, percent), "ngram-pairs")
    discard(pivots, pairs)
    roots = connected_components(_verified(docs, classes, checked, k, percent)).select(F.col("node").alias("a"), "root")
    roots = checked_broadcast(materialise(roots, "ngram-roots"))

    # then all pairs that these links leave apart
    apart = materialise(_apart(shared, roots), "ngram-apart")
    both = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    met = materialise(_cross_pairs(apart, percent).join(checked.select(*both), ["u", "v"], "left_anti"), "ngram-met")
    pairs = materialise(_near_pairs(met, classes, percent), "ngram-pairs")
    links = _verified(docs, classes, pairs, k, percent)
    for c in ("u", "v"):  # in terms of what is already connected
        links = links.join(roots.select(F.col("a").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    merged = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("above"))

    named = classes.select("a", "n", "least").join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
    named = named.join(merged, "root", "left").withColumn("root", F.coalesce("above", "root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "root").select("a", "n", "component_id"), "ngram-named")
    discard(classes, shared, checked, apart, met, pairs)
    out = sets.join(named, ["a", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
