"""Language identification by compression: a text's language is that whose zstandard dictionary makes it smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNDETERMINED = "und"
#: Bytes that are compressed at a time. The window covers the dictionary and one piece, so a lead means the same at any length.
PIECE_BYTES = 16 << 10
#: Places of a long text that a sample is taken from.
SAMPLE_PLACES = 4


def language_dictionaries(train: DataFrame, sample_docs: int = 100, sample_chars: int = 2000, dict_bytes: int = 48 << 10, most_languages: int = 2000) -> dict[str, bytes]:
    """Raw-content dictionaries of at most dict_bytes, one for each non-null lang of train (doc_id, text, lang), most frequent first.

    Learned from a bounded sample: the sample_docs documents of each language whose identifiers hash lowest, sample_chars of each,
    taken from SAMPLE_PLACES evenly spaced places of the whole text. They fill the dictionary in equal shares.
    What the driver holds is bounded by the number of languages; more than most_languages values of lang are an error, as they are
    no languages then. Rows with a null text or lang, and empty texts, teach nothing; a language of which no sampled text has a letter
    has no dictionary, and an empty table gives none. Repeated rows count as they are; other columns are ignored.
    """
    train = train.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect()}
    if not counts:
        return {}
    if len(counts) > most_languages:
        raise ValueError(f"lang has over {most_languages} values")
    spread = 1 << 20
    order = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(spread))
    limits = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1, 2 * sample_docs / n) * spread))))
    picked = train.where(order < F.coalesce(limits[F.col("lang")], F.lit(0)))
    picked = picked.select("lang", _spread(sample_chars).alias("text"), order.alias("o"), "doc_id").orderBy("o", "doc_id").limit(4 * sample_docs * len(counts))
    parts: dict[str, list[str]] = {}
    for row in picked.collect():
        if len(got := parts.setdefault(row.lang, [])) < sample_docs:
            got.append(letters(row.text))
    filled = {lang: equal_shares([x.encode("utf-8", "replace") for x in own], dict_bytes) for lang, own in parts.items()}
    return {lang: filled[lang] for lang in counts if filled.get(lang, b"").strip()}


def _spread(chars: int) -> Column:
    """Whole texts of up to chars characters; of longer ones as many, from evenly spaced places."""
    each = chars // SAMPLE_PLACES
    places = (F.floor((F.length("text") - each) * i / max(1, SAMPLE_PLACES - 1)).cast("int") + 1 for i in range(SAMPLE_PLACES))
    return F.when(F.length("text") <= chars, F.col("text")).otherwise(F.concat_ws(" ", *(F.substring("text", p, F.lit(each)) for p in places)))


def equal_shares(texts: list[bytes], size: int) -> bytes:
    """Up to size bytes of texts, as much of each; what short ones leave goes to the longer."""
    share, left = {}, size
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), left // (len(texts) - k))
        left -= share[i]
    # of each place in a text the same part
    cut = []
    for i, text in enumerate(texts):
        step, part = -(-len(text) // SAMPLE_PLACES), -(-share[i] // SAMPLE_PLACES)
        cut.append(text if share[i] == len(text) else b"".join(text[at : at + part] for at in range(0, len(text), step))[: share[i]])
    return b"".join(cut)


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words, one space around each: case, digits and punctuation say nothing about the language."""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


class Compressors:
    """One compressor for each language; sizes() gives the bytes that each makes of a text, PIECE_BYTES at a time.

    Every piece begins with the dictionary alone: a window that slides over a long text soon leaves the dictionary behind. The end of
    the dictionary itself is put before each piece. It costs the same few bytes in every language, and keeps zstandard from storing
    short texts as they are, which would make all sizes equal.
    """

    def __init__(self, dictionaries: dict[str, bytes], carrier_bytes: int = 256):
        self.languages = list(dictionaries)
        params = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.each = []
        for lang in self.languages:
            learned = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            learned.precompute_compress(compression_params=params)
            compressor, carrier = zstandard.ZstdCompressor(dict_data=learned, compression_params=params), dictionaries[lang][-carrier_bytes:]
            self.each.append((compressor, carrier, len(compressor.compress(carrier))))

    def sizes(self, text: str) -> list[int]:
        raw = letters(text).encode("utf-8", "replace")
        pieces = [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
        return [sum(max(0, len(c.compress(carrier + x)) - alone) for x in pieces) for c, carrier, alone in self.each]


def decide(sizes: list[int], languages: list[str], margin: float) -> tuple[str, float, bool]:
    """Smallest size (of equals the first language), its lead over the next as a share of that, and whether it is too narrow."""
    ranked = sorted((size, i) for i, size in enumerate(sizes))
    best, i = ranked[0]
    lead = 1.0 if len(ranked) == 1 else (ranked[1][0] - best) / max(1, ranked[1][0])
    return languages[i], lead, lead < margin


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.002) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text); whole texts are compressed, piece by piece.

    Null texts and those without a letter are `und`, score 0, rejected; so is everything if no language was learned. A text whose
    two smallest sizes differ by less than margin of the larger keeps its best guess in lang_pred and is rejected. Repeated rows
    and ties give repeated, equal results; an empty table gives an empty result; other columns are dropped.
    """
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = Compressors(dictionaries)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if text is None or not tools.each or not any(map(str.isalpha, text)):
                    rows.append((UNDETERMINED, 0.0, True))
                else:
                    rows.append(decide(tools.sizes(text), tools.languages, margin))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(predict, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id"):
    """Documents kept from training: those whose crc32 of the identifier as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
