"""Token ids of whole texts by a byte-level BPE vocabulary file, each distinct word of a worker encoded once."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import span_hashes

#: Classes of characters for the splitting pattern.
SPACE, LETTER, NUMBER, OTHER, UNASSIGNED = range(5)
#: Places of the table of common words, and characters that are split at a time.
SLOTS, GROUP_CHARS = 1 << 20, 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            table[code] = LETTER if kind[0] == "L" else NUMBER
        elif kind in ("Cn", "Cs"):
            table[code] = UNASSIGNED
    # The characters of Unicode's White_Space property
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode(texts) gives an array of ids for each text, the same as the tokenizers library gives for the whole text.

    The vocabulary's pattern splits texts into words that are encoded independently. Here the split is done for a whole batch with
    array operations, and only words that this worker has not met are handed to the library. Texts with an apostrophe (the
    pattern's contractions) or with characters outside the Unicode of this Python go to the library whole. Words are told apart by
    a 64-bit hash; the store of known words is emptied when it is over most_words, so memory is bounded.
    """

    def __init__(self, path: str | None = None, most_words: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or default_vocabulary())
        self.library.encode_special_tokens = True
        #: Of ids: unsigned, 16 bits where the vocabulary allows.
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.most_words = most_words
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        # where the last word with these low bits of its hash is: most words are found here, without a search
        self.slot_hash, self.slot_word = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.word = np.zeros(0, np.int32)  # the number of each known word, in order of learning
        self.start, self.count, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=self.dtype) for ids in self._lists(texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and "'" not in t]
        odd = [i for i, t in enumerate(texts) if t and "'" in t]
        for i, ids in zip(odd, self._library([texts[i] for i in odd]), strict=True):
            out[i] = ids
        group: list[int] = []
        size = 0
        for i in [*plain, -1]:
            if i >= 0:
                group.append(i)
                size += len(texts[i])
            if group and (i < 0 or size >= GROUP_CHARS):
                for j, ids in zip(group, self._split([texts[j] for j in group]), strict=True):
                    out[j] = ids
                group, size = [], 0
        return out

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        kind = _classes()[codes]
        if (kind == UNASSIGNED).any():
            return self._library(texts)
        first = np.zeros(len(codes), dtype=bool)
        first[begin] = True
        # A word starts where the class changes; white space runs give their last character to what follows.
        changes = np.empty(len(codes), dtype=bool)
        changes[0] = True
        np.not_equal(kind[1:], kind[:-1], out=changes[1:])
        starts = changes | first
        blank = kind == SPACE
        last_blank = np.zeros(len(codes), dtype=bool)  # the last of a run before other text
        last_blank[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
        starts |= last_blank
        joined = np.zeros(len(codes), dtype=bool)  # text whose leading single space belongs to it
        joined[1:] = last_blank[:-1] & (codes[:-1] == 0x20)
        starts &= ~joined
        at = np.flatnonzero(starts)
        size = np.diff(at, append=len(codes))
        hashes = _hashes(whole, codes, at, size)
        if len(self.known) > self.most_words:
            self._forget()
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        word = self.slot_word[slot]
        missed = np.flatnonzero(self.slot_hash[slot] != hashes)
        if len(missed):
            distinct, where, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            found = self._places(distinct)
            new = found < 0
            if new.any():
                fresh = missed[where[new]]
                words = [whole[a : a + n] for a, n in zip(at[fresh].tolist(), size[fresh].tolist(), strict=True)]
                self._learn(distinct[new], self._lists(words))
                found = self._places(distinct)
            first = slot[missed[where]]
            self.slot_hash[first], self.slot_word[first] = distinct, found
            word[missed] = found[inverse]
        count = self.count[word].astype(np.int64)
        ends = np.cumsum(count)
        offset = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - count, count)
        ids = self.pool[np.repeat(self.start[word], count) + offset]
        of_text = np.searchsorted(at, begin)
        cuts = np.append(ends, 0)[of_text - 1]
        cuts[of_text == 0] = 0
        return np.split(ids, cuts[1:])

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, self.word[place], -1)

    def _learn(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        number = len(self.count) + np.arange(len(hashes), dtype=np.int32)
        known, word = np.concatenate([self.known, hashes]), np.concatenate([self.word, number])
        order = np.argsort(known, kind="stable")  # two sorted runs, which this merges
        self.known, self.word = known[order], word[order]
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), self.dtype, int(count.sum()))])


@lru_cache(maxsize=1)
def worker_encoder(path: str | None) -> Encoder:
    """The encoder of this Python worker, whose known words stay from task to task; ids don't depend on them."""
    return Encoder(path)


def _hashes(whole: str, codes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words' UTF-8 bytes; none is 0, which marks an empty slot."""
    raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = at, at + size
    if len(raw) != len(codes):
        before = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
        starts, ends = before[starts], before[ends]
    return np.maximum(span_hashes(raw, starts, ends), np.uint64(1))
