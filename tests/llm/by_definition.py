"""Results by definition, in plain Python, that the operators are held against. They share no code with them."""

import hashlib
import re
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of (doc_id, text) and (item_id, text)."""
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(FOLD))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add(item)
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def similar_classes(docs, k, percent):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = []
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append((doc_id, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = {}
    for i, (_, grams) in enumerate(sets):
        for g in grams:
            having.setdefault(g, []).append(i)
    for i, (_, x) in enumerate(sets):
        for j, both in Counter(j for g in x for j in having[g] if j > i).items():
            if 100 * both >= percent * (len(x) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[find(i)] = min((x for x in (doc_id, least.get(find(i))) if x is not None), default=None)
    return [(doc_id, len(x), least[find(i)]) for i, (doc_id, x) in enumerate(sets)]


def repeats(docs, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    raw = [(d, b"" if t is None else t.encode("utf-8", "surrogatepass")) for d, t in docs]
    seen = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        hit = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit.update(range(i, i + length))
        spans = sum(i - 1 not in hit for i in hit)
        out.append((d, len(t), len(hit), spans, hashlib.sha256(bytes(b for i, b in enumerate(t) if i not in hit)).hexdigest()))
    return out


def repeated_lines(docs, least_chars=8, least_block_chars=40):
    """Deleted lines of each document of (doc_id, text): each is compared with all earlier ones, diagonal by diagonal."""
    lines = {d: [(i, own) for i, line in enumerate(text.split("\n")) if len(own := line.strip()) >= least_chars] for d, text in docs}
    out = {}
    for doc_id, own in lines.items():
        for other in (x for d, x in lines.items() if d < doc_id):
            for shift in range(-len(own), len(other)):
                block = []
                for k in range(len(own) + 1):
                    if k < len(own) and 0 <= k + shift < len(other) and own[k][1] == other[k + shift][1]:
                        block.append(own[k])
                        continue
                    if block and sum(len(x) for _, x in block) >= least_block_chars:
                        out.setdefault(doc_id, set()).update(range(block[0][0], block[-1][0] + 1))
                    block = []
    return out
