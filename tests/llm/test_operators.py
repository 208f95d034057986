"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import by_definition
import numpy as np
import pytest

from ledgerloom.llm import decontaminate, exact_dedup, fm_index, language_id, line_dedup, ngram_join, packing, suffix_dedup, toxicity, training_order, url_filter
from ledgerloom.llm.common import Words
from ledgerloom.llm.tokens import Encoder

random.seed(7)
WORDS = "the of river stone cloud bright under walking seven lamp house green paper window north salt".split()


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", "", "ing", "s"]) for _ in range(n))


BASE = prose(300)
ODD_ROWS = [
    (1, BASE),
    (2, BASE),
    (2, BASE),
    (3, BASE.replace("river", "brook", 1)),
    (4, None),
    (5, ""),
    (6, "   \t\n "),
    (7, "one"),
    (8, "Two  words"),
    (9, "two words"),
    (10, "é ß 日本語 " * 30),
    (11, prose(6000)),
    (12, "\n".join(prose(12) for _ in range(30))),
    (13, "1234 !! 5678"),
    (None, prose(40)),
    (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every awkward kind, with extra columns that bear names that the operators use."""
    rows = [(d, t, 1, "x", 2) for d, t in ODD_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, unit int, norm string, kept int")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_are_hashed_alike_wherever_they_lie():
    a = Words(["Foo bar", None, "bar", "", "x" * 5000 + " foo"], "ascii_alnum")
    assert a.first.tolist() == [0, 2, 2, 3, 3, 5]
    assert a.hashes[1] == a.hashes[2] and a.hashes[0] == a.hashes[4] and a.hashes[0] != a.hashes[1]


# --- 1 toxicity


def test_chain_learns_and_uses_earlier_links():
    rng = np.random.default_rng(0)
    bad, low = np.uint64(11), np.uint64(22)
    docs, labels = [], {"quality": [], "toxic": []}
    for i in range(600):
        toxic, quality = i % 5 == 0, i % 3 != 0
        own = set(rng.integers(100, 160, 12).astype(np.uint64).tolist()) | ({int(bad)} if toxic else set()) | (set() if quality else {int(low)})
        docs.append(np.array(sorted(own), np.uint64))
        labels["quality"].append(quality)
        labels["toxic"].append(toxic)
    chain = toxicity.fit_chain(docs, {k: np.array(v) for k, v in labels.items()}, np.arange(600) % 5, 5)
    assert [len(link.earlier) for link in chain] == [0, 1]
    weights = dict(zip(chain[1].words.tolist(), chain[1].weights.tolist()))
    assert weights[int(bad)] == max(weights.values()) > 2


def test_toxicity_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (7, 0, 1), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(odd, labels)
    scored = toxicity.score_toxicity(odd, chain).collect()
    assert len(scored) == len(ODD_ROWS) and all(0 <= r.prob_toxic <= 1 for r in scored)
    assert not any(r.toxic for r in scored if r.doc_id in (4, 5, 6))
    assert toxicity.score_toxicity(nothing, chain).count() == 0
    untrained = toxicity.train_chain(nothing, labels)
    assert not any(r.toxic for r in toxicity.score_toxicity(odd, untrained).collect())


def test_toxicity_on_labelled_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train_chain(docs.where("doc_id % 2 = 0"), labels)
    test = toxicity.score_toxicity(docs.where("doc_id % 2 = 1"), chain).join(labels, "doc_id").collect()
    right = sum(r.toxic == (r[-1] == 1) for r in test) / len(test)
    assert right > 0.85  # a few hundred labels


# --- 2 language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_language(docs, language_id.language_dictionaries(docs.where(~language_id.held_out()))).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert sum(r.rejected for r in found) / len(found) < 0.03


def test_language_on_odd_rows(spark, odd, nothing):
    learned = {"aa": language_id.letters(BASE).encode(), "bb": language_id.letters("zwo drei vier " * 50).encode()}
    found = language_id.identify_language(odd, learned).collect()
    assert len(found) == len(ODD_ROWS)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {4, 5, 6, 13, None}
    assert all(r.rejected and r.score == 0 for r in found if r.lang_pred == "und") and all(0 <= r.score <= 1 for r in found)
    assert language_id.identify_language(nothing, learned).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(odd, {}).collect()} == {"und"}
    assert language_id.language_dictionaries(odd.withColumnRenamed("norm", "lang").where("false")) == {}


# --- 3 decontamination


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 1), (40, 2), (500, 3), (300, 1), (2000, 60)):
        text = rng.integers(1, symbols + 1, n)
        index = fm_index.FMIndex(text, symbols)
        for length in (1, 2, 5):
            phrases = rng.integers(1, symbols + 1, (15, length))
            low, high = index.search(phrases, np.full(15, length))
            for phrase, a, b in zip(phrases, low, high):
                want = [i for i in range(n - length + 1) if (text[i : i + length] == phrase).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [("a", " ".join(BASE.split()[20:50])), ("b", "Two Words"), ("b", None), ("c", ""), ("d", prose(30)), ("e", " ".join(BASE.split()[20:31])), (None, "one")]


def test_decontamination_equals_brute_force(spark, odd, nothing):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    phrases = decontaminate.benchmark_phrases(benchmark)
    report = decontaminate.contamination_report(decontaminate.find_contamination(odd, phrases))
    want = by_definition.contamination(ODD_ROWS, [(i, t) for i, t in ITEMS if i is not None])
    got = {(r.doc_id, r.n_words): tuple(r) for r in report.collect()}
    for row in want:
        if row[0] != 7:  # hit by the item without identifier
            assert got[row[0], row[1]] == row
    assert got[7, 1][2:4] == (1, 0)
    assert decontaminate.find_contamination(nothing, phrases).count() == 0
    none = decontaminate.benchmark_phrases(benchmark.where("false"))
    assert decontaminate.find_contamination(odd, none).where("n_hit > 0").count() == 0


def test_spans_cover_the_hit_words(spark):
    benchmark = spark.createDataFrame([("x", "alpha beta")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "é! Alpha  beta, alpha beta gamma")], "doc_id long, text string")
    row = decontaminate.find_contamination(docs, decontaminate.benchmark_phrases(benchmark)).first()
    raw = "é! Alpha  beta, alpha beta gamma".encode()
    assert [raw[s.start : s.end].decode() for s in row.spans] == ["Alpha  beta, alpha beta"]


def test_large_benchmark_is_refused(spark, odd):
    with pytest.raises(ValueError):
        decontaminate.benchmark_phrases(odd.selectExpr("doc_id AS item_id", "text"), most_bytes=10)


def test_decontamination_on_documents(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.contamination_report(decontaminate.find_contamination(docs, decontaminate.benchmark_phrases(benchmark)))
    want = by_definition.contamination([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in benchmark.collect()])
    assert collected(got) == sorted(want, key=repr)


# --- 4 exact


def test_exact_dedup_on_odd_rows(spark, odd, nothing):
    for hot_rows in (512, 1):
        rows = exact_dedup.exact_dedup(odd, hot_rows=hot_rows).collect()
        assert len(rows) == len(ODD_ROWS) and rows[0].norm == "x"
        groups = {}
        import re

        for d, t in ODD_ROWS:
            groups.setdefault(re.sub(exact_dedup.SPACE_RUN, " ", t or ""), []).append(d)
        for r in rows:
            own = groups[re.sub(exact_dedup.SPACE_RUN, " ", r.text or "")]
            ids = [d for d in own if d is not None]
            assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(own))
        assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_hot_group_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same  text' ELSE concat('text ', id) END AS text")
    rows = exact_dedup.exact_dedup(docs, hot_rows=100).collect()
    assert sum(r.kept for r in rows) == 2001 and {r.group_size for r in rows} == {1, 1000}
    assert {r.keep_id for r in rows if r.group_size == 1000} == {0}


# --- 5 order


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(total):
    for key in (1, 99):
        assert sorted(training_order.feistel(np.arange(total), total, key).tolist()) == list(range(total))
    if total > 100:
        assert (training_order.feistel(np.arange(total), total, 1) != training_order.feistel(np.arange(total), total, 2)).any()


def test_training_order_round_trip(spark, odd, nothing, tmp_path):
    path = f"file://{tmp_path}/order"
    rows = training_order.materialise_order(odd, path, length=64, shard_sequences=8).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    slots = {r.slot: np.frombuffer(r.ids, "<u2") for r in training_order.read_slots(spark, path, 0).collect()}
    got = {}
    for r in sorted(rows, key=lambda r: r.seq):
        assert r.shard == r.slot // 8 and r.byte_offset == (r.slot % 8) * 128 and len(slots[r.slot]) == 64
        got.setdefault(r.doc_id, []).append(slots[r.slot][: r.n_ids])
    encoder = Encoder()
    for d, t in ODD_ROWS:
        if d not in (2, None):
            assert np.concatenate(got[d]).tolist() == [*encoder.encode([t or ""])[0].tolist(), 0]
    resumed = training_order.read_slots(spark, path, 5, 20).collect()
    assert sorted(r.slot for r in resumed) == list(range(5, 21)) and all(r.ids == slots[r.slot].tobytes() for r in resumed)
    assert training_order.materialise_order(nothing, f"file://{tmp_path}/none").count() == 0


# --- tokens and 9 packing


def test_encoder_equals_the_library():
    texts = [t for _, t in ODD_ROWS if t] + ["a  b", "\n\n a\n", "don't 's it’s 12ab34", " \t x", "<|endoftext|>", "a\u2028b\u00a0c", "A" * 3000, "\U0001f600 x", "\u0378 unassigned"]
    alphabet = " \t\n ab'é1½!?日\u3000\u00a0́"
    texts += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 12))) for _ in range(3000)]
    encoder = Encoder(most_words=500)
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def check_packing(rows, docs, size):
    import zlib

    encoder, by_seq, by_doc = Encoder(), {}, {}
    for r in rows:
        assert 1 <= r.length <= size
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for d, t in docs:
        own = sorted(by_doc[d], key=lambda r: r.piece)
        ids = np.append(encoder.encode([t or ""])[0], 0).astype("<u4")
        assert [r.length for r in own] == packing.cut_lengths(len(ids), size)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(by_seq)


def test_packing_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd, size=256, block_units=4).collect()
    check_packing(rows, [(d, t) for d, t in ODD_ROWS if d not in (2, None)], 256)
    assert sum(r.doc_id == 2 for r in rows) == 2 * sum(r.doc_id == 1 for r in rows)
    assert packing.pack_documents(nothing).count() == 0


def test_packing_is_close_to_the_least(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_ends_when_no_bin_can_be_filled(spark, monkeypatch):
    text = prose(20)
    n, written = len(Encoder().encode([text])[0]) + 1, []

    def counted(df, label, write=packing.materialise):
        written.append(label)
        assert len(written) < 30
        return write(df, label)

    monkeypatch.setattr(packing, "materialise", counted)
    docs = spark.createDataFrame([(d, text) for d in range(40)], "doc_id long, text string")
    rows = packing.pack_documents(docs, size=n * 3 // 2, block_units=4).collect()
    assert len(rows) == 40 and check_packing(rows, [(d, text) for d in range(40)], n * 3 // 2) == 40


def test_crossover_keeps_every_item():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    a, b = packing.founders(lengths, 100, 2, rng)
    for _ in range(20):
        a, b = b, packing.crossover(a, b, lengths, 100, rng)
        assert sorted(i for x in b for i in x) == list(range(200)) and all(sum(lengths[i] for i in x) <= 100 for x in b)


# --- 6 n-gram join


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    texts = []
    for _ in range(12):
        words = prose(60).split()
        texts.append(" ".join(words))
        for _ in range(random.randint(0, 6)):
            words[random.randrange(60)] = "changed"
            texts.append(" ".join(words))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, texts[0])]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(ngram_join.similar_documents(docs, k, percent, sketch_bits=16)) == sorted(by_definition.similar_classes(rows, k, percent), key=repr)
    # every token counted as frequent: the salted path
    assert collected(ngram_join.similar_documents(docs, k, percent, sketch_bits=16, most_group=1)) == sorted(by_definition.similar_classes(rows, k, percent), key=repr)


def test_ngram_join_on_odd_rows(odd, nothing):
    rows = ngram_join.similar_documents(odd).collect()
    own = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert len(rows) == len(ODD_ROWS) and own[2] == own[3] == 1 and own[9] == 8 and own[4] == 4 and own[5] == 5
    assert ngram_join.similar_documents(nothing).count() == 0


# --- 7 suffixes


@pytest.mark.parametrize("options", [{}, {"most_bucket": 1}, {"chunk": 3}])
def test_repeats_equal_brute_force(spark, options):
    base = "".join(random.choice("ab \n") for _ in range(2500))
    rows = [(1, base), (2, base[500:1200] + "x" * 50 + base[100:320]), (3, None), (4, ""), (5, "z" * 1000), (6, base[:199]), (7, base[:200]), (8, "é" * 150 + base[700:1000]), (9, base[700:1000] + "q"), (9, base[700:1000] + "q"), (10, "ab" * 300), (None, "y" + base[900:1150])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, unit int")
    got = suffix_dedup.removal_report(suffix_dedup.remove_repeats(docs, **options))
    assert collected(got) == sorted(by_definition.repeats(rows, 200), key=repr)
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    base = "".join(random.choice("abcd ") for _ in range(9000))
    rows = [(1, base), (2, "q" * 10 + base[1000:6000] + "r" * 500)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    tool = suffix_dedup.Anchors(200)
    for raw in found:
        parts = list(suffix_dedup._slices([raw.tobytes()], 200))
        assert sum(len(b) - 199 for b, _, _, _ in parts) == len(raw) - 199
        assert all((tool.runs(b, e)["high"] <= len(b) - 200).all() for b, e, _, _ in parts)
    assert collected(suffix_dedup.removal_report(suffix_dedup.remove_repeats(docs))) == sorted(by_definition.repeats(rows, 200), key=repr)


# --- 8 lines


def test_line_alignment_equals_brute_force(spark):
    lines = [prose(10) for _ in range(40)]
    rows = [(1, "\n".join(lines[:20])), (2, "\n".join([prose(9), *lines[5:15], "", *lines[15:18], prose(9)])), (3, "\n".join([lines[9], lines[8], lines[7]])), (4, "\n".join(lines[:20])), (5, "short\nshort\nshort"), (6, "\n".join([lines[1]] * 3)), (7, prose(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_definition.repeated_lines(rows)
    for r in line_dedup.delete_repeated_lines(docs).collect():
        text = dict(rows)[r.doc_id]
        assert r.text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want.get(r.doc_id, ()))
    assert want[4] == set(range(20)) and 7 not in want and 1 not in want


def test_lines_of_odd_rows(odd, nothing):
    rows = line_dedup.delete_repeated_lines(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(r.text == "" for r in rows if r.doc_id == 2) and all(r.text is None for r in rows if r.doc_id == 4)
    assert line_dedup.delete_repeated_lines(nothing).count() == 0


# --- 10 urls


def test_cascade_is_exact(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS key")
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 400, 3)] + [("absent",)], "key string")
    levels = url_filter.cascade(listed, keys, most_wrong=0.8)
    assert len(levels) > 2  # small filters, so that there are false positives to encode
    found = {r.key for r in keys.where(url_filter.is_listed(url_filter.F.col("key"), levels)).collect()}
    assert found == {f"k{i}" for i in range(0, 400, 3)}


def test_url_rules(spark):
    urls = [
        ("http://A.Example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/10?q", "example.org", "/en/10", "example.org/en/1", "block"),
        ("https://example.org/en/2#t", "example.org", "/en/2", "org/", "allow"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("x://m.b.com/fr/", "m.b.com", "/fr/", "com/fr/", "allow"),
        ("x://b.com/de/x/y", "b.com", "/de/x/y", "com/de/", "block"),
        ("x://notcom/fr/", "notcom", "/fr/", None, "allow"),
        ("http://www.spam-farm.example.net/en/1", "www.spam-farm.example.net", "/en/1", None, "block"),
        ("http://spam-farm.example.org/en/7", "spam-farm.example.org", "/en/7", "org/", "allow"),
        (None, "", "", None, "allow"),
        ("no scheme.org/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://org/", "org", "/", "org/", "allow"),
        ("http://org/", "org", "/", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rows = {r.page_id: tuple(r)[1:] for r in url_filter.url_verdicts(pages, spark).collect()}
    assert [rows[i] for i in range(len(urls))] == [u[1:] for u in urls]
    assert url_filter.url_verdicts(pages.where("false"), spark).count() == 0
