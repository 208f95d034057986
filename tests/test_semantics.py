"""Small exact cases of scans, pages, merges, forks, codecs and replays, and folds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, frames, text
from ledgerloom.operators import checks, files, kv, logs, replay, streams
from ledgerloom.operators import inspect as look
from ledgerloom.operators.sequences import page_by_bytes, prefix_filter, running_total, successor
from ledgerloom.sources import stores
from ledgerloom.streaming import live


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def log(spark):
    data = [("s", f"item/{c}", i + 1, "put", f"v{c}") for i, c in enumerate("abcde")]
    data += [("s", "other", 6, "put", "o"), ("s2", "item/z", 7, "put", "z"), ("s", "item/b", 8, "put", "v2"), ("s", "item/d", 9, "delete", None)]
    return spark.createDataFrame(data, "partition string, key string, seq long, op string, value string")


def test_state_snapshot_and_scan_bounds(log):
    state = kv.state(log)
    assert rows(state.where("partition = 's'").select("key", "seq")) == [("item/a", 1), ("item/b", 8), ("item/c", 3), ("item/e", 5), ("other", 6)]
    assert rows(kv.state_as_of(log, 7).where("key = 'item/b'").select("value")) == [("vb",)]
    assert rows(kv.scan(state, "s", gte="item/b", lt="item/e").select("key")) == [("item/b",), ("item/c",)]
    assert rows(kv.scan(state, "s", gt="item/b", lte="item/e").select("key")) == [("item/c",), ("item/e",)]
    assert rows(kv.scan(state, "s", prefix="item/").select("key")) == [("item/a",), ("item/b",), ("item/c",), ("item/e",)]
    assert kv.scan(state, "s", gte="x", lt="b").count() == 0


def test_page_cursor(log):
    state = kv.scan(kv.state(log), "s")
    assert rows(kv.page(state.select("key"), 2)) == [("item/a", "item/b"), ("item/b", "item/b")]
    assert {c for _, c in rows(kv.page(state.select("key"), 5))} == {None}
    assert rows(kv.bounded_page(state.select("key", "value"), 200, 1).select("key")) == [("item/a",)]


def test_prefix_successor(spark):
    assert successor("ab") == "ac" and successor("\U0010ffff") is None
    keys = spark.createDataFrame([("ab",), ("abz",), ("ac",), ("aa",)], "key string")
    assert rows(keys.where(prefix_filter("key", "ab"))) == [("ab",), ("abz",)]


def test_merges(spark):
    data = [("k", i, "merge", v) for i, v in enumerate([1, 41, 8])] + [("p", 0, "merge", 5), ("p", 1, "put", 100), ("p", 2, "merge", 1), ("d", 0, "put", 9), ("d", 1, "delete", 0), ("d", 2, "merge", 2), ("gone", 0, "delete", 0)]
    data += [("w", 0, "put", (1 << 63) - 1), ("w", 1, "merge", 1)]
    tail = kv.merge_tail(spark.createDataFrame(data, "key string, seq long, op string, amount long"))
    assert dict(rows(kv.merge_fold(tail, "u64_add"))) == {"k": "50", "p": "101", "d": "2", "w": str(1 << 63)}
    assert dict(rows(kv.merge_fold(tail, "i64_add")))["w"] == -(1 << 63)
    assert dict(rows(kv.merge_fold(tail, "u64_max")))["k"] == 41
    assert dict(rows(kv.merge_fold(tail, "u64_min")))["k"] == 1
    assert dict(rows(kv.merge_fold(tail, "append")))["k"] == "1418"


def test_prefix_compaction(log):
    assert kv.reduced_prefixes(["item/a", "item/ab", "item/c"]) == ["item/a", "item/c"]
    assert rows(kv.compact(kv.state(log), ["item/"]).select("key")) == [("other",)]
    assert kv.compact(log, []).count() == log.count()


def test_transactions(spark):
    times = spark.createDataFrame([(1, 0, 10), (2, 5, 20), (3, 12, 30)], "tx long, begin long, commit long")
    touched = spark.createDataFrame([(1, "a", True), (2, "a", False), (2, "b", True), (3, "b", True)], "tx long, key string, wrote boolean")
    assert rows(kv.write_conflicts_ww(times, touched)) == [(3,)]
    assert rows(kv.write_conflicts_rw(times, touched)) == [(2,), (3,)]


def test_running_total_over_ranges(spark):
    data = [(k, i, (i * 7) % 11) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(data, "k long, i long, v long")
    want, total = {}, {1: 0, 2: 0}
    for k, i, v in data:
        want[k, i] = total[k]
        total[k] += v
    assert {(r.k, r.i): r.t for r in running_total(df, ["k"], "i", "v", "t", chunk=7).collect()} == want


def test_pages_by_bytes(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 5, 600_000), (1, 2, 600_009, 1)], "sid long, seq long, at long, bytes long")
    at = lambda budget: [r.at for r in page_by_bytes(df, ["sid"], "seq", "bytes", budget).orderBy("at").collect()]
    assert at(1) == [0] and at(2) == [0, 5] and at(600_002) == [0, 5, 600_009]


def test_fork_at_an_offset_inside_a_message(spark):
    messages = spark.createDataFrame([(1, 0, "hello", 0), (2, 1, "own", 0), (3, 2, "c", 0)], "sid long, seq long, body string, msg_offset long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "sid long")
    forks = spark.createDataFrame([(2, 1, 3), (3, 2, 10)], "sid long, source long, fork_offset long")
    ranges = streams.lineage(ids, forks)
    read = streams.fork_read(messages, ranges)
    assert rows(read.where("reader = 2").select("start", "seq")) == [(0, 0), (3, 1)]
    assert rows(read.where("reader = 3").select("start", "seq")) == [(0, 0), (10, 2), (3, 1)]
    assert rows(look.logical(messages, ranges, 2, start=1).select("start")) == [(3,)]


def test_parts_round_trip(spark):
    bodies = spark.createDataFrame([(1, "é" * 50), (2, ""), (3, "x" * 16), (4, "x" * 17)], "id long, body string")
    parts = streams.split_parts(bodies, "body", 16)
    assert dict(rows(parts.groupBy("id").count())) == {1: 7, 2: 1, 3: 1, 4: 2}
    assert {r.id: bytes(r.body).decode() for r in streams.join_parts(parts, ["id"]).collect()} == {r.id: r.body for r in bodies.collect()}


def test_reclaim_floor(spark):
    state = spark.createDataFrame([(1, 10, 0), (2, 10, 4), (3, 10, 0)], "sid long, trim long, reclaimed long")
    pins = spark.createDataFrame([(1, 7), (1, 3), (2, 2)], "sid long, start long")
    assert dict(rows(streams.reclaim_floor(state, pins))) == {1: 3, 2: 4, 3: 10}


def test_snapshot_history(spark):
    hour, day = 3_600_000, 86_400_000
    at = [0, hour // 2, day, day + hour // 2, 2 * day, 2 * day + hour // 2, 2 * day + hour]
    snaps = spark.createDataFrame(list(enumerate(at)), "snap_offset long, created_ms long")
    kept = {r[0] for r in logs.kept_history(snaps, [(hour, 2 * hour), (day, 3 * day)], at[-1]).collect()}
    assert {at[i] for i in kept} == {hour // 2, day + hour // 2, 2 * day + hour // 2, 2 * day + hour}


def test_current_snapshot_skips_unreadable_and_deletion_is_sticky(spark):
    index = spark.createDataFrame([("a", 1, 10, False), ("a", 2, None, False), ("b", 1, 5, True), ("b", 2, 9, False)], "base string, at long, snapshot_offset long, deleted boolean")
    assert rows(logs.current_snapshots(index)) == [("a", 10, False), ("b", None, True)]


def test_contiguous_suffix(spark):
    entries = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 12, 15), (1, 15, 20)], "base long, entry_offset long, next_offset long")
    assert rows(logs.contiguous_suffix(entries)) == [(1, 12)]


def test_file_ranges(spark):
    asked = [(-1, 0, None), (3, 2, None), (None, None, -1), (0, 4, None), (8, None, None), (None, None, 3), (10, None, None), (None, None, 0), (2, 99, None)]
    df = spark.createDataFrame(asked, "a long, b long, c long").withColumn("r", files.clamp_range(F.col("a"), F.col("b"), F.col("c"), F.lit(10).cast("long")))
    got = [(r.r.outcome, r.r.first, r.r.last) for r in df.collect()]
    assert got == [("invalid_range", None, None)] * 3 + [("ok", 0, 4), ("ok", 8, 9), ("ok", 7, 9), ("range_not_satisfiable", None, None), ("range_not_satisfiable", None, None), ("ok", 2, 9)]


def test_offset_tokens(spark):
    tokens = ["start", "now", "0000000000000000_0000000000001234", "0000000000000000_123", "0000000000000001_0000000000000001", "0000000000000000_000000000000000a", " 0000000000000000_0000000000000001", ""]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(codecs.parse_offset(F.col("t")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("start", None), ("now", None), ("offset", 1234)] + [("bad_offset", None)] * 5
    assert spark.range(1).select(codecs.offset_token(F.lit(12345678901234567))).first()[0] == "0000000000000000_12345678901234567"


def test_base64url_is_strict(spark):
    values = ["-_8", "-_9", "+/8", "YQ==", "YQ", "", "a"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(codecs.unbase64url(F.col("v")).alias("r")).collect()
    assert [None if r.r is None else bytes(r.r) for r in got] == [b"\xfb\xff", None, None, None, b"a", b"", None]


def test_media_types_and_durations(spark):
    df = spark.createDataFrame([("Text/HTML; q=1", "5ms"), (None, "2h"), ("", "x"), (" a/b ", "10")], "m string, d string")
    got = df.select(codecs.media_type(F.col("m")), codecs.duration_ms(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("text/html", 5), (codecs.OCTET_STREAM, 7_200_000), (codecs.OCTET_STREAM, None), ("a/b", None)]


# XXH64 with seed 0 of the first 0, 1, 2 and 3 of the bytes (i * 7 + 3) mod 256.
HASHES = [17241709254077376921, 2244420788148980662, 17707835710518616835, 3589991498569311433]


def test_hash_vectors(spark):
    texts = ["".join(chr((i * 7 + 3) % 256) for i in range(n)) for n in range(4)]  # below 0x80, so their UTF-8 is the bytes
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("h", codecs.xxh64(F.col("t")))
    got = got.select("i", "h", codecs.unsigned_mod(F.col("h"), 7).alias("m")).orderBy("i").collect()
    assert [r.h % (1 << 64) for r in got] == HASHES and [r.m for r in got] == [h % 7 for h in HASHES]


def test_placement_is_capped_and_stable():
    nodes = ["a", "b", "c"]
    got = checks.placement(64, nodes)
    assert sorted(got) == list(range(64)) and max(list(got.values()).count(n) for n in nodes) <= 22
    assert checks.placement(64, nodes[::-1]) == got and checks.placement(8, []) == {}


def test_json_split():
    assert text.split_array(' [ 1 ,\n{ "a" : [ 2 ] } , "x" ] ') == (["1", '{ "a" : [ 2 ] }', '"x"'], None)
    assert text.split_array("2.50") == (["2.50"], None) and text.split_array("[ ]") == ([], "empty_array")
    for bad in ("", "{", "[1,]", "nope", "[1] [2]", "[NaN]"):
        assert text.split_array(bad) == ([], "invalid_json")
    items, _ = text.split_array('["a,\\"]", {"b": "[,"}, [1, [2]]]')
    assert items == ['"a,\\"]"', '{"b": "[,"}', "[1, [2]]"]


def test_rendering():
    assert text.render(b'a"b') == '"a\\"b"' and text.render(b"ab\xff\x00") == '"ab" ff00' and text.render(b"\xff") == "ff"
    assert text.whole_characters("é日".encode()[1:-1]) == b"" and text.whole_characters(b"ab\xc3") == b"ab" and text.whole_characters("é".encode()) == "é".encode()
    assert text.page_value({"$x": b"\xff", "y": [b"ok"]}) == {"$$x": {"$bytes": "ff"}, "y": ["ok"]}


def test_varuints_and_frames():
    for n, raw in ((0, "00"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001")):
        assert frames.write_varuint(n).hex() == raw and frames.read_varuint(bytes.fromhex(raw), 0) == (n, len(raw) // 2)
    whole = b"".join(frames.write_varuint(len(x)) + x for x in (b"a", b"", b"bc"))
    assert whole.hex() == "016100026263" and [f for f, _ in frames.split_frames(whole)] == [b"a", b"", b"bc"]
    assert frames.split_frames(bytes.fromhex("036162")) == [(None, "truncated")]
    assert frames.split_frames(bytes.fromhex("ff" * 9 + "01")) == [(None, "invalid")]


def test_awareness():
    bad = [(None, None, None, "invalid")]
    assert frames.read_awareness(b"") == bad and frames.read_awareness(b"\x01") == bad and frames.read_awareness(b"\x00\x00") == bad
    assert frames.read_awareness(b"\x00") == []
    assert frames.read_awareness(b"\x01\x07\x02\x04null") == [(7, 2, "null", None)]


def test_producer_table():
    step = lambda state, e, s: replay.producer_step(state, (e, s))
    assert step({}, 0, 3) == ("gap", 0) and step({}, 4, 0) == ("appended", 0)
    held = {"epoch": 2, "seq": 5}
    assert step(dict(held), 1, 9) == ("stale_epoch", 2)
    assert step(dict(held), 3, 1) == ("bad_request", None)
    assert step(dict(held), 3, 0) == ("appended", 0)
    assert step(dict(held), 2, 5) == ("duplicate", 5) and step(dict(held), 2, 6) == ("appended", 6) and step(dict(held), 2, 8) == ("gap", 6)
    assert held == {"epoch": 2, "seq": 5}


def test_batches_apply_wholly_or_not():
    op = lambda kind, key, version=None, absent=False: {"op": kind, "key": key, "if_version": version, "if_absent": absent}
    state = {"check": 1}
    assert replay.batch_step(state, ([op("put", "first"), op("delete", "last", 0), op("check", "missing", 0)], 5)) == ("conflict", "last", None)
    assert state == {"check": 1}
    assert replay.batch_step(state, ([op("put", "a", absent=True), op("check", "check", 1), op("delete", "check")], 6)) == ("ok", None, 6)
    assert state == {"a": 6}


def test_conditional_writes():
    state = {}
    assert replay.cas_step(state, ("put", "absent", None, 1)) == ("ok", 1)
    assert replay.cas_step(state, ("put", "absent", None, 2)) == ("conflict", 1)
    assert replay.cas_step(state, ("put", "version", 1, 3)) == ("ok", 3)
    assert replay.cas_step(state, ("delete", "version", 1, 4)) == ("conflict", 3)
    assert replay.cas_step(state, ("delete", "none", None, 5)) == ("ok", None)


def test_stream_replay_outcomes():
    state = {}
    run = lambda *c: replay.append_step(state, c)[0]
    none = (None, None, None, None)
    assert run("append", "j", *none, 5, False) == "not_found"
    assert run("create", "j", *none, 0, False) == "created" and run("create", "j", *none, 0, False) == "exists" and run("create", "t", *none, 0, False) == "conflict"
    assert run("append", "t", *none, 5, False) == "content_type_mismatch" and run("append", "j", *none, 0, False) == "bad_request"
    assert run("append", "j", "w", 0, 0, "b", 5, False) == "appended" and run("append", "j", "w", 0, 0, "c", 5, False) == "duplicate"
    assert run("append", None, "w", 0, 1, "b", 5, False) == "stream_seq_conflict" and run("append", None, "w", 0, 1, "c", 5, False) == "appended"
    assert run("append", "j", "v", 0, 1, None, 5, False) == "gap" and run("append", "j", "v", 0, 0, None, 5, False) == "appended"  # producers are apart
    assert run("close", "j", *none, 0, False) == "closed_now" and run("append", "t", "w", 9, 9, "a", 5, False) == "closed" and state["tail"] == 27
    assert run("close", "j", *none, 0, False) == "already_closed" and run("append", "j", *none, 0, True) == "already_closed"


def test_what_closed_a_stream_is_a_duplicate_when_sent_again():
    state = {}
    run = lambda *c: replay.append_step(state, c)
    run("create", "j", None, None, None, None, 0, False)
    assert run("append", "j", "w", 1, 0, None, 3, False) == ("appended", 7, 0)
    assert run("close", None, "w", 0, 0, None, 0, False) == ("stale_epoch", 7, 1) and run("close", None, "w", 1, 2, None, 0, False) == ("gap", 7, 1)
    assert run("close", None, "w", 1, 0, None, 0, False) == ("duplicate", 7, 0)  # seen before, so the stream stays open
    assert run("append", "j", "w", 1, 1, None, 3, True) == ("appended", 14, 1)
    assert run("append", "j", "w", 1, 1, None, 3, True) == ("duplicate", 14, 1) == run("close", None, "w", 1, 1, None, 0, False)
    assert run("close", None, "w", 1, 2, None, 0, False) == ("closed", 14, None) and run("append", "j", "x", 1, 1, None, 3, False)[0] == "closed"
    assert run("create", "j", None, None, None, None, 0, False)[0] == "conflict"  # not created closed


def test_lifecycles():
    state = {}
    run = lambda *c: replay.lifecycle_step(state, c)[0]
    assert run("read", 0, None, None) == "not_found" and run("create", 0, "j", 10) == "created" and run("create", 1, "j", 10) == "exists" and run("create", 1, "j", None) == "conflict"
    assert run("read", 9_000, None, None) == "read" and run("read", 18_999, None, None) == "read" and run("read", 28_999, None, None) == "not_found"
    assert run("create", 30_000, "t", None) == "created" and run("fork", 30_001, None, None) == "forked" and run("delete", 30_002, None, None) == "soft_deleted"
    assert run("read", 30_003, None, None) == "gone" and run("create", 30_003, "t", None) == "conflict" and run("unfork", 30_004, None, None) == "reclaimed"
    assert run("unfork", 30_004, None, None) == "not_found" and run("create", 30_005, "j", 1) == "created" and run("delete", 30_006, None, None) == "deleted"
    assert run("create", 40_000, "j", 1) == "created" and run("fork", 40_001, None, None) == "forked" and run("read", 41_001, None, None) == "gone"


def test_expiry_index_moves_once_in_a_tenth():
    state = {}
    assert [replay.expiry_index_step(state, (ms, 10)) for ms in (0, 999, 1000, 1500, 2000)] == [(True, 10_000), (False, 10_000), (True, 11_000), (False, 11_000), (True, 12_000)]


def test_fold_equals_plain_python(spark):
    rng = random.Random(5)
    commands = [(rng.randrange(4), at, rng.randrange(3), rng.randrange(4)) for at in range(400)]
    df = spark.createDataFrame(commands, "producer long, at long, epoch long, seq long")
    states, want = {}, []
    for p, at, epoch, seq in commands:
        want.append((p, at, *replay.producer_step(states.setdefault(p, {}), (epoch, seq))))
    assert rows(replay.fold(df, ["producer"], ["at"], ["epoch", "seq"], replay.producer_step, "outcome string, carried long")) == sorted(want, key=repr)
    assert rows(live.run_to_end(df, live.producer_dedup, "test-dedup")) == sorted(want, key=repr)


def test_claims_and_append_batches():
    state = {}
    assert [replay.claim_step(state, c)[0] for c in (("c1", "p"), ("c1", "p"), ("c2", "p"), ("c3", "q"))] == ["granted", "renewed", "taken_over", "refused"]
    state = {}
    assert [replay.batching_step(state, c)[0] for c in ((0, 1), (9, 1), (10, 1), (11, 300_000), (12, 1))] == [0, 0, 1, 1, 2]


def test_histogram_and_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (0.001, 0.002, 0.3, 20.0)], "k string, v double")
    got = {r.le: r.n for r in checks.histogram(df, ["k"], "v").collect()}
    assert got["0.001"] == 1 and got["0.0025"] == 2 and got["10.0"] == 3 and got["+Inf"] == 4
    assert {r.p: r.v for r in checks.percentiles(df, ["k"], "v", [50.0, 99.0]).collect()} == {50.0: 0.002, 99.0: 20.0}


def test_bank(spark):
    moved = spark.createDataFrame([(1, 0, 1, 7)], "bank long, source long, destination long, amount long")
    assert [r.expected for r in checks.bank_balances(moved).orderBy("account").collect()] == [993, 1007, 1000, 1000]


def test_stores(spark, log, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x00\x01")
    assert [(r.size, bytes(r.body)) for r in stores.objects(spark, f"file://{tmp_path}", "*.bin").collect()] == [(2, b"\x00\x01")]
    marks = spark.createDataFrame([("early", 3), ("late", 8)], "name string, max_seq long")
    assert stores.read_checkpoint(log, marks, "early").count() == 3 and stores.read_checkpoint(log, marks, "none").count() == 0
    assert stores.clone(log, 2, log.where("seq = 9")).count() == 3
    path = f"file://{tmp_path}/log"
    stores.write_by_shard(log, path, "partition", "key")
    assert spark.read.parquet(path).count() == log.count()


def test_inspection_forms(spark, log):
    assert rows(look.scan(log, "s", "item/", limit=2, after="item/a").select("key")) == [("item/b",), ("item/c",)]
    assert rows(look.get(log, "s", "item/b", 1, 9).select("part", "at", "full_size")) == [("2", 1, 2)]
    assert rows(look.get(log, "s", "item/b", 9).select("part", "at")) == [("", 9)]
    assert rows(look.partitions(log)) == [("s",), ("s2",)]
    assert rows(look.home({"kv": (log, "partition")})) == [("kv", "s", 8), ("kv", "s2", 1)]
    bodies = spark.createDataFrame([("p", "1", "hello")], "partition string, id string, body string")
    assert [bytes(r.part) for r in look.object_range(bodies, "1", 1, 2).collect()] == [b"el"]
    assert rows(look.file_page(bodies, "p")) == [("1", 5, "inline")]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "partition string, key string, seq long, op string, value string")
    assert kv.state(nothing).count() == 0 and kv.page(kv.state(nothing).select("key"), 5).count() == 0
    commands = spark.createDataFrame([], "producer long, at long, epoch long, seq long")
    assert replay.fold(commands, ["producer"], ["at"], ["epoch", "seq"], replay.producer_step, "outcome string, carried long").count() == 0
