"""Replays of whole tables against plain Python that keeps histories instead of states."""

from collections import defaultdict

from ledgerloom.plans import check_queries as Q
from ledgerloom.sources.tables import kv_log


def by_key(df, key, order):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r[order]):
        out[tuple(r[k] for k in key)].append(r)
    return out


def test_conditional_writes(spark, sf_dir):
    log = by_key(kv_log(spark, sf_dir).select("partition", "key", "seq", "op", "amount"), ["partition", "key"], "seq")
    got = {(r.partition, r.key, r.seq): (r.outcome, r.current) for r in Q.kv_cas_replay(spark, sf_dir).collect()}
    for (partition, key), rows in log.items():
        done = []  # accepted writes: (version, deleted)
        for r in rows:
            now = None if not done or done[-1][1] else done[-1][0]
            kind = r.amount % 3
            refused = (kind == 0 and now is not None) or (kind == 1 and now != r.seq - r.amount * 50)
            if not refused:
                done.append((r.seq, r.op == "delete"))
            want = ("conflict", now) if refused else ("ok", None if r.op == "delete" else r.seq)
            assert got[partition, key, r.seq] == want
    assert len(got) == sum(map(len, log.values())) and len(set(got.values())) > 3


def test_producers(spark, sf_dir):
    commands = by_key(Q.producer_commands(spark, sf_dir), ["producer"], "at")
    got = {(r.producer, r["at"]): r.outcome for r in Q.producer_dedup(spark, sf_dir).collect()}
    for (producer,), rows in commands.items():
        accepted = []  # (epoch, seq)
        for r in rows:
            epochs = [e for e, _ in accepted]
            of_epoch = [s for e, s in accepted if e == r.epoch]
            if epochs and r.epoch < max(epochs):
                want = "stale_epoch"
            elif not of_epoch:
                want = "appended" if r.seq == 0 else "bad_request" if epochs else "gap"
            else:
                want = "duplicate" if r.seq in of_epoch or r.seq < max(of_epoch) else "appended" if r.seq == max(of_epoch) + 1 else "gap"
            if want == "appended":
                accepted.append((r.epoch, r.seq))
            assert got[producer, r["at"]] == want


def test_appends(spark, sf_dir):
    commands = by_key(Q._stream_commands(spark, sf_dir), ["sid"], "at")
    got = {(r.sid, r["at"]): (r.outcome, r.tail) for r in Q.stream_append_replay(spark, sf_dir).collect()}
    seen = set()
    for (sid,), rows in commands.items():
        created, stored, closing = None, [], None  # stored: accepted appends and closes
        for r in rows:
            size = 0 if r.op == "close" else r.bytes
            close = r.op == "close" or r.close
            tail = sum(4 + s.bytes for s, _ in stored if s.op == "append" and s.bytes)
            mine = [s.producer_seq for s, _ in stored if s.producer == r.producer]
            if r.op == "create":
                want = "created" if created is None else "exists" if created == r.content_type and not closing else "conflict"
                created = created or r.content_type
                tail = tail if want != "created" else 0
            elif created is None:
                want, tail = "not_found", None
            elif not size and not close:
                want = "bad_request"
            elif closing:
                again = r.producer and (closing.producer, closing.epoch, closing.producer_seq) == (r.producer, r.epoch, r.producer_seq)
                want = "duplicate" if again else "closed" if size or r.producer else "already_closed"
            elif size and r.content_type != created:
                want = "content_type_mismatch"
            elif r.producer and r.producer_seq <= max(mine, default=-1) and mine:
                want = "duplicate"
            elif r.producer and r.producer_seq != max(mine, default=-1) + 1:
                want = "gap"
            elif size and r.stream_seq and any(s.stream_seq and s.op == "append" and s.bytes and s.stream_seq >= r.stream_seq for s, _ in stored):
                want = "stream_seq_conflict"
            else:
                want = "appended" if size else "closed_now"
                stored.append((r, close))
                closing = r if close else None
                tail += 4 + size if size else 0
            seen.add(want)
            assert got[sid, r["at"]] == (want, tail), (sid, r)
    assert {"appended", "duplicate", "gap", "closed", "closed_now", "conflict", "exists", "bad_request", "content_type_mismatch"} <= seen
