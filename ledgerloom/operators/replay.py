"""Commands replayed in order: what each did, given all before it that were accepted.

A rejected command must not change the state, so these are folds. Rows are dealt by key and sorted, and one task streams through its
keys with the state of the current one: a key may have any number of commands. Data outcomes are rows, never exceptions.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[dict, tuple], tuple]


def fold(commands: DataFrame, keys: list[str], order: list[str], fields: list[str], step: Step, out: str) -> DataFrame:
    """keys, order and what step(state, fields of the command) returns (columns in the DDL string out), for every command.

    state is a dict that step changes; it is empty at the first command of a key. Commands of equal order follow each other in any order.
    """
    types = dict(commands.dtypes)
    names = [c.split()[0] for c in out.split(", ")]
    schema = ", ".join([*(f"{c} {types[c]}" for c in [*keys, *order]), out])
    columns = [*keys, *order, *fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for batch in batches:
            rows = []
            for row in batch[columns].astype(object).where(batch[columns].notna(), None).itertuples(index=False, name=None):
                key = row[: len(keys)]
                if key != current:
                    current, state = key, {}
                rows.append((*row[: len(keys) + len(order)], *step(state, row[len(keys) + len(order) :])))
            yield pd.DataFrame(rows, columns=[*keys, *order, *names])

    return commands.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def producer_step(state: dict, command: tuple) -> tuple:
    """(epoch, seq) of a producer: appended, duplicate, gap, stale_epoch or bad_request, with the number that the outcome carries."""
    epoch, seq = command
    if "epoch" not in state:
        if seq != 0:
            return "gap", 0
    elif epoch < state["epoch"]:
        return "stale_epoch", state["epoch"]
    elif epoch > state["epoch"]:
        if seq != 0:
            return "bad_request", None
    elif seq <= state["seq"]:
        return "duplicate", state["seq"]
    elif seq > state["seq"] + 1:
        return "gap", state["seq"] + 1
    state.update(epoch=epoch, seq=seq)
    return "appended", seq


def cas_step(state: dict, command: tuple) -> tuple:
    """(op, condition, expected, seq) on one key: condition none, absent or version. Outcome and the version afterwards."""
    op, condition, expected, seq = command
    now = state.get("version")
    if (condition == "absent" and now is not None) or (condition == "version" and now != expected):
        return "conflict", now
    if op == "delete":
        state.pop("version", None)
        return "ok", None
    state["version"] = seq
    return "ok", seq


def batch_step(state: dict, command: tuple) -> tuple:
    """(ops, seq): ops is a list of {op, key, if_version, if_absent}; conditions see the state before the batch, the first failure wins."""
    ops, seq = command
    for op in ops:
        now = state.get(op["key"])
        if (op["if_absent"] and now is not None) or (op["if_version"] is not None and op["if_version"] != now):
            return "conflict", op["key"], now
    for op in ops:
        if op["op"] == "put":
            state[op["key"]] = seq
        elif op["op"] == "delete":
            state.pop(op["key"], None)
    return "ok", None, seq


def append_step(state: dict, command: tuple) -> tuple:
    """(op, content_type, producer, epoch, producer_seq, stream_seq, bytes, close) on one stream: outcome, tail, and the number echoed.

    op is create, append or close; an append may close too, and without a body it must. Checks come in a fixed order: open, content type,
    producer, stream sequence. Every producer has its own epoch and number. What closed the stream is a duplicate when it is sent again.
    """
    op, content_type, producer, epoch, seq, stream_seq, size, close = command
    if op == "create":
        if state:
            return ("exists" if state["content_type"] == content_type and not state["closed"] else "conflict"), state["tail"], None
        state.update(content_type=content_type, tail=0, closed=False, closed_by=None, producers={}, stream_seq=None)
        return "created", 0, None
    if not state:
        return "not_found", None, None
    tail, close = state["tail"], op == "close" or bool(close)
    size = 0 if op == "close" else size
    if not size and not close:
        return "bad_request", tail, None
    sender = None if producer is None else (producer, epoch, seq)
    if state["closed"]:
        if sender is not None and sender == state["closed_by"]:
            return "duplicate", tail, seq
        return ("already_closed" if not size and sender is None else "closed"), tail, None
    if size and content_type is not None and content_type != state["content_type"]:
        return "content_type_mismatch", tail, None
    own = dict(state["producers"].get(producer, {}))
    if sender is not None:
        outcome, number = producer_step(own, (epoch, seq))
        if outcome != "appended":
            return outcome, tail, number
    if size and stream_seq is not None:
        if state["stream_seq"] is not None and stream_seq <= state["stream_seq"]:
            return "stream_seq_conflict", tail, None
        state["stream_seq"] = stream_seq
    if sender is not None:
        state["producers"][producer] = own
    if close:
        state.update(closed=True, closed_by=sender)
    if size:
        state["tail"] += 4 + size
    return ("appended" if size else "closed_now"), state["tail"], None if sender is None else seq


def lifecycle_step(state: dict, command: tuple) -> tuple:
    """(op, ms, content_type, ttl_s) on one path: create, read, delete, fork (a child pins it) or unfork. Outcome and the number of forks.

    A sliding time to live ends a stream ttl_s after its last access. A stream that ends or is deleted while forks pin it is gone: it
    can't be read, and its path can't be used again, until the last fork goes.
    """
    op, ms, content_type, ttl_s = command
    if state and not state["gone"] and state["ttl_s"] and ms >= state["accessed"] + state["ttl_s"] * 1000:
        _end(state)
    if op == "unfork":
        if not state or not state["forks"]:
            return "not_found", 0
        state["forks"] -= 1
        left, reclaimed = state["forks"], state["gone"] and not state["forks"]
        if reclaimed:
            state.clear()
        return ("reclaimed" if reclaimed else "unforked"), left
    if op == "create":
        if not state:
            state.update(content_type=content_type, ttl_s=ttl_s, accessed=ms, forks=0, gone=False)
            return "created", 0
        same = not state["gone"] and (state["content_type"], state["ttl_s"]) == (content_type, ttl_s)
        return ("exists" if same else "conflict"), state["forks"]
    if not state:
        return "not_found", 0
    if state["gone"]:
        return "gone", state["forks"]
    if op == "delete":
        forks = state["forks"]
        _end(state)
        return ("soft_deleted" if forks else "deleted"), forks
    state["accessed"] = ms
    if op == "fork":
        state["forks"] += 1
    return ("forked" if op == "fork" else "read"), state["forks"]


def _end(state: dict) -> None:
    if state["forks"]:
        state["gone"] = True
    else:
        state.clear()


def expiry_index_step(state: dict, command: tuple) -> tuple:
    """(ms, ttl_s): whether an access moves the expiry index, and the deadline there; it moves at most once in a tenth of the time to live."""
    ms, ttl_s = command
    due = ms + ttl_s * 1000
    moved = not state or due - state["due"] >= ttl_s * 100
    if moved:
        state["due"] = due
    return moved, state["due"]


def claim_step(state: dict, command: tuple) -> tuple:
    """(connection, principal) claims a client id: free and own ids are granted, the same principal takes over, others are refused."""
    connection, principal = command
    if state and state["principal"] != principal:
        return "refused", state["connection"]
    outcome = "granted" if not state else "renewed" if state["connection"] == connection else "taken_over"
    state.update(connection=connection, principal=principal)
    return outcome, connection


def batching_step(state: dict, command: tuple, most_ms: int = 10, most_bytes: int = 262_144) -> tuple:
    """(ms, bytes): the number of the append batch; one closes most_ms after its first update, or at most_bytes."""
    ms, size = command
    if state and (ms - state["begin"] >= most_ms or state["bytes"] >= most_bytes):
        state.update(number=state["number"] + 1, begin=ms, bytes=0)
    elif not state:
        state.update(number=0, begin=ms, bytes=0)
    state["bytes"] += size
    return (state["number"],)
