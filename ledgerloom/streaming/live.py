"""Structured Streaming versions of stateful operators."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.operators.replay import producer_step
from ledgerloom.sources.storage import new_path


def producer_dedup(commands: DataFrame) -> DataFrame:
    """producer, at, outcome, carried of a stream of commands (producer, at, epoch, seq); a producer's state is two numbers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(("epoch", "seq"), state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("at")  # one producer's commands of one micro-batch
        out = [(key[0], at, *producer_step(held, (epoch, seq))) for at, epoch, seq in rows[["at", "epoch", "seq"]].itertuples(index=False)]
        if held:
            state.update((int(held["epoch"]), int(held["seq"])))
        yield pd.DataFrame(out, columns=["producer", "at", "outcome", "carried"]).astype({"carried": "Int64"})

    return commands.groupBy("producer").applyInPandasWithState(run, "producer long, at long, outcome string, carried long", "epoch long, seq long", "append", "NoTimeout")


def sliding_expiry(touches: DataFrame) -> DataFrame:
    """sid, at, expired of a stream of touches (sid, at, ms, ttl_ms): whether the stream had expired since its last touch; 0 never expires."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at, ms, ttl in pd.concat(list(batches)).sort_values("at")[["at", "ms", "ttl_ms"]].itertuples(index=False):
            out.append((key[0], at, bool(last is not None and ttl and ms >= last + ttl)))
            last = int(ms)
        state.update((last,))
        yield pd.DataFrame(out, columns=["sid", "at", "expired"])

    return touches.groupBy("sid").applyInPandasWithState(run, "sid long, at long, expired boolean", "last long", "append", "NoTimeout")


def run_to_end(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Put rows into a folder, stream all of it through operator with a checkpoint, and read what the sink has.

    All paths lie in the shared folder; the sink commits files atomically, so a restarted query neither loses nor repeats rows.
    """
    spark = rows.sparkSession
    source, sink, marks = (new_path(spark, f"{label}-{part}") for part in ("in", "out", "marks"))
    rows.write.parquet(source)
    stream = operator(spark.readStream.schema(rows.schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
