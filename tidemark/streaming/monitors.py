"""Stateful monitors: event rates and hash chains, a state a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import ZERO_HASH, entry_hash


def rate_monitor(events: DataFrame, key: str, ts: str, width: int, alert_at: int = 10) -> DataFrame:
    """(key, ts, event_count, alert) of each event: events in [ts - width, ts] so far, itself included.

    An event older than the last one of its key gives -1 and is not recorded. State is the times inside the window.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = []
        for t in sorted(int(x) for f in frames for x in f[ts]):
            if held and t < held[-1]:
                rows.append((k[0], t, -1, False))
                continue
            held.append(t)
            while held[0] < t - width:
                held.pop(0)
            rows.append((k[0], t, len(held), len(held) >= alert_at))
        state.update((held,))
        yield pd.DataFrame(rows, columns=["key", "ts", "event_count", "alert"])

    kind = dict(events.dtypes)[key]
    return events.select(key, ts).groupBy(key).applyInPandasWithState(step, f"key {kind}, ts long, event_count long, alert boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def chain_monitor(entries: DataFrame, chain_id: str, ts: str, path: str) -> StreamingQuery:
    """Writes (chain, chain_seq, reason) of each entry as it comes to ``path``/out: null for a sound one, else SEQUENCE, LINK, HASH or TIME.

    Entries of a micro-batch may come in any order and from any number of files: a sort, which spills, puts each chain in
    order, and no chain is held in memory. State is the last sequence number, hash and time of each chain, of this
    micro-batch and the one before; a micro-batch that comes again replaces what it wrote.
    """
    order = ["chain_seq", "ts", "prev_hash", "chain_hash"]

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(chain_id).alias("chain"), "chain_seq", F.col(ts).alias("ts"), "prev_hash", "data_hash", "chain_hash", F.lit(True).alias("new"))
        if number:
            held = batch.sparkSession.read.parquet(f"{path}/state-{(number - 1) % 2}").select("chain", "last.*", F.lit(False).alias("new"))
            rows = rows.unionByName(held, allowMissingColumns=True)
        seen = Window.partitionBy("chain").orderBy("new", *order)
        before = lambda c, first: F.when(F.row_number().over(seen) == 1, F.lit(first)).otherwise(F.lag(c).over(seen))
        fails = lambda right: ~F.coalesce(right, F.lit(False))
        reason = (
            F.when(fails(F.col("chain_seq") == before("chain_seq", -1) + 1), "SEQUENCE")
            .when(fails(F.col("prev_hash") == before("chain_hash", ZERO_HASH)), "LINK")
            .when(fails(F.col("chain_hash") == entry_hash(F.col("chain_seq"), F.col("ts"), F.col("prev_hash"), F.col("data_hash"))), "HASH")
            .when(F.col("ts") < F.lag("ts").over(seen), "TIME")
        )
        rows.withColumn("reason", reason).filter("new").select("chain", "chain_seq", "reason").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        last = F.max_by(F.struct("chain_seq", "ts", "chain_hash"), F.struct("new", *order))
        rows.groupBy("chain").agg(last.alias("last")).write.mode("overwrite").parquet(f"{path}/state-{number % 2}")

    return entries.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def on_alert(monitored: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands the alerts of each micro-batch to ``handler``, which may halt what it watches."""
    return monitored.writeStream.foreachBatch(lambda batch, n: handler(batch.filter("alert"), n)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
