"""Structure from streams: stateful event logs, late bars, idempotent sinks.

Each stream's state is its fold, kept between micro-batches; a micro-batch's bars are folded
in order of time. Bars not later than the last one folded are late: they are not folded, but
handed on as ``late_bar`` rows for a dead-letter table. Events can be taken back later, so
sinks are keyed by batch: a repeated batch replaces itself, and readers take the last word
of each subject.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.events import SCHEMA, EventFold, current
from barloom.operators.layers import Settings, _bars
from barloom.session import ship_package

_COLUMNS = ["stream_id", *[c.split()[0] for c in SCHEMA.split(", ")]]


def stream_events(bars: DataFrame, settings: Settings = Settings(), upper: bool = True) -> DataFrame:
    """Events of a streaming table of bars (stream_id, ts, open, high, low, close), as events.event_log gives them.

    Rows of kind ``late_bar`` (layer ``late``) carry bars that came too late.
    """
    ship_package(bars.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, last = pickle.loads(state.get[0]) if state.exists else (EventFold(settings, upper), None)
        rows = pd.concat(list(batches)).sort_values("ts_us", kind="stable")
        repeated = rows.duplicated("ts_us", keep="last")
        late = repeated | (rows["ts_us"] <= last if last is not None else False)
        out = [(key[0], "late", -1, t / 1e6, -1, "late_bar", "", 0, t, json.dumps({"ts_us": t})) for t in rows.loc[late, "ts_us"].tolist()]
        rows = rows[~late]
        out += [(key[0], *row) for row in fold.push(rows)]
        if len(rows):
            last = int(rows["ts_us"].iloc[-1])
        state.update((pickle.dumps((fold, last)),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    return _bars(bars).groupBy("stream_id").applyInPandasWithState(step, f"stream_id string, {SCHEMA}", "fold binary", "append", GroupStateTimeout.NoTimeout)


def deduplicated(bars: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A streaming table of bars without repeats of a (stream_id, ts) that come within ``lateness``; older ones are dropped by the watermark."""
    return bars.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["stream_id", "ts"]).drop("event_time")


def to_log(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of events under ``path``, a folder a micro-batch; a batch that is run again overwrites its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(query: StreamingQuery) -> dict:
    """What a stream has done so far: bars and number of its recent micro-batches, and how long the last one took."""
    known = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p) for p in query.recentProgress]
    last = known[-1] if known else {}
    return {
        "bars_processed": sum(int(p.get("numInputRows", 0)) for p in known), "batches": len(known),
        "last_process_duration_ms": float(last.get("durationMs", {}).get("triggerExecution", 0.0)), "last_batch_at": last.get("timestamp"),
    }


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events written so far, without late bars."""
    return spark.read.parquet(path).drop("batch").where("layer <> 'late'")


def standing(spark: SparkSession, path: str) -> DataFrame:
    """What stands now: the last event of each subject that was not taken back."""
    return current(read_log(spark, path))


def upsert_bars(bars: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of bars into an upsert table (see sources.tables.read_upserted)."""
    return to_log(bars, path, checkpoint, **trigger)
