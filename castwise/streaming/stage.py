"""The stage as a stream: presence changes from moves that come in any order, one state per play.

Same rules as operators.presence.  A move is kept until the watermark has passed its time, so that none
before it can still come; then a play's kept moves are taken in order of pos.  The state of a play that
has been silent for ``idle`` of event time is dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUT = "play_id string, pos long, char_id string, on int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(stage: set, kind: str, who: set, corresp: set) -> set:
    """Who is on stage after a move."""
    if kind == "onStage":
        return stage | who if who else set()
    if kind == "entrance":
        return stage | who
    if kind == "exit":
        return stage - who
    return (stage - who) | corresp if kind in ("split", "merge") else stage


class Stage(StatefulProcessor):
    """Keeps moves until they are final, and who is on stage after the last final one."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at long, pos long, type string, who array<string>, corresp array<string>")
        self.stage = handle.getValueState("stage", "here array<string>, last long")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for pdf in rows:
            many = lambda x: [] if x is None else list(x)
            new += [(int(at), int(pos), kind or "", many(who), many(corresp)) for at, pos, kind, who, corresp in zip(pdf["at"], pdf["pos"], pdf["type"], pdf["who"], pdf["corresp"], strict=True)]
        self.kept.appendList(new)
        times = {m[0] for m in new}
        for at in times | {max(times) + self.idle}:
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=["play_id", "pos", "char_id", "on"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out = timerValues.getCurrentWatermarkInMs(), []
        here, last = self.stage.get() if self.stage.exists() else ([], 0)
        kept = list(self.kept.get()) if self.kept.exists() else []
        ready = sorted((m for m in kept if m[0] <= now), key=lambda m: m[1])
        stage = set(here)
        for at, pos, kind, who, corresp in ready:
            after = step(stage, kind, set(who), set(corresp))
            out += [(key[0], pos, c, int(c in after)) for c in sorted(stage ^ after)]
            stage, last = after, max(last, at)
        if ready:
            self.stage.update((sorted(stage), last))
            kept = [m for m in kept if m[0] > now]
            self.kept.put(kept) if kept else self.kept.clear()
        if not kept and last + self.idle <= now:
            self.stage.clear()
        yield pd.DataFrame(out, columns=["play_id", "pos", "char_id", "on"])

    def close(self) -> None:
        pass


def presence_changes(moves: DataFrame, late: str = "10 minutes", idle_hours: int = 24) -> DataFrame:
    """play_id, pos, char_id, on (1: comes, 0: goes) of a streaming table of moves with their event time, ts, which rises with pos.

    Moves may come up to ``late`` out of order, across batches as well; later ones are left out by the
    watermark.  State is kept by RocksDB, which the session's stateStore.providerClass must name (a local session is set here).
    """
    spark = moves.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(name, ROCKS)
    elif "RocksDB" not in spark.conf.get(name, ""):
        raise RuntimeError(f"{name} must be {ROCKS}")
    rows = moves.withWatermark("ts", late).select("play_id", F.col("pos").cast("long").alias("pos"), "type", "who", "corresp", F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("play_id").transformWithStateInPandas(Stage(idle_hours * 3_600_000), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def unit_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling units over event time: rows and words per unit, closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no longer gap between them: start, end, rows and words, closed by the watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "value")
