"""Who is on stage: set-valued state as intervals, without a sequential fold.

moves: play_id, pos, type, who array, corresp array.  Entrance and onStage add who; exit
takes who away; split and merge take who away, then add corresp; an onStage without who
clears the stage; other types change nothing.  Each move becomes events of characters; the
last event decides, so an interval is what lies between two changes of one character:
on stage after pos p means start_pos <= p < end_pos (null end: to the end of the play).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import scanned


def nearest(points: DataFrame, marks: DataFrame, name: str, value: str, after: bool, strict: bool = False, pos: str = "pos", long: bool = False) -> DataFrame:
    """points with ``name``: the ``value`` of the nearest of marks (play_id, at, value) at or after, or at or before, the position.

    An as-of join as one scan over both tables: each play is sorted once and no pairs are tried.
    ``strict``: a mark at the position itself doesn't count.  marks' values ascend with at.
    """
    rows = points.withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_at", F.col(pos).cast("long")).withColumn("_point", F.lit(True))
    told = marks.select("play_id", F.col("at").cast("long").alias("_at"), F.col(value).alias("_mark"), F.lit(False).alias("_point"))
    # marks at the position itself come before it if they are to count among those before, or not among those after
    tie = F.col("_point") == (after == strict)
    both = rows.unionByName(told, allowMissingColumns=True).withColumn("_tie", tie)
    best = scanned(both, ["play_id"], ["_at", "_tie", "_mark"], {name: ("next" if after else "last", "_mark")}, long)
    return best.where("_point").drop("_mark", "_at", "_point", "_tie")


def state_events(moves: DataFrame, long: bool = False) -> DataFrame:
    """play_id, char_id, pos, on (1 or 0); a cleared stage ends only what is open there, so clearings don't multiply characters."""
    one = moves.select("play_id", "pos", "type", F.coalesce("who", F.array().cast("array<string>")).alias("who"), F.coalesce("corresp", F.array().cast("array<string>")).alias("corresp"))
    swap = F.col("type").isin("split", "merge")
    added = one.select("play_id", "pos", F.explode(F.when(F.col("type").isin("entrance", "onStage"), F.col("who")).when(swap, F.col("corresp"))).alias("char_id"), F.lit(1).alias("on"))
    gone = one.select("play_id", "pos", F.explode(F.when(F.col("type") == "exit", F.col("who")).when(swap, F.array_except("who", "corresp"))).alias("char_id"), F.lit(0).alias("on"))
    clears = one.where((F.col("type") == "onStage") & (F.size("who") == 0)).select("play_id", F.col("pos").alias("at"))
    own = nearest(added.unionByName(gone), clears, "cleared", "at", after=True, strict=True, long=long)
    swept = scanned(own, ["play_id", "char_id"], ["pos"], {"_next": ("lead", "pos")}, long).where("on = 1 AND cleared IS NOT NULL AND (_next IS NULL OR cleared < _next)")
    return own.drop("cleared").unionByName(swept.select("play_id", F.col("cleared").alias("pos"), "char_id", F.lit(0).alias("on")))


def presence_intervals(moves: DataFrame, long: bool = False) -> DataFrame:
    """play_id, char_id, start_pos, end_pos; adjacent intervals are one.  ``long``: a play may be as long as the table."""
    key = ["play_id", "char_id"]
    told = scanned(state_events(moves, long), key, ["pos"], {"was": ("lag", "on")}, long).where("on <> coalesce(was, 0)")
    ended = scanned(told, key, ["pos"], {"end_pos": ("lead", "pos")}, long)
    return ended.where("on = 1").select(*key, F.col("pos").alias("start_pos"), "end_pos")


def on_stage_within(spans: DataFrame, presence: DataFrame, long: bool = False) -> DataFrame:
    """play_id, seg_id, char_id for spans (play_id, seg_id, first, last; ids and places ascend) that meet a character's interval.

    An interval meets the spans from the first that ends at or after its start to the last that
    begins before its end, so two as-of lookups replace a range join and rows are only made for results.
    """
    begins = nearest(presence, spans.select("play_id", F.col("last").alias("at"), "seg_id"), "_a", "seg_id", after=True, pos="start_pos", long=long)
    far = begins.withColumn("_end", F.coalesce(F.col("end_pos").cast("long"), F.lit(1 << 62)))
    both = nearest(far, spans.select("play_id", F.col("first").alias("at"), "seg_id"), "_b", "seg_id", after=False, pos="_end", long=long).where("_a <= _b")
    return both.select("play_id", F.explode(F.sequence("_a", "_b")).alias("seg_id"), "char_id")


def off_stage(points: DataFrame, presence: DataFrame, before: bool = False, long: bool = False) -> DataFrame:
    """points (play_id, pos, char_id) whose character is not on stage; before: judged before the position."""
    changes = presence.select("play_id", "char_id", F.col("start_pos").alias("pos"), F.lit(1).alias("_on")).unionByName(presence.where("end_pos IS NOT NULL").select("play_id", "char_id", F.col("end_pos").alias("pos"), F.lit(0).alias("_on")))
    rows = points.withColumn("_point", F.lit(True)).unionByName(changes.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    tie = F.col("_point") if not before else ~F.col("_point")
    rows = rows.withColumn("_at", F.col("pos").cast("long")).withColumn("_tie", tie)
    told = scanned(rows, ["play_id", "char_id"], ["_at", "_tie"], {"_state": ("last", "_on")}, long)
    return told.where("_point AND coalesce(_state, 0) = 0").select(*points.columns)
