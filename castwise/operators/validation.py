"""Checks that tell and never reject: one table of issues (play_id, code, source_line, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .presence import off_stage, presence_intervals

# The tokens of a move's state, by axis; the last axis is for crossings only.
AXES = {
    "location": ("stage", "voice-only"),
    "visibility": ("unhidden", "hidden"),
    "capacity": ("awake", "asleep"),
    "vitality": ("alive", "dead"),
    "engagement": ("aware", "unaware"),
    "crossing": ("fetch-prop", "signal-off"),
}


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def move_issues(moves: DataFrame) -> DataFrame:
    ana, kind = F.coalesce("ana", F.array().cast("array<string>")), F.col("type")
    known, crossing = _array(t for a in AXES.values() for t in a), _array(AXES["crossing"])
    told = lambda code, when, tokens=ana: F.when(when, F.struct(F.lit(code).alias("code"), F.concat_ws(" ", kind, F.array_join(F.array_sort(tokens), " ")).alias("detail")))
    checks = [
        told("legacy-subtype", F.col("legacy")),
        told("unknown-token", F.size(F.array_except(ana, known)) > 0, F.array_except(ana, known)),
        told("state-on-crossing", (kind == "crossing") & (F.size(F.array_except(ana, crossing)) > 0), F.array_except(ana, crossing)),
        told("crossing-token", (kind != "crossing") & (F.size(F.array_intersect(ana, crossing)) > 0), F.array_intersect(ana, crossing)),
        told("tokens-forbidden", kind.isin("exit", "merge", "split") & (F.size(ana) > 0)),
        told("tokens-missing", kind.isin("state-change", "crossing") & (F.size(ana) == 0)),
        *(told(f"axis-conflict-{name}", F.size(F.array_intersect(ana, _array(t))) > 1, F.array_intersect(ana, _array(t))) for name, t in AXES.items()),
    ]
    return moves.select("play_id", "source_line", F.explode(F.array_compact(F.array(*checks))).alias("x")).select("play_id", "x.code", "source_line", "x.detail")


def issues(t: dict[str, DataFrame]) -> DataFrame:
    """All checks over the tables of sources.tei.tables()."""
    moves, speeches, characters = t["moves"], t["speeches"], t["characters"]
    row = lambda df, code, detail: df.select("play_id", F.lit(code).alias("code"), F.col("source_line").cast("long").alias("source_line"), detail.cast("string").alias("detail"))
    used = reduce(DataFrame.unionByName, [df.select("play_id", "source_line", F.explode(c).alias("char_id")) for df, c in ((moves, "who"), (moves, "corresp"), (speeches, "who"), (speeches, "to_whom"))])
    undeclared = used.join(characters.select("play_id", "char_id"), ["play_id", "char_id"], "left_anti")
    here = presence_intervals(moves)
    changes = moves.where("type = 'state-change'").select("play_id", "pos", "source_line", F.explode("who").alias("char_id"))
    said = speeches.select("play_id", "pos", "source_line", F.explode("who").alias("char_id"))
    declared = t["units"].select("play_id", "level").distinct()

    def before_first(level: str) -> DataFrame:
        loose = speeches.where(F.col(f"{level}_pos").isNull()).select("play_id", F.lit(1).alias("n"), "word_count").unionByName(moves.where(F.col(f"{level}_pos").isNull()).select("play_id", F.lit(1).alias("n"), F.lit(0).cast("long").alias("word_count")))
        loose = loose.join(declared.where(F.col("level") == level), "play_id", "left_semi").groupBy("play_id").agg(F.sum("n").alias("n"), F.sum("word_count").alias("w"))
        return loose.select("play_id", F.lit(f"before-first-{level}").alias("code"), F.lit(None).cast("long").alias("source_line"), F.format_string("%d items, %d words", "n", "w").alias("detail"))

    inside = moves.select("play_id", "middle_pos", "large_pos").unionByName(speeches.select("play_id", "middle_pos", "large_pos")).where("middle_pos IS NOT NULL")
    straddling = inside.groupBy("play_id", "middle_pos").agg(F.size(F.collect_set(F.coalesce("large_pos", F.lit(-1)))).alias("n")).where("n > 1")
    bare = moves.where("bare").groupBy("play_id").agg(F.count("*").alias("n"), F.min("source_line").alias("source_line"))
    dropped = t["relations"].where("NOT declared")
    nameless = t["plays"].where("NOT has_work_id")
    nowhere = F.lit(None).cast("long").alias("source_line")
    every = [
        move_issues(moves),
        row(undeclared, "undeclared-id", F.col("char_id")),
        row(off_stage(changes, here, before=True), "state-change-absent", F.col("char_id")),
        row(off_stage(said, here), "speech-off-stage", F.col("char_id")),
        before_first("large"), before_first("middle"),
        straddling.select("play_id", F.lit("unit-straddles").alias("code"), nowhere, F.col("middle_pos").cast("string").alias("detail")),
        row(bare, "bare-moves", F.col("n")),
        dropped.select("play_id", F.lit("relation-dropped").alias("code"), nowhere, F.concat_ws(" ", "name", "part", "whole").alias("detail")),
        nameless.select("play_id", F.lit("no-work-id").alias("code"), nowhere, F.col("path").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, every)
