"""Segmentation of the interleaved stream of moves and speeches, and folds of segments.

moves: play_id, pos, type, who, corresp, stage_pos, large_pos, middle_pos
speeches: play_id, pos, who, word_count, large_pos, middle_pos
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import STRUCTURAL
from .order import scanned
from .presence import on_stage_within


def _empty_on_stage() -> Column:
    return (F.col("type") == "onStage") & (F.size(F.coalesce("who", F.array().cast("array<string>"))) == 0)


def interleaved(moves: DataFrame, speeches: DataFrame) -> DataFrame:
    units = [c for c in ("large_pos", "middle_pos") if c in moves.columns]
    m = moves.select("play_id", "pos", "type", "who", "stage_pos", *units, F.lit(None).cast("long").alias("word_count"))
    s = speeches.select("play_id", "pos", F.lit("speech").alias("type"), "who", F.lit(None).cast("long").alias("stage_pos"), *units, F.col("word_count").cast("long").alias("word_count"))
    return m.unionByName(s)


def assigned(moves: DataFrame, speeches: DataFrame, presence: DataFrame, long: bool = False) -> DataFrame:
    """The stream with seg_id: a beat with a structural move opens a segment, or the first speech with none open.

    A leading empty onStage is segment 1 by itself; a closing one on an empty stage opens
    nothing; rows before any segment belong nowhere and are left out.  ``long``: a play may be as long as the table.
    """
    ends = moves.groupBy("play_id").agg(F.min("pos").alias("first"), F.max("pos").alias("final"))
    m = moves.join(ends, "play_id").withColumn("marker", (F.col("pos") == F.col("first")) & _empty_on_stage())
    beat = Window.partitionBy("play_id", F.coalesce("stage_pos", -1 - F.col("pos")))  # without a stage direction, a move is a beat by itself
    m = m.withColumn("structural", F.max(F.col("type").isin(*STRUCTURAL)).over(beat))
    closing = m.where((F.col("pos") == F.col("final")) & _empty_on_stage() & ~F.col("marker")).select("play_id", "pos")
    p = presence.select(F.col("play_id").alias("_play"), "start_pos", "end_pos")
    full = closing.join(p, (F.col("play_id") == F.col("_play")) & (F.col("start_pos") < F.col("pos")) & (F.col("end_pos").isNull() | (F.col("end_pos") >= F.col("pos"))), "left_semi")
    bare = closing.join(full.select("play_id"), "play_id", "left_anti").select("play_id", F.col("pos").alias("bracket"))
    lagged = scanned(m.where("NOT marker").select("play_id", "pos", "stage_pos", "structural"), ["play_id"], ["pos"], {"lagged": ("lag", "stage_pos")}, long)
    opens = F.col("structural") & (F.col("lagged").isNull() | F.col("stage_pos").isNull() | (F.col("stage_pos") != F.col("lagged")))
    flags = lagged.select("play_id", "pos", opens.cast("int").alias("opens"))
    stream = interleaved(moves, speeches).join(m.where("marker").select("play_id", F.col("pos").alias("marker_pos")), "play_id", "left")
    stream = stream.join(flags, ["play_id", "pos"], "left").join(bare, "play_id", "left").withColumn("opens", F.coalesce("opens", F.lit(0)))
    rest = stream.where("marker_pos IS NULL OR pos <> marker_pos")
    begun = (F.col("type") == "speech") | (F.col("opens") > 0)
    rest = scanned(rest, ["play_id"], ["pos"], {"begun": ("sum", begun.cast("int"))}, long)
    open_before = F.col("begun") > 0
    first_speech = (F.col("type") == "speech") & ~open_before
    flag = F.when(F.col("bracket").isNotNull() & (F.col("pos") == F.col("bracket")) & open_before, 0).when(first_speech, 1).otherwise(F.col("opens"))
    shift = F.col("marker_pos").isNotNull().cast("int")
    rest = scanned(rest.withColumn("flag", flag), ["play_id"], ["pos"], {"so_far": ("sum", "flag")}, long)
    rest = rest.withColumn("seg_id", F.col("so_far") + F.col("flag")).where("seg_id > 0").withColumn("seg_id", (F.col("seg_id") + shift).cast("long"))
    marker = stream.where("pos = marker_pos").withColumn("seg_id", F.lit(1).cast("long"))
    keep = ["play_id", "pos", "type", "who", "word_count", "seg_id", *(c for c in ("large_pos", "middle_pos") if c in stream.columns)]
    return rest.select(*keep).unionByName(marker.select(*keep))


def sd_segments(stream: DataFrame) -> DataFrame:
    """One row per segment of assigned(): bounds, words, speeches, crossings and the opening item's units."""
    units = [F.min_by(c, "pos").alias(c) for c in ("large_pos", "middle_pos") if c in stream.columns]
    return stream.groupBy("play_id", "seg_id").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("word_count"),
        F.count_if(F.col("type") == "speech").alias("num_speeches"), F.count_if(F.col("type") == "crossing").alias("num_crossings"), *units,
    )


def segment_speakers(stream: DataFrame) -> DataFrame:
    """play_id, seg_id, char_id, words: textless speeches count as well."""
    s = stream.where((F.col("type") == "speech") & F.col("seg_id").isNotNull())
    return s.select("play_id", "seg_id", F.explode("who").alias("char_id"), "word_count").groupBy("play_id", "seg_id", "char_id").agg(F.sum("word_count").alias("words"))


def sd_cast(stream: DataFrame, presence: DataFrame, long: bool = False) -> DataFrame:
    """play_id, seg_id, char_id: on stage after the segment's last row, or speaking in it."""
    ends = stream.groupBy("play_id", "seg_id").agg(F.max("pos").alias("last"))
    # after the last row: an end at that row is before it
    here = on_stage_within(ends.withColumn("first", F.col("last") + 1), presence, long)
    return here.unionByName(segment_speakers(stream).select("play_id", "seg_id", "char_id")).distinct()


def unit_stream(moves: DataFrame, speeches: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """The keyed part of the stream with seg_id by declared units (pos); content without unit is left out."""
    ids = units.withColumn("seg_id", F.row_number().over(Window.partitionBy("play_id").orderBy("pos")).cast("long")).select("play_id", F.col("pos").alias(unit), "seg_id")
    return interleaved(moves, speeches).join(ids, ["play_id", unit])


def unit_segments(stream: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """One row per declared unit, also if it holds nothing."""
    ids = units.withColumn("seg_id", F.row_number().over(Window.partitionBy("play_id").orderBy("pos")).cast("long")).select("play_id", "seg_id", F.col("pos").alias(unit))
    return ids.join(sd_segments(stream).select("play_id", "seg_id", "start_pos", "end_pos", "word_count", "num_speeches", "num_crossings"), ["play_id", "seg_id"], "left").fillna(0, ["word_count", "num_speeches", "num_crossings"])


def unit_cast(stream: DataFrame, presence: DataFrame) -> DataFrame:
    """play_id, seg_id, char_id: on stage at any moment of the unit, or speaking in it."""
    spans = stream.groupBy("play_id", "seg_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    here = on_stage_within(spans, presence)
    return here.select("play_id", "seg_id", "char_id").unionByName(segment_speakers(stream).select("play_id", "seg_id", "char_id")).distinct()


def silent_present(cast: DataFrame, speakers: DataFrame) -> DataFrame:
    return cast.join(speakers.select("play_id", "seg_id", "char_id"), ["play_id", "seg_id", "char_id"], "left_anti")


def active_span(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """The segments between the first and the last with a cast, empty ones inside included."""
    ends = cast.groupBy("play_id").agg(F.min("seg_id").alias("_a"), F.max("seg_id").alias("_b"))
    return segments.join(ends, "play_id").where("seg_id BETWEEN _a AND _b").drop("_a", "_b")


def cast_sets(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """play_id, seg_id, members: a sorted array for every segment."""
    sets = cast.groupBy("play_id", "seg_id").agg(F.array_sort(F.collect_set("char_id")).alias("members"))
    return segments.select("play_id", "seg_id").join(sets, ["play_id", "seg_id"], "left").withColumn("members", F.coalesce("members", F.array().cast(sets.schema["members"].dataType)))


def equality_fold(sets: DataFrame) -> DataFrame:
    """play_id, seg_id, fold_id: maximal runs of neighbours with equal members share a fold_id, from 1."""
    w = Window.partitionBy("play_id").orderBy("seg_id")
    new = F.coalesce((F.lag("members").over(w) != F.col("members")).cast("int"), F.lit(1))
    return sets.withColumn("_new", new).withColumn("fold_id", F.sum("_new").over(w).cast("long")).drop("_new")


#: Run starts that the fold's state holds in one array before it is set aside: adding one never copies all.
STARTS = 256


def speaking_fold(sets: DataFrame, speakers: DataFrame) -> DataFrame:
    """play_id, seg_id, fold_id under the speaking model.

    Blocks of equal members are joined left to right while both sides of every boundary
    in the run are empty or both are not, and nobody who crosses a boundary of the run
    speaks in it.
    """
    folds = equality_fold(sets).select("play_id", "seg_id", "fold_id", "members")
    said = speakers.groupBy("play_id", "seg_id").agg(F.collect_set("char_id").alias("said"))
    return speaking_runs(folds.join(said, ["play_id", "seg_id"], "left"))


def speaking_runs(folds: DataFrame) -> DataFrame:
    """speaking_fold() of segments with fold_id (their block), members and said (null: nobody).

    Two neighbours that can't be joined by themselves are never in one run, so a play falls into sections at
    such boundaries, wherever its runs begin.  The blocks of a section are folded by one aggregate, whose
    state is the run so far.
    """
    none = F.array().cast(folds.schema["members"].dataType)
    blocks = folds.groupBy("play_id", "fold_id").agg(F.first("members").alias("members"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("said", none)))).alias("said"))
    w = Window.partitionBy("play_id").orderBy("fold_id")
    told = blocks.withColumn("last", F.lag("members").over(w)).withColumn("before", F.lag("said").over(w))
    told = told.withColumn("moved", F.coalesce(F.array_union(F.array_except("members", "last"), F.array_except("last", "members")), none))
    apart = F.col("last").isNull() | ((F.size("members") > 0) != (F.size("last") > 0)) | F.arrays_overlap("moved", "said") | F.arrays_overlap("moved", "before")
    told = told.withColumn("section", F.sum(apart.cast("long")).over(w)).select("play_id", "section", F.struct("fold_id", "moved", "said").alias("block"))

    def join(s: Column, b: Column) -> Column:
        crossing, heard = F.array_union(s["crossers"], b["moved"]), F.array_union(s["voices"], b["said"])
        cut = (F.size(s["now"]) == 0) | F.arrays_overlap(crossing, heard)
        full = F.size(s["now"]) >= STARTS
        own = F.array(b["fold_id"])
        return F.struct(
            F.when(cut, none).otherwise(crossing).alias("crossers"), F.when(cut, b["said"]).otherwise(heard).alias("voices"),
            F.when(full & cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(~cut, s["now"]).when(full, own).otherwise(F.concat(s["now"], own)).alias("now"),
        )

    start = F.struct(none.alias("crossers"), none.alias("voices"), F.array().cast("array<array<bigint>>").alias("done"), F.array().cast("array<bigint>").alias("now"))
    sections = told.groupBy("play_id", "section").agg(F.array_sort(F.collect_list("block")).alias("_b"))
    folded = F.aggregate("_b", start, join, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))
    # a section of one block starts one run, and nothing need be folded
    starts = sections.select("play_id", F.explode(F.when(F.size("_b") == 1, F.array(F.get("_b", F.lit(0))["fold_id"])).otherwise(folded)).alias("fold_id"), F.lit(1).alias("_starts"))
    runs = blocks.select("play_id", "fold_id").join(starts, ["play_id", "fold_id"], "left").select("play_id", "fold_id", F.count("_starts").over(w).cast("long").alias("_run"))
    return folds.join(runs, ["play_id", "fold_id"]).select("play_id", "seg_id", F.col("_run").alias("fold_id"))


def folded(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of segments re-keyed to the folded segments (a bag: nothing is merged)."""
    return rows.join(folds.select("play_id", "seg_id", "fold_id"), ["play_id", "seg_id"]).drop("seg_id").withColumnRenamed("fold_id", "seg_id")
