"""partOf: closure, targets, projection of casts onto wholes, absorption of silent parts.

relations: play_id, part, whole (direct), and n, their order, if known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pin import written


def closure(relations: DataFrame) -> DataFrame:
    """play_id, part, whole, depth (shortest way) over ways of any length; cycles end, and no one is part of itself.

    Each round joins ways to ways, so a chain of n steps takes about log2 n rounds; it ends when a round finds no new pair.
    """
    ways = written(relations.where("part <> whole").select("play_id", "part", "whole").distinct().withColumn("depth", F.lit(1)))
    known = ways.count()
    while True:
        further = ways.select("play_id", F.col("part").alias("whole"), F.col("whole").alias("top"), F.col("depth").alias("more"))
        longer = ways.join(further, ["play_id", "whole"]).where("part <> top").select("play_id", "part", F.col("top").alias("whole"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = written(ways.unionByName(longer).groupBy("play_id", "part", "whole").agg(F.min("depth").alias("depth")))
        before, known = known, ways.count()
        if known == before:
            return ways


def chains(relations: DataFrame) -> DataFrame:
    """play_id, part, whole, depth along the chains in which a part's last relation counts (without n: the largest whole)."""
    n = F.col("n") if "n" in relations.columns else F.col("whole")
    return closure(relations.groupBy("play_id", "part").agg(F.max_by("whole", n).alias("whole")))


def targets(relations: DataFrame, groups: DataFrame | None = None, chained: DataFrame | None = None) -> DataFrame:
    """play_id, part, whole: the highest (selected) whole on each part's chain (``chained``: chains(relations), if known)."""
    rows = chains(relations) if chained is None else chained
    if groups is not None:
        rows = rows.join(groups.select("play_id", F.col("char_id").alias("whole")).distinct(), ["play_id", "whole"], "left_semi")
    w = Window.partitionBy("play_id", "part").orderBy(F.desc("depth"), "whole")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("play_id", "part", "whole")


def undeclared(relations: DataFrame, characters: DataFrame) -> DataFrame:
    """play_id, char_id of wholes that nobody declares: what aggregation makes up (and warns of)."""
    return relations.select("play_id", F.col("whole").alias("char_id")).distinct().join(characters.select("play_id", "char_id"), ["play_id", "char_id"], "left_anti")


def groups(relations: DataFrame, characters: DataFrame) -> DataFrame:
    """Declared wholes, which can stand for their parts."""
    return relations.select("play_id", F.col("whole").alias("char_id")).distinct().join(characters.select("play_id", "char_id"), ["play_id", "char_id"], "left_semi")


def projected(rows: DataFrame, target: DataFrame, distinct: bool = True) -> DataFrame:
    """rows with char_id replaced by its target; sets stay sets."""
    t = target.select("play_id", F.col("part").alias("char_id"), "whole")
    out = rows.join(t, ["play_id", "char_id"], "left").withColumn("char_id", F.coalesce("whole", "char_id")).drop("whole").select(*rows.columns)
    return out.distinct() if distinct else out


def aggregated_characters(characters: DataFrame, target: DataFrame, heard: DataFrame) -> DataFrame:
    """play_id, char_id, is_mute, is_collective, is_chorus, made_up after everyone's parts have become their wholes.

    Parts go; a whole is collective, and a chorus if it or any part is; a whole that nobody declares is made up
    as a chorus.  Mute is who has no speech (heard: play_id, char_id) of its own or of a part.
    """
    to = target.select("play_id", F.col("part").alias("char_id"), "whole")
    named = F.coalesce("whole", "char_id").alias("char_id")
    one = characters.join(to, ["play_id", "char_id"], "left").select("play_id", named, "is_collective", "is_chorus", F.col("whole").isNotNull().alias("_part"))
    wholes = target.select("play_id", F.col("whole").alias("char_id")).distinct().withColumn("_whole", F.lit(True))
    voices = heard.join(to, ["play_id", "char_id"], "left").select("play_id", named).distinct().withColumn("_heard", F.lit(True))
    own = one.groupBy("play_id", "char_id").agg(F.max("is_collective").alias("is_collective"), F.max("is_chorus").alias("is_chorus"), F.min("_part").alias("_none"))
    rows = own.join(wholes, ["play_id", "char_id"], "full").join(voices, ["play_id", "char_id"], "left")
    whole, made_up = F.col("_whole").isNotNull(), F.coalesce("_none", F.lit(True))
    return rows.select("play_id", "char_id", F.col("_heard").isNull().alias("is_mute"), (whole | F.col("is_collective")).alias("is_collective"), (made_up | F.col("is_chorus")).alias("is_chorus"), made_up.alias("made_up"))


def silent_parts(characters: DataFrame, target: DataFrame) -> DataFrame:
    """play_id, part, whole: mute parts whose top whole is declared and speaks."""
    mute = characters.where("is_mute").select("play_id", F.col("char_id").alias("part"))
    heard = characters.where("NOT is_mute").select("play_id", F.col("char_id").alias("whole"))
    return target.join(mute, ["play_id", "part"], "left_semi").join(heard, ["play_id", "whole"], "left_semi").select("play_id", "part", "whole")
