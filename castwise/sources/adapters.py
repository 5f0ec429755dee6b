"""Tables of other shape read as plays.

A  orders: play = customer's nation and order year, segment = order, character = supplier,
   words = quantity of lines where a line was returned (such suppliers speak).
B  events: play = day, position = row by time, character = user_id % 12; sign-ups enter,
   errors leave, purchases set or clear the stage, clicks are speeches; hours are middle
   units and six hours large ones.
D  events once more, as whole plays: as B, but sign-ups with k % 6 = 1 merge and errors with
   k % 6 = 0 split (into the next character), characters over 8 are mute, some speeches are
   joint (k % 7 = 0) or of a group (k % 5 = 0), and partOf joins characters to groups.
C  conversations: play = conversation, segment = turn, character = role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import word_count
from ..operators.order import numbered
from ..plans.pin import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A: play_id, o_orderdate, o_orderkey and these columns of every line of an order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *columns)
    play = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.year("o_orderdate").cast("string")).alias("play_id")
    heads = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(play, "o_orderdate", "o_orderkey")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))


def order_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: play_id, seg_id, char_id, words, speaks."""
    said = F.max(F.col("l_returnflag") == "R")
    rows = order_lines(spark, sf_dir, "l_suppkey", "l_quantity", "l_returnflag").groupBy("play_id", "o_orderdate", "o_orderkey", F.col("l_suppkey").alias("char_id")).agg(F.sum("l_quantity").cast("long").alias("quantity"), said.alias("speaks"))
    seg = F.dense_rank().over(Window.partitionBy("play_id").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return rows.select("play_id", seg.alias("seg_id"), "char_id", F.when(F.col("speaks"), F.col("quantity")).otherwise(0).alias("words"), "speaks")


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: play_id, members (the different characters, null among them) of every segment; lines meet by order only, so they are shuffled once."""
    members = F.collect_set(F.struct("l_suppkey"))["l_suppkey"].alias("members")
    return order_lines(spark, sf_dir, "l_suppkey").groupBy("play_id", "o_orderdate", "o_orderkey").agg(members).select("play_id", "members")


def order_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: play_id, members (part: a supplier, whole: its nation, top: its region, as order_relations() names them) of every segment; lines meet by order only."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    wholes = supplier.select("s_suppkey", (F.col("s_nationkey") + 100000).cast("long").alias("whole"))
    tops = nation.select((F.col("n_nationkey") + 100000).cast("long").alias("whole"), (F.col("n_regionkey") + 200000).cast("long").alias("top"))
    lines = order_lines(spark, sf_dir, "l_suppkey").join(wholes.join(tops, "whole", "left"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    members = F.collect_set(F.struct(F.col("l_suppkey").cast("long").alias("part"), "whole", "top")).alias("members")
    return lines.groupBy("play_id", "o_orderdate", "o_orderkey").agg(members).select("play_id", "members")


def order_segments(cast: DataFrame) -> DataFrame:
    last = Window.partitionBy("play_id")
    s = cast.groupBy("play_id", "seg_id").agg(F.sum("words").alias("word_count"))
    return s.withColumn("is_initial", F.col("seg_id") == 1).withColumn("is_final", F.col("seg_id") == F.max("seg_id").over(last))


def order_relations(spark: SparkSession, sf_dir: str, cast: DataFrame) -> DataFrame:
    """A: supplier -> its nation (100000 + key) -> its region (200000 + key), in every play of the supplier."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    parts = cast.select("play_id", "char_id").distinct().join(supplier.select("s_suppkey", "s_nationkey"), F.col("char_id") == F.col("s_suppkey"))
    first = parts.select("play_id", F.col("char_id").alias("part"), (F.col("s_nationkey") + 100000).cast("long").alias("whole"))
    up = nation.select((F.col("n_nationkey") + 100000).cast("long").alias("part"), (F.col("n_regionkey") + 200000).cast("long").alias("whole"))
    second = first.select("play_id", F.col("whole").alias("part")).distinct().join(up, "part").select("play_id", "part", "whole")
    return first.unionByName(second)


def order_characters(spark: SparkSession, sf_dir: str, cast: DataFrame) -> DataFrame:
    """A: play_id, char_id, is_mute, is_collective, is_chorus, sex_class, nature_class (from account and key)."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    mute = cast.groupBy("play_id", "char_id").agg((~F.max("speaks")).alias("is_mute"))
    k = F.col("char_id")
    return mute.join(supplier, k == F.col("s_suppkey")).select(
        "play_id", "char_id", "is_mute", (k % 7 == 0).alias("is_collective"), (k % 10 == 0).alias("is_chorus"),
        F.when(F.col("s_acctbal") < 0, "unspecified").when(k % 3 == 0, "female").when(k % 3 == 1, "male").otherwise("mixed").alias("sex_class"),
        F.when(k % 5 == 0, "divine").when(k % 5 == 1, "animal").when(k % 5 == 2, "concept").when(k % 5 == 3, "human").otherwise("other").alias("nature_class"),
    )


def event_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B: moves and speeches."""
    return event_tables(table(spark, sf_dir, "events"))


def one_long_play(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B: all events as moves and speeches of one play."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "user_id", "value", "props")
    placed = numbered(events, "ts", "event_id", name="pos").withColumn("pos", F.col("pos").cast("int"))
    return event_tables(placed, F.lit("all"), F.col("pos"))


def event_tables(events: DataFrame, day: Column | None = None, pos: Column | None = None) -> tuple[DataFrame, DataFrame]:
    k = F.get_json_object("props", "$.k").cast("long")
    who = F.array((F.col("user_id") % 12).cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd") if day is None else day
    pos = F.row_number().over(Window.partitionBy(day).orderBy("ts", "event_id")) if pos is None else pos
    rows = events.select(
        day.alias("play_id"), pos.alias("pos"), "event_type", k.alias("k"), who.alias("who"),
        F.floor("value").cast("long").alias("word_count"), F.hour("ts").cast("long").alias("middle_pos"), F.floor(F.hour("ts") / 6).cast("long").alias("large_pos"),
    )
    kind = F.when(F.col("event_type") == "signup", "entrance").when(F.col("event_type") == "error", "exit").when(F.col("event_type") == "purchase", "onStage").otherwise(F.when(F.col("k") % 2 == 1, "crossing").otherwise("state-change"))
    nobody = F.array().cast("array<string>")
    moves = rows.where("event_type <> 'click'").select("play_id", "pos", kind.alias("type"), F.when((F.col("event_type") == "purchase") & (F.col("k") % 10 == 0), nobody).otherwise(F.col("who")).alias("who"), nobody.alias("corresp"), F.col("pos").cast("long").alias("stage_pos"), "large_pos", "middle_pos")
    return moves, rows.where("event_type = 'click'").select("play_id", "pos", "who", "word_count", "large_pos", "middle_pos")


def event_checks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """E: B with what the checks look at: a line per row, state tokens, bare and legacy moves (from k), large units from six o'clock on
    and middle ones of four hours from four on, characters under 9 declared, one dropped relation, and no work id on odd days.
    """
    from ..operators.validation import AXES

    k, hour = F.get_json_object("props", "$.k").cast("long"), F.hour("ts")
    day = F.date_format("ts", "yyyy-MM-dd")
    at = F.row_number().over(Window.partitionBy(day).orderBy("ts", "event_id"))
    told = table(spark, sf_dir, "events").select(day.alias("play_id"), at.alias("pos"), k.alias("k"), F.when(hour >= 6, F.floor(hour / 6)).cast("long").alias("large_pos"), F.when(hour >= 4, F.floor(hour / 4)).cast("long").alias("middle_pos"))
    told = told.withColumn("source_line", (10 * F.col("pos")).cast("long"))
    moves, speeches = (x.drop("large_pos", "middle_pos").join(told, ["play_id", "pos"]) for x in event_stream(spark, sf_dir))
    tokens = F.array(*(F.lit(t) for axis in AXES.values() for t in axis))
    one = lambda i: F.get(tokens, (F.col("k") + i) % 12)
    kind = F.col("k") % 4
    ana = F.when(kind == 0, F.array(one(0))).when(kind == 1, F.array(one(0), one(1))).when(kind == 2, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    moves = moves.withColumn("ana", ana).withColumn("legacy", F.col("k") % 9 == 0).withColumn("bare", F.col("k") % 5 == 0)
    other = F.array(((F.element_at("who", 1).cast("int") + 1) % 12).cast("string"))
    speeches = speeches.withColumn("to_whom", F.when(F.col("k") % 3 == 0, other).otherwise(F.array().cast("array<string>")))
    plays = told.select("play_id").distinct()
    units = [told.where(F.col(f"{level}_pos").isNotNull()).select("play_id", F.lit(level).alias("level"), F.col(f"{level}_pos").alias("pos")).distinct() for level in ("large", "middle")]
    related = F.array(*(F.struct(F.lit("partOf").alias("name"), F.lit(a).alias("part"), F.lit(b).alias("whole"), F.lit(d).alias("declared")) for a, b, d in (("0", "1", True), ("9", "nobody", False))))
    return {
        "moves": moves, "speeches": speeches, "units": units[0].unionByName(units[1]),
        "characters": plays.select("play_id", F.explode(_ids(*range(9))).alias("char_id")), "relations": plays.select("play_id", F.explode(related).alias("r")).select("play_id", "r.*"),
        "plays": plays.select("play_id", (F.substring("play_id", -1, 1).cast("int") % 2 == 0).alias("has_work_id"), F.concat("play_id", F.lit(".xml")).alias("path")),
    }


def event_units(moves: DataFrame, speeches: DataFrame, unit: str) -> DataFrame:
    return moves.select("play_id", F.col(unit).alias("pos")).unionByName(speeches.select("play_id", F.col(unit).alias("pos"))).distinct()


def conversation_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: play_id, seg_id, char_id, words."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("play_id"), F.col("turn").alias("seg_id"), F.col("role").alias("char_id"), word_count(F.col("text")).alias("words"))


def _ids(*numbers: int):
    return F.array(*(F.lit(str(n)) for n in numbers))


def event_plays(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """D: the tables of a corpus, as sources.tei.tables gives them."""
    k = F.get_json_object("props", "$.k").cast("long")
    day = F.date_format("ts", "yyyy-MM-dd")
    ch = F.col("user_id") % 12
    rows = table(spark, sf_dir, "events").select(
        day.alias("play_id"), F.row_number().over(Window.partitionBy(day).orderBy("ts", "event_id")).alias("pos"), "event_type", k.alias("k"), ch.alias("ch"),
        F.floor("value").cast("long").alias("word_count"), F.hour("ts").cast("long").alias("middle_pos"), F.floor(F.hour("ts") / 6).cast("long").alias("large_pos"),
    )
    is_ = lambda kind: F.col("event_type") == kind
    spoken = is_("click") & (F.col("ch") < 9)
    kind = (
        F.when(is_("signup"), F.when(F.col("k") % 6 == 1, "merge").otherwise("entrance")).when(is_("error"), F.when(F.col("k") % 6 == 0, "split").otherwise("exit"))
        .when(is_("purchase"), "onStage").when(spoken, "speech").when(F.col("k") % 2 == 1, "crossing").otherwise("state-change")
    )
    own, nobody = F.array(F.col("ch").cast("string")), F.array().cast("array<string>")
    group = F.when(F.col("ch") == 0, "women").when(F.col("ch") == 3, "chorus")
    who = (
        F.when(is_("purchase") & (F.col("k") % 10 == 0), nobody).when(spoken & (F.col("k") % 5 == 0) & F.col("ch").isin(0, 3), F.array(group))
        .when(spoken & (F.col("k") % 7 == 0) & (F.col("ch") != 1), F.concat(own, _ids(1))).otherwise(own)
    )
    rows = written(rows.select("*", kind.alias("type"), who.alias("who")))  # every table of the corpus is read from them
    swap = F.when(F.col("type").isin("split", "merge"), F.array(((F.col("ch") + 1) % 12).cast("string"))).otherwise(nobody)
    moves = rows.where("type <> 'speech'").select("play_id", "pos", "type", "who", swap.alias("corresp"), F.col("pos").cast("long").alias("stage_pos"), "large_pos", "middle_pos")
    speeches = rows.where("type = 'speech'").select("play_id", "pos", "who", "word_count", "large_pos", "middle_pos")
    unit = lambda level, name: rows.select("play_id", F.lit(level).alias("level"), F.col(f"{level}_pos").alias("pos"), F.concat(F.lit(name), F.col(f"{level}_pos").cast("string")).alias("xml_id"), F.lit("part").alias("type")).distinct()
    plays = rows.select("play_id").distinct()
    names = plays.select("play_id", F.explode(F.concat(_ids(*range(12)), F.array(F.lit("women"), F.lit("chorus")))).alias("char_id"))
    heard = speeches.select("play_id", F.explode("who").alias("char_id")).distinct().withColumn("_heard", F.lit(True))
    people = names.join(heard, ["play_id", "char_id"], "left").select(
        "play_id", "char_id", F.concat(F.lit("No. "), "char_id").alias("name_en"), F.lit("").alias("name_grc"), F.when(F.col("char_id").isin("0", "1", "2", "women"), "female").when(F.col("char_id") == "11", "").otherwise("male").alias("sex"),
        F.when(F.col("char_id") == "10", "divine").otherwise("human").alias("nature"), F.col("_heard").isNull().alias("is_mute"), F.col("char_id").isin("women", "chorus").alias("is_collective"), (F.col("char_id") == "chorus").alias("is_chorus"),
    )
    ways = F.array(*(F.struct(F.lit(a).alias("part"), F.lit(b).alias("whole")) for a, b in EVENT_PARTS))
    part_of = plays.select("play_id", F.explode(ways).alias("w")).select("play_id", "w.part", "w.whole")
    about = plays.select("play_id", F.concat(F.lit("Day "), "play_id").alias("title_en"), F.concat(F.lit("Author "), F.substring("play_id", -1, 1)).alias("author"))
    return {"plays": about, "moves": moves, "speeches": speeches, "units": unit("large", "q").unionByName(unit("middle", "h")), "characters": people, "part_of": part_of}


#: D: who is part of whom, in every play.
EVENT_PARTS = (("0", "women"), ("1", "women"), ("2", "women"), ("9", "women"), ("women", "chorus"), ("3", "chorus"))
