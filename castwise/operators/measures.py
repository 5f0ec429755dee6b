"""Speech distribution, demographics, segment indices and plot dynamics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import change_rate
from .order import ranked

PLAY = ("play_id",)


def gini_of(rows: DataFrame, value: str, by) -> DataFrame:
    """by, gini over the rows' values as they are (filter zeros before, or not): two aggregates over a rank."""
    w = Window.partitionBy(*by).orderBy(value)
    x = rows.withColumn("_i", F.row_number().over(w)).groupBy(*by).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col("_i")).alias("_q"))
    return x.select(*by, F.when(F.col("_s") > 0, 2 * F.col("_q") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")).otherwise(0.0).alias("gini"))


def speech_totals(speech: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id, words: attributed words of characters that speak any; speech: by, char_id, words."""
    return speech.where("words > 0").groupBy(*by, "char_id").agg(F.sum("words").alias("words"))


def speech_distribution(speech: DataFrame, by=PLAY) -> DataFrame:
    """by, total_words, gini_words, effective_speakers, top_speaker, top_speakers, top_share."""
    totals = speech_totals(speech, by)
    top = totals.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("words")))).where("_r = 1")
    top = top.groupBy(*by).agg(F.array_sort(F.collect_list("char_id")).alias("top_speakers"), F.max("words").alias("_top"))
    own = totals.groupBy(*by).agg(F.sum("words").alias("total_words"), (F.pow(F.sum("words").cast("double"), F.lit(2)) / F.sum(F.col("words").cast("double") * F.col("words"))).alias("effective_speakers"))
    x = own.join(gini_of(totals, "words", by).withColumnRenamed("gini", "gini_words"), list(by)).join(top, list(by))
    return x.select(*by, "total_words", "gini_words", "effective_speakers", F.col("top_speakers")[0].alias("top_speaker"), "top_speakers", (F.col("_top") / F.col("total_words")).alias("top_share"))


def demographics(characters: DataFrame, by=PLAY, include_mutes: bool = True) -> DataFrame:
    """Counts over declared characters; needs is_mute, is_collective, sex_class, nature_class."""
    rows = characters if include_mutes else characters.where("NOT is_mute")
    mute, collective = F.col("is_mute"), F.col("is_collective")
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*by).agg(
        count(~mute, "speakers"), count(mute, "mutes"), count(~collective, "individuals"), count(collective, "collectives"), count(collective & ~mute, "collective_speakers"),
        *(count(F.col("sex_class") == s, s) for s in ("male", "female", "mixed", "unspecified")), *(count(F.col("nature_class") == n, n) for n in ("human", "divine", "animal", "concept", "other")),
    )


def composition(counts: DataFrame) -> DataFrame:
    """Adds speakers_share, collective_speakers_share and female_share; null over 0."""
    share = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    return counts.withColumn("speakers_share", share(c("speakers"), c("speakers") + c("mutes"))).withColumn("collective_speakers_share", share(c("collective_speakers"), c("speakers"))).withColumn("female_share", share(c("female"), c("female") + c("male")))


def change_rates(sets: DataFrame, by=PLAY) -> DataFrame:
    """by, seg_id, change_rate to the next segment; out of an empty first and into an empty last one left out.

    sets: by, seg_id, members, is_initial, is_final.
    """
    w = Window.partitionBy(*by).orderBy("seg_id")
    ends = sets.groupBy(*by).agg(F.min("seg_id").alias("_first"), F.max("seg_id").alias("_last"))
    x = sets.withColumn("_next", F.lead("members").over(w)).withColumn("_next_final", F.lead("is_final").over(w)).withColumn("_next_seg", F.lead("seg_id").over(w)).join(ends, list(by)).where("_next_seg IS NOT NULL")
    opening = (F.col("seg_id") == F.col("_first")) & F.col("is_initial") & (F.size("members") == 0)
    closing = (F.col("_next_seg") == F.col("_last")) & F.col("_next_final") & (F.size("_next") == 0)
    return x.where(~opening & ~closing).select(*by, "seg_id", change_rate(F.col("members"), F.col("_next")).alias("change_rate"))


def drama_change_rate(rates: DataFrame, by=PLAY) -> DataFrame:
    return rates.groupBy(*by).agg(F.avg("change_rate").alias("drama_change_rate"), F.stddev_pop("change_rate").alias("change_rate_sd"), F.count("*").alias("transitions"))


def scanned(segments: DataFrame, cast: DataFrame, by=PLAY) -> DataFrame:
    """by, seg_id, at (0-based), scanned: segments without an initial one that is empty, if there are others."""
    w = Window.partitionBy(*by)
    filled = cast.select(*by, "seg_id").distinct().withColumn("_filled", F.lit(True))
    x = segments.join(filled, [*by, "seg_id"], "left").withColumn("_n", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy("seg_id")))
    x = x.where(~((F.col("_rn") == 1) & F.col("is_initial") & F.col("_filled").isNull() & (F.col("_n") > 1)))
    return x.select(*by, "seg_id", (F.row_number().over(w.orderBy("seg_id")) - 1).cast("long").alias("at"), F.count("*").over(w).alias("scanned"))


def segment_indices(segments: DataFrame, cast: DataFrame, speech: DataFrame, by=PLAY) -> DataFrame:
    """by, all_in_segment, all_in_index, final_cast_share, max_simultaneous_speakers.

    Everyone has been in when the latest of all first appearances has come, so no running
    union is needed. segments: by, seg_id, is_initial; speech: by, seg_id, char_id, words.
    """
    one = cast.select(*by, "seg_id", "char_id").distinct()
    spots = one.join(scanned(segments, one, by), [*by, "seg_id"])
    firsts = spots.groupBy(*by, "char_id").agg(F.min("at").alias("at"), F.max("scanned").alias("scanned"))
    all_in = firsts.groupBy(*by).agg(F.max("at").alias("all_in_segment"), ((F.max("at") + 1) / F.max("scanned")).alias("all_in_index"), F.count("*").alias("_cast"))
    final = one.groupBy(*by, "seg_id").agg(F.count("*").alias("_size")).groupBy(*by).agg(F.max_by("_size", "seg_id").alias("_final"))
    most = speech.where("words > 0").groupBy(*by, "seg_id").agg(F.count_distinct("char_id").alias("_v")).groupBy(*by).agg(F.max("_v").alias("max_simultaneous_speakers"))
    x = segments.select(*by).distinct().join(all_in, list(by), "left").join(final, list(by), "left").join(most, list(by), "left")
    return x.select(*by, "all_in_segment", F.coalesce("all_in_index", F.lit(0.0)).alias("all_in_index"), F.coalesce(F.col("_final") / F.col("_cast"), F.lit(0.0)).alias("final_cast_share"), F.when(F.col("_cast") > 0, F.coalesce("max_simultaneous_speakers", F.lit(0))).otherwise(0).cast("long").alias("max_simultaneous_speakers"))


def temporal_gini(cast: DataFrame, speech: DataFrame, active: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id, total_words, speaking_segments, n_onstage_segments, n_active_segments, temporal_gini.

    Over the active segments where a character is present or has words; cast is the stage's.
    """
    key = [*by, "seg_id", "char_id"]
    words = speech.where("words > 0").groupBy(*key).agg(F.sum("words").alias("words"))
    span = cast.select(*key).distinct().join(words, key, "full").join(active.select(*by, "seg_id"), [*by, "seg_id"], "left_semi").fillna(0, ["words"])
    # the rank and the sums share one shuffle by character
    rank = F.row_number().over(Window.partitionBy(*by, "char_id").orderBy("words"))
    own = span.withColumn("_i", rank).groupBy(*by, "char_id").agg(F.sum("words").alias("total_words"), F.count_if(F.col("words") > 0).alias("speaking_segments"), F.count("*").alias("n_onstage_segments"), F.sum(F.col("words") * F.col("_i")).alias("_q")).where("total_words > 0")
    n = active.groupBy(*by).agg(F.count("*").alias("n_active_segments"))
    k = F.col("n_onstage_segments")
    gini = 2 * F.col("_q") / (k * F.col("total_words")) - (k + 1) / k
    return own.withColumn("temporal_gini", F.round(gini, 6)).drop("_q").join(n, list(by))


def word_bounds(segments: DataFrame, by=PLAY, words: str = "word_count") -> DataFrame:
    """Adds left_words, right_words: a segment's place on the axis of words."""
    w = Window.partitionBy(*by).orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("right_words", F.sum(words).over(w)).withColumn("left_words", F.col("right_words") - F.col(words))


def threshold_passages(spell_rows: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id, passages: entries and leavings, two for each run of presence; first_appearance."""
    return spell_rows.groupBy(*by, "char_id").agg((2 * F.count("*")).alias("passages"), F.min("start").alias("first_appearance"))


def loudest_segment(speech: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id, seg_id, words: the first of those with most words."""
    rows = speech.where("words > 0").groupBy(*by, "char_id", "seg_id").agg(F.sum("words").alias("words"))
    best = F.max(F.struct("words", (-F.col("seg_id")).alias("neg")))
    return rows.groupBy(*by, "char_id").agg(best.alias("b")).select(*by, "char_id", (-F.col("b.neg")).alias("seg_id"), F.col("b.words").alias("words"))


def heatmap_cells(segments: DataFrame, cast: DataFrame, speakers: DataFrame, by=PLAY) -> DataFrame:
    """by, speaking, silent, absent: states of character x segment cells, counted without building them."""
    key = [*by, "seg_id", "char_id"]
    both = cast.select(*key).distinct().withColumn("_p", F.lit(1)).join(speakers.select(*key).distinct().withColumn("_s", F.lit(1)), key, "full")
    n = segments.groupBy(*by).agg(F.count("*").alias("_segments"))
    c = both.groupBy(*by).agg(F.count("_s").alias("speaking"), F.count_if(F.col("_s").isNull()).alias("silent"), F.count_distinct("char_id").alias("_chars"))
    return c.join(n, list(by)).select(*by, "speaking", "silent", (F.col("_chars") * F.col("_segments") - F.col("speaking") - F.col("silent")).alias("absent"))


def near_pairs(plays: DataFrame, order: str = "order", reach: int = 5) -> DataFrame:
    """a, b: pairs of plays whose orders differ by at most reach.

    A range join by bands: each play meets those of its own band of width reach and the next.
    """
    x = plays.select("play_id", F.col(order).alias("o"), F.floor(F.col(order) / F.lit(max(1, reach))).alias("band"))
    y = x.select(F.col("play_id").alias("b"), F.col("o").alias("ob"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    return x.withColumnRenamed("play_id", "a").join(y, "band").where((F.col("a") < F.col("b")) & (F.abs(F.col("o") - F.col("ob")) <= reach)).select("a", "b", (F.col("o") - F.col("ob")).alias("difference"))


def degree_anchor(average: Column) -> Column:
    """The power of two nearest to the median average degree; 8 without any."""
    return F.coalesce(F.pow(F.lit(2.0), F.round(F.log2(F.median(average)))), F.lit(8.0))


def line_ranges(segments: DataFrame, by=PLAY) -> DataFrame:
    """Adds line_start, line_end: from a segment's first line to before the next known start, else to its own last line.

    segments: by, seg_id, first_line, last_line (null where nothing has a line).
    """
    after = Window.partitionBy(*by).orderBy(F.desc("seg_id")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last("first_line", ignorenulls=True).over(after)
    end = F.coalesce(following - 1, F.col("last_line"), F.col("first_line"))
    return segments.withColumn("line_end", F.when(F.col("first_line").isNotNull(), end)).withColumn("line_start", F.col("first_line"))


def coincident(points: DataFrame, x: str, y: str, key: str = "play_id") -> DataFrame:
    """Adds place and places of each point among those at the same rounded spot, in order of key."""
    spot = Window.partitionBy(F.round(x), F.round(y))
    return points.withColumn("place", F.row_number().over(spot.orderBy(key)).cast("long")).withColumn("places", F.count("*").over(spot))


def bands(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds band: which run of neighbours with an equal group a row is in, and shaded for every other one.

    Rows are one per play of a corpus, sorted by group first, so runs are groups.
    """
    return ranked(rows, group, "band", dense=True).withColumn("shaded", F.col("band") % 2 == 1).orderBy(*order)


def heatmap_edges(cast: DataFrame, speech: DataFrame, part_of: DataFrame | None = None, by=PLAY) -> DataFrame:
    """by, present_pairs, speaking_pairs and their densities and mean degrees: distinct pairs in a segment together."""
    from .graph import pairs

    def told(rows: DataFrame, name: str) -> DataFrame:
        return pairs(rows, part_of, by).select(*by, "src", "dst").distinct().groupBy(*by).agg(F.count("*").alias(name))

    n = cast.groupBy(*by).agg(F.count_distinct("char_id").alias("_n"))
    x = n.join(told(cast, "present_pairs"), list(by), "left").join(told(speech.where("words > 0"), "speaking_pairs"), list(by), "left").fillna(0, ["present_pairs", "speaking_pairs"])
    most = F.col("_n") * (F.col("_n") - 1)
    density = lambda c: F.when(most > 0, 2 * F.col(c) / most).otherwise(0.0)
    return x.select(*by, "present_pairs", "speaking_pairs", density("present_pairs").alias("present_density"), density("speaking_pairs").alias("speaking_density"), (2 * F.col("present_pairs") / F.col("_n")).alias("present_degree"), (2 * F.col("speaking_pairs") / F.col("_n")).alias("speaking_degree"))


def heatmap_orders(cast: DataFrame, speech: DataFrame, passages: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id and its row under four orders: loudest, appearance, mobility, alphabetical."""
    words = speech.groupBy(*by, "char_id").agg(F.sum("words").alias("words"))
    x = cast.groupBy(*by, "char_id").agg(F.min("seg_id").alias("first")).join(words, [*by, "char_id"], "left").join(passages.select(*by, "char_id", "passages"), [*by, "char_id"], "left").fillna(0, ["words", "passages"])
    w = Window.partitionBy(*by)
    name = F.col("char_id").cast("string")
    orders = {"loudest": (F.desc("words"), name), "appearance": (F.asc("first"), name), "mobility": (F.desc("passages"), F.desc("words"), name), "alphabetical": (name,)}
    return x.select(*by, "char_id", *(F.row_number().over(w.orderBy(*o)).cast("long").alias(k) for k, o in orders.items()))


def delimited(columns, separator: str = ",") -> Column:
    """One line of a table: values with a quote, line feed, comma or semicolon are quoted."""
    def cell(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('["\n,;]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(separator, *map(cell, columns))


def dense_rows(segments: DataFrame, cast: DataFrame, speech: DataFrame, who: DataFrame, by=PLAY) -> DataFrame:
    """by, char_id, words, present, speaks: arrays with a place for every segment between the first and last with a cast."""
    key = [*by, "seg_id", "char_id"]
    ends = cast.groupBy(*by).agg(F.min("seg_id").alias("_a"), F.max("seg_id").alias("_b"))
    active = segments.select(*by, "seg_id").join(ends, list(by)).where("seg_id BETWEEN _a AND _b").select(*by, "seg_id")
    said = speech.groupBy(*key).agg(F.sum("words").alias("_words"), F.lit(True).alias("_said"))
    cells = active.join(who.select(*by, "char_id").distinct(), list(by))  # one cell for each place of the arrays
    cells = cells.join(cast.select(*key).distinct().withColumn("_here", F.lit(True)), key, "left").join(said, key, "left")
    rows = cells.groupBy(*by, "char_id").agg(F.sort_array(F.collect_list(F.struct("seg_id", F.coalesce("_words", F.lit(0)).alias("words"), F.coalesce("_here", F.lit(False)).alias("present"), F.coalesce("_said", F.lit(False)).alias("speaks")))).alias("_x"))
    return rows.select(*by, "char_id", *(F.col(f"_x.{c}").alias(c) for c in ("words", "present", "speaks")))


def transitions(rates: DataFrame, by=PLAY) -> DataFrame:
    """Adds from_no: the number, from 1, that a transition is shown with among those of its play."""
    return rates.withColumn("from_no", F.row_number().over(Window.partitionBy(*by).orderBy("seg_id")).cast("long"))
