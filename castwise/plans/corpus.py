"""The whole analysis of a corpus as one set of tables over all plays, spines, models and aggregations.

Variants are rows of a lattice with one key (``play_id`` in the operators' sense): raw
presence is computed once per play, and each variant projects it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nature_class, sex_class
from ..operators import graph, hierarchy, measures, paths, segment
from ..operators.presence import presence_intervals
from .pin import written
from .variants import MODELS, masks

SPINES = {"sd": None, "large-seq": "large", "middle-seq": "middle"}
VARIANT = ["play", "segmentation", "model", "groups"]


def spine(t: dict[str, DataFrame], mode: str, here: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, cast, spoken) of one segmentation; spoken has a row for each set of speakers of a segment and the words they say together."""
    level = SPINES[mode]
    w = Window.partitionBy("play_id").orderBy("seg_id")
    whole = Window.partitionBy("play_id")
    if level is None:
        stream = written(segment.assigned(t["moves"], t["speeches"], here))  # read by segments, cast and speech
        cast = segment.sd_cast(stream, here)
        segs = segment.sd_segments(stream)
    else:
        units = t["units"].where(F.col("level") == level)
        stream = segment.unit_stream(t["moves"], t["speeches"], units, f"{level}_pos")
        cast = segment.unit_cast(stream, here)
        segs = segment.unit_segments(stream, units, f"{level}_pos").join(units.select("play_id", F.col("pos").alias(f"{level}_pos"), "xml_id", "type"), ["play_id", f"{level}_pos"])
    filled = cast.select("play_id", "seg_id").distinct().withColumn("_filled", F.lit(True))
    segs = segs.join(filled, ["play_id", "seg_id"], "left").withColumn("_n", F.count("*").over(whole)).withColumn("is_initial", F.row_number().over(w) == 1)
    last = F.col("seg_id") == F.max("seg_id").over(whole)
    if level is None:
        segs = segs.withColumn("is_final", last & (F.col("_n") > 1) & F.col("_filled").isNull()).withColumn("label", _label(F.col("_filled").isNull()))
    else:
        named = F.concat_ws("/", F.when(F.col("type") != "", F.col("type")), F.when(F.col("xml_id") != "", F.col("xml_id")))
        own = F.when(named != "", named).otherwise(F.concat(F.lit("<unit-"), F.col(f"{level}_pos").cast("string"), F.lit(">")))
        segs = segs.withColumn("is_final", last).withColumn("label", F.concat_ws("-", F.lit(mode), "seg_id", own))
    said = stream.where("type = 'speech' AND size(who) > 0").groupBy("play_id", "seg_id", "who").agg(F.sum("word_count").alias("words"))
    keep = ["play_id", "seg_id", "label", "start_pos", "end_pos", "word_count", "num_speeches", "num_crossings", "is_initial", "is_final"]
    tag = lambda df, *c: df.select(F.lit(mode).alias("segmentation"), *c)
    return tag(segs, *keep), tag(cast, "play_id", "seg_id", "char_id"), tag(said, "play_id", "seg_id", "who", "words")


def _label(empty):
    """sd-k, marked where a segment opens or closes the play."""
    k = F.concat(F.lit("sd-"), F.col("seg_id").cast("string"))
    return F.when(F.col("is_initial") & empty, F.concat(k, F.lit("-initial-empty"))).when(F.col("is_initial"), F.concat(k, F.lit("-initial"))).when(F.col("is_final"), F.concat(k, F.lit("-final"))).otherwise(k)


def aggregations(t: dict[str, DataFrame], chained: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What aggregation makes of every non-empty subset of a play's groups.

    (play_id, groups) of those to compute, '' among them: subsets that rewrite everyone alike are one, told by the
    smallest; (play_id, groups, part, whole): what each of these rewrites; (play_id, groups, rep): every subset that rewrites
    anyone, with the one it is computed as.  A subset's map is made in its row from the play's chains, so nothing is
    exploded before alike ones are one.
    """
    own = hierarchy.groups(t["part_of"], t["characters"]).groupBy("play_id").agg(F.array_sort(F.collect_set("char_id")).alias("all"))
    chosen = masks(own, F.col("all"), keep=True).select("play_id", "groups", "chosen")
    steps = hierarchy.chains(t["part_of"]) if chained is None else chained
    up = steps.groupBy("play_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "whole"))), lambda x: x["whole"]).alias("up"))
    ways = up.groupBy("play_id").agg(F.array_sort(F.collect_list(F.struct("part", "up"))).alias("ways"))
    highest = lambda w: F.get(F.filter(w["up"], lambda x: F.array_contains("chosen", x)), 0)
    rewritten = F.filter(F.transform("ways", lambda w: F.struct(w["part"].alias("part"), highest(w).alias("whole"))), lambda m: m["whole"].isNotNull())
    rows = chosen.join(ways, "play_id").select("play_id", "groups", F.size("chosen").alias("k"), rewritten.alias("map")).where("size(map) > 0")
    reps = rows.groupBy("play_id", "map").agg(F.min(F.struct("k", "groups"))["groups"].alias("rep"))
    shared = rows.join(reps, ["play_id", "map"]).select("play_id", "groups", "rep")
    maps = reps.select("play_id", F.col("rep").alias("groups"), F.explode("map").alias("m")).select("play_id", "groups", "m.part", "m.whole")
    plain = t["plays"].select("play_id", F.lit("").alias("groups"))
    return plain.unionByName(reps.select("play_id", F.col("rep").alias("groups"))), maps, plain.withColumn("rep", F.lit("")).unionByName(shared)


def told(rows: DataFrame, shared: DataFrame, play: str = "play_id") -> DataFrame:
    """Rows by play and groups as computed, for every subset that is computed as them."""
    s = shared.select(F.col("play_id").alias(play), F.col("groups").alias("_groups"), F.col("rep").alias("groups"))
    return rows.join(s, [play, "groups"]).drop("groups").withColumnRenamed("_groups", "groups").select(*rows.columns)


def all_characters(t: dict[str, DataFrame]) -> DataFrame:
    """rewritten_characters() of every subset of every play's groups."""
    keys, maps, shared = aggregations(t)
    return told(rewritten_characters(t, keys, maps), shared)


def rewritten_characters(t: dict[str, DataFrame], keys: DataFrame, maps: DataFrame) -> DataFrame:
    """play_id, groups, char_id and flags after aggregation: groups are collective, a chorus if any part is; mute if nobody of it speaks."""
    base = t["characters"].join(keys, "play_id")
    m = maps.withColumnRenamed("part", "char_id")
    moved = base.join(m, ["play_id", "groups", "char_id"], "left")
    own = moved.groupBy("play_id", "groups", F.coalesce("whole", "char_id").alias("char_id")).agg(
        F.max("is_chorus").alias("is_chorus"), F.max(F.col("is_collective") | F.col("whole").isNotNull()).alias("is_collective"), F.min("is_mute").alias("is_mute"),
        *(F.max(F.when(F.col("whole").isNull(), F.col(c))).alias(c) for c in ("name_en", "name_grc", "sex", "nature")),
    )
    return own


def rewrites(t: dict[str, DataFrame], keys: DataFrame, maps: DataFrame, people: DataFrame, chained: DataFrame | None = None) -> DataFrame:
    """model, play_id, groups, part, whole: aggregation, and for p-speaking the absorption of silent parts after it."""
    top = hierarchy.targets(t["part_of"], chained=chained)
    heard = people.where("NOT is_mute").select("play_id", "groups", F.col("char_id").alias("whole"))
    mute = people.where("is_mute").select("play_id", "groups", F.col("char_id").alias("part"))
    absorbed = mute.join(top, ["play_id", "part"]).join(heard, ["play_id", "groups", "whole"], "left_semi").select("play_id", "groups", "part", "whole")
    then = absorbed.select("play_id", "groups", F.col("part").alias("whole"), F.col("whole").alias("further"))
    chained = maps.join(then, ["play_id", "groups", "whole"], "left").select("play_id", "groups", "part", F.coalesce("further", "whole").alias("whole"))
    first = absorbed.join(maps.select("play_id", "groups", "part"), ["play_id", "groups", "part"], "left_anti")
    named = lambda df, m: df.select(F.lit(m).alias("model"), "play_id", "groups", "part", "whole")
    return named(maps, "full").unionByName(named(maps, "s-speaking")).unionByName(named(chained.unionByName(first), "p-speaking"))


def lattice(t: dict[str, DataFrame], spines=tuple(SPINES)) -> dict[str, DataFrame]:
    """variants, segments, cast (model's), stage_cast, speech, sets, nodes, pairs, edges, links (edges without ids), people, rules by VARIANT.

    play_id is a key of what is computed; variants tells which segmentation, model and groups it stands for (several, if
    they rewrite alike), computed has one row for each.  A segment is one row, with its casts and its speech as arrays,
    until it has been rewritten and folded; rows by character are made from that.
    """
    here = written(presence_intervals(t["moves"]))
    parts = [spine(t, m, here) for m in spines]
    segs, cast, said = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
    chained = hierarchy.chains(t["part_of"])
    keys, maps, shared = map(written, aggregations(t, chained))
    people = written(rewritten_characters(t, keys, maps))
    rules = written(rewrites(t, keys, maps, people, chained))
    at, way = ["segmentation", "play_id"], ["play_id", "model", "groups"]
    on_stage = cast.groupBy(*at, "seg_id").agg(F.collect_list("char_id").alias("_stage"))
    spoken = said.groupBy(*at, "seg_id").agg(F.collect_list(F.struct("who", "words")).alias("_said"))
    base = written(segs.join(on_stage, [*at, "seg_id"], "left").join(spoken, [*at, "seg_id"], "left"))
    nobody = F.array().cast("array<string>")
    heard = base.select(*at, F.explode("_said.who").alias("who")).groupBy(*at).agg(F.array_distinct(F.flatten(F.collect_set("who"))).alias("_heard"))
    models = F.explode(F.array(*(F.lit(m) for m in MODELS)))
    to = rules.groupBy(*way).agg(F.map_from_entries(F.collect_list(F.struct("part", "whole"))).alias("_to"))
    rewritten = lambda who: F.when(F.col("_to").isNull(), F.array_distinct(who)).otherwise(F.array_distinct(F.transform(who, lambda c: F.coalesce(F.try_element_at("_to", c), c))))
    vid = F.concat_ws("\u001f", "play_id", "segmentation", "model", "groups")
    ways = base.select(*at).distinct().join(keys.withColumn("model", models), "play_id").join(to, way, "left").join(heard, at, "left")
    ways = written(ways.select(*at, "model", "groups", "_to", F.coalesce(rewritten(F.col("_heard")), nobody).alias("_heard"), vid.alias("_vid")))
    computed = written(ways.select(F.col("_vid").alias("play_id"), F.col("play_id").alias("play"), "segmentation", "model", "groups"))
    variants = written(told(computed, shared, "play"))  # several may share a play_id
    beats = base.join(ways, at).withColumn("stage", F.array_sort(F.coalesce(rewritten(F.col("_stage")), nobody)))
    each = F.transform("_said", lambda s: F.transform(rewritten(s["who"]), lambda c: F.struct(c.alias("char_id"), s["words"].alias("words"))))
    beats = beats.withColumn("speech", F.coalesce(F.flatten(each), F.array().cast("array<struct<char_id:string,words:bigint>>"))).withColumn("kept", F.array_intersect("stage", "_heard"))
    beats = beats.withColumn("voices", F.array_sort(F.array_distinct(F.col("speech.char_id")))).withColumn("own", F.when(F.col("model") == "full", F.col("stage")).when(F.col("model") == "p-speaking", F.col("kept")).otherwise(F.col("voices")))
    numbers = ["start_pos", "end_pos", "word_count", "num_speeches", "num_crossings", "is_initial", "is_final", "label"]
    # fold: sd only, not under full. Runs are judged on the kept stage cast.
    foldable = (F.col("segmentation") == "sd") & (F.col("model") != "full")
    beats = written(beats.select(F.col("_vid").alias("play_id"), "seg_id", *numbers, "own", "stage", "speech", F.when(foldable, F.col("kept")).alias("members"), F.when(foldable & (F.col("model") == "s-speaking"), F.col("voices")).alias("said")))
    plain = beats.where("members IS NULL").select("play_id", "seg_id", *numbers, "own", "stage", "speech")
    runs = segment.equality_fold(beats.where("members IS NOT NULL AND said IS NULL"))
    blocks = written(segment.equality_fold(beats.where("said IS NOT NULL").select("play_id", "seg_id", "members", "said")))
    runs = runs.unionByName(beats.where("said IS NOT NULL").join(segment.speaking_runs(blocks), ["play_id", "seg_id"]))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    folded = runs.groupBy("play_id", "fold_id").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), *(F.sum(c).alias(c) for c in ("word_count", "num_speeches", "num_crossings")),
        F.min_by("is_initial", "seg_id").alias("is_initial"), F.max_by("is_final", "seg_id").alias("is_final"), union("own"), union("stage"), F.flatten(F.collect_list("speech")).alias("speech"),
    )
    folded = folded.withColumnRenamed("fold_id", "seg_id").withColumn("label", _label(F.size("stage") == 0))
    table = plain.unionByName(written(folded.select(*plain.columns)))
    segments = table.select("play_id", "seg_id", *numbers)
    by_character = lambda c: table.select("play_id", "seg_id", F.explode(c).alias("char_id"))
    own, stage = by_character("own"), by_character("stage")
    speech = table.select("play_id", "seg_id", F.explode("speech").alias("s")).groupBy("play_id", "seg_id", "s.char_id").agg(F.sum("s.words").alias("words"))
    closed = hierarchy.closure(t["part_of"]).select(F.col("play_id").alias("play"), "part", "whole").join(computed.select("play", "play_id"), "play").drop("play")
    sets = written(graph.cast_sets(table.select("play_id", F.col("own").alias("members"), "word_count")))
    nodes = sets.select("play_id", F.explode("members").alias("char_id")).distinct()
    pair_rows = graph.pairs(own, closed)
    edges = graph.static_edges(pair_rows, segments.select("play_id", "seg_id", "word_count"))
    return {"variants": variants, "segments": segments, "cast": own, "stage_cast": stage, "speech": speech, "nodes": nodes, "pairs": pair_rows, "edges": edges, "links": graph.set_edges(sets, closed), "people": told(people, shared), "rules": rules, "computed": computed}


def node_metrics(a: dict[str, DataFrame]) -> DataFrame:
    """play_id, char_id and the network measures of every character in every variant of a lattice()."""
    nodes, edges, key = a["nodes"], a["links"], ["play_id", "char_id"]
    measured = paths.path_measures(nodes, edges).drop("component", "reach", "distance_sum", "eccentricity")
    metrics = graph.degrees(nodes, edges).join(graph.clustering(nodes, edges).drop("degree"), key).join(measured, key)
    rounded = ("clustering", "betweenness", "closeness", "eigenvector")
    return metrics.select(*key, "degree", "weighted_degree", "triangles", *(F.round(c, 6).alias(c) for c in rounded))


def analyse(t: dict[str, DataFrame], spines=tuple(SPINES), nodes_too: bool = True) -> dict[str, DataFrame]:
    """lattice() with node_metrics (if asked for), temporal_gini, indices, demographics and the comparison of all variants."""
    a = lattice(t, spines)
    variants, segments, own, stage, speech, nodes, rules = (a[k] for k in ("variants", "segments", "cast", "stage_cast", "speech", "nodes", "rules"))
    nodes, edges = written(nodes), written(a["links"])
    a = a | {"nodes": nodes, "links": edges}
    distances = written(paths.distance_measures(paths.levels(nodes, paths.neighbours(edges))))
    degree = graph.degrees(nodes, edges)
    cluster = written(graph.clustering(nodes, edges))
    gini = written(measures.temporal_gini(stage, speech, segment.active_span(segments, stage)))
    indices = written(measures.segment_indices(segments, own, speech))
    all_in = measures.scanned(segments, own).join(indices.select("play_id", F.col("all_in_segment").alias("at")), ["play_id", "at"]).join(segments.select("play_id", "seg_id", "label"), ["play_id", "seg_id"])
    short = F.regexp_extract("label", r"^(?:large-seq|middle-seq)-\d+-(.+)$", 1)
    all_in = all_in.select("play_id", F.when(short != "", short).otherwise(F.col("label")).alias("all_in_segment_label"))
    # words of the whole play under the variant's rewriting, units or not
    talk = t["speeches"].select("play_id", "pos", F.explode("who").alias("char_id"), "word_count").join(a["computed"].withColumnRenamed("play_id", "vid"), F.col("play_id") == F.col("play")).drop("play_id")
    talk = talk.join(rules.select("model", F.col("play_id").alias("play"), "groups", F.col("part").alias("char_id"), "whole"), ["model", "play", "groups", "char_id"], "left").select(F.col("vid").alias("play_id"), "pos", F.coalesce("whole", "char_id").alias("char_id"), F.col("word_count").alias("words")).distinct()
    speeches = written(measures.speech_distribution(talk))
    rates = measures.drama_change_rate(measures.change_rates(segment.cast_sets(segments, own).join(segments.select("play_id", "seg_id", "is_initial", "is_final"), ["play_id", "seg_id"])))
    top_gini = speeches.select("play_id", F.col("top_speaker").alias("char_id")).join(gini, ["play_id", "char_id"]).select("play_id", F.col("temporal_gini").alias("top_speaker_temporal_gini"))
    size = graph.network_size(nodes, edges)
    left = lambda a, b: a.join(b, "play_id", "left")
    count = segments.groupBy("play_id").agg(F.count("*").alias("segments"))
    table = reduce(left, [variants, size, graph.max_degree(degree).drop("max_degree_ids"), paths.path_summary(distances).drop("isolates"), cluster.groupBy("play_id").agg(F.avg("clustering").alias("average_clustering")), count, indices, all_in, speeches.drop("total_words", "top_speakers"), top_gini, rates.drop("change_rate_sd", "transitions")])
    about = t["plays"].select(F.col("play_id").alias("play"), F.col("title_en").alias("title"), "author")
    comparison = table.join(about, "play").select(
        F.col("play").alias("id"), F.col("title").alias("play"), "author", "segmentation", "model", F.col("groups").alias("aggregated"), F.coalesce("order", F.lit(0)).alias("order"), F.coalesce("num_edges", F.lit(0)).alias("edges"), "density",
        F.col("average_degree").alias("avg_degree"), "max_degree", "diameter", F.col("average_path_length").alias("avg_path_length"), F.col("average_clustering").alias("avg_clustering"), "components", "segments", "all_in_index", "all_in_segment_label",
        F.col("final_cast_share").alias("final_segment_cast_share"), "max_simultaneous_speakers", F.coalesce("gini_words", F.lit(0.0)).alias("gini_words"), F.coalesce("effective_speakers", F.lit(0.0)).alias("effective_speakers"), "top_speaker",
        F.coalesce("top_share", F.lit(0.0)).alias("top_speaker_word_share"), "top_speaker_temporal_gini", "drama_change_rate",
    )
    if nodes_too:  # exports read them several times
        pairs = written(a["pairs"])
        a = a | {"pairs": pairs, "edges": written(graph.static_edges(pairs, segments.select("play_id", "seg_id", "word_count")))}
    return a | ({"node_metrics": node_metrics(a)} if nodes_too else {}) | {"temporal_gini": gini, "indices": indices, "demographics": demographics(a["people"]), "comparison": comparison}


def demographics(people: DataFrame, include_mutes: bool = True) -> DataFrame:
    """play_id, groups and the counts of the characters as each aggregation leaves them."""
    classed = people.withColumn("sex_class", F.coalesce(sex_class(F.col("sex")), F.lit("unspecified"))).withColumn("nature_class", F.coalesce(nature_class(F.col("nature")), F.lit("other")))
    return measures.demographics(classed, ("play_id", "groups"), include_mutes)


def ratio_source(counts: DataFrame) -> DataFrame:
    """play_id and the counts that its ratios are told from: those of the fullest aggregation, else its own."""
    size = F.when(F.col("groups") == "", 0).otherwise(F.size(F.split("groups", ",")))
    w = Window.partitionBy("play_id").orderBy(size.desc(), "groups")
    return measures.composition(counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumnRenamed("groups", "source"))


def play_blocks(a: dict[str, DataFrame]) -> DataFrame:
    """id, segmentation, model, raw, agg: a play's comparison as it is and fully aggregated (null if there is nothing to aggregate)."""
    c = a["comparison"]
    size = F.when(F.col("aggregated") == "", 0).otherwise(F.size(F.split("aggregated", ",")))
    block = F.struct(*(x for x in c.columns if x not in ("id", "segmentation", "model")))
    rows = c.select("id", "segmentation", "model", size.alias("_k"), block.alias("_b"))
    return rows.groupBy("id", "segmentation", "model").agg(F.min_by("_b", "_k").alias("raw"), F.when(F.max("_k") > 0, F.max_by("_b", "_k")).alias("agg"))


def chorus_rows(a: dict[str, DataFrame]) -> DataFrame:
    """play_id, char_id and arrays over the active span: words, present and speaks of every chorus character, zeros and all."""
    chorus = a["people"].where("is_chorus").withColumnRenamed("play_id", "play").join(a["computed"].select("play_id", "play", "groups"), ["play", "groups"]).select("play_id", "char_id")
    return measures.dense_rows(a["segments"], a["stage_cast"], a["speech"], chorus)
