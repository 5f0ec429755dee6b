"""Exports of an analysis: CSV, JSON, GEXF and GraphML, one row or file content per variant.

Contents are built on the executors as one string for each variant (a variant is one
play's network), and ``write`` has the executors put them into a folder with one sub-folder per play.
"""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pin import written
from .files import SCHEMA, open_uri, register

CHARACTER_COLUMNS = ["id", "name_english", "name_greek", "is_mute", "is_collective", "is_chorus", "sex", "in_network", "degree", "weightedDegree", "betweenness", "closeness", "eigenvector", "clustering", "triangles", "total_words", "speaking_segments", "n_onstage_segments", "temporal_gini"]


def escape(value: Column) -> Column:
    """For an XML attribute in double quotes."""
    out = value.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def script_safe(value: Column) -> Column:
    """JSON that can stand inside a script element: no markup characters, no line or paragraph separators."""
    for point in (0x3C, 0x3E, 0x26, 0x2028, 0x2029):
        value = F.replace(value, F.lit(chr(point)), F.lit(f"\\u{point:04x}"))
    return value


def payload_json(a: dict[str, DataFrame]) -> DataFrame:
    """play_id, payload: all that a page of one variant shows, as script-safe JSON (segments, characters, edges, comparison row)."""

    def rows(df: DataFrame, name: str, *order: str) -> DataFrame:
        rest = [c for c in df.columns if c != "play_id" and c not in order]
        return df.groupBy("play_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    line = a["comparison"].join(a["computed"].withColumnsRenamed({"play": "id", "groups": "aggregated"}), ["id", "segmentation", "model", "aggregated"])
    head = line.select("play_id", F.struct(*(c for c in line.columns if c != "play_id")).alias("comparison"))
    words = a["speech"].where("words > 0").groupBy("play_id", "seg_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("char_id", "words")))).alias("words_by_speaker"))
    segments = segments_csv(a).join(words.withColumnRenamed("seg_id", "segment_id"), ["play_id", "segment_id"], "left")
    # a map has no order, so it goes into the sorted rows as JSON of its own
    segments = segments.withColumn("words_by_speaker", F.coalesce(F.to_json("words_by_speaker"), F.lit("{}")))
    x = head.join(rows(segments, "segments", "segment_id"), "play_id", "left").join(rows(characters_csv(a), "characters", "id"), "play_id", "left").join(rows(network_csv(a), "edges", "Source", "Target"), "play_id", "left")
    return x.select("play_id", script_safe(F.to_json(F.struct("comparison", "segments", "characters", "edges"))).alias("payload"))


def characters_csv(a: dict[str, DataFrame]) -> DataFrame:
    """Every declared character of each variant's play, blank where it isn't in the network."""
    v = a["computed"]
    base = a["people"].withColumnRenamed("play_id", "play").join(v, ["play", "groups"])
    full = base.join(a["node_metrics"], ["play_id", "char_id"], "left").join(a["temporal_gini"], ["play_id", "char_id"], "left")
    c = F.col
    return full.select("play_id", c("char_id").alias("id"), c("name_en").alias("name_english"), c("name_grc").alias("name_greek"), "is_mute", "is_collective", "is_chorus", "sex", c("degree").isNotNull().alias("in_network"), "degree", c("weighted_degree").alias("weightedDegree"), "betweenness", "closeness", "eigenvector", "clustering", "triangles", "total_words", "speaking_segments", "n_onstage_segments", "temporal_gini")


def segments_csv(a: dict[str, DataFrame]) -> DataFrame:
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("play_id", "seg_id").agg(F.array_join(F.array_sort(F.collect_set("char_id")), "|").alias(name), F.count_distinct("char_id").alias(f"n_{name}"))

    x = a["segments"]
    for df, name in ((a["stage_cast"], "characters"), (a["speech"], "speakers"), (a["cast"], "model_cast")):
        x = x.join(sets(df, name), ["play_id", "seg_id"], "left").fillna({name: "", f"n_{name}": 0})
    return x.select("play_id", F.col("seg_id").alias("segment_id"), "label", "is_initial", "is_final", F.col("n_characters").alias("num_characters"), "characters", "num_speeches", "word_count", "num_crossings", "speakers", F.col("n_model_cast").alias("model_cast_size"), "model_cast")


def network_csv(a: dict[str, DataFrame], weight: str = "segments_shared") -> DataFrame:
    return a["edges"].select("play_id", F.col("src").alias("Source"), F.lit("Undirected").alias("Type"), F.col("dst").alias("Target"), F.col(weight).alias("Weight"))


def dynamic_csv(a: dict[str, DataFrame]) -> DataFrame:
    from ..operators.graph import dynamic_metrics

    x = dynamic_metrics(a["segments"], a["cast"], a["pairs"])
    return x.select("play_id", F.col("seg_id").alias("segment_id"), F.col("label").alias("segment_label"), "size", F.col("num_edges").alias("numEdges"), "word_count", "is_initial", "is_final")


def metrics_json(a: dict[str, DataFrame]) -> DataFrame:
    """play_id, json: the comparison row with its nodes, keys sorted."""
    nodes = a["node_metrics"].groupBy("play_id").agg(F.array_sort(F.collect_list(F.struct("char_id", "betweenness", "closeness", "clustering", "degree", "eigenvector", "triangles", "weighted_degree"))).alias("nodes"))
    c = a["comparison"].join(a["computed"].withColumnsRenamed({"play": "id", "groups": "aggregated"}), ["id", "segmentation", "model", "aggregated"]).join(nodes, "play_id", "left")
    return c.select("play_id", F.to_json(F.struct(*sorted(x for x in c.columns if x != "play_id"))).alias("json"))


def _joined(rows: DataFrame, line: Column, order: list[str], name: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("play_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias(name))


def _attributes(kind: str, names: dict[str, str]) -> str:
    return f'<attributes class="{kind}" mode="static">' + "".join(f'<attribute id="{i}" title="{n}" type="{t}"/>' for i, (n, t) in enumerate(names.items())) + "</attributes>"


_NODE = {"name": "string", "name_grc": "string", "is_mute": "boolean", "is_collective": "boolean", "is_chorus": "boolean", "sex": "string"}


def _nodes(a: dict[str, DataFrame]) -> DataFrame:
    v = a["computed"].select("play_id", "play", "groups")
    people = a["people"].withColumnRenamed("play_id", "play")
    x = a["nodes"].join(v, "play_id").join(people, ["play", "groups", "char_id"], "left")
    name = F.coalesce(F.when(F.col("name_en") != "", F.col("name_en")), F.when(F.col("name_grc") != "", F.col("name_grc")), F.col("char_id"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return x.select("play_id", "char_id", name.alias("name"), F.coalesce("name_grc", F.lit("")).alias("name_grc"), *map(flag, ("is_mute", "is_collective", "is_chorus")), F.coalesce("sex", F.lit("")).alias("sex"))


def _node_values() -> Column:
    return F.concat(F.lit("<attvalues>"), *(F.concat(F.lit(f'<attvalue for="{i}" value="'), escape(F.col(n)), F.lit('"/>')) for i, n in enumerate(_NODE)), F.lit("</attvalues>"))


def _spells(rows: DataFrame, *what: str) -> DataFrame:
    """One timestamp for each segment in which the element is active."""
    times = F.array_sort(F.collect_set("seg_id"))
    return rows.groupBy("play_id", *what).agg(F.concat(F.lit("<spells>"), F.array_join(F.transform(times, lambda k: F.concat(F.lit('<spell timestamp="'), k.cast("string"), F.lit('"/>'))), ""), F.lit("</spells>")).alias("spells"))


def gexf(a: dict[str, DataFrame], dynamic: bool = False, weight: str = "segments_shared") -> DataFrame:
    """play_id, gexf: 1.2 static, or 1.3 with a timestamp per active segment."""
    nodes, edges = _nodes(a), a["edges"].withColumn("w", F.col(weight))
    nothing = F.lit("")
    if dynamic:
        nodes = nodes.join(_spells(a["cast"], "char_id"), ["play_id", "char_id"], "left")
        edges = edges.join(_spells(a["pairs"], "src", "dst"), ["play_id", "src", "dst"], "left")
    spell = lambda: F.coalesce("spells", nothing) if dynamic else nothing
    node = F.concat(F.lit('<node id="'), escape(F.col("char_id")), F.lit('" label="'), escape(F.col("name")), F.lit('">'), _node_values(), spell(), F.lit("</node>"))
    edge = F.concat(F.lit('<edge id="'), escape(F.concat_ws("--", "src", "dst")), F.lit('" source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('" weight="'), F.col("w").cast("string"), F.lit('"><attvalues><attvalue for="0" value="'), F.col("w").cast("string"), F.lit('"/></attvalues>'), spell(), F.lit("</edge>"))
    version = "1.3" if dynamic else "1.2draft"
    mode = 'mode="dynamic" timeformat="double" timerepresentation="timestamp"' if dynamic else 'mode="static"'
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/{version}" version="{version[:3]}"><graph defaultedgetype="undirected" {mode}>{_attributes("node", _NODE)}{_attributes("edge", {"weight": "double"})}'
    x = a["computed"].select("play_id").join(_joined(nodes, node, ["char_id"], "n"), "play_id", "left").join(_joined(edges, edge, ["src", "dst"], "e"), "play_id", "left")
    return x.select("play_id", F.concat(F.lit(head + "<nodes>\n"), F.coalesce("n", nothing), F.lit("\n</nodes><edges>\n"), F.coalesce("e", nothing), F.lit("\n</edges></graph></gexf>")).alias("gexf"))


def graphml(a: dict[str, DataFrame], weight: str = "segments_shared") -> DataFrame:
    """play_id, graphml."""
    kinds = {"string": "string", "boolean": "boolean"}
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{n}" for="node" attr.name="{n}" attr.type="{kinds[t]}"/>' for n, t in _NODE.items()) + '<key id="weight" for="edge" attr.name="weight" attr.type="double"/><key id="segment_ids" for="edge" attr.name="segment_ids" attr.type="string"/><graph edgedefault="undirected">\n'
    node = F.concat(F.lit('<node id="'), escape(F.col("char_id")), F.lit('">'), *(F.concat(F.lit(f'<data key="{n}">'), escape(F.col(n)), F.lit("</data>")) for n in _NODE), F.lit("</node>"))
    ids = F.array_join(F.transform("segment_ids", lambda s: s.cast("string")), ",")
    edge = F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('"><data key="weight">'), F.col(weight).cast("string"), F.lit('</data><data key="segment_ids">'), ids, F.lit("</data></edge>"))
    nothing = F.lit("")
    x = a["computed"].select("play_id").join(_joined(_nodes(a), node, ["char_id"], "n"), "play_id", "left").join(_joined(a["edges"], edge, ["src", "dst"], "e"), "play_id", "left")
    return x.select("play_id", F.concat(F.lit(head), F.coalesce("n", nothing), F.lit("\n"), F.coalesce("e", nothing), F.lit("\n</graph></graphml>")).alias("graphml"))


def corpus_payload(a: dict[str, DataFrame], plays: DataFrame) -> DataFrame:
    """id, payload: each play with its blocks (raw, and agg where there is one) and the counts behind its ratios, as script-safe JSON."""
    from ..plans.corpus import play_blocks, ratio_source

    blocks = play_blocks(a).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("segmentation", "model", "raw", "agg"))).alias("blocks"))
    counts = ratio_source(a["demographics"])
    told = counts.select(F.col("play_id").alias("id"), F.struct(*(c for c in counts.columns if c != "play_id")).alias("composition"))
    about = plays.select(F.col("play_id").alias("id"), F.col("title_en").alias("title"), "author", "genre")
    rows = about.join(blocks, "id", "left").join(told, "id", "left")
    return rows.select("id", script_safe(F.to_json(F.struct("id", "title", "author", "genre", "composition", "blocks"))).alias("payload"))


def write_corpus(a: dict[str, DataFrame], plays: DataFrame, name: str, path: str) -> None:
    """The corpus's page data: its name, its authors and its plays in order of id, one play after another as they come (the driver holds one partition)."""
    from ..operators.views import authors

    session = plays.sparkSession
    head = session.createDataFrame([(name,)], "name string").crossJoin(authors(plays))
    start = head.select(script_safe(F.to_json(F.struct("name", "authors"))).alias("payload")).first()["payload"]
    fs, root = open_uri(path)
    with fs.open_output_stream(root) as f:
        f.write(start.removesuffix("}").encode() + b',"plays":[')
        for i, r in enumerate(corpus_payload(a, plays).orderBy("id").toLocalIterator()):
            f.write((b"," if i else b"") + r["payload"].encode())
        f.write(b"]}")


def write_table(rows: DataFrame, order: list[str], path: str) -> None:
    """One CSV file of a sorted table, row after row (the driver holds one partition)."""
    fs, root = open_uri(path)
    with fs.open_output_stream(root) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(rows.columns)
        out.writerows(rows.orderBy(*order).toLocalIterator())


def play_folders(plays: DataFrame) -> DataFrame:
    """play_id, path, folder: a name from the title; later files with a taken name add the file's stem."""
    from pyspark.sql import Window

    from ..functions import clean_file_name

    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = plays.select("play_id", "path", stem.alias("stem"), clean_file_name(F.col("title_en")).alias("folder"))
    w = Window.partitionBy(F.lower("folder")).orderBy("path")
    first = named.withColumn("_r", F.row_number().over(w))
    return first.select("play_id", "path", F.when(F.col("_r") == 1, F.col("folder")).otherwise(F.concat_ws("-", "folder", "stem")).alias("folder"))


def recorded_source(folder: str) -> str | None:
    """The file that a folder's exports come from; None without a marker, or with one that can't be read."""
    fs, root = open_uri(folder)
    try:
        with fs.open_input_file(f"{root}/source.json") as f:
            return json.loads(f.read()).get("source")
    except (OSError, ValueError, AttributeError):
        return None


def _csv_of(name: str, columns: list[str]):
    def one(pdf):
        own = pdf[pdf[columns[0]].notna()][columns].sort_values(columns[:2])
        return pd.DataFrame({"place": [pdf["_place"].iloc[0]], "name": [name], "content": [own.to_csv(index=False)]})

    return one


def write(a: dict[str, DataFrame], plays: DataFrame, out: str, model: str = "full", weight: str = "segments_shared", payloads: bool = False) -> list[str]:
    """The exports of one model without aggregation (full where the model has made nothing), as files under out/<play>/<segmentation>/.

    ``out`` is a folder that driver and executors share.  Files are written by the executors, one variant's
    at a time, and get their names when all of one kind are done; the driver sees the plays' names and the files' paths.  A folder that source.json gives
    to another file, or that two files would get, is refused.
    """
    raw = a["computed"].where("groups = ''")
    wanted = raw.where(F.col("model") == model)
    if not wanted.join(a["nodes"], "play_id", "left_semi").take(1):
        wanted = raw.where("model = 'full'")
    folders = play_folders(plays)
    taken: dict[str, str] = {}
    for r in folders.collect():
        key, root = r["folder"].lower(), f"{out}/{r['folder']}"
        known = taken.setdefault(key, r["path"]) if key in taken else recorded_source(root)
        if known not in (None, r["path"]):
            raise FileExistsError(f"{root} holds the exports of another file")
        taken[key] = r["path"]
    marker = F.to_json(F.struct(F.col("path").alias("source")))
    _put(folders.select(F.col("folder").alias("place"), F.lit("source.json").alias("name"), marker.alias("content")), out)
    places = wanted.join(folders.select(F.col("play_id").alias("play"), "folder"), "play").select("play_id", F.concat_ws("/", "folder", "segmentation").alias("_place"))
    tables = {"characters.csv": characters_csv(a), "segments.csv": segments_csv(a), "networkdata.csv": network_csv(a, weight), "dynamic_metrics.csv": dynamic_csv(a)}
    contents = {"metrics.json": metrics_json(a), "networkdata.gexf": gexf(a, weight=weight), "dynamic.gexf": gexf(a, dynamic=True, weight=weight), "networkdata.graphml": graphml(a, weight)}
    if payloads:
        contents["payload.json"] = payload_json(a)
    wanted_places = written(places)
    for name, df in tables.items():
        rows = wanted_places.join(df, "play_id", "left").groupBy("play_id")
        _put(rows.applyInPandas(_csv_of(name, [c for c in df.columns if c != "play_id"]), SCHEMA), out)
    for name, df in contents.items():
        own = next(c for c in df.columns if c != "play_id")
        _put(df.join(wanted_places, "play_id").select(F.col("_place").alias("place"), F.lit(name).alias("name"), F.col(own).alias("content")), out)
    found = sorted(r["_place"] for r in wanted_places.select("_place").collect())
    return [f"{out}/{place}/{name}" for name in (*tables, *contents) for place in found]


def _put(rows: DataFrame, out: str) -> None:
    register(rows.sparkSession)
    rows.write.format("play_files").mode("append").option("path", out).save()
