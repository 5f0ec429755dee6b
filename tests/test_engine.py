from __future__ import annotations

import json
import random
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pytest
from pyspark.sql import functions as F

from castwise.cli import corpus_paths, main
from castwise.functions import effective_number, gini, nature_class, register, word_count
from castwise.operators import graph, hierarchy, paths, segment
from castwise.operators.presence import presence_intervals
from castwise.operators.validation import issues
from castwise.plans.corpus import analyse
from castwise.sinks import exports
from castwise.sources.tei import play, read_plays, tables

from .tei_build import milestone, move, sp, stage, tei


def load(spark, tmp_path, *plays):
    for i, p in enumerate(plays):
        (tmp_path / f"p{i}.xml").write_text(p)
    return tables(read_plays(spark, str(tmp_path)).cache())


def casts(spark, tmp_path, people, body, **more):
    t = load(spark, tmp_path, tei(people, body, **more))
    here = presence_intervals(t["moves"])
    stream = segment.assigned(t["moves"], t["speeches"], here)
    sets = segment.cast_sets(segment.sd_segments(stream), segment.sd_cast(stream, here))
    return ["".join(r["members"]) for r in sets.orderBy("seg_id").collect()]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ([stage(move("entrance", "a")), sp("a", "x"), stage(move("entrance", "b")), sp("b", "y")], ["a", "ab"]),
        ([stage(move("entrance", "a")), sp("a", "x"), stage(move("state-change", "a", "asleep")), sp("a", "y")], ["a"]),
        ([stage(move("entrance", "a b")), sp("a", "x"), stage(move("exit", "b")), sp("a", "y")], ["ab", "a"]),
        ([stage(move("onStage")), stage(move("entrance", "a")), sp("a", "x")], ["", "a"]),
        ([stage(move("entrance", "a")), sp("a", "x"), sp("c", "y")], ["ac"]),
        ([move("entrance", "a"), sp("a", "x"), move("exit", "a"), move("entrance", "b"), sp("b", "y")], ["a", "b"]),
        ([stage(move("entrance", "a")), stage(move("crossing", "c", "fetch-prop")), sp("a", "x")], ["a"]),
        ([stage(move("entrance", "a")), sp("a", "x"), stage(move("exit", "a")), stage(move("onStage"))], ["a", ""]),
    ],
)
def test_sd_casts(spark, tmp_path, body, expected):
    assert casts(spark, tmp_path, ["a", "b", "c"], body) == expected


def state_by_rule(moves):
    """The rules one move after another."""
    state, out = set(), []
    for pos, kind, who, corresp in moves:
        if kind == "entrance" or (kind == "onStage" and who):
            state |= set(who)
        elif kind == "onStage":
            state = set()
        elif kind == "exit":
            state -= set(who)
        elif kind in ("split", "merge"):
            state = (state - set(who)) | set(corresp)
        out.append((pos, frozenset(state)))
    return out


def test_presence_is_the_sequential_state(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for p in range(60):
        moves = []
        for pos in range(1, 20):
            kind = rng.choice(["entrance", "exit", "onStage", "merge", "split", "crossing"])
            who = sorted(rng.sample("abcd", rng.randint(0 if kind == "onStage" else 1, 2)))
            corresp = sorted(rng.sample("abcd", rng.randint(1, 2))) if kind in ("merge", "split") else []
            moves.append((pos, kind, who, corresp))
            rows.append((str(p), pos, kind, who, corresp))
        for pos, s in state_by_rule(moves):
            want[str(p), pos] = s
    found = presence_intervals(spark.createDataFrame(rows, "play_id string, pos int, type string, who array<string>, corresp array<string>")).collect()
    got = {k: frozenset(r["char_id"] for r in found if r["play_id"] == k[0] and r["start_pos"] <= k[1] and (r["end_pos"] is None or r["end_pos"] > k[1])) for k in want}
    assert got == want


def fold_by_rule(blocks):
    """Merge a block iff no boundary of the whole run is crossed by somebody who speaks in it."""
    runs = [[blocks[0]]] if blocks else []
    for b in blocks[1:]:
        run = [*runs[-1], b]
        said = set().union(*(s for _, s in run))
        fine = all(bool(x) == bool(y) and not (x ^ y) & said for (x, _), (y, _) in zip(run[:-1], run[1:], strict=True))
        if fine:
            runs[-1] = run
        else:
            runs.append([b])
    return [len(r) for r in runs]


def test_speaking_fold(spark):
    rng = random.Random(7)
    sets, said, want = [], [], {}
    for p in range(40):
        blocks, last = [], None
        for i in range(8):
            cast = set(rng.sample("abc", rng.randint(0, 3)))
            if cast == last:
                continue
            last = cast
            voices = {c for c in cast if rng.random() < 0.4}
            blocks.append((cast, voices))
        for i, (c, v) in enumerate(blocks, 1):
            sets.append((str(p), i, sorted(c)))
            said += [(str(p), i, x) for x in v]
        want[str(p)] = fold_by_rule(blocks)
    a = spark.createDataFrame(sets, "play_id string, seg_id long, members array<string>")
    got = segment.speaking_fold(a, spark.createDataFrame(said, "play_id string, seg_id long, char_id string")).groupBy("play_id", "fold_id").count().orderBy("play_id", "fold_id").collect()
    by = {}
    for r in got:
        by.setdefault(r["play_id"], []).append(r["count"])
    assert by == want


def edges_of(spark, pairs):
    e = spark.createDataFrame([("p", a, b, w) for a, b, w in pairs], "play_id string, src string, dst string, segments_shared long")
    n = e.select("play_id", F.explode(F.array("src", "dst")).alias("char_id")).distinct()
    return n, e


def test_graph_measures(spark):
    n, e = edges_of(spark, [("a", "b", 3), ("a", "c", 3), ("b", "c", 3), ("a", "d", 1), ("x", "y", 1)])
    c = {r["char_id"]: r for r in graph.clustering(n, e).collect()}
    assert (c["d"]["clustering"], c["d"]["triangles"]) == (0, 0)
    assert c["a"]["clustering"] == pytest.approx(1 / 3) and c["b"]["clustering"] == 1
    p = {r["char_id"]: r for r in paths.path_measures(n, e).collect()}
    assert p["a"]["betweenness"] == pytest.approx(2 / 10) and p["b"]["betweenness"] == 0
    assert p["a"]["closeness"] == pytest.approx(3 / 3 * 3 / 5) and p["y"]["component"] == "x"
    assert p["x"]["eigenvector"] == pytest.approx(0.5**0.5) and sum(p[k]["eigenvector"] ** 2 for k in "abcd") == pytest.approx(1)
    s = paths.path_summary(paths.path_measures(n, e)).first()
    assert (s["components"], s["isolates"], s["diameter"]) == (2, 0, 2) and s["average_path_length"] == pytest.approx(16 / 12)


def brute_betweenness(nodes, edges):
    near = {v: [b if a == v else a for a, b in edges if v in (a, b)] for v in nodes}

    def paths(s, t):
        level = [[s]]
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [[*p, u] for p in level for u in near[p[-1]] if u not in p]
        return []

    out = dict.fromkeys(nodes, 0.0)
    for i, s in enumerate(nodes):
        for t in nodes[i + 1 :]:
            ways = paths(s, t)
            for w in ways:
                for v in w[1:-1]:
                    out[v] += 1 / len(ways)
    k = (len(nodes) - 1) * (len(nodes) - 2) / 2
    return {v: x / k for v, x in out.items()}


def test_betweenness_against_all_paths(spark):
    rng = random.Random(3)
    names = list("abcdefg")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.4]
    n, e = edges_of(spark, [(a, b, 1) for a, b in pairs])
    own = sorted({x for p in pairs for x in p})
    want = brute_betweenness(own, pairs)
    for r in paths.path_measures(n, e).collect():
        assert r["betweenness"] == pytest.approx(want[r["char_id"]])


def test_numbers(spark):
    rows = spark.createDataFrame([([5, 5, 5, 5],), ([0, 0, 0, 4],), ([],), (None,)], "v array<int>")
    got = [(r[0], r[1], r[2]) for r in rows.select(F.round(gini("v"), 6), F.round(gini("v", True), 6), effective_number("v")).collect()]
    assert got[0] == (0, 0, 4) and got[1] == (0, 0.75, 1) and got[2] == (0, 0, 0)
    assert spark.range(1).select(word_count(F.lit("one † two— – 3 b"))).first()[0] == 4
    assert spark.range(1).select(nature_class(F.lit("Abstraction"))).first()[0] == "concept"
    register(spark)
    assert spark.sql("SELECT round(gini(array(1D, 3D)), 6), effective_number(array(2D, 2D)), change_rate(array('a'), array('a', 'b'))").first()[:] == (0.25, 2.0, 0.5)


def test_hierarchy(spark):
    r = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c")], "play_id string, part string, whole string")
    closed = hierarchy.closure(r)
    assert {(x["part"], x["whole"], x["depth"]) for x in closed.collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}
    only = lambda *g: {(x["part"], x["whole"]) for x in hierarchy.targets(r, spark.createDataFrame([("p", i) for i in g], "play_id string, char_id string")).collect()}
    assert only("b") == {("a", "b")} and only("c") == {("a", "c"), ("b", "c")} and only("b", "c") == {("a", "c"), ("b", "c")} and only("z") == set()
    loop = spark.createDataFrame([("p", "a", "b"), ("p", "b", "a")], "play_id string, part string, whole string")
    assert {(x["part"], x["whole"]) for x in hierarchy.closure(loop).collect()} == {("a", "b"), ("b", "a")}


PLAY = tei(
    ["a:male:human", "b:female:divine", "g:group", "p1", "p2", "m"],
    [
        milestone("large-seq", "L1", "prologue"), milestone("middle-seq", "s1"),
        stage(move("entrance", "a")), sp("a", "one two three"), stage(move("entrance", "p1 p2")), sp("p1", "four"),
        milestone("middle-seq", "s2"), stage(move("exit", "p2")), sp("a p1", "five <note>not me</note>six"),
        milestone("large-seq", "L2"), milestone("middle-seq", "s3"), stage(move("entrance", "b m"), move("exit", "p1")), sp("b", "seven"), sp("b"),
    ],
    relations=[("p1", "g"), ("p2", "g")],
)


def test_corpus(spark, tmp_path):
    t = load(spark, tmp_path, PLAY, "<TEI><broken>")
    assert t["failed"].count() == 1 and t["plays"].first()["play_id"] == "tlg0019.tlg003"
    a = {k: v.cache() for k, v in analyse(t).items()}
    c = {(r["segmentation"], r["model"], r["aggregated"]): r for r in a["comparison"].collect()}
    assert len(c) == 3 * 3 * 2
    full = c["sd", "full", ""]
    assert (full["order"], full["segments"], full["components"]) == (5, 4, 1)
    assert full["top_speaker"] == "a" and full["top_speaker_word_share"] == pytest.approx(5 / 9)
    assert c["sd", "full", "g"]["order"] == 4 and c["sd", "s-speaking", ""]["order"] == 3
    assert c["large-seq", "full", ""]["segments"] == 2 and c["middle-seq", "full", ""]["segments"] == 3
    for r in c.values():  # invariants of every configuration
        assert 0 <= r["density"] <= 1 and 0 <= r["gini_words"] < 1 and 0 <= r["all_in_index"] <= 1 and 0 <= r["final_segment_cast_share"] <= 1
        assert r["edges"] <= r["order"] * (r["order"] - 1) / 2 and r["effective_speakers"] <= 3 + 1e-9
    nodes = {}
    for r in a["nodes"].join(a["variants"], "play_id").collect():
        nodes.setdefault((r["segmentation"], r["groups"], r["model"]), set()).add(r["char_id"])
    for (seg, g, m), x in nodes.items():  # s-speaking within p-speaking within full
        if m == "s-speaking":
            assert x <= nodes[seg, g, "p-speaking"]
    for df, column in ((exports.gexf(a), "gexf"), (exports.gexf(a, dynamic=True), "gexf"), (exports.graphml(a), "graphml")):
        for r in df.collect():
            ElementTree.fromstring(r[column].split("\n", 1)[1])
    for r in exports.payload_json(a).collect():
        assert "<" not in r["payload"] and {c["id"] for c in json.loads(r["payload"])["characters"]} <= {"a", "b", "g", "p1", "p2", "m"}
    made = exports.write(a, t["plays"], str(tmp_path / "out"))
    assert len(made) == 3 * 8 and all(Path(m).exists() for m in made)
    exports.write_corpus(a, t["plays"], "Demo", str(tmp_path / "corpus.json"))
    corpus = json.loads((tmp_path / "corpus.json").read_text())
    assert corpus["name"] == "Demo" and len(corpus["plays"]) == 1 and len(corpus["plays"][0]["blocks"]) == 9 and all(b["agg"]["aggregated"] == "g" for b in corpus["plays"][0]["blocks"])
    assert {r["id"] for r in exports.characters_csv(a).collect()} == {"a", "b", "g", "p1", "p2", "m"}
    told = {(r["code"], r["detail"]) for r in issues(t).collect()}
    assert told == set()


def test_issues(spark, tmp_path):
    body = [sp("a", "early"), milestone("large-seq", "L"), milestone("middle-seq", "m"), move("exit", "a", "asleep"), stage(move("crossing", "z")), milestone("large-seq", "L2"), stage(move("state-change", "a", "awake asleep odd")), sp("a", "x")]
    t = load(spark, tmp_path, tei(["a"], body, relations=[("a", "nobody")], urn="none"))
    assert {r["code"] for r in issues(t).collect()} == {"speech-off-stage", "before-first-large", "before-first-middle", "bare-moves", "tokens-forbidden", "tokens-missing", "undeclared-id", "unit-straddles", "state-change-absent", "axis-conflict-capacity", "unknown-token", "relation-dropped", "no-work-id"}


def test_parser_reads_no_external_entity(tmp_path):
    secret = tmp_path / "secret"
    secret.write_text("hidden")
    text = f'<!DOCTYPE TEI [<!ENTITY x SYSTEM "file://{secret}">]><TEI><text><body><sp who="#a"><l>one &x; two</l></sp></body></text></TEI>'
    assert play(text.encode(), "f.xml")["speeches"][0]["word_count"] == 2


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.xml").write_text(PLAY)
    assert corpus_paths([str(tmp_path / "in"), str(tmp_path / "in" / "p.xml"), str(tmp_path / "none")]) == [str((tmp_path / "in" / "p.xml").resolve())]
    assert main(["corpus", str(tmp_path / "none")]) == 1
    assert main(["analyze", str(tmp_path / "in" / "p.xml"), "--seg", "sd", "--out", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "Demo" / "sd" / "characters.csv").exists()


def test_script_safe(spark):
    text = "a b<c>&\u2028\u2029"
    assert spark.range(1).select(exports.script_safe(F.lit(text))).first()[0] == "a b\\u003cc\\u003e\\u0026\\u2028\\u2029"


def streamed(spark, moves, files, where, **how):
    """What comes out when the rows of each file are one batch, in this order, and a far move of another play ends the day."""
    from castwise.streaming.stage import presence_changes

    timed = moves.select("play_id", F.col("pos").cast("long").alias("pos"), "type", "who", "corresp").withColumn("ts", F.timestamp_seconds(F.col("pos") + 1_700_000_000)).toPandas()
    schema = "play_id string, pos long, type string, who array<string>, corresp array<string>, ts timestamp"
    Path(where).mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(where)
    q = presence_changes(source, **how).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", where + "-state").start()
    try:
        for rows in (*files, None):
            part = timed.iloc[rows] if rows is not None else timed.iloc[:1].assign(play_id="~", ts=timed["ts"].max() + pd.Timedelta(days=9))
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
            q.processAllAvailable()
        state = q.lastProgress
    finally:
        q.stop()
    return [(r["play_id"], r["pos"], r["char_id"], r["on"]) for r in spark.table("changes").where("play_id <> '~'").collect()], state


def batch_changes(moves):
    return {(r["play_id"], r[p], r["char_id"], on) for r in presence_intervals(moves).collect() for p, on in (("start_pos", 1), ("end_pos", 0)) if r[p] is not None}


def test_shuffled_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for play_id in ("a", "b"):
        for pos in range(1, 60):
            kind = rng.choice(["entrance", "entrance", "exit", "onStage", "split", "merge", "crossing", "clear"])
            who = [] if kind == "clear" else rng.sample("uvwxyz", rng.randint(1, 2))
            rows.append((play_id, pos, "onStage" if kind == "clear" else kind, who, rng.sample("uvwxyz", 1) if kind in ("split", "merge") else []))
    moves = spark.createDataFrame(rows, "play_id string, pos long, type string, who array<string>, corresp array<string>").coalesce(1)
    order = rng.sample(range(len(rows)), len(rows))
    got, state = streamed(spark, moves, [order[i::4] for i in range(4)], str(tmp_path / "moves"))
    assert len(got) == len(set(got)) and set(got) == batch_changes(moves)
    assert sum(s["numRowsTotal"] for s in state["stateOperators"]) < 20  # the plays' states are gone


def test_long_chains_and_last_parents(spark):
    chain = spark.createDataFrame([("p", f"{i:02d}", f"{i + 1:02d}") for i in range(12)] + [("q", "a", "b"), ("q", "b", "a"), ("q", "c", "a")], "play_id string, part string, whole string")
    got = hierarchy.closure(chain)
    assert got.where("play_id = 'p'").count() == 78 and {(r["part"], r["whole"]) for r in got.where("play_id = 'q'").collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")}
    two = spark.createDataFrame([("p", "x", "g", 0), ("p", "x", "h", 1), ("p", "g", "top", 2)], "play_id string, part string, whole string, n int")
    assert {(r["part"], r["whole"]) for r in hierarchy.targets(two).collect()} == {("x", "h"), ("g", "top")}


def test_too_many_groups_are_refused(spark):
    from castwise.plans.variants import MAX_GROUPS, masks

    plays = spark.createDataFrame([("p",)], "play_id string")
    group = lambda n: F.array(*(F.lit(str(i)) for i in range(n)))
    assert masks(plays, group(5)).count() == 31
    with pytest.raises(Exception, match="has over"):
        masks(plays, group(MAX_GROUPS + 1)).count()


def test_files_of_any_extension(spark, tmp_path):
    (tmp_path / "a.tei").write_text(PLAY)
    assert read_plays(spark, str(tmp_path / "a.tei")).where("error is null").count() == 1


def test_one_title_and_stem_are_refused(spark):
    rows = spark.createDataFrame([("a", "/x/f.xml", "T"), ("b", "/y/g.xml", "T"), ("c", "/z/g.xml", "T")], "play_id string, path string, title_en string")
    assert [r["folder"] for r in exports.play_folders(rows).orderBy("path").collect()] == ["T", "T-g", "T-g"]
    assert exports.recorded_source("/nowhere") is None


def test_pairs_and_sessions(spark, tmp_path):
    from castwise.functions import register
    from castwise.streaming.stage import sessions, unit_counts

    register(spark)
    assert {tuple(r) for r in spark.sql("SELECT * FROM pairs(array('b', 'a', 'c', 'a'))").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    rows = [(f"2024-01-01 00:{m:02d}:00", u, 1.0) for u, m in ((1, 0), (1, 20), (1, 59), (2, 5))] + [("2024-01-02 00:00:00", 3, 1.0)]
    spark.createDataFrame(rows, "t string, user_id int, value double").selectExpr("to_timestamp(t) ts", "user_id", "value", "'x' event_type").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    for name, plan, want in (("s", sessions, {(1, 2), (1, 1), (2, 1)}), ("u", unit_counts, {(None, 4)})):
        q = plan(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r["user_id"] if name == "s" else None, r["n"]) for r in spark.table(name).collect()}
        assert got == want
