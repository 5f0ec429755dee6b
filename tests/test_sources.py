"""The data source on deep and broken files, and the files' sink when tasks fail."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from castwise.sinks import files
from castwise.sources import datasource
from castwise.sources.tei import read_plays

HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title xml:lang="en">Deep</title></titleStmt></fileDesc></teiHeader><text><body>'
TAIL = "</body></text></TEI>"


def deep(depth: int) -> str:
    inner = '<stage><move type="entrance" who="#a"/></stage><sp who="#a"><p>three more words</p></sp>'
    return HEAD + "<div>" * depth + inner + "</div>" * depth + f'<sp who="#a">{"<seg>" * depth}one two{"</seg>" * depth}</sp>' + TAIL


def test_deep_files_and_partitions(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"p{i}.xml").write_text(deep(5000 if i == 0 else 3))
    (tmp_path / "bad.xml").write_text("<TEI><unclosed>")
    (tmp_path / "other.txt").write_text("no play")
    datasource.register(spark)
    got = spark.read.format("tei_plays").option("partition_mb", "0.00001").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 6
    rows = {Path(r["path"]).stem: r for r in got.collect()}
    assert sorted(rows) == ["bad", "p0", "p1", "p2", "p3", "p4"] and rows["bad"]["error"]
    for i in range(5):
        assert rows[f"p{i}"]["error"] is None and [s["word_count"] for s in rows[f"p{i}"]["speeches"]] == [3, 2]
        assert [(m["type"], m["who"], m["pos"], m["bare"]) for m in rows[f"p{i}"]["moves"]] == [("entrance", ["a"], 1, False)]
    same = [c for c in got.columns if c != "path"]
    plain = read_plays(spark, str(tmp_path)).select(*same).where("error is null")
    assert sorted(map(str, got.select(*same).where("error is null").collect())) == sorted(map(str, plain.collect()))


def test_one_file_and_a_missing_folder(spark, tmp_path):
    (tmp_path / "x.tei").write_text(deep(1))
    datasource.register(spark)
    assert spark.read.format("tei_plays").load(str(tmp_path / "x.tei")).count() == 1
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("tei_plays").load(str(tmp_path / "nowhere")).count()


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_all_files_or_none(spark, tmp_path):
    files.register(spark)
    out = str(tmp_path / "out")
    rows = spark.range(20).select(F.concat(F.lit("play"), (F.col("id") % 3).cast("string")).alias("place"), F.concat("id", F.lit(".txt")).alias("name"), F.repeat(F.lit("x"), 1000).alias("content")).repartition(4)
    put = lambda df: df.write.format("play_files").mode("append").option("path", out).save()
    broken = rows.withColumn("content", F.when(F.col("name") == "13.txt", F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        put(broken)
    assert names(tmp_path) == []  # other tasks had written theirs
    put(rows)
    assert len(names(out)) == 20 and not (tmp_path / "out" / "_staged").exists()
    with pytest.raises(Exception, match="one name"):
        put(rows.unionByName(rows))
    assert all((tmp_path / "out" / n).read_text() == "x" * 1000 for n in names(out))
