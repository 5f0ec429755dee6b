"""What pages do with a corpus: choose plays, fall back, sort tables, tell labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(rows: DataFrame, plays: DataFrame, invert: bool = False) -> DataFrame:
    """rows of the chosen plays, or of all others; comes before any median or range."""
    return rows.join(plays.select("play_id").distinct(), "play_id", "left_anti" if invert else "left_semi")


def active(plays: DataFrame, blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Plays that are chosen and have a block of the segmentation shown."""
    return selected(selected(plays, blocks), chosen)


def aggregated_or_raw(raw: DataFrame, aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """Each raw row with the values of its aggregated counterpart, if there is one; is_aggregated tells."""
    values = [c for c in raw.columns if c not in keys]
    other = aggregated.select(*keys, F.struct(*values).alias("_agg"))
    own = raw.select(*keys, F.struct(*values).alias("_raw")).join(other, keys, "left")
    return own.select(*keys, F.coalesce("_agg", "_raw").alias("_b"), F.col("_agg").isNotNull().alias("is_aggregated")).select(*keys, "_b.*", "is_aggregated")


def table_order(column: str, descending: bool = False, key: str | None = None) -> list[Column]:
    """orderBy of a sortable table: numbers by value and before text, text by its letters; key is another column to sort by."""
    text = F.col(key or column).cast("string")
    number = F.expr(f"try_cast(`{key or column}` AS DOUBLE)")
    return [number.desc_nulls_last(), F.lower(text).desc(), text.desc()] if descending else [number.asc_nulls_last(), F.lower(text), text]


def heard_enough(rows: DataFrame, words: int = 40) -> DataFrame:
    """Speakers that a table of temporal Gini shows."""
    return rows.where(F.col("total_words") >= words)


def visible(characters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Characters in the network shown."""
    return characters.join(nodes.select("play_id", "char_id").distinct(), ["play_id", "char_id"], "left_semi")


def shown_labels(plays: DataFrame, highlighted: Column, most: int = 20) -> DataFrame:
    """Adds labelled: all plays if there are at most ``most``, else those highlighted."""
    count = F.broadcast(plays.agg(F.count("*").alias("_n")))  # one row
    return plays.crossJoin(count).withColumn("labelled", (F.col("_n") <= most) | highlighted).drop("_n")


def chorus_keys() -> list[Column]:
    """orderBy of chorus rows: genre (none last), author, title and name."""
    return [F.coalesce("genre", F.lit("zz")), F.col("author"), F.col("title"), F.col("name")]


def authors(plays: DataFrame) -> DataFrame:
    """One row: authors, distinct and sorted."""
    return plays.agg(F.array_sort(F.collect_set(F.when(F.col("author") != "", F.col("author")))).alias("authors"))


def corpus_name(paths: list[str], plays: int, name: str | None = None) -> str:
    """The name given, else that of the only folder, else a label that tells how many plays there are."""
    from pathlib import Path

    if name:
        return name
    if len(paths) == 1 and Path(paths[0]).is_dir():
        return Path(paths[0]).name or "Corpus"
    return f"Custom corpus ({plays} play{'' if plays == 1 else 's'})"
