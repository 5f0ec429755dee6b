"""Column expressions of the engine, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STRUCTURAL = ("entrance", "exit", "onStage", "merge", "split")


def word_count(text: Column) -> Column:
    """Tokens between (Unicode) white space that hold a letter or digit; null text: 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))).cast("long")


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def display_name(en: Column, grc: Column, char_id: Column) -> Column:
    return F.coalesce(blank_to_null(en), blank_to_null(grc), char_id)


def nature_class(nature: Column) -> Column:
    n = F.lower(nature)
    # The buckets, and the words that count as a concept.
    return F.when(n.isin("human", "divine", "animal"), n).when(n.isin("concept", "personified-concept", "personified-abstraction", "abstraction"), F.lit("concept")).otherwise(F.lit("other"))


def sex_class(sex: Column) -> Column:
    s = F.lower(sex)
    return F.when(s.isin("male", "female", "mixed"), s).otherwise(F.lit("unspecified"))


def unit_label(kind: Column, n: Column, xml_id: Column, pos: Column) -> Column:
    named = F.concat_ws("/", blank_to_null(kind), blank_to_null(n), blank_to_null(xml_id))
    return F.when(named != "", named).otherwise(F.concat(F.lit("<unit-"), pos.cast("string"), F.lit(">")))


def role(is_mute: Column, is_chorus: Column, is_collective: Column) -> Column:
    return F.when(is_mute, "mute").when(is_chorus, "chorus").when(is_collective, "collective").otherwise("individual")


def ratio(part: Column, whole: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(whole != 0, part / whole)


def gini(values: Column, include_zeros: bool = False) -> Column:
    """Of an array of numbers; empty or all zero: 0."""
    v = F.array_sort(values if include_zeros else F.filter(values, lambda x: x > 0))

    def of(s: Column) -> Column:
        n, zero = F.size(s), F.lit(0.0)
        total = F.aggregate(s, zero, lambda a, x: a + x)
        ranked = F.aggregate(F.zip_with(s, F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x, i: x * i), zero, lambda a, x: a + F.coalesce(x, zero))
        return F.when((n > 0) & (total > 0), 2 * ranked / (n * total) - (n + 1) / n).otherwise(zero)

    return F.transform(F.array(F.transform(v, lambda x: x.cast("double"))), of)[0]


def effective_number(values: Column) -> Column:
    """(sum v)^2 / sum v^2 over positive values; 0 without any."""
    v = F.filter(F.transform(values, lambda x: x.cast("double")), lambda x: x > 0)
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    q = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(q > 0, s * s / q).otherwise(F.lit(0.0))


def change_rate(a: Column, b: Column) -> Column:
    """Share of the union of two sets that is in one of them only; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, (union - F.size(F.array_intersect(a, b))) / union).otherwise(F.lit(0.0))


def clean_file_name(title: Column) -> Column:
    """Runs of other characters than letters, digits, '.', '_' and '-' become '_'; bare ends; else 'play'."""
    name = F.regexp_replace(F.regexp_replace(F.trim(title), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(blank_to_null(name), F.lit("play"))


# Authors by whom a play without a genre is told, comedy first.
COMEDY = ("aristophanes", "menander", "plautus", "terence", "ἀριστοφάνης", "αριστοφάνης", "μένανδρος")
TRAGEDY = ("sophocles", "euripides", "aeschylus", "seneca", "σοφοκλῆς", "σοφοκλης", "εὐριπίδης", "ευριπίδης", "αἰσχύλος", "αισχύλος")


def genre(own: Column, author: Column) -> Column:
    a = F.lower(F.coalesce(author, F.lit("")))
    return F.coalesce(blank_to_null(own), F.when(a.rlike("|".join(COMEDY)), "comedy").when(a.rlike("|".join(TRAGEDY)), "tragedy").otherwise("other"))


def register(spark: SparkSession) -> None:
    """SQL functions gini, effective_number and change_rate, and the table function pairs (SQL bodies, no Python at run time)."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION gini(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        coalesce((SELECT CASE WHEN sum(x) > 0 THEN 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) ELSE 0 END
                  FROM (SELECT col AS x, pos + 1 AS i FROM posexplode(array_sort(filter(v, e -> e > 0))))), 0)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION effective_number(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        coalesce(pow(aggregate(filter(v, e -> e > 0), 0D, (a, e) -> a + e), 2) / nullif(aggregate(v, 0D, (a, e) -> a + e * e), 0), 0)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION change_rate(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN
        coalesce(1 - size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0), 0)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION pairs(members ARRAY<STRING>) RETURNS TABLE(src STRING, dst STRING) RETURN
        SELECT a.col AS src, b.col AS dst FROM explode(array_distinct(members)) AS a JOIN explode(array_distinct(members)) AS b ON a.col < b.col""")
