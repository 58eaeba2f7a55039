"""Which of many names occur in which texts of a unit, by an inverted index of n-grams.

A name is entered once, under the gram of it that the fewest names of its unit have; a text asks for each of its own
distinct grams. So a text meets only names that share a rare gram with it, and is then searched for these.
Names shorter than a gram are entered whole, and only texts of units that have such names ask for shorter grams.
In units of at most FEW names every text is searched for all of them, which is no more than that many searches a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import kept

GRAM = 4
FEW = 64


def _grams(text: Column, size: int | Column) -> Column:
    """Distinct substrings of ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def mentions(texts: DataFrame, names: DataFrame, few: int = FEW) -> DataFrame:
    """(unit_id, idx, name, and names' other columns): the texts (unit_id, idx, text) that contain a name; one row a pair.

    (unit_id, idx) is unique in texts and (unit_id, name) in names; null and empty names are in no text. The names are
    written once, as the plan is chosen by how many a unit has.
    """
    names = kept(names.where(F.length("name") > 0), "names")
    many = names.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select("unit_id")
    out = ["unit_id", "idx", *[c for c in names.columns if c != "unit_id"]]
    if not many.limit(1).count():
        return texts.join(names, "unit_id").where(F.contains("text", F.col("name"))).select(*out)
    small = texts.join(names.join(many, "unit_id", "left_anti"), "unit_id").where(F.contains("text", F.col("name"))).select(*out)
    large = _indexed(texts.join(many, "unit_id", "left_semi"), names.join(many, "unit_id", "left_semi").select("unit_id", "name"))
    return small.unionByName(large.join(names, ["unit_id", "name"]).select(*out))


def _indexed(texts: DataFrame, names: DataFrame) -> DataFrame:
    grams = names.select("unit_id", "name", F.explode(_grams(F.col("name"), F.least(F.length("name"), F.lit(GRAM)))).alias("gram"))
    common = grams.groupBy("unit_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    keys = grams.join(common, ["unit_id", "gram"]).groupBy("unit_id", "name").agg(F.min(F.struct("n", "gram")).alias("k")).select("unit_id", "name", F.col("k.gram").alias("gram"))
    asked = texts.select("unit_id", "idx", F.explode(_grams(F.col("text"), GRAM)).alias("gram"))
    short = names.where(F.length("name") < GRAM)
    if short.limit(1).count():
        some = texts.join(short.select("unit_id").distinct(), "unit_id", "left_semi")
        for n in range(1, GRAM):
            asked = asked.unionByName(some.select("unit_id", "idx", F.explode(_grams(F.col("text"), n)).alias("gram")))
    met = asked.join(keys, ["unit_id", "gram"]).select("unit_id", "idx", "name")
    return met.join(texts.select("unit_id", "idx", "text"), ["unit_id", "idx"]).where(F.contains("text", F.col("name"))).select("unit_id", "idx", "name")
