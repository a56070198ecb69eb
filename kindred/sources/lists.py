"""Result lists: one row an entity, matched ids joined by commas; dumps of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_lists(pairs: DataFrame, ids: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """s1, name: ids by falling p, repeated pairs once; entities without a pair have an empty list."""
    best = pairs.groupBy("s1", "cand").agg(F.max("p").alias("p"))
    lists = best.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "cand"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["cand"].cast("string")), ",")
    return ids.select("s1").join(lists, "s1", "left").select("s1", F.coalesce(joined, F.lit("")).alias(name))


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated, unquoted, each part with a header; parts are ranges of the first column in order, so that they can be put end to end."""
    key = lists.columns[0]
    lists.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def error_dump(decided: DataFrame, left: DataFrame, right: DataFrame, most: int = 300) -> DataFrame:
    """The most confident false positives and false negatives with the texts of both sides; decided: s1, cand, p, y, keep."""
    kind = F.when((F.col("y") == 0) & F.col("keep"), "false_positive").when((F.col("y") == 1) & ~F.col("keep"), "false_negative")
    errors = decided.withColumn("kind", kind).filter("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("p").desc(), "s1", "cand"))
    top = errors.withColumn("place", place).filter(F.col("place") <= most).select("kind", "s1", "cand", "p")
    return top.join(left, "s1").join(right, "cand")


def missed_dump(missed: DataFrame, left: DataFrame, right: DataFrame, most: int = 300) -> DataFrame:
    """True pairs that blocking did not bring together, the first by id, with the texts of both sides; missed: s1, cand."""
    return missed.select("s1", "cand").orderBy("s1", "cand").limit(most).join(left, "s1").join(right, "cand").select(F.lit("blocking_miss").alias("kind"), "s1", "cand", F.lit(None).cast("double").alias("p"), *[c for c in left.columns if c != "s1"], *[c for c in right.columns if c != "cand"])
