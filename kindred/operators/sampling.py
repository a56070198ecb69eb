"""Splits and samples that depend on ids alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.native import id_fraction


def splits(ids: DataFrame, id_col: str = "s1", hidden: float = 0.15, folds: int = 5) -> DataFrame:
    """id, hidden, fold: which records act as distractors alone, and which fold scores a record."""
    u = id_fraction(F.col(id_col))
    v = id_fraction(F.concat(F.lit("fold:"), F.col(id_col).cast("string")))
    return ids.select(id_col, (u < hidden).alias("hidden"), F.floor(v * folds).cast("int").alias("fold"))


def hash_sample(s1: DataFrame, pool: DataFrame, truth: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """s1 by hash; the pool records matched to what stays, and of those matched to nobody a share by hash."""
    kept = s1.filter(id_fraction(F.col("s1")) < rate)
    matched = truth.join(kept.select("s1"), "s1", "left_semi").select("cand").distinct()
    theirs = pool.join(matched, "cand", "left_semi")
    loose = pool.join(truth.select("cand").distinct(), "cand", "left_anti").filter(id_fraction(F.col("cand")) < rate)
    return kept, theirs.unionByName(loose)


def group_sample(s1: DataFrame, group: str, country: str, share: float, must: tuple[str, ...] = ()) -> DataFrame:
    """country, group, n: whole groups, the musts first and the others by hash, until they hold the share of a country's records."""
    total = s1.groupBy(country).agg(F.count(F.lit(1)).alias("total"))
    sizes = s1.filter(F.col(group) != "").groupBy(country, group).agg(F.count(F.lit(1)).alias("n")).join(total, country)
    first = F.col(group).isin(*must) if must else F.lit(False)
    u = id_fraction(F.concat_ws("|", country, group))
    w = Window.partitionBy(country).orderBy(F.when(first, 0).otherwise(1), u, group).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return sizes.withColumn("before", before).filter(first | (F.col("before") < F.col("total") * share)).select(country, group, "n")


def group_pool(pool: DataFrame, truth: DataFrame, kept: DataFrame, groups: DataFrame, group: str, country: str, share: float) -> DataFrame:
    """The pool records that go with a sample of whole groups, and why: matched to a kept s1, of a kept group, or without
    a group and within the share by hash; the first reason counts.

    pool: cand, group, country; truth: s1, cand; kept: s1; groups: country, group.
    """
    mine = truth.join(kept.select("s1"), "s1", "left_semi").select("cand").distinct().withColumn("mine", F.lit(True))
    of = groups.select(country, group).distinct().withColumn("of", F.lit(True))
    j = pool.join(mine, "cand", "left").join(of, [country, group], "left")
    loose = (F.col(group) == "") & (id_fraction(F.col("cand")) < share)
    why = F.when(F.col("mine"), "matched").when(F.col("of"), "group").when(loose, "hash")
    return j.withColumn("why", why).filter("why IS NOT NULL").select(*pool.columns, "why")
