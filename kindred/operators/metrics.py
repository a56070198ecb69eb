"""F0.5 by entity and its macro mean, with breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("macro_f05", "n_s1", "f05_singletons", "f05_matched", "n_singletons", "singleton_rate_true", "singleton_rate_pred", "micro_precision", "micro_recall", "n_pred_pairs", "n_true_pairs")


def per_entity(pred: DataFrame, truth: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """s1, n_true, n_pred, tp, f05 for each s1 of ids.  Repeated pairs count once.

    Both sides are tagged and counted in one aggregation by pair and one by s1, without a join of the two.
    """
    tag = lambda d, t, p: d.select("s1", "cand").distinct().select("s1", "cand", F.lit(t).alias("t"), F.lit(p).alias("q"))
    both = tag(truth, 1, 0).unionByName(tag(pred, 0, 1)).groupBy("s1", "cand").agg(F.max("t").alias("t"), F.max("q").alias("q"))
    count = both.groupBy("s1").agg(F.sum("t").alias("n_true"), F.sum("q").alias("n_pred"), F.sum(F.col("t") * F.col("q")).alias("tp"))
    out = ids.select("s1", *keep).join(count, "s1", "left").fillna(0, ["n_true", "n_pred", "tp"])
    f = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("n_pred")))
    return out.withColumn("f05", f)


def _summary():
    single = F.col("n_true") == 0
    return [
        F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n_s1"),
        F.avg(F.when(single, F.col("f05"))).alias("f05_singletons"), F.avg(F.when(~single, F.col("f05"))).alias("f05_matched"),
        F.count(F.when(single, 1)).alias("n_singletons"), F.avg(single.cast("double")).alias("singleton_rate_true"),
        F.avg((F.col("n_pred") == 0).cast("double")).alias("singleton_rate_pred"),
        (F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("micro_precision"), (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("micro_recall"),
        F.sum("n_pred").alias("n_pred_pairs"), F.sum("n_true").alias("n_true_pairs"),
    ]


def breakdown(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    return per_entity(pred, truth, ids).agg(*_summary())


def by_group(pred: DataFrame, truth: DataFrame, ids: DataFrame, group: str) -> DataFrame:
    """The breakdown of each group and of all, whose group is null."""
    return per_entity(pred, truth, ids, group).rollup(group).agg(*_summary())
