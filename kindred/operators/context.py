"""Second-stage features: how a candidate stands among the others of its s1, and its s1 among the others of the candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.strings import logit


def _by(key: str, tie: str):
    w = Window.partitionBy(key)
    return w, w.orderBy(F.col("p").desc(), tie)


def group_stats(pairs: DataFrame) -> DataFrame:
    """Within each s1: rank from 0, gap to the best, share, count over a half (in all and by source), sum and maximum."""
    w, ranked = _by("s1", "cand")
    total = F.sum("p").over(w)
    over = lambda c: F.count(F.when((F.col("p") > 0.5) & c, 1)).over(w)
    out = {
        "p1_logit": logit(F.col("p")),
        "s1_rank": F.row_number().over(ranked) - 1,
        "s1_gap_to_best": F.col("p") - F.max("p").over(w),
        "s1_share": F.when(total > 0, F.col("p") / total).otherwise(0.0),
        "s1_cnt_over05": over(F.lit(True)),
        "s1_sum_p": total,
        "s1_max_p": F.max("p").over(w),
    }
    if "source" in pairs.columns:
        out |= {f"s1_cnt_over05_src{s}": over(F.col("source") == s) for s in (2, 3)}
    return pairs.withColumns(out)


def competition(pairs: DataFrame) -> DataFrame:
    """Within each candidate: the best probability at another s1 (0 if none), the margin to it, whether this is the best."""
    w, ranked = _by("cand", "s1")
    r = F.row_number().over(ranked)
    first = pairs.withColumn("r", r)
    second = F.max(F.when(F.col("r") == 2, F.col("p"))).over(w)
    other = F.when(F.col("r") == 1, F.coalesce(second, F.lit(0.0))).otherwise(F.max("p").over(w))
    out = first.withColumns({"comp_best_other": other, "comp_n_s1_over05": F.count(F.when(F.col("p") > 0.5, 1)).over(w), "comp_n_s1": F.count(F.lit(1)).over(w)})
    return out.withColumns({"comp_margin": F.col("p") - F.col("comp_best_other"), "comp_is_argmax": (F.col("r") == 1).cast("int")}).drop("r")


def top_peers(pairs: DataFrame, k: int = 3) -> DataFrame:
    """s1, cand, peer, peer_p, peer_rank (1 to k): the k best other candidates of the same s1.

    Only the k + 1 best of an s1 can be anyone's peer, so the join meets each pair with k + 1 rows at most.
    """
    _, ranked = _by("s1", "cand")
    placed = pairs.select("s1", "cand", "p", F.row_number().over(ranked).alias("r"))
    best = placed.filter(F.col("r") <= k + 1).select("s1", F.col("cand").alias("peer"), F.col("p").alias("peer_p"), F.col("r").alias("r2"))
    met = placed.join(best, "s1").filter(F.col("r") != F.col("r2"))
    rank = F.when(F.col("r2") > F.col("r"), F.col("r2") - 1).otherwise(F.col("r2"))  # the row itself leaves a gap
    return met.withColumn("peer_rank", rank).filter(F.col("peer_rank") <= k).select("s1", "cand", "p", "peer", "peer_p", "peer_rank")


def max_and_mean(peers: DataFrame, value: Column, name: str, where: Column | None = None) -> list[Column]:
    """Aggregates over peers: the largest value, and the mean weighted by the peers' probability; null values are left out."""
    v = value if where is None else F.when(where, value)
    w = F.when(v.isNotNull(), F.col("peer_p"))
    return [F.max(v).alias(f"{name}_max"), F.when(F.count(v) > 0, F.sum(v * w) / (F.sum(w) + 1e-6)).alias(f"{name}_wmean")]


def cluster_agreement(peers: DataFrame) -> DataFrame:
    """peers with addr_sim, hn_same, name_sim, opposite (booleans): one row a pair with the five agreement columns."""
    sim = F.coalesce("addr_sim", F.lit(0.0))
    addr_max, addr_mean = max_and_mean(peers, sim, "clu_addr")
    opposite, _ = max_and_mean(peers, sim, "clu_addr_opp", F.col("opposite"))
    house, _ = max_and_mean(peers, F.col("hn_same"), "clu_hn")
    names, _ = max_and_mean(peers, F.col("name_sim"), "clu_name")
    return peers.groupBy("s1", "cand").agg(addr_max, addr_mean, house.alias("clu_hn_agree"), opposite, names)


def twins(peers: DataFrame) -> DataFrame:
    """peers with n_key, peer_key, hn, peer_hn: whether a better peer has the same name but another house number, and by how much."""
    t = (F.col("n_key") != "") & (F.col("n_key") == F.col("peer_key")) & (F.col("hn") != "") & (F.col("peer_hn") != "") & (F.col("hn") != F.col("peer_hn")) & (F.col("peer_p") > F.col("p"))
    gap = F.max(F.when(t, F.col("peer_p") - F.col("p")))
    return peers.groupBy("s1", "cand").agg(gap.isNotNull().cast("int").alias("twin_better"), gap.alias("twin_gap"))
