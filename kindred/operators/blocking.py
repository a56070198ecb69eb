"""Candidate generation: capped equi-joins, similarity top-k joins, their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.tokens import tfidf

SCORES = ("sc_name", "sc_na", "sc_addr", "sc_rev")
RANKS = ("rk_name", "rk_na", "rk_addr", "rk_rev")
FLAGS = ("ex_name", "ex_street", "ex_hn")
NOT_RETRIEVED = 99


def all_present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(k) != "", F.lit(False)) for k in keys])


def state_gate(a: Column, b: Column) -> Column:
    """States agree or one of them is missing."""
    return (a == b) | (a == "") | (b == "")


def exact_key_pairs(s1: DataFrame, pool: DataFrame, keys: list[str], cap: int = 300, country: str = "country", gate: str | None = None) -> DataFrame:
    """s1, cand of records with equal, non-empty keys in one country.

    Keys that more than cap pool records share are left out, which bounds what a record of s1 can meet; the counts
    are aggregated before anything is joined.
    """
    on = [country, *keys]
    left = s1.filter(all_present(keys)).select(F.col("id").alias("s1"), *on, *([F.col(gate).alias("g1")] if gate else []))
    right = pool.filter(all_present(keys)).select(F.col("id").alias("cand"), *on, *([F.col(gate).alias("g2")] if gate else []))
    rare = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cap).select(*on)
    joined = left.join(right.join(rare, on, "left_semi"), on)
    return (joined.filter(state_gate(F.col("g1"), F.col("g2"))) if gate else joined).select("s1", "cand")


def partition_join(q: DataFrame, p: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    """q and p joined on keys where p has q's label or none, or q has none: three disjoint equi-joins instead of an OR.

    q has qid, p has pid; the label of q names the partition.
    """
    a, b = q.withColumnRenamed(label, "part"), p.withColumnRenamed(label, "plabel")
    same = a.filter("part <> ''").join(b.filter("plabel <> ''").withColumnRenamed("plabel", "part"), [*on, "part"])
    open_pool = a.filter("part <> ''").join(b.filter("plabel = ''").drop("plabel"), on)
    open_query = a.filter("part = ''").join(b.drop("plabel"), on)
    return same.unionByName(open_pool).unionByName(open_query)


def similarity_topk(q: DataFrame, p: DataFrame, k: int, k_reverse: int = 0, threshold: float = 0.05, **weights) -> tuple[DataFrame, DataFrame | None]:
    """Cosine of character-gram weights: (forward, reverse) with s1, cand, score, rank from 0.

    q and p: id, country, label, text.  Forward ranks each query's pool records, reverse each pool record's queries
    within the query's partition.  Ties go to the smaller id.  Rows that repeat an id are one record, of all their texts.
    """
    if k <= 0:
        empty = q.limit(0).select(F.col("id").alias("s1"), F.col("id").alias("cand"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return empty, empty
    texts = q.select("id", F.lit("q").alias("side"), "country", "text").unionByName(p.select("id", F.lit("p").alias("side"), "country", "text"))
    w = tfidf(texts, **weights)
    qw = w.filter("side = 'q'").join(q.select("id", "country", "label").distinct(), ["id", "country"]).select(F.col("id").alias("s1"), "country", "gram", F.col("w").alias("wq"), "label")
    pw = w.filter("side = 'p'").join(p.select("id", "country", "label").distinct(), ["id", "country"]).select(F.col("id").alias("cand"), "country", "gram", F.col("w").alias("wp"), "label")
    met = partition_join(qw, pw, ["country", "gram"])
    scored = met.groupBy("country", "part", "s1", "cand").agg(F.round(F.sum(F.col("wq") * F.col("wp")), 6).alias("score")).filter(F.col("score") > threshold)
    best = Window.partitionBy("country", "s1").orderBy(F.col("score").desc(), "cand")
    forward = scored.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k).select("s1", "cand", "score", "rank")
    if k_reverse <= 0:
        return forward, None
    back = Window.partitionBy("country", "part", "cand").orderBy(F.col("score").desc(), "s1")
    return forward, scored.withColumn("rank", F.row_number().over(back) - 1).filter(F.col("rank") < k_reverse).select("s1", "cand", "score", "rank")


def union_merge(frames: list[DataFrame]) -> DataFrame:
    """One row a pair: largest scores, least ranks, flags; what no frame retrieved is 0, 99 and 0."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    for c in (*SCORES, *RANKS, *FLAGS):
        if c not in every.columns:
            every = every.withColumn(c, F.lit(None).cast("double" if c in SCORES else "int"))
    return every.groupBy("s1", "cand").agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in SCORES],
        *[F.coalesce(F.min(c), F.lit(NOT_RETRIEVED)).alias(c) for c in RANKS],
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in FLAGS],
    )


def heuristic_cap(pairs: DataFrame, cap: int = 150) -> DataFrame:
    """The cap best pairs of each s1 by largest score plus flags; ties to the smaller cand."""
    h = F.greatest(*SCORES) + sum(F.col(c) for c in FLAGS)
    w = Window.partitionBy("s1").orderBy(F.desc("h"), "cand")
    return pairs.withColumn("h", h).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).drop("h", "r")


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 where the pair is true."""
    t = truth.select("s1", "cand").distinct().withColumn("hit", F.lit(1))
    return pairs.join(t, ["s1", "cand"], "left").withColumn("y", F.coalesce("hit", F.lit(0))).drop("hit")


def missed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.select("s1", "cand").join(pairs.select("s1", "cand"), ["s1", "cand"], "left_anti")


def recall(pairs: DataFrame, truth: DataFrame, queried: DataFrame) -> DataFrame:
    """One row: n_gt_pairs, n_hit, blocking_recall, n_pairs, pairs_per_s1, over the s1 that are queried."""
    t = truth.select("s1", "cand").join(queried.select("s1"), "s1", "left_semi")
    hit = t.join(pairs.select("s1", "cand").distinct().withColumn("hit", F.lit(1)), ["s1", "cand"], "left")
    tag = lambda d, k, hit: d.select(F.lit(k).alias("k"), hit.alias("hit"))
    none = F.lit(None).cast("int")
    every = tag(hit, "true", F.col("hit")).unionByName(tag(pairs, "pair", none)).unionByName(tag(queried, "s1", none))
    of = lambda k: F.count(F.when(F.col("k") == k, 1))
    one = every.agg(of("true").alias("n_gt_pairs"), F.count("hit").alias("n_hit"), of("pair").alias("n_pairs"), of("s1").alias("n_s1"))
    return one.select("n_gt_pairs", "n_hit", (F.col("n_hit") / F.nullif("n_gt_pairs", F.lit(0))).alias("blocking_recall"), "n_pairs", (F.col("n_pairs") / F.greatest("n_s1", F.lit(1))).alias("pairs_per_s1"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 15, 20, 30)) -> DataFrame:
    """k, hits, recall of pairs with rank (from 0) below k."""
    t = truth.select("s1", "cand").distinct().join(ranked.select("s1", "cand", "rank"), ["s1", "cand"], "left")
    per = t.select("rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return per.groupBy("k").agg(F.count(F.when(F.col("rank") < F.col("k"), 1)).alias("hits"), F.count(F.lit(1)).alias("n")).select("k", "hits", (F.col("hits") / F.col("n")).alias("recall"))
