"""From probabilities to match lists: one-to-one, adjustment, expected-F subsets, caps, tuning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.strings import logit


def one_to_one(pairs: DataFrame, margin: float = 0.0) -> DataFrame:
    """Adds o2o: whether the pair is its candidate's best and beats the second by the margin (no second counts as 0)."""
    w = Window.partitionBy("cand")
    ranked = pairs.withColumn("r", F.row_number().over(w.orderBy(F.col("p").desc(), "s1")))
    second = F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))).over(w), F.lit(0.0))
    return ranked.withColumn("o2o", (F.col("r") == 1) & (F.col("p") - second >= margin)).drop("r")


def adjusted(pairs: DataFrame, a: float = 1.0, b: float = 0.0) -> DataFrame:
    """Adds pa: the probability after a linear map of its logit."""
    return pairs.withColumn("pa", 1 / (1 + F.exp(-(a * logit(F.col("p")) + b))))


def best_prefixes(lists: list[np.ndarray], most: int = 12, beta2: float = 0.25) -> np.ndarray:
    """For each list of probabilities, how many of the largest maximise the expected F of an s1, pairs being independent.

    The numbers of true pairs inside and outside of a prefix are Poisson binomial; their distributions are built up
    exactly, for all lists of about one length at once.  An empty list scores 1 where nothing is true.  Ties go to the
    shorter prefix.
    """
    out = np.zeros(len(lists), np.int64)
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    step = 8  # lists are filled up with zeros, which change nothing, to a multiple of this
    for width in np.unique(-(-size[size > 0] // step) * step):
        rows = np.flatnonzero((size > width - step) & (size <= width))
        for i in range(0, len(rows), most_rows := max(1, (1 << 22) // int(width) ** 2)):
            part = rows[i : i + most_rows]
            p = np.zeros((len(part), width))
            for j, r in enumerate(part):
                p[j, : size[r]] = np.sort(np.asarray(lists[r], float))[::-1]
            out[part] = _prefix_lengths(p, most, beta2)
    return out


def _prefix_lengths(p: np.ndarray, most: int, beta2: float) -> np.ndarray:
    n = p.shape[1]
    rest = [np.ones((len(p), 1))]  # rest[j]: how many of the last j are true
    for j in range(n - 1, -1, -1):
        q, last = p[:, j : j + 1], rest[-1]
        nxt = np.zeros((len(p), last.shape[1] + 1))
        nxt[:, :-1] = last * (1 - q)
        nxt[:, 1:] += last * q
        rest.append(nxt)
    best, best_k, inside = np.prod(1 - p, axis=1), np.zeros(len(p), np.int64), np.ones((len(p), 1))
    for k in range(1, min(n, most) + 1):
        q = p[:, k - 1 : k]
        nxt = np.zeros((len(p), k + 1))
        nxt[:, :-1] = inside * (1 - q)
        nxt[:, 1:] += inside * q
        inside = nxt
        t, r = np.arange(1, k + 1)[:, None], np.arange(n - k + 1)[None, :]
        e = np.einsum("it,ir,tr->i", inside[:, 1:], rest[n - k], (1 + beta2) * t / (beta2 * (t + r) + k), optimize=True)
        more = e > best + 1e-12
        best[more], best_k[more] = e[more], k
    return best_k


def best_prefix(p: np.ndarray, most: int = 12, beta2: float = 0.25) -> int:
    return int(best_prefixes([np.asarray(p, float)], most, beta2)[0])


def _prefixes(ps: pd.Series) -> pd.Series:
    return pd.Series(best_prefixes([np.array([]) if x is None else np.asarray(x) for x in ps]), dtype="int32")


def expected_f(pairs: DataFrame, p: str = "pa") -> DataFrame:
    """Adds chosen: whether the pair is in its s1's prefix of largest expected F0.5.

    An s1 has as many pairs as blocking lets through, a bounded number, so its probabilities meet in one array.
    """
    prefix = F.pandas_udf(_prefixes, "int")
    k = pairs.groupBy("s1").agg(F.sort_array(F.collect_list(p), asc=False).alias("ps")).select("s1", prefix("ps").alias("k"))
    r = F.row_number().over(Window.partitionBy("s1").orderBy(F.col(p).desc(), "cand"))
    return pairs.withColumn("r", r).join(k, "s1").withColumn("chosen", F.col("r") <= F.col("k")).drop("r", "k")


def apply_rule(pairs: DataFrame, rule: str = "threshold", threshold: float = 0.5, margin: float | None = 0.0, a: float = 1.0, b: float = 0.0, cap: int = 12) -> DataFrame:
    """Adds keep.  margin None leaves out one-to-one; the cap ranks all pairs of an s1 by p, kept or not."""
    every = pairs.withColumn("place", F.row_number().over(Window.partitionBy("s1").orderBy(F.col("p").desc(), "cand")))
    every = adjusted(one_to_one(every, margin) if margin is not None else every.withColumn("o2o", F.lit(True)), a, b)
    if rule == "threshold":
        out = every.withColumn("keep", F.col("o2o") & (F.col("pa") >= threshold))
    elif rule == "expected_f":
        chosen = expected_f(every.filter("o2o").select("s1", "cand", "pa")).filter("chosen").select("s1", "cand", F.lit(True).alias("keep"))
        out = every.join(chosen, ["s1", "cand"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    else:
        raise ValueError(f"no rule {rule}")
    return out.withColumn("keep", F.col("keep") & (F.col("place") <= cap)).select(*pairs.columns, "pa", "keep")


def grid(rule: str = "auto", one_to_one: bool = True) -> list[dict]:
    """The settings that tuning compares, in the order in which ties are decided."""
    out = []
    for margin in (0.0, 0.05, 0.1) if one_to_one else (None,):
        if rule in ("auto", "threshold"):
            out += [{"rule": "threshold", "threshold": t, "margin": margin} for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)]
        if rule in ("auto", "expected_f"):
            out += [{"rule": "expected_f", "margin": margin, "a": a, "b": b} for a in (0.8, 1.0, 1.25, 1.5) for b in (-1.0, -0.5, 0.0, 0.5)]
    return out


def tune(pairs: DataFrame, truth: DataFrame, ids: DataFrame, settings: list[dict] | None = None, cap: int = 12) -> tuple[dict, list[tuple[dict, float]]]:
    """The setting of largest macro F0.5 and all scores; the first one wins ties.

    All settings are worked out in one pass: pairs are ranked once, each is taken with every setting whose one-to-one
    rule it passes, and scores are one aggregate row a setting.
    """
    settings = settings or grid()
    one = lambda i, s: F.struct(
        F.lit(i).alias("i"), F.lit(s["rule"] == "threshold").alias("plain"), F.lit(float(s.get("threshold", 0.5))).alias("threshold"),
        F.lit(s.get("margin")).cast("double").alias("margin"), F.lit(float(s.get("a", 1.0))).alias("a"), F.lit(float(s.get("b", 0.0))).alias("b"),
    )
    w = Window.partitionBy("cand")
    ranked = pairs.select("s1", "cand", "p", F.row_number().over(Window.partitionBy("s1").orderBy(F.col("p").desc(), "cand")).alias("place"))
    ranked = ranked.withColumn("r", F.row_number().over(w.orderBy(F.col("p").desc(), "s1")))
    ranked = ranked.withColumn("gap", F.col("p") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))).over(w), F.lit(0.0)))
    each = ranked.select("*", F.explode(F.array(*[one(i, s) for i, s in enumerate(settings)])).alias("z")).select("s1", "cand", "p", "place", "r", "gap", "z.*")
    each = each.filter(F.col("margin").isNull() | ((F.col("r") == 1) & (F.col("gap") >= F.col("margin"))))
    each = each.withColumn("pa", 1 / (1 + F.exp(-(F.col("a") * logit(F.col("p")) + F.col("b")))))
    kept = each.filter(F.col("plain") & (F.col("pa") >= F.col("threshold")) & (F.col("place") <= cap)).select("i", "s1", "cand")
    if any(s["rule"] != "threshold" for s in settings):
        lists = each.filter(~F.col("plain"))
        k = lists.groupBy("i", "s1").agg(F.sort_array(F.collect_list("pa"), asc=False).alias("ps")).select("i", "s1", F.pandas_udf(_prefixes, "int")("ps").alias("k"))
        at = F.row_number().over(Window.partitionBy("i", "s1").orderBy(F.col("pa").desc(), "cand"))
        kept = kept.unionByName(lists.withColumn("at", at).join(k, ["i", "s1"]).filter((F.col("at") <= F.col("k")) & (F.col("place") <= cap)).select("i", "s1", "cand"))
    t = truth.select("s1", "cand").distinct()
    have = ids.select("s1").join(t.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")), "s1", "left").select("s1", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    per = kept.join(t.withColumn("hit", F.lit(1)), ["s1", "cand"], "left").groupBy("i", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    f = F.when(F.col("tp") == 0, 0.0).otherwise(1.25 * F.col("tp") / (0.25 * F.col("n_true") + F.col("n_pred")))
    found = {r["i"]: r for r in per.join(have, "s1").groupBy("i").agg(F.sum(f).alias("f"), F.count(F.when(F.col("n_true") == 0, 1)).alias("wrong")).collect()}
    n, alone = have.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_true") == 0, 1))).first()
    # an s1 without truth for which nothing is kept scores 1
    results = [(s, (alone + (found[i]["f"] - found[i]["wrong"] if i in found else 0.0)) / max(n, 1)) for i, s in enumerate(settings)]
    return max(results, key=lambda x: x[1])[0], results
