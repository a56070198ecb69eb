"""Token statistics: document frequencies, weights, learned dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import native


def idf(records: DataFrame, tokens: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, token, df, idf = ln((N + 1) / (df + 1)) + 1; N counts all records, those without tokens too."""
    df = records.select(*by, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    if by:
        joined = df.join(records.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), list(by))
    else:
        joined = df.withColumn("n", F.lit(records.count()))
    return joined.select(*by, "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(texts: DataFrame, min_df: int = 2, max_share: float = 0.02, floor: int = 20_000, max_features: int | None = 400_000, n: int = 3) -> DataFrame:
    """id, side, country, gram, w: sublinear, smoothed and L2-normed weights of character grams; texts: id, side, country, text.

    Grams in fewer than min_df or more than max(max_share * N, floor) texts of a country are left out, which is also
    what keeps a gram's join small; the max_features most frequent ones stay, all of them if that is None.
    """
    size = texts.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    tf = texts.select("id", "side", "country", F.explode(native.char_grams(F.col("text"), n)).alias("gram")).groupBy("id", "side", "country", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("country", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(size, "country")
    most = F.least(F.greatest(F.floor(F.col("n") * max_share), F.lit(floor)), F.col("n"))
    df = df.filter((F.col("df") >= F.least(F.lit(min_df), most)) & (F.col("df") <= most))
    if max_features is not None:
        df = most_frequent(df, max_features)
    df = df.select("country", "gram", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = tf.join(df, ["country", "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("side", "country", "id")))
    return raw.select("id", "side", "country", "gram", (F.col("w") / norm).alias("w"))


def most_frequent(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` grams of largest cf in each country, ties by gram; df: country, gram, cf.

    How many grams have each count says which counts stay as a whole; only those of the one count at the edge are ranked.
    """
    counts = df.groupBy("country", "cf").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("country").orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, 0))
    room = counts.withColumn("left", most - (upto.cast("long") - F.col("c"))).filter("left > 0").select("country", "cf", F.col("c").alias("grams"), "left")
    met = df.join(room, ["country", "cf"])
    edge = met.filter(F.col("grams") > F.col("left"))
    place = F.row_number().over(Window.partitionBy("country", "cf").orderBy("gram"))
    return met.filter(F.col("grams") <= F.col("left")).unionByName(edge.withColumn("place", place).filter(F.col("place") <= F.col("left")).drop("place")).drop("grams", "left")


def aligned_pairs(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """a, b: tokens at the same place of two token arrays of equal length."""
    zipped = F.arrays_zip(left.alias("a"), right.alias("b"))
    return pairs.filter((F.size(left) == F.size(right)) & (F.size(left) > 0)).select(F.inline(zipped))


def top_two(aligned: DataFrame, min_count: int = 2, runner_up_share: float = 0.2) -> DataFrame:
    """a, best, second: the most common b, and the next one where its share of a is large enough; ties by b."""
    counts = aligned.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("a")
    ranked = counts.select("*", F.row_number().over(w.orderBy(F.col("c").desc(), "b")).alias("r"), F.sum("c").over(w).alias("total"))
    out = ranked.filter("r <= 2").groupBy("a").agg(
        F.max(F.when(F.col("r") == 1, F.col("b"))).alias("best"),
        F.max(F.when(F.col("r") == 1, F.col("c"))).alias("n_best"),
        F.max(F.when((F.col("r") == 2) & (F.col("c") / F.col("total") >= runner_up_share), F.col("b"))).alias("second"),
    )
    return out.filter(F.col("n_best") >= min_count)


def vocabulary(rows: DataFrame, keys: list[str], min_count: int = 2) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def word_counts(texts: DataFrame, text: str, min_count: int = 3) -> DataFrame:
    """word, n of words of two letters or more."""
    words = texts.select(F.explode(native.plain_tokens(F.col(text))).alias("word"))
    return vocabulary(words.filter(F.col("word").rlike("^[a-z]{2,}$")), ["word"], min_count)


def key_frequencies(s1: DataFrame, pool: DataFrame, key: str, country: str, city: str) -> DataFrame:
    """For each record of s1: log1p counts of its key in its country, and in its city on both sides; 0 where missing."""
    some = lambda d, *c: d.filter(" AND ".join(f"{x} <> ''" for x in c))
    a = some(s1, key).groupBy(key, country).agg(F.count(F.lit(1)).alias("c1"))
    b = some(s1, key, city).groupBy(key, country, city).agg(F.count(F.lit(1)).alias("c2"))
    c = some(pool, key, city).groupBy(key, country, city).agg(F.count(F.lit(1)).alias("c3"))
    out = s1.join(a, [key, country], "left").join(b, [key, country, city], "left").join(c, [key, country, city], "left")
    return out.select(*s1.columns, *[F.log1p(F.coalesce(x, F.lit(0))).alias(n) for x, n in (("c1", "nk_cnt_country"), ("c2", "nk_cnt_city"), ("c3", "nk_cnt_pool_city"))])
