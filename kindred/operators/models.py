"""Fold-wise boosted trees on pair features, out-of-fold scores, isotonic calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.native import id_fraction

MISSING = -1.0


def assembled(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds features: names, and for each one that can be null whether it is; null itself becomes MISSING."""
    cols = {}
    for n in names:
        cols[f"__{n}"] = F.coalesce(F.col(n).cast("double"), F.lit(MISSING))
        cols[f"__{n}_null"] = F.col(n).isNull().cast("double")
    out = df.withColumns(cols)
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(out).drop(*cols)


def subsample(df: DataFrame, most: int, label: str = "y", key: tuple[str, ...] = ("s1", "cand")) -> DataFrame:
    """All positives and negatives by hash, so that about ``most`` rows remain: a parameter of training alone."""
    n, pos = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    if n <= most or n == pos:
        return df
    rate = max(0.0, (most - pos) / (n - pos))
    return df.filter((F.col(label) == 1) | (id_fraction(F.concat_ws("|", *key)) < rate))


def train_folds(df: DataFrame, names: list[str], folds: int = 5, iterations: int = 30, depth: int = 5, most: int = 2_000_000, seed: int = 7) -> dict[int, GBTClassificationModel]:
    """For each fold a model that has not seen it.  A tenth of the entities, by hash, tells when to stop."""
    out = {}
    for k in range(folds):
        part = subsample(df.filter(F.col("fold") != k), most).withColumn("stop", id_fraction(F.concat(F.lit("stop:"), F.col("s1").cast("string"))) < 0.1)
        if part.agg(F.countDistinct("y")).first()[0] < 2:
            continue  # nothing to tell apart in this part
        data = assembled(part, names)
        both = data.filter("stop").agg(F.countDistinct("y")).first()[0] == 2
        gbt = GBTClassifier(labelCol="y", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, validationTol=0.001)
        out[k] = (gbt.setValidationIndicatorCol("stop") if both else gbt).fit(data)
    if not out:
        raise ValueError("no fold has both classes")
    return out


def _probability(model: GBTClassificationModel, data: DataFrame, name: str) -> DataFrame:
    scored = model.setProbabilityCol("__pr").setRawPredictionCol("__raw").setPredictionCol("__pd").transform(data)
    return scored.withColumn(name, vector_to_array("__pr")[1]).drop("__pr", "__raw", "__pd")


def predict(models: dict[int, GBTClassificationModel], df: DataFrame, names: list[str], out: str = "p", oof: bool = False) -> DataFrame:
    """The mean over all models; with oof a row's own fold's model, or the mean where that fold has none."""
    data = assembled(df, names)
    for k, m in models.items():
        data = _probability(m, data, f"__p{k}")
    mean = reduce(lambda a, b: a + b, [F.col(f"__p{k}") for k in models]) / len(models)
    own = F.coalesce(*[F.when(F.col("fold") == k, F.col(f"__p{k}")) for k in models], mean) if oof else mean
    return data.withColumn(out, own).drop("features", *[f"__p{k}" for k in models])


def calibrate(df: DataFrame, p: str = "p", y: str = "y"):
    """A monotone map from p to the rate of y."""
    return IsotonicRegression(labelCol=y, featuresCol=p, predictionCol="__cal").fit(df.select(F.col(p), F.col(y).cast("double").alias(y)))


def calibrated(model, df: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
    return model.setFeaturesCol(p).setPredictionCol("__cal").transform(df).withColumn(out, F.least(F.greatest(F.col("__cal"), F.lit(0.0)), F.lit(1.0))).drop("__cal")


def quality(df: DataFrame, p: str = "p", y: str = "y") -> dict[str, float]:
    """auc, average_precision (a step sum over thresholds) and log_loss."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = df.agg(F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))).first()[0]
    at = df.groupBy(F.col(p).alias("t")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("t") * 4096))
    # running sums in two levels: over buckets of scores, of which there are a few thousand, and within each
    per = at.groupBy("bucket").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("bn"))
    w = Window.partitionBy("bucket").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = at.join(F.broadcast(per), "bucket").select("pos", (F.col("bp") + F.sum("pos").over(w)).alias("cp"), (F.col("bn") + F.sum("n").over(w)).alias("cn"))
    ap = run.agg(F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / F.nullif(F.sum("pos"), F.lit(0))).first()[0]
    auc = BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=y, metricName="areaUnderROC").evaluate(df.select(F.col(p).cast("double"), F.col(y).cast("double")))
    return {"auc": float(auc), "average_precision": float(ap or 0.0), "log_loss": float(loss)}


def importance(models: dict[int, GBTClassificationModel], names: list[str], top: int = 20) -> list[tuple[str, float]]:
    """Mean importance across folds, a name's null indicator counted with it."""
    total = dict.fromkeys(names, 0.0)
    for m in models.values():
        for i, v in enumerate(m.featureImportances.toArray()):
            total[names[i // 2]] += float(v) / len(models)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]


def save(models: dict[int, GBTClassificationModel], names: list[str], store, folder: str) -> None:
    for k, m in models.items():
        m.write().overwrite().save(f"{store.folder}/{folder}/{k}")
    store.save_json(f"{folder}.json", {"names": names, "folds": sorted(models)})


def load(store, folder: str, names: list[str]) -> dict[int, GBTClassificationModel]:
    """Models of the same features in the same order; anything else is an error."""
    meta = store.load_json(f"{folder}.json")
    if meta is None or meta["names"] != names:
        raise ValueError(f"{folder} was trained on other features")
    return {k: GBTClassificationModel.load(f"{store.folder}/{folder}/{k}") for k in meta["folds"]}


def prune(scored: DataFrame, most: int = 20, least: float = 0.003) -> DataFrame:
    """Adds prune_rank, from 0 by falling prune_p; keeps ranks below most with a prune_p of at least ``least``."""
    r = F.row_number().over(Window.partitionBy("s1").orderBy(F.col("prune_p").desc(), "cand")) - 1
    return scored.withColumn("prune_rank", r).filter((F.col("prune_rank") < most) & (F.col("prune_p") >= least))


def demo(spark, sf_dir: str) -> tuple[DataFrame, dict, DataFrame]:
    """Labelled documents' quality from their sizes, in two folds: (rows with features, models, s1, y, fold, oof and calibrated)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("s1"), F.lit(0).alias("cand"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("n_words"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("double").alias("n_symbols"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("s1"), F.col("quality").alias("y"))
    data = docs.join(labels, "s1").withColumn("fold", F.floor(id_fraction(F.col("s1")) * 2).cast("int")).repartition(8, "s1").sortWithinPartitions("s1")
    names = ["n_chars", "n_words", "n_symbols"]
    models = train_folds(data, names, folds=2, iterations=5, depth=3)
    scored = predict(models, data, names, "oof", oof=True)
    return data, models, calibrated(calibrate(scored, "oof"), scored, "oof", "calibrated").select("s1", "y", "fold", "oof", "calibrated")
