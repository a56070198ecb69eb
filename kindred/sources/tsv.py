"""Delimited sources of a linkage job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def stripped(c: str):
    """Without white space at both ends, of any kind; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def _read(spark: SparkSession, path: str) -> DataFrame:
    options = {"sep": "\t", "quote": "", "escape": "", "header": True, "inferSchema": False, "encoding": "UTF-8", "mode": "PERMISSIVE"}
    return spark.read.options(**options).csv(path)


def read_source(spark: SparkSession, path: str, source: int | None = None, check: bool = True) -> DataFrame:
    """The four columns as stripped strings, and source if given.  A missing column or a repeated id is an error."""
    raw = _read(spark, path)
    lacking = [c for c in COLUMNS if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    out = raw.select(*[stripped(c).alias(c) for c in COLUMNS])
    if check:
        n, ids = out.agg(F.count(F.lit(1)), F.countDistinct("entity_id")).first()
        if n != ids:
            raise ValueError(f"{path} repeats {n - ids} ids")
    return out if source is None else out.withColumn("source", F.lit(source).cast("tinyint"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1, ids: the second column, whatever its name, split at commas; empty means no match."""
    raw = _read(spark, path)
    a, b = raw.columns[:2]
    return raw.select(stripped(a).alias("s1"), F.filter(F.transform(F.split(F.coalesce(F.col(b), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("ids"))


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(s1, pool of sources 2 and 3, truth or None where there is none)."""
    at = f"{folder}/{split}_"
    s1 = read_source(spark, f"{at}source1.tsv", 1)
    pool = read_source(spark, f"{at}source2.tsv", 2).unionByName(read_source(spark, f"{at}source3.tsv", 3))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}ground_truth.tsv")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return s1, pool, read_truth(spark, f"{at}ground_truth.tsv") if there else None


def truth_pairs(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """s1, cand of known ids."""
    each = truth.select("s1", F.explode("ids").alias("cand"))
    return each.join(s1.select(F.col("entity_id").alias("s1")), "s1").join(pool.select(F.col("entity_id").alias("cand")), "cand").select("s1", "cand").distinct()
