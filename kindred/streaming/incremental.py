"""Pool records that arrive over time, linked batch by batch to a table of s1 records.

How often each key has arrived is kept beside the pairs, so that a cap holds for all arrivals so far and not for those
of one batch.  Each micro-batch writes its records' keys, counts and pairs under its own number, which makes a repeated
batch overwrite itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking


def link_arrivals(arrivals: DataFrame, s1: DataFrame, keys: list[str], sink: str, checkpoint: str, cap: int = 300, gate: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Pairs of arriving pool records (id, country, keys, gate) and s1 on equal keys, as Parquet below sink/batch=N.

    A key that more than ``cap`` records have had up to and with a batch gives no more pairs; ``settled`` takes back
    those that it gave before.
    """
    by = ["country", *keys]

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{sink}_counts/batch={n}")
        full = spark.read.parquet(f"{sink}_counts").filter(F.col("batch") <= n).groupBy(*by).agg(F.sum("n").alias("n")).filter(F.col("n") > cap)
        open_ = batch.join(full, by, "left_anti")
        pairs = blocking.exact_key_pairs(s1, open_, keys, cap, gate=gate).join(open_.select(F.col("id").alias("cand"), *by), "cand")
        pairs.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    w = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def settled(spark, sink: str, keys: list[str], cap: int = 300) -> DataFrame:
    """s1, cand of all batches, without those of keys that have passed the cap since: what one join of all arrivals gives."""
    by = ["country", *keys]
    full = spark.read.parquet(f"{sink}_counts").groupBy(*by).agg(F.sum("n").alias("n")).filter(F.col("n") > cap)
    return spark.read.parquet(sink).join(full, by, "left_anti").select("s1", "cand")
