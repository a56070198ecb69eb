"""Checks a result file from the command line; the exit code is 0 where it passes, 1 where it does not, 2 where it cannot be read.

    python -m kindred.plans.check --result matches_tsv --source1 test_source1.tsv --pool test_source2.tsv test_source3.tsv --candidates candidates_tsv
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kindred.operators import validate
from kindred.sources import tsv

HEADER = ("source1_entity_id", "matched_entity_ids")


def _lines(spark: SparkSession, path: str, header: tuple[str, ...]) -> tuple[DataFrame, str | None]:
    """(lines behind the header, what is wrong with the header)"""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    tops = [r["line"] for r in lines.withColumn("file", F.input_file_name()).groupBy("file").agg(F.first("line").alias("line")).select("line").distinct().limit(2).collect()]
    issue = next(filter(None, (validate.header_issue(x, header) for x in tops or [""])), None)
    return lines.filter(F.col("line") != "\t".join(header)), issue


def check(spark: SparkSession, result: str, source1: str, pool: list[str] = (), candidates: str | None = None) -> dict:
    """issue -> what was found; empty where all is well."""
    lines, issue = _lines(spark, result, HEADER)
    found: dict = {"header": issue} if issue else {}
    bad = validate.malformed(lines)
    if n := bad.count():
        found["malformed"] = {"n": n, "examples": [r[0] for r in bad.limit(5).collect()]}
    ids = tsv.read_source(spark, source1, check=False).select(F.col("entity_id").alias("s1"))
    others = None
    for p in pool:
        one = tsv.read_source(spark, p, check=False).select(F.col("entity_id").alias("id"))
        others = one if others is None else others.unionByName(one)
    named = None
    if candidates:
        rows, wrong = _lines(spark, candidates, ("source1_entity_id", "candidate_entity_ids"))
        found |= {"candidates_header": wrong} if wrong else {}
        named = validate.rows_of(rows)
    return found | validate.report(validate.rows_of(lines), ids, others, named)


def main(argv: list[str] | None = None) -> int:
    from kindred.session import session

    p = argparse.ArgumentParser()
    p.add_argument("--result", required=True)
    p.add_argument("--source1", required=True)
    p.add_argument("--pool", nargs="*", default=[])
    p.add_argument("--candidates")
    a = p.parse_args(argv)
    try:
        found = check(session(), a.result, a.source1, a.pool, a.candidates)
    except (AnalysisException, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(found, indent=1, default=str))
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main())
