"""Checks of result lists: (line) as read, or (s1, ids) once split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(lists: DataFrame, line: str = "line") -> DataFrame:
    """s1, ids (array, empty parts left out) of tab-separated lines; blank lines are ignored."""
    cut = F.split(F.col(line), "\t", 2)
    ids = F.filter(F.split(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), ","), lambda x: x != "")
    return lists.filter(F.trim(line) != "").select(F.get(cut, F.lit(0)).alias("s1"), ids.alias("ids"))


def malformed(lists: DataFrame, line: str = "line") -> DataFrame:
    return lists.filter((F.trim(line) != "") & ~F.contains(F.col(line), F.lit("\t")))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.select("s1", F.size("ids").alias("n"), F.size(F.array_distinct("ids")).alias("n_distinct")).filter("n <> n_distinct")


def wrong_prefix(rows: DataFrame, own: str = "S1-", allowed: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """s1, id, issue: ids of the own source (self_match) or of none (unknown_prefix)."""
    each = rows.select("s1", F.explode("ids").alias("id"))
    fits = F.lit(False)
    for p in allowed:
        fits = fits | F.startswith(F.col("id"), F.lit(p))
    return each.filter(~fits).withColumn("issue", F.when(F.startswith(F.col("id"), F.lit(own)), "self_match").otherwise("unknown_prefix"))


def unknown_ids(rows: DataFrame, pool: DataFrame) -> DataFrame:
    return rows.select("s1", F.explode("ids").alias("id")).join(pool.select("id"), "id", "left_anti").select("s1", "id")


def missing_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("s1").join(rows.select("s1"), "s1", "left_anti")


def extra_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.select("s1").join(ids.select("s1"), "s1", "left_anti").distinct()


def not_among_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    a = matches.select("s1", F.explode("ids").alias("id"))
    b = candidates.select("s1", F.explode("ids").alias("id"))
    return a.join(b, ["s1", "id"], "left_anti")


def report(rows: DataFrame, ids: DataFrame, pool: DataFrame | None = None, candidates: DataFrame | None = None, examples: int = 5) -> dict[str, dict]:
    """issue -> {"n": count, "examples": a few}; empty where all is well."""
    issues = {
        "duplicate_rows": duplicate_rows(rows).select("s1"), "duplicate_ids": duplicate_ids(rows).select("s1"),
        "wrong_prefix": wrong_prefix(rows).select("id"), "missing_rows": missing_rows(rows, ids), "extra_rows": extra_rows(rows, ids),
    }
    if pool is not None:
        issues["unknown_ids"] = unknown_ids(rows, pool).select("id")
    if candidates is not None:
        issues["not_among_candidates"] = not_among_candidates(rows, candidates).select("id")
    found = {}
    for name, d in issues.items():
        n = d.count()
        if n:
            found[name] = {"n": n, "examples": [r[0] for r in d.orderBy(d.columns[0]).limit(examples).collect()]}
    return found


def header_issue(text: str, header: tuple[str, ...]) -> str | None:
    """What is wrong with the first line of a result file; None if nothing is."""
    first = text.split("\n", 1)[0].rstrip("\r")
    if not first.strip():
        return "the file is empty"
    if tuple(first.split("\t")) == header:
        return None
    return "comma-separated, not tab-separated" if "," in first and "\t" not in first else f"the header is not {header}"
