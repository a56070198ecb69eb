"""Pieces shared by the training-data operators: word patterns, native lower-casing, shared storage."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maximal runs of characters that are not ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Maximal runs of ASCII letters and digits and of all characters beyond ASCII, in lower-cased text.
#: (The same class as a complement is ten times slower in the JVM.)
ALNUM_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  ASCII texts take the fast built-in, others a character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "kindred-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: While a table is written: its shuffle files go when it stands, and Arrow batches stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings within the block, and what was set before behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Folders of tables made by the calls of ``tidy`` that are running, innermost last.
_made: list[list[str]] = []


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Shuffle files of the rows go at once; the table goes when ``tidy`` or ``drop_written`` says so, or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    with settings(spark, _WRITING):
        df.write.options(**options).parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    if _made:
        _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table made by ``written`` that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _drop(df.sparkSession, folder)


def tidy(f: Callable) -> Callable:
    """f, after which the tables that it wrote and that none of the returned DataFrames reads are removed."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        mine: list[str] = []
        _made.append(mine)
        try:
            out = f(*args, **kwargs)
        finally:
            _made.pop()
        frames = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        used = set().union(*map(_folders, frames)) if mine else set()
        for path in mine:
            if os.path.basename(path) not in used:
                _drop(SparkSession.active(), path)
            elif _made:
                _made[-1].append(path)
        return out

    return run


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Names a row by its content: rows with equal id and text are equal and get equal results."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x01")), F.coalesce(F.col(text), F.lit("\x01"))), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anti_join(docs: DataFrame, gone: DataFrame, key: str, limit: int = 500_000) -> DataFrame:
    """docs without the rows whose key is in gone (one column of that name, distinct).

    gone is written and counted first; up to limit rows it is broadcast, so that the texts stay where they are.
    """
    gone = written(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= limit else gone, key, "left_anti")


def own_name(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
