"""Small tables with what operators have to bear."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = " ".join(f"plain{i} words" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "someone without an id", "en", "b"),
    (5, LONG, "en", "b"),
    (6, PROSE, "en", None),
    (7, PROSE + " one more", "fr", "a"),
    (8, "  \t\n ", "en", "c"),
    (9, "a line\n" * 50, "en", "c"),
    (10, "İstanbul ÉTÉ ß straße 🙂 ＡＢＣ", "fr", "é"),
    (10, "İstanbul ÉTÉ ß straße 🙂 ＡＢＣ", "fr", "é"),
    (11, "same id", "en", "a"),
    (11, "other text of the same id", "en", "a"),
]
#: Names that the operators use inside.
CLASHING = ("id", "key", "score", "h", "w", "s", "p", "g", "n", "size", "src", "n_words", "kept", "block", "text_", "component", "rep", "label", "learn", "doc", "slot", "shard", "digest", "payload", "row_key", "row_source", "row_slot", "row_all", "at", "m", "start", "share", "text_key", "toxicity", "__key", "__times", "__time", "__toxicity")


def documents(spark, rows=ROWS, clash=True):
    d = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else d


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
