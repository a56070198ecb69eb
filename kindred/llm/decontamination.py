"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of an item; a shorter item is one window.  A text that contains a window
contains all its shingles (``SHINGLE`` words, or fewer in shorter windows), so that one necessary shingle is enough of a prefix:
the window's rarest, by its count in all documents.  Texts are probed with these alone.  A probe that meets passes the length
and positional bounds (the window must lie within the text, its shingle at its place) and is then compared word by
word.  Nothing but confirmed occurrences is shuffled.

The windows are broadcast up to ``BROADCAST_WINDOWS`` of them, a size that is counted first; beyond, the joins shuffle
by shingle, with the same result.

Defined results: null texts and items have no words and never match; null ids are kept as null (an item's as the
string ``null``); an item id that occurs twice is one item; repeated documents get a row each with equal results; an
empty benchmark hits nothing, an empty table gives no rows; columns other than ids and texts are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ALNUM_WORD, anti_join, ascii_lower, own_name, table, text_key, tidy, words_of, written

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """words (of the window, distinct), items (ids as strings), n (words), width (of its shingles)."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words_of(ascii_lower(F.col(text_col)), ALNUM_WORD).alias("w")).filter(F.size("w") > 0)
    cut = w.select("item", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")).alias("words"))
    n = F.size("words")
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select("words", "items", n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("width"))


def _shingle(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(width)])


def _probes(docs: DataFrame, widths: list[int], behind: int = 0) -> DataFrame:
    """Each place of each text with the hash of the shingle that starts there, once for each width."""
    at = docs.select("*", F.posexplode(F.concat("w", F.array_repeat(F.lit(""), behind)) if behind else F.col("w")).alias("pos", "word")).drop("word")
    if len(widths) == 1:
        return at.withColumns({"width": F.lit(widths[0]), "h": _shingle("w", F.col("pos"), widths[0])})
    return at.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("width"), _shingle("w", F.col("pos"), k).alias("h")) for k in widths])))


def rarest(wins: DataFrame, docs: DataFrame, widths: list[int], small: bool) -> DataFrame:
    """wins with h, the hash of each window's rarest shingle in docs, and off, where in the window it stands."""
    each = wins.withColumn("wid", F.xxhash64("words")).select("wid", "words", "width", F.posexplode("words").alias("off", "word")).filter(F.col("off") <= F.size("words") - F.col("width"))
    hashed = F.coalesce(*[F.when(F.col("width") == k, _shingle("words", F.col("off"), k)) for k in widths])
    each = each.select("words", "width", "off", hashed.alias("h"))
    keys = each.select("width", "h").distinct()
    seen = _probes(docs, widths).select("width", "h").join(F.broadcast(keys) if small else keys, ["width", "h"]).groupBy("width", "h").agg(F.count(F.lit(1)).alias("c"))
    rank = each.join(seen, ["width", "h"], "left").groupBy("words").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "off")).alias("r"))
    return wins.join(rank, "words").select("words", "items", "n", "width", F.col("r.h").alias("h"), F.col("r.off").alias("off"))


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, id, n_words, start, n and items: a row for each confirmed window, and one with null start for each document.

    key names a document by its content (see text_key).
    """
    wins = written(windows(items, item_col, item_text, window), "benchmark-windows")
    n_windows = wins.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]  # with the items of each: what a broadcast would hold
    widths = sorted(r["width"] for r in wins.select("width").distinct().collect())  # at most SHINGLE rows
    words = docs.select(text_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), words_of(ascii_lower(F.col(text_col)), ALNUM_WORD).alias("w"))
    plain = words.select("key", "id", F.size("w").cast("long").alias("n_words"))
    none = {"start": F.lit(None).cast("int"), "n": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")}
    if not widths:
        return plain.withColumns(none)
    small = n_windows <= broadcast_windows
    only = docs.select(words_of(ascii_lower(F.col(text_col)), ALNUM_WORD).alias("w"))
    chosen = written(rarest(wins, only, widths, small), "benchmark-prefixes")
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))  # positional and length bounds
    holds = F.slice("w", F.when(fits, start + 1).otherwise(F.lit(1)), F.col("n")) == F.col("words")
    if small:
        # one pass: the place behind the last word stands for the document and stays
        met = _probes(words, widths, behind=1).join(F.broadcast(chosen), ["width", "h"], "left").withColumn("ok", F.coalesce(fits & holds, F.lit(False)))
        met = met.filter(F.col("ok") | ((F.col("pos") == F.size("w")) & (F.col("width") == widths[0])))
        when = lambda c: F.when(F.col("ok"), c)
        return met.select("key", "id", F.size("w").cast("long").alias("n_words"), when(start).alias("start"), when(F.col("n")).alias("n"), when(F.col("items")).alias("items"))
    # the probes are shuffled without their text, by a number in place of the key; what meets is confirmed against the
    # text afterwards, so that a number that two keys share does no harm
    short = F.xxhash64("key")
    met = _probes(words, widths).select(short.alias("k"), "pos", "width", "h").join(chosen, ["width", "h"]).select("k", "pos", "off", "n", "words", "items").distinct()
    found = words.withColumn("k", short).join(met, "k").filter(fits & holds).select("key", "id", F.size("w").cast("long").alias("n_words"), start.alias("start"), "n", "items")
    return found.unionByName(plain.withColumns(none))


@tidy
def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, id, n_words, n_hit, items (sorted ids of items with occurring windows): a row for each different document.

    Places are pre-aggregated to distinct spans before they are ordered; a document's spans are at most its words.
    """
    occ = occurrences(docs, items, id_col, text_col, item_col, item_text, window, broadcast_windows)
    per = occ.groupBy("key", "id", "n_words", "start").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    spans = "array_sort(filter(spans, s -> s.start IS NOT NULL))"
    reach = f"aggregate({spans}, struct(0 AS upto, 0L AS hit), (a, s) -> struct(greatest(a.upto, s.start + s.n) AS upto, a.hit + greatest(0, s.start + s.n - greatest(a.upto, s.start)) AS hit), a -> a.hit)"
    out = per.groupBy("key", "id", "n_words").agg(F.collect_list(F.struct("start", "n")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select("key", "id", "n_words", F.expr(reach).cast("long").alias("n_hit"), "items")


@tidy
def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_share: float = 0.0) -> DataFrame:
    """docs without those of whose words more than max_share are hit; all columns, all copies of what stays."""
    hit = contamination(docs, items, id_col, text_col, item_col, item_text, window).filter(F.col("n_hit") > F.col("n_words") * max_share)
    key = own_name(docs, "text_key")
    return anti_join(docs.withColumn(key, text_key(id_col, text_col)), hit.select(F.col("key").alias(key)), key).select(docs.columns)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).drop("id")
    rows = docs.select("doc_id", text_key().alias("key")).join(found, "key")  # equal rows get a row each
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + 9], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)
), place AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, p, win.n, item FROM place JOIN win ON place.g = win.g AND place.n = win.n
), word AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""
