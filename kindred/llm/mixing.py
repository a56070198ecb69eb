"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target number of words.  A golden-ratio sequence x(n) = frac((n + 1/2) / phi) runs over slots of B
words each; the source whose interval of cumulative target weight holds x(n) fills slot n, so that every stretch of
the schedule is close to the target weights.  The documents of a source, shuffled by a hash of their id, lie end to
end on a line, which is cut into blocks of B words; the k-th slot of a source takes the k-th block of its line.  A
line is walked at most ``max_repeats`` times.

Hot sources: ranks and offsets are prefix sums in two levels (per chunk of slots, per hash bucket of documents), so
no task holds a whole source.  The schedule has at most ``slots`` slots whatever the input's size; B grows instead.
The sequence meets a target to within two blocks or so; therefore, where B is over one word, sources of fewer than FEW blocks are
not left to it: they take their target to the word, in blocks spread evenly over the slots beside what those have, the last block cut short.

Defined results: a null text has size 0 and gives no words; null sources form one source, last in order; null ids
are shuffled like the empty string; repeated rows are laid out and taken one by one; ties in the shuffle are broken by
id and size, which leaves equal rows interchangeable; an empty table, or one without words, takes nothing.  Columns
other than id, source and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_WORD, own_name, table, text_key, tidy, written

WEIGHTS = (3, 1, 2)
GOLDEN = 0.6180339887498949
#: Sources up to which their table is broadcast; beyond, joins shuffle.
BROADCAST_SOURCES = 20_000
CELLS = 4096
CHUNK = 4096
#: Blocks of a target below which a source takes it exactly; from here on two blocks, by which the sequence can err, are a twentieth.
FEW = 40


def source_key(source_col: str):
    """A string that orders sources by code point, null last."""
    return F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"), F.coalesce(F.col(source_col), F.lit("")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, src (order-preserving key, null last), size, bucket and u (the shuffle's order)."""
    u = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        source_key(source_col).alias("src"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_WORD)).cast("long").alias("size"),
        F.substring(u, 1, 3).alias("bucket"),
        u.alias("u"),
    )


def targets(sizes: DataFrame, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """src, s (words of the source), w, target, lo and hi (its interval of cumulative weight).  One row a source.

    A target is least(max_repeats * s, level * w): the level at which the targets sum to share times all words is what
    resharing the excess by weight ends at.  Sources are taken by rising cap / w; one is at its cap if the level of
    what is left before it lies above that ratio.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("s"))
    n = len(weights)
    by_order, by_ratio = Window.orderBy("src"), Window.orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    nth = F.row_number().over(by_order) - 1
    d = per.select("src", "s", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % n + 1).cast("int")).alias("w"))
    d = d.select("*", (F.col("s") * float(max_repeats)).alias("cap"), (F.sum("s").over(whole) * float(share)).alias("total"), F.sum("w").over(whole).alias("all_w"))
    d = d.withColumn("ratio", F.col("cap") / F.col("w"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    d = d.withColumn("full", left > F.col("ratio") * left_w)
    d = d.withColumn("level", (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))) / F.nullif(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(0.0)))
    d = d.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")))
    sofar = F.sum("target").over(by_order.rowsBetween(Window.unboundedPreceding, 0))
    d = d.select("src", "s", "w", "target", "total", sofar.alias("upto"))
    return d.select("src", "s", "w", "target", "total", ((F.col("upto") - F.col("target")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))


def schedule(of: DataFrame, total: float, block: int, small: bool) -> DataFrame:
    """slot, src, k, end: which source fills each slot, and with which of its blocks; end is where the source's last is cut."""
    n = int(-(-total // block)) if total > 0 else 0
    few = (F.col("target") < FEW * block) if block > 1 else F.lit(False)
    x = (F.col("id") + 0.5) * GOLDEN
    points = of.sparkSession.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS))
    spans = of.filter("target > 0").filter(~few).select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))).alias("cell"))
    placed = points.join(F.broadcast(spans) if small else spans, "cell").filter("x >= lo AND x < hi").select("slot", "src", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = placed.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("src", "chunk", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot"))
    plan = placed.select("*", nth.alias("nth")).join(starts, ["src", "chunk"]).select("slot", "src", (F.col("start") + F.col("nth") - 1).alias("k"), F.lit(None).cast("long").alias("end"))
    if block == 1:
        return plan
    end = F.floor(F.col("target") + 0.5)
    rest = of.filter("target > 0").filter(few).select("src", end.alias("end")).filter("end > 0").withColumn("m", F.ceil(F.col("end") / block))
    rest = rest.select("src", "m", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    at = F.col("k") / F.col("m") + F.crc32(F.col("src").cast("binary")) / float(1 << 32)  # each source's own start
    return plan.unionByName(rest.select(F.least(F.floor((at - F.floor(at)) * n), F.lit(n - 1)).cast("long").alias("slot"), "src", "k", "end"))


def lines(sizes: DataFrame) -> DataFrame:
    """Each document with words and its offset o on its source's line of s words."""
    some = sizes.filter("size > 0")
    per = some.groupBy("src", "bucket").agg(F.sum("size").alias("c"))
    w = Window.partitionBy("src")
    per = per.select("src", "bucket", F.coalesce(F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("c").over(w).alias("s"))
    inner = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return some.select("*", inner.alias("inner")).join(per, ["src", "bucket"]).select("id", "src", "size", "s", (F.col("start") + F.col("inner")).alias("o"))


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, slots: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(sizes, targets, lines, schedule, pieces, whether sources are few)"""
    sizes = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    of = written(targets(sizes, share, max_repeats, weights), "mix-targets")  # one row a source
    stat = of.agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).first()
    total, small = float(stat["total"] or 0.0), stat["n"] <= BROADCAST_SOURCES
    block = max(1, int(-(-total // slots)))
    plan = schedule(of, total, block, small)
    laid = lines(sizes)
    at = F.col("o") + F.col("repeat") * F.col("s")
    cut = (
        laid.select("*", F.explode(F.array(*[F.lit(i).cast("long") for i in range(max_repeats)])).alias("repeat"))
        .withColumn("at", at)
        .withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    )
    words = F.least(F.col("at") + F.col("size"), (F.col("k") + 1) * block, F.col("end")) - F.greatest(F.col("at"), F.col("k") * block)  # a null end does not count
    # a schedule packs to a few bytes a slot on disk, not in a broadcast
    pieces = cut.join(plan.hint("merge"), ["src", "k"]).withColumn("words", words).filter("words > 0").select("slot", "id", "src", "o", "words", "repeat")
    return sizes, of, laid, plan, pieces, small


@tidy
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, schedule, pieces); params: share, max_repeats, weights, slots.

    documents: id, src, size, source_size, target, taken.  schedule: slot, src, k, end.  pieces: slot, id, src, o, words and
    repeat (0 for a document's first walk): what each slot takes from which document.
    """
    sizes, of, laid, plan, pieces, small = _laid_out(docs, id_col, text_col, source_col, **params)
    took = pieces.groupBy("src", "o").agg(F.sum("words").alias("taken"))  # (src, o) names a document with words
    out = laid.join(took, ["src", "o"], "left").select("id", "src", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    out = out.unionByName(sizes.filter("size = 0").select("id", "src", "size", F.lit(0).cast("long").alias("taken")))
    by = of.select("src", F.col("s").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    return out.join(F.broadcast(by) if small else by, "src"), plan, pieces


@tidy
def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_broadcast: int = 500_000, max_repeats: int = 2, **params) -> DataFrame:
    """docs as the mix takes them: each row as often as its taken words, in wholes of its size, round to.

    Rows equal in id, text and source are mixed as one group: the times that it is taken go round its rows, in the
    order of a hash of their other columns, so that none is dropped by chance.  Documents without words bear nothing
    to a mix and go.  All columns are kept.  Within a partition rows stand in the order of the slots that take them.
    How often each group stays is counted; up to ``most_broadcast`` of these numbers go to the texts, more are joined.
    """
    key, src, slot = (own_name(docs, n) for n in ("row_key", "row_source", "row_slot"))
    keyed = docs.withColumn(key, text_key(id_col, text_col)).withColumn(src, source_key(source_col))
    sizes, _, _, _, pieces, _ = _laid_out(keyed, key, text_col, source_col, max_repeats=max_repeats, **params)
    first = [F.min(F.when(F.col("repeat") == i, F.col("slot"))) for i in range(max_repeats)]  # of each walk
    took = pieces.groupBy("id", "src").agg(F.sum("words").alias("taken"), F.sort_array(F.array_compact(F.array(*first))).alias("at"))
    rows = sizes.filter("size > 0").groupBy("id", "src").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    kept = took.join(rows, ["id", "src"]).select(F.unhex("id").alias(key), F.col("src").alias(src), "n", times.alias("times"), "at").filter("times > 0")
    kept = written(kept, "mix-times")
    keyed = keyed.withColumn(key, F.unhex(key))
    total, several = kept.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    side = F.broadcast if total <= most_broadcast else lambda d: d
    sure = kept.select(key, src, F.struct("n", "times", "at").alias(slot))
    at = lambda times: F.explode(F.transform(F.sequence(F.lit(1), times), lambda i: F.coalesce(F.get(F.col(slot)["at"], i - 1), F.get(F.col(slot)["at"], F.lit(0))))).alias(slot)
    out = keyed.join(side(sure.filter(F.col(slot)["n"] == 1)), [key, src]).select(*docs.columns, at(F.col(slot)["times"]))
    if several > 1:
        rest = [F.col(c) for c, t in docs.dtypes if "map<" not in t]  # maps cannot be compared
        row = own_name(docs, "row_all")
        kinds = keyed.join(side(sure.filter(F.col(slot)["n"] > 1)), [key, src]).groupBy(key, src, F.xxhash64(*rest).alias("h")).agg(F.first(F.struct(*docs.columns)).alias(row), F.first(slot).alias(slot), F.count(F.lit(1)).alias("m"))
        kinds = kinds.withColumn("start", F.sum("m").over(Window.partitionBy(key, src).orderBy("h")) - F.col("m"))
        n, t = F.col(slot)["n"], F.col(slot)["times"]
        share = F.col("m") * F.floor(t / n) + F.greatest(F.lit(0), F.least(F.col("start") + F.col("m"), t % n) - F.col("start"))
        kinds = kinds.withColumn("share", share.cast("int")).filter("share > 0")
        out = out.unionByName(kinds.select(row, at(F.col("share"))).select(f"{row}.*", slot))
    return out.sortWithinPartitions(slot).drop(slot)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs, _, _ = mix(table(spark, sf_dir, "documents"))
    return docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS u
  FROM documents
), p AS (
  SELECT src, sum(size)::BIGINT AS s, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY src
), t AS (
  SELECT *, 2.0::DOUBLE * s AS cap, 1.5::DOUBLE * (SELECT sum(s)::DOUBLE FROM p) AS total FROM p
), f AS (
  SELECT *, total - coalesce(sum(cap) OVER r, 0) > cap / w * ((SELECT sum(w) FROM p) - coalesce(sum(w) OVER r, 0)) AS is_full
  FROM t WINDOW r AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE (total - coalesce((SELECT sum(cap) FROM f WHERE is_full), 0)) / (SELECT sum(w) FROM f WHERE NOT is_full) * w END AS target FROM f
), c AS (
  SELECT *, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS upto FROM g
), b AS (
  SELECT greatest(1, ceil(max(total) / 1048576))::BIGINT AS block, max(total) AS total FROM c
), x AS (
  SELECT (n + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((n + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS x
  FROM (SELECT unnest(range(0, (SELECT ceil(total / block)::BIGINT FROM b))) AS n)
), n AS (
  SELECT src, count(*) AS n FROM x JOIN c ON x.x >= (c.upto - c.target) / c.total AND x.x < c.upto / c.total GROUP BY src
), o AS (
  SELECT d.*, c.s, c.target, sum(size) OVER (PARTITION BY d.src ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS o,
    coalesce(n.n, 0) * (SELECT block FROM b) AS l
  FROM d JOIN c ON d.src = c.src LEFT JOIN n ON d.src = n.src
)
SELECT doc_id, size, s AS source_size, target,
  (greatest(0, least(o + size, l) - o) + greatest(0, least(o + s + size, l) - o - s))::BIGINT AS taken
FROM o
"""
