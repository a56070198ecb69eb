"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure bit a rule; policies
are versioned masks over these bits, so that applying, comparing and ablating policies never reads a text again.

Defined results: a null text counts as empty (no words, no lines); a null doc_id is kept as null; repeated rows get
a row each; an empty table gives an empty ledger; columns of the input other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SPACE_WORD, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A document fails where the condition holds; bit is the rule's place in the ledger."""

    name: str
    bit: int
    condition: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Bits are never reused: a changed rule takes a new bit, and older policies stay as they were.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", 2, "4 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    Rule("short_words", 4, "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 25 * n_words"),
)
POLICIES = {
    p.name: p
    for p in (
        Policy("base", 1, ("few_words", "repeated_windows")),
        Policy("production", 1, ("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "short_words", "long_words")),
    )
}


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in policy.rules)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: one narrow pass, no shuffle.

    Windows are compared by hash first; only a text with two equal hashes sorts its windows, and there equal hashes
    are confirmed on the words themselves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    d = d.select(
        "id",
        words_of(F.col("t"), SPACE_WORD).alias("w"),
        F.char_length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    d = d.select(
        "id", "w", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    eight = ", ".join(f"get(h, i + {k})" for k in range(WINDOW))
    d = d.withColumn("g", F.expr(f"CASE WHEN size(h) > {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({eight})) END"))
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS h, i AS p))) END"))
    same = "get(s, {a}).h = get(s, {b}).h AND slice(w, get(s, {a}).p + 1, 8) = slice(w, get(s, {b}).p + 1, 8)"
    d = d.withColumn("r", F.expr(f"CASE WHEN s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(s) - 1), j -> coalesce({same.format(a='j - 1', b='j')}, false) OR coalesce({same.format(a='j', b='j + 1')}, false)), j -> get(s, j).p)) END"))
    covered = F.expr(f"CASE WHEN r IS NULL OR size(r) = 0 THEN 0 WHEN size(r) = 1 THEN {WINDOW} ELSE aggregate(sequence(1, size(r) - 1), {WINDOW}, (a, k) -> a + least({WINDOW}, get(r, k) - get(r, k - 1))) END")
    return d.select(F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and fail_bits, in which bit b is set where the rule with that bit fails."""
    bits: Column = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.condition), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(of: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds kept, policy and policy_version to a ledger."""
    return of.withColumns({"kept": F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0, "policy": F.lit(policy.name), "policy_version": F.lit(policy.version)})


def ablations(of: DataFrame, policies: tuple[Policy, ...] = tuple(POLICIES.values()), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, version, rule, n_failed, n_only, n_kept, n_kept_without: what each rule removes, alone and beyond the others.

    Documents are counted by bit pattern first, at most 2 ** rules rows; the rest works on those counts.  An empty
    ledger has no patterns and gives no rows.
    """
    patterns = of.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    byname = {r.name: r for r in rules}
    long = lambda x: F.lit(x).cast("long")
    cases = [F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(n).alias("rule"), long(1 << byname[n].bit).alias("bit"), long(mask(p, rules)).alias("mask")) for p in policies for n in p.rules]
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    fails = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.select("fail_bits", "n", F.inline(F.array(*cases)))
        .groupBy("policy", "version", "rule")
        .agg(
            hit(fails.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            hit(fails == F.col("bit")).alias("n_only"),
            hit(fails == 0).alias("n_kept"),
            hit(fails.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from kindred.llm.common import table

    led = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["production"])
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM m WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(CASE WHEN q IS NULL THEN 8 ELSE least(8, p - q) END)::BIGINT AS n FROM rep GROUP BY doc_id
), a AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id
), b AS (
  SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
    + 8 * (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)::INT + 16 * (n_words > 0 AND word_chars < 2 * n_words)::INT
    + 32 * (word_chars > 25 * n_words)::INT)::BIGINT AS fail_bits
  FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
