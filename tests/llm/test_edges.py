"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names: for each operator and stage."""

import pytest
from pyspark.sql import functions as F

from kindred.llm import decontamination, licenses, mixing, quality_rules, sharding, simhash, suffix_dedup, suffix_tree, toxicity, warc
from tests.llm.cases import ROWS, documents, rows_of

ITEMS = [(1, "plain3 words plain4 words plain5 words plain6 words plain7 words plain8 words"), (2, None), (3, ""), (None, "straße"), (4, "other text"), (4, "other text")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(0) for c in ("h", "words", "n", "items", "key")})


def labels(spark, rows=((1, 1), (5, 0), (9, 0), (None, 1), (7, None), (7, 0), (7, 1), (99, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int").withColumn("y", F.lit("clash"))


def model(spark, docs):
    return toxicity.fit(docs, labels(spark), min_df=1)


OPERATORS = {
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "simhash_wide": lambda spark, d: simhash.near_duplicates(d, shingle=5, radius=52, lanes=4, sure=24, similarity=0.8),
    "decontamination": lambda spark, d: decontamination.contamination(d, items(spark)),
    "toxicity": lambda spark, d: toxicity.score(d, model(spark, d)).select("doc_id", "score"),
    "quality_rules": lambda spark, d: quality_rules.ledger(d),
    "sharding": lambda spark, d: sharding.assign(d).select("doc_id", "slot", "shard"),
    "mixing": lambda spark, d: mixing.mix(d)[0],
    "suffix_dedup": lambda spark, d: suffix_dedup.removed(d),
    "licenses": lambda spark, d: licenses.scan(d),
    "suffix_tree": lambda spark, d: suffix_tree.score(d),
}
STAGES = {
    "toxicity": lambda spark, d: toxicity.score(d, model(spark, d), score_col="__t").filter("__t < 0.5").drop("__t"),
    "simhash": lambda spark, d: simhash.keep_one(d),
    "decontamination": lambda spark, d: decontamination.clean(d, items(spark)),
    "mixing": lambda spark, d: mixing.mixed(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_clashing_names(spark, name):
    """Extra columns change nothing; there is a row for each row, or (decontamination) each different one; twice gives the same."""
    plain = rows_of(OPERATORS[name](spark, documents(spark, clash=False)))
    assert plain == rows_of(OPERATORS[name](spark, documents(spark)))
    assert len(plain) == len(ROWS) - (name == "decontamination")


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, name):
    d = documents(spark)
    out = STAGES[name](spark, d)
    assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
    assert set(rows_of(out)) <= set(rows_of(d))
    assert STAGES[name](spark, documents(spark, [])).collect() == []


def test_simhash_values(spark):
    got = {(r["id"], r["n"]): r for r in simhash.near_duplicates(documents(spark)).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[2]["f0"] == by_id[3]["f0"] == by_id[8]["f0"] == 0  # no words
    assert by_id[2]["component"] == by_id[3]["component"] == by_id[8]["component"] == 2
    assert by_id[6]["component"] == 1 and by_id[None]["component"] is None and by_id[5]["component"] == 5
    kept = [r["doc_id"] for r in simhash.keep_one(documents(spark)).collect()]
    assert None in kept and 1 in kept and 6 not in kept and 7 not in kept and kept.count(10) == 2 and 5 in kept


def test_decontamination_values(spark):
    got = {r["id"]: r for r in decontamination.contamination(documents(spark), items(spark)).collect() if r["id"] != 11}
    assert got[1]["n_hit"] == 12 and got[1]["items"] == ["1"] and got[2]["n_words"] == 0 and got[2]["items"] == []
    assert got[10]["items"] == ["null"] and got[10]["n_hit"] == 1
    assert sorted(r["doc_id"] or 0 for r in decontamination.clean(documents(spark), items(spark)).collect()) == [0, 2, 3, 5, 8, 9, 11]
    none = decontamination.contamination(documents(spark), items(spark, [(2, None), (3, "")]))
    assert {r["n_hit"] for r in none.collect()} == {0}
    slow = decontamination.contamination(documents(spark), items(spark), broadcast_windows=0)
    assert rows_of(slow) == rows_of(decontamination.contamination(documents(spark), items(spark)))


def test_toxicity_values(spark):
    d = documents(spark)
    assert toxicity.fit(d, labels(spark, [])).weights == {}
    rate = toxicity.score(d, toxicity.fit(d, labels(spark, [(1, 1), (5, 1)]))).select("score").distinct().collect()
    assert len(rate) == 1 and rate[0][0] > 0.99
    m = toxicity.fit(d, labels(spark), min_df=1)
    s = {r["doc_id"]: r["score"] for r in toxicity.score(d, m).collect()}
    assert s[2] == s[3] == s[8] and 0 <= min(s.values()) and max(s.values()) <= 1 and s[1] > s[5]


def test_quality_values(spark):
    q = {r["doc_id"]: r for r in quality_rules.ledger(documents(spark)).collect()}
    assert q[2]["n_words"] == q[3]["n_words"] == q[8]["n_words"] == 0 and q[2]["fail_bits"] & 1
    assert q[9]["n_dup_lines"] == 49 and q[9]["n_repeat_words"] == q[9]["n_words"] == 100
    assert q[5]["n_words"] == 30_000 and q[5]["n_repeat_words"] == 0 and q[None]["n_words"] == 4


def test_mixing_values(spark):
    got = mixing.mix(documents(spark))[0].collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    of = {}
    for r in got:
        of.setdefault(r["src"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - w) <= 0.02 * w + 8 for t, w in of.values())
    assert max(of) == "1"  # the null source comes last
    words = mixing.mixed(documents(spark)).collect()
    assert all(r["text"] and r["text"].split() for r in words)


def test_rows_of_one_text_are_mixed_alike(spark):
    """Rows equal in id, text and source but for another column: none goes by chance, reruns agree, also without a broadcast."""
    rows = [(1, "a b c d", "en", "x"), (1, "a b c d", "fr", "x"), (1, "a b c d", "fr", "x"), (1, "a b c d", "fr", "y"), (2, "e f", "en", "x"), (2, "e f", "en", "x")]
    d = documents(spark, rows)
    want = rows_of(mixing.mixed(d, share=2.0))
    assert len(want) == 2 * len(rows) and set(want) == set(rows_of(d))  # twice all words: every row twice
    assert rows_of(mixing.mixed(d.repartition(5), share=2.0, most_broadcast=0)) == want


def test_suffix_values(spark):
    got = {}
    for r in suffix_dedup.removed(documents(spark)).collect():
        got.setdefault(r["id"], []).append(r)
    n = got[1][0]["n_bytes"]
    assert got[1][0]["n_removed"] == 0 and got[6][0]["n_removed"] == n and got[7][0]["n_removed"] == n
    assert got[2][0]["n_bytes"] == got[3][0]["n_bytes"] == 0 and got[None][0]["n_removed"] == 0
    assert got[9][0]["n_bytes"] == 350 and got[9][0]["n_removed"] == 350 - 7 and got[9][0]["n_spans"] == 1
    assert all(r["n_removed"] == 0 for r in got[10] + got[11])  # shorter than a string


def test_suffix_tree_values(spark):
    got = {r["id"]: r for r in suffix_tree.score(documents(spark)).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == got[8]["n_tokens"] == 1 and got[5]["n_tokens"] == 30_001
    out = suffix_tree.score(documents(spark), train=F.lit(False)).collect()
    assert {r["n_known"] for r in out} == {0} and {r["train_tokens"] for r in out} == {0}


def test_warc_values(spark):
    html = "<p>" + "x" * 1200
    rows = [(1, "http://a/", html), (2, None, html), (2, "b", html), (3, "c\r\nd", None), (4, "", ""), (None, "e", html), (5, "f", "short"), (6, "g", "short"), (7, "é", "é" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "payload", "record_type", "path")})
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1203, "revisit", 2), (2, 1203, "response", None), (2, 1203, "response", None), (3, 0, "response", None), (4, 0, "response", None), (None, 1203, "revisit", 2), (5, 5, "response", None), (6, 5, "response", None), (7, 1998, "response", None)], key=repr)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_license_values(spark):
    d = documents(spark, [*ROWS, (12, "cc by nc " * 20_000 + "SPDX-License-Identifier: MIT, and so on", "en", "a")])
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r["id"], []).append(r)
    for i in (2, 3, 8):
        assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"], r["allowed"]) for r in got[i]] == [(0, 0, None, "", 0.0, None)]
    assert len(got[10]) == len(got[11]) == 2 and got[None][0]["n_words"] == 4 and got[5][0]["n_words"] == 30_000 and got[5][0]["labels"] == ""
    r = got[12][0]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["expressions"]) == (20_000, 0, 59_997, "cc-by-nc", "cc-by-nc,mit", ["MIT"])


def test_sharding_values(spark):
    got = [(r["doc_id"], r["shard"]) for r in sharding.assign(documents(spark)).collect()]
    assert len({s for i, s in got if i == 11}) == 1 and len({s for i, s in got if i is None}) == 1
