"""Facts about single operators, on a few rows each."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import strings as st
from kindred.operators import blocking, context, decide, features, metrics, normalize, tokens, validate
from kindred.sources import lists, tsv
from kindred.sources.store import Store

PAIRS = "s1 long, cand long, p double"


def kept(df, flag="keep"):
    return {(r["s1"], r["cand"]) for r in df.filter(flag).collect()}


def test_one_to_one(spark):
    d = spark.createDataFrame([(0, 5, 0.9), (1, 5, 0.95), (2, 5, 0.1), (0, 6, 0.8)], PAIRS)
    assert kept(decide.one_to_one(d), "o2o") == {(1, 5), (0, 6)}
    assert kept(decide.one_to_one(d, 0.1), "o2o") == {(0, 6)}
    tie = spark.createDataFrame([(1, 5, 0.5), (0, 5, 0.5)], PAIRS)
    assert kept(decide.one_to_one(tie), "o2o") == {(0, 5)}


def test_expected_f():
    assert decide.best_prefix([0.05, 0.03, 0.02]) == 0
    assert decide.best_prefix([0.95, 0.9]) == 2
    assert decide.best_prefix([0.99, 0.9, 0.35, 0.05]) == 2
    assert decide.best_prefix([]) == 0 and decide.best_prefix([0.99] * 20, most=12) == 12


@pytest.mark.parametrize("p", [[0.7, 0.4], [0.9, 0.6, 0.3], [0.5, 0.5, 0.5, 0.2], [0.1]])
def test_expected_f_by_enumeration(p):
    """Against all outcomes of the pairs."""
    n, best = len(p), (-1.0, 0)
    for k in range(n + 1):
        e = 0.0
        for m in range(2**n):
            y = [m >> i & 1 for i in range(n)]
            w = math.prod(q if t else 1 - q for q, t in zip(p, y, strict=True))
            tp, t = sum(y[:k]), sum(y)
            e += w * (1.0 if k == t == 0 else 0.0 if tp == 0 else 1.25 * tp / (0.25 * t + k))
        if e > best[0] + 1e-12:
            best = (e, k)
    assert decide.best_prefix(p) == best[1]


def test_rule_caps_and_rules(spark):
    d = spark.createDataFrame([(0, i, 0.99 - i / 100) for i in range(5)], PAIRS)
    assert kept(decide.apply_rule(d, threshold=0.5, cap=2)) == {(0, 0), (0, 1)}
    assert kept(decide.apply_rule(d, rule="expected_f")) == {(0, i) for i in range(5)}
    with pytest.raises(ValueError):
        decide.apply_rule(d, rule="other")
    assert len(decide.grid()) == 66 and len(decide.grid("threshold", False)) == 6


def test_f05(spark):
    truth = spark.createDataFrame([(0, 10), (0, 11), (2, 12), (3, 13), (3, 14), (3, 15), (3, 15)], "s1 long, cand long")
    pred = spark.createDataFrame([(0, 10), (0, 11), (0, 16), (2, 17), (3, 13), (3, 13)], "s1 long, cand long")
    ids = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "s1 long, c string")
    f = {r["s1"]: round(r["f05"], 3) for r in metrics.per_entity(pred, truth, ids).collect()}
    assert f == {0: 0.714, 1: 1.0, 2: 0.0, 3: round(1.25 / (0.75 + 1), 3)}
    b = metrics.breakdown(pred, truth, ids).first()
    assert b["n_singletons"] == 1 and b["f05_singletons"] == 1.0 and b["n_pred_pairs"] == 5 and b["n_true_pairs"] == 6
    assert math.isclose(b["macro_f05"], (0.7142857 + 1 + 0 + 0.7142857) / 4, rel_tol=1e-6)
    groups = {r["c"]: r["n_s1"] for r in metrics.by_group(pred, truth, ids, "c").collect()}
    assert groups == {"a": 2, "b": 2, None: 4}
    none = metrics.per_entity(pred.limit(0), truth, spark.createDataFrame([(9,)], "s1 long")).first()
    assert none["f05"] == 1.0


def test_jaro_winkler_and_ratios():
    assert round(st.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(st.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert st.jaro_winkler("", "") == 1.0 and st.jaro_winkler("a", "") == 0.0
    assert st.token_sort("b a", "a b") == 100.0 and st.token_set("a b", "a b c d") == 100.0 and st.token_set("a", "b") == 0.0 and st.token_set("", "a") == 0.0
    assert st.indel("abc", "abd") == pytest.approx(200 * 2 / 6) and st.indel("", "") == 100.0
    assert st.partial("abc", "xxabcxx") == 100.0 and st.partial("", "a") == 0.0


def test_missing_values(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("", "a"), (None, "a")], "x string, y string")
    assert [r[0] for r in d.select(st.equal_or_missing(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, None, None]
    assert [r[0] for r in d.select(features.suffix_relation(F.coalesce("x", F.lit("")), F.col("y"))).collect()] == [0, 1, 2, 2]
    none = d.select(*features.set_overlap(F.lit(None).cast("map<string,double>"), F.lit(None).cast("map<string,double>"), "q")).first()
    assert none["q_jac"] is None and none["q_n_a"] == 0.0 and none["q_max_idf_unmatched_a"] is None
    tset = st.scorer("token_set")
    best = d.select(features.best_over_variants(tset, [F.col("x")], [F.lit("a b"), F.lit("")]).alias("v")).collect()
    assert [r["v"] for r in best] == [100.0, 100.0, None, None]


def test_house_numbers(spark):
    d = spark.createDataFrame([("12", "12"), ("12", "120"), ("", "5"), ("5", ""), ("", ""), ("123456789012", "1")], "a string, b string")
    e = F.lit("")
    got = d.select(*features.house_number(F.col("a"), F.col("b"), F.col("a"), F.col("b"), e, e, e, e)).collect()
    assert [r["hn_state"] for r in got] == [0, 0, 2, 1, 3, 2]
    assert [r["hn_prefix"] for r in got] == [0, 1, None, None, None, None] and got[1]["hn_close"] == 0 and got[0]["hn_close"] == 1


def test_exact_keys_cap_and_gate(spark):
    s1 = spark.createDataFrame([(1, "US", "k", "OH"), (2, "US", "", "OH"), (3, "IN", "k", ""), (4, "US", None, "OH")], "id long, country string, key string, st string")
    pool = spark.createDataFrame([(i, "US", "k", "TX" if i < 3 else "") for i in range(5)] + [(9, "IN", "k", "KA")], "id long, country string, key string, st string")
    pairs = lambda **k: {(r[0], r[1]) for r in blocking.exact_key_pairs(s1, pool, ["key"], **k).collect()}
    assert pairs() == {(1, i) for i in range(5)} | {(3, 9)}
    assert pairs(cap=4) == {(3, 9)} and pairs(gate="st") == {(1, 3), (1, 4), (3, 9)}


def test_similarity_in_partitions(spark):
    q = spark.createDataFrame([(1, "US", "OH", "acme foods"), (2, "US", "", "acme foods"), (3, "US", "TX", "zzz")], "id long, country string, label string, text string")
    p = spark.createDataFrame([(10, "US", "OH", "acme foods"), (11, "US", "TX", "acme foods"), (12, "US", "", "acme food"), (13, "IN", "OH", "acme foods")], "id long, country string, label string, text string")
    forward, back = blocking.similarity_topk(q, p, 5, 1, min_df=1)
    got = {}
    for r in forward.collect():
        got.setdefault(r["s1"], []).append((r["rank"], r["cand"]))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {1: [10, 12], 2: [10, 11, 12]}
    assert {(r["cand"], r["s1"]) for r in back.collect()} == {(10, 1), (10, 2), (11, 2), (12, 1), (12, 2)}
    empty, _ = blocking.similarity_topk(q, p, 0)
    assert empty.collect() == []


def test_grams(spark):
    from kindred.functions.native import char_grams

    got = spark.createDataFrame([("ab c",), ("",), (None,)], "t string").select(char_grams(F.col("t"))).collect()
    assert [r[0] for r in got] == [[" ab", "ab ", " c "], [], []]


def test_peers_and_twins(spark):
    d = spark.createDataFrame([(1, c, p) for c, p in ((1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6), (5, 0.5))], PAIRS)
    got = {}
    for r in context.top_peers(d).collect():
        got.setdefault(r["cand"], []).append((r["peer_rank"], r["peer"]))
    assert [c for _, c in sorted(got[1])] == [2, 3, 4] and [c for _, c in sorted(got[5])] == [1, 2, 3]
    t = spark.createDataFrame([(1, 1, 0.5, 2, 0.9, "k", "k", "1", "2"), (1, 2, 0.9, 1, 0.5, "k", "k", "2", "1"), (1, 3, 0.1, 2, 0.9, "", "", "1", "2")], "s1 long, cand long, p double, peer long, peer_p double, n_key string, peer_key string, hn string, peer_hn string")
    assert {r["cand"]: (r["twin_better"], r["twin_gap"] and round(r["twin_gap"], 6)) for r in context.twins(t).collect()} == {1: (1, 0.4), 2: (0, None), 3: (0, None)}


def test_dictionary(spark):
    rows = [("silver foundation", "सिल्वर फाउंडेशन")] * 3 + [("silver base", "सिल्वर फाउंडेशन")]
    s1 = spark.createDataFrame([(f"S1-{i}", a, "", "India") for i, (a, _) in enumerate(rows)], "entity_id string, business_name string, business_address string, country string")
    pool = spark.createDataFrame([(f"S2-{i}", b, "", "India") for i, (_, b) in enumerate(rows)], s1.schema)
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(4)], "s1 string, cand string")
    d = normalize.fit_dictionary(s1, pool, truth)
    assert d.best == {"सिल्वर": "silver", "फाउंडेशन": "foundation"} and d.second == {"फाउंडेशन": "base"}
    assert d.text("सिल्वर फाउंडेशन") == ("silver foundation", 0) and d.runner_up("सिल्वर फाउंडेशन") == "silver base"


def test_cities(spark):
    rows = [("1 Main St, Euclid, OH", "US"), ("2 Main St, Euclid, OH", "US"), ("3 Rd, Lucknow, UP", "India"), ("4 Rd, Lucknow 226001, UP", "India"), ("5 Rd, Pune, Maharashtra", "India")]
    s1 = spark.createDataFrame([(str(i), "", a, c) for i, (a, c) in enumerate(rows)], "entity_id string, business_name string, business_address string, country string")
    assert normalize.fit_cities(s1, normalize.Dictionary()) == {"US": {"euclid"}, "India": {"lucknow"}}


def test_idf_counts_records_without_tokens(spark):
    d = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],)], "t array<string>")
    got = {r["token"]: (r["df"], round(r["idf"], 6)) for r in tokens.idf(d, "t").collect()}
    assert got == {"a": (2, round(math.log(4 / 3) + 1, 6)), "b": (1, round(math.log(2) + 1, 6))}


def test_result_files(spark):
    d = spark.createDataFrame([("S1-1\tS2-1,S2-1",), ("S1-1\t",), ("S1-2\tS1-9,X-1,S3-4",), ("  ",), ("no tab",)], "line string")
    rows = validate.rows_of(d.filter("line <> 'no tab'"))
    assert [r[0] for r in validate.malformed(d).collect()] == ["no tab"]
    ids = spark.createDataFrame([("S1-1",), ("S1-3",)], "s1 string")
    pool = spark.createDataFrame([("S2-1",), ("S3-4",)], "id string")
    cands = spark.createDataFrame([("S1-1", ["S2-1"])], "s1 string, ids array<string>")
    got = validate.report(rows, ids, pool, cands)
    assert {k: v["n"] for k, v in got.items()} == {"duplicate_rows": 1, "duplicate_ids": 1, "wrong_prefix": 2, "missing_rows": 1, "extra_rows": 1, "unknown_ids": 2, "not_among_candidates": 3}
    assert got["missing_rows"]["examples"] == ["S1-3"]
    for first, rest, issue in (("a,b\n", "x,y\n", "comma"), ("x\ty\n", "", "header"), ("", "", "empty")):
        assert issue in validate.header_issue(first + rest, ("source1_entity_id", "matched_entity_ids"))
    assert validate.header_issue("source1_entity_id\tmatched_entity_ids\n", ("source1_entity_id", "matched_entity_ids")) is None


def test_sources(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\n1\t  "q" \\ x\t\t US \tz\n2\té\tb, c\tIndia\tz\n')
    rows = tsv.read_source(spark, str(p), 2).orderBy("entity_id").collect()
    assert tuple(rows[0]) == ("1", '"q" \\ x', "", "US", 2) and rows[1]["business_name"] == "é"
    p.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n1\ta\tb\tc\n1\ta\tb\tc\n")
    with pytest.raises(ValueError, match="repeats"):
        tsv.read_source(spark, str(p))
    p.write_text("entity_id\tcountry\n1\tc\n")
    with pytest.raises(ValueError, match="lacks"):
        tsv.read_source(spark, str(p))
    p.write_text("source1_entity_id\tanything\nS1-1\tS2-1, S3-10\nS1-2\t\n")
    assert [(r["s1"], r["ids"]) for r in tsv.read_truth(spark, str(p)).orderBy("s1").collect()] == [("S1-1", ["S2-1", "S3-10"]), ("S1-2", [])]


def test_store_and_lists(spark, tmp_path):
    s = Store(spark, str(tmp_path / "w"))
    assert not s.has("t") and s.load_json("x.json", 5) == 5
    t = s.save("t", spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (4, 2, 0.1)], PAIRS))
    assert s.gather("t", spark.createDataFrame([(1,)], "s1 long")).count() == 2
    s.report(a=1)
    s.report(b={"é": [1]})
    assert s.load_json("report.json") == {"a": 1, "b": {"é": [1]}}
    out = lists.id_lists(t, spark.createDataFrame([(1,), (4,), (9,)], "s1 long"), "m")
    assert {r["s1"]: r["m"] for r in out.collect()} == {1: "3,2", 4: "2", 9: ""}
    lists.write_lists(out, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == "s1\tm\n1\t3,2\n4\t2\n9\t\n"


def test_config():
    with pytest.raises(KeyError):
        Config.of({"no_such": 1})
    assert Config.of(json.loads(Config().json())) == Config() and Config().having(folds=2).folds == 2


def test_stage_choice():
    from kindred.plans.pipeline import STAGES, chosen

    assert chosen("all") == STAGES and chosen("block:prune") == ("block", "prune") and chosen("write") == ("write",)
    with pytest.raises(SystemExit):
        chosen("nothing")


def test_folds_score_what_they_have_not_seen(spark):
    from kindred.operators import models

    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    rows = [(int(i), 0, float(v), None if i % 5 == 0 else float(v), int(v + rng.normal() * 0.3 > 0), int(i % 2)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "s1 long, cand long, x double, z double, y int, fold int").repartition(2).cache()
    fitted = models.train_folds(d, ["x", "z"], folds=2, iterations=5, depth=2)
    out = models.predict(fitted, d, ["x", "z"], "p", oof=True)
    q = models.quality(out)
    assert set(fitted) == {0, 1} and q["auc"] > 0.95 and 0 < q["log_loss"] < 0.5 and 0.9 < q["average_precision"] <= 1
    assert {n for n, _ in models.importance(fitted, ["x", "z"])} == {"x", "z"}
    cal = models.calibrated(models.calibrate(out), out).agg(F.min("p_cal"), F.max("p_cal")).first()
    assert 0 <= cal[0] <= cal[1] <= 1
