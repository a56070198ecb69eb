"""The linkage job: load, normalize, block, prune, features, stage1, context, decide, write.

Each stage reads keyed tables from the store and writes its own; nothing is joined by position.  Run all stages, or
some of them, from the command line::

    python -m kindred.plans.pipeline --data FOLDER --work FOLDER --mode train --stages normalize:prune --set folds=3
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.operators import blocking, context, decide, features, metrics, models, normalize, sampling, tokens, validate
from kindred.sources import lists, tsv
from kindred.sources.store import Store

STAGES = ("load", "normalize", "block", "prune", "features", "stage1", "context", "decide", "write")
CHEAP = ("sc_name", "sc_na", "sc_addr", "sc_rev", "rk_name", "rk_na", "rk_addr", "rk_rev", "ex_name", "ex_street", "ex_hn")
KEYS = ("s1", "cand")


class Linkage:
    """mode train learns resources, models and decision settings; mode test uses those of a train run's store."""

    def __init__(self, spark: SparkSession, data: str, store: Store, cfg: Config = Config(), mode: str = "train", trained: Store | None = None, only: str | None = None):
        if mode not in ("train", "test"):
            raise ValueError(f"no mode {mode}")
        self.spark, self.data, self.store, self.cfg, self.mode = spark, data, store, cfg, mode
        self.trained, self.only = trained or store, only

    # ------------------------------------------------------------ stages
    def load(self) -> None:
        s1, pool, truth = tsv.read_split(self.spark, self.data, self.mode)
        if self.only is not None:  # a shard: records of one country meet no others
            s1, pool = (x.filter(F.col("country") == self.only) for x in (s1, pool))
        s1, pool = self.store.save("s1", s1), self.store.save("pool", pool)
        if truth is not None:
            self.store.save("truth", tsv.truth_pairs(truth, s1, pool))
        ids = s1.select(F.col("entity_id").alias("s1"), "country")
        split = sampling.splits(ids, "s1", self.cfg.hidden if self.mode == "train" else 0.0, self.cfg.folds)
        self.store.save("ids", ids.join(split, "s1"))
        counts = s1.groupBy("country").count().collect()  # one row a country
        self.store.report(s1_by_country={r["country"]: r["count"] for r in counts})

    def normalize(self) -> None:
        s1, pool = self.store.load("s1"), self.store.load("pool")
        if self.mode == "train":
            truth = self.store.load("truth") if self.store.has("truth") else None
            found = normalize.fit(s1, pool, truth, self.cfg)
        else:
            found = normalize.extended(normalize.Resources.of_json(self.trained.load_json("resources.json")), s1, self.cfg)
        self.store.save_json("resources.json", found.as_json())
        a, b = (self.store.save(f"{n}_norm", normalize.normalize(d, found)) for n, d in (("s1", s1), ("pool", pool)))
        every = a.unionByName(b)
        for p, c in features.SETS.items():
            idf = self.store.save(f"idf_{p}", tokens.idf(every.select(features.token_set(F.col(c)).alias("t")), "t"))
            for n, d in (("s1", a), ("pool", b)):
                self.store.save(f"{n}_{p}", features.weighted_set(d.select("id", features.token_set(F.col(c)).alias("t")), "t", idf, f"m_{p}"))
        self.store.save("s1_freq", tokens.key_frequencies(a, b, "n_key", "country", "a_city").select("id", "nk_cnt_country", "nk_cnt_city", "nk_cnt_pool_city"))

    def block(self) -> None:
        cfg = self.cfg
        asked = self.store.load("ids").filter(~F.col("hidden")).select(F.col("s1").alias("id"))
        a, b = self.store.load("s1_norm").join(asked, "id"), self.store.load("pool_norm")
        label = F.col("a_state") if cfg.by_state else F.lit("")
        text = normalize.retrieval_texts()
        weights = {"min_df": cfg.min_df, "max_share": cfg.max_df, "floor": cfg.max_df_floor, "max_features": cfg.max_features, "n": cfg.ngram}
        frames = []
        for n, k, back in (("name", cfg.k_name, 0), ("na", cfg.k_name_addr, cfg.k_reverse), ("addr", cfg.k_addr, 0)):
            q, p = (d.filter("a_street <> '' OR a_hn <> ''") if n == "addr" else d for d in (a, b))
            side = lambda d, n=n: d.select("id", "country", label.alias("label"), text[n].alias("text"))
            forward, reverse = blocking.similarity_topk(side(q), side(p), k, back, cfg.threshold, **weights)
            named = lambda d, s: d.groupBy(*KEYS).agg(F.max("score").alias(f"sc_{s}"), F.min("rank").alias(f"rk_{s}"))
            frames.append(named(forward, n))
            if reverse is not None and back > 0:
                frames.append(named(reverse, "rev"))
        for flag, keys, gate in (("ex_name", ["n_key"], "a_state"), ("ex_street", ["a_city", "a_street_key"], None), ("ex_hn", ["a_hn", "a_street_key"], None)):
            frames.append(blocking.exact_key_pairs(a, b, keys, cfg.exact_block_cap, gate=gate).withColumn(flag, F.lit(1)))
        pairs = self.store.save("pairs", blocking.heuristic_cap(blocking.union_merge(frames), cfg.max_union_per_s1))
        if self.store.has("truth"):
            self.store.report(blocking=blocking.recall(pairs, self.store.load("truth"), asked.withColumnRenamed("id", "s1")).first().asDict())

    def _records(self) -> tuple[DataFrame, DataFrame]:
        a, b = self.store.load("s1_norm").join(self.store.load("s1_freq"), "id", "left"), self.store.load("pool_norm")
        for p in features.SETS:
            a, b = a.join(self.store.load(f"s1_{p}"), "id", "left"), b.join(self.store.load(f"pool_{p}"), "id", "left")
        return a, b

    def _labelled(self, pairs: DataFrame) -> DataFrame:
        fold = self.store.load("ids").select("s1", "fold")
        out = pairs.join(fold, "s1")
        return blocking.labelled(out, self.store.load("truth")) if self.store.has("truth") else out.withColumn("y", F.lit(0))

    def _fit_and_score(self, df: DataFrame, stage: str, names: list[str], out: str) -> DataFrame:
        """Trains or loads a stage's models and adds their score: out of fold in training, the folds' mean otherwise."""
        if self.mode == "train":
            fitted = models.train_folds(df, names, self.cfg.folds, self.cfg.iterations, self.cfg.depth, self.cfg.max_train_rows, self.cfg.seed)
            models.save(fitted, names, self.store, stage)
            self.store.report(**{f"{stage}_importance": models.importance(fitted, names)})
        else:
            fitted = models.load(self.trained, stage, names)
        return models.predict(fitted, df, names, out, oof=self.mode == "train")

    def prune(self) -> None:
        pairs = self.store.load("pairs")
        a, b = self._records()
        both = {"st": "a_state", "hn": "a_hn", "city": "a_city", "pc": "a_postcode", "key": "n_key", "nm": "m_nm", "ad": "m_ad"}
        x = a.select(F.col("id").alias("s1"), *[F.col(c).alias(f"x_{n}") for n, c in both.items()], "nk_cnt_country", "nk_cnt_city", "nk_cnt_pool_city")
        y = b.select(F.col("id").alias("cand"), *[F.col(c).alias(f"y_{n}") for n, c in both.items()], F.col("n_is_domain").cast("int").alias("cand_is_domain"), F.col("a_empty").cast("int").alias("cand_addr_empty"), F.col("source").alias("cand_source"), F.col("n_script").alias("cand_script"))
        eq = lambda n: (F.nullif(f"x_{n}", F.lit("")) == F.nullif(f"y_{n}", F.lit(""))).cast("double")
        here = lambda c: (F.col(c) != "").cast("double")
        pairs = pairs.join(pairs.groupBy("s1").agg(F.log1p(F.count(F.lit(1))).alias("log_n_cands_union")), "s1")
        equal = [eq("st").alias("state_eq"), eq("hn").alias("hn_eq"), eq("city").alias("city_eq"), eq("pc").alias("pc_eq"), F.coalesce(eq("key"), F.lit(0.0)).alias("key_eq"), here("x_hn").alias("hn_present_s1"), here("y_hn").alias("hn_present_c")]
        j = pairs.join(x, "s1").join(y, "cand").select(*pairs.columns, *features.set_overlap(F.col("x_nm"), F.col("y_nm"), "nm"), *features.set_overlap(F.col("x_ad"), F.col("y_ad"), "ad"), *equal, *[c for c in x.columns if c.startswith("nk_")], "cand_is_domain", "cand_addr_empty", "cand_source", "cand_script")
        names = [c for c in j.columns if c not in KEYS]
        scored = self._fit_and_score(self.store.save("cheap", self._labelled(j)), "pruner", names, "prune_p")
        kept = models.prune(scored.select(*pairs.columns, "prune_p"), self.cfg.prune_top, self.cfg.prune_min_p)
        self.store.save("candidates", kept)

    def features(self) -> None:
        self.store.save("features", self._labelled(features.pair_features(self.store.load("candidates"), *self._records())))

    def stage1(self) -> None:
        df = self.store.load("features")
        names = [c for c in df.columns if c not in (*KEYS, "y", "fold")]
        self.store.save("p1", self._fit_and_score(df, "stage1", names, "p").select(*KEYS, "p"))

    def context(self) -> None:
        f, p1 = self.store.load("features"), self.store.load("p1")
        info = self.store.load("pool_norm").select(F.col("id").alias("cand"), "source", "n_key", "n_core", F.col("a_hn").alias("hn"))
        bag = self.store.load("pool_ad").select(F.col("id").alias("cand"), F.map_keys("m_ad").alias("bag"))
        pairs = p1.join(info.select("cand", "source"), "cand")
        stats = context.competition(context.group_stats(pairs))
        them = info.join(bag, "cand", "left").select(F.col("cand").alias("peer"), F.col("source").alias("peer_source"), F.col("n_key").alias("peer_key"), F.col("n_core").alias("peer_core"), F.col("hn").alias("peer_hn"), F.col("bag").alias("peer_bag"))
        from kindred.functions import strings as st

        peers = context.top_peers(p1).join(info, "cand").join(bag, "cand", "left").join(them, "peer")
        shared, every = F.size(F.array_intersect("bag", "peer_bag")), F.size(F.array_union("bag", "peer_bag"))
        peers = peers.withColumns({"addr_sim": F.when(every > 0, shared / every), "hn_same": (F.nullif("hn", F.lit("")) == F.nullif("peer_hn", F.lit(""))).cast("double"), "name_sim": st.scorer("token_set")("n_core", "peer_core") / 100, "opposite": F.col("source") != F.col("peer_source")})
        ctx = stats.drop("source").withColumnRenamed("p", "p1").join(context.cluster_agreement(peers), list(KEYS), "left").join(context.twins(peers), list(KEYS), "left").withColumn("twin_better", F.coalesce("twin_better", F.lit(0)))
        df = self.store.save("context", f.join(ctx, list(KEYS)))
        names = [c for c in df.columns if c not in (*KEYS, "y", "fold")]
        scored = self.store.save("p2", self._fit_and_score(df, "stage2", names, "p2").select(*KEYS, "y", "p2"))
        if self.mode == "train":
            iso = models.calibrate(scored, "p2")
            iso.write().overwrite().save(f"{self.store.folder}/isotonic")
            self.store.report(stage2=models.quality(scored, "p2"))
        else:
            from pyspark.ml.regression import IsotonicRegressionModel

            iso = IsotonicRegressionModel.load(f"{self.trained.folder}/isotonic")
        self.store.save("p_cal", models.calibrated(iso, scored, "p2", "p").select(*KEYS, "p"))

    def decide(self) -> None:
        pairs, ids = self.store.load("p_cal"), self.store.load("ids").filter(~F.col("hidden"))
        cfg = self.cfg
        if self.mode == "train" and cfg.decision_rule == "threshold":
            best = {"rule": "threshold", "threshold": cfg.decision_threshold, "margin": cfg.margin if cfg.one_to_one else None}
        elif self.mode == "train":
            n = ids.count()
            some = ids if n <= cfg.tune_max_s1 else ids.filter(sampling.id_fraction(F.concat(F.lit("tune:"), F.col("s1"))) < cfg.tune_max_s1 / n)
            sample = self.store.save("tune_pairs", pairs.join(some.select("s1"), "s1", "left_semi"))
            truth = self.store.load("truth").join(some.select("s1"), "s1", "left_semi")
            best, results = decide.tune(sample, truth, some, decide.grid(cfg.decision_rule, cfg.one_to_one))
            self.store.report(tuning=[[r, s] for r, s in results])
        else:
            best = self.trained.load_json("decision.json")
        self.store.save_json("decision.json", best)
        kept = self.store.save("matches", decide.apply_rule(pairs, **best, cap=cfg.max_matches_per_s1).filter("keep"))
        if self.store.has("truth"):
            truth = self.store.load("truth").join(ids.select("s1"), "s1", "left_semi")
            self.store.report(metrics=metrics.breakdown(kept, truth, ids).first().asDict(), by_country=[r.asDict() for r in metrics.by_group(kept, truth, ids, "country").collect()])

    def write(self) -> None:
        ids, matches, cands = self.store.load("ids"), self.store.load("matches"), self.store.load("candidates")
        got = lists.id_lists(matches, ids, "matched_entity_ids")
        all_ = lists.id_lists(cands.withColumn("p", F.col("prune_p")), ids, "candidate_entity_ids")
        named = lambda d: d.withColumnRenamed("s1", "source1_entity_id")
        lists.write_lists(named(got), f"{self.store.folder}/matches_tsv")
        lists.write_lists(named(all_), f"{self.store.folder}/candidates_tsv")
        rows = lambda d: validate.rows_of(d.select(F.concat_ws("\t", *d.columns).alias("line")))
        pool = self.store.load("pool").select(F.col("entity_id").alias("id"))
        if self.store.has("truth"):
            raw = lambda d, k, side: d.select(F.col("entity_id").alias(k), F.concat_ws(" | ", "business_name", "business_address").alias(side))
            left, right = raw(self.store.load("s1"), "s1", "left_text"), raw(self.store.load("pool"), "cand", "right_text")
            truth = self.store.load("truth").join(ids.filter(~F.col("hidden")).select("s1"), "s1", "left_semi")
            kept = matches.select(*KEYS, F.lit(True).alias("keep"))
            decided = blocking.labelled(self.store.load("p_cal").join(kept, list(KEYS), "left").withColumn("keep", F.coalesce("keep", F.lit(False))), truth)
            errors = lists.error_dump(decided, left, right).unionByName(lists.missed_dump(blocking.missed(truth, self.store.load("pairs")), left, right))
            self.store.report(errors={r["kind"]: r["count"] for r in self.store.save("errors", errors).groupBy("kind").count().collect()})
        issues = validate.report(rows(got), ids.select("s1"), pool, rows(all_))
        self.store.report(issues=issues)
        if issues:
            raise ValueError(f"the result does not pass: {issues}")

    def run(self, stages: tuple[str, ...] = STAGES) -> dict:
        for s in stages:
            getattr(self, s)()
        return self.store.load_json("report.json", {})


def by_country(spark: SparkSession, data: str, work: str, cfg: Config, mode: str, trained: Store) -> tuple[dict[str, dict], DataFrame]:
    """The job run for one country after another, each in a store of its own, and its lists put together: (reports, lists)."""
    s1, _, _ = tsv.read_split(spark, data, mode)
    countries = sorted(r["country"] for r in s1.select("country").distinct().collect())  # a few
    reports, whole = {}, None
    for c in countries:
        store = Store(spark, f"{work}/{c}")
        reports[c] = Linkage(spark, data, store, cfg, mode, trained, only=c).run()
        got = lists.id_lists(store.load("matches"), store.load("ids"))
        whole = got if whole is None else whole.unionByName(got)
    if whole is None:
        raise ValueError(f"{data} has no records to link")
    lists.write_lists(whole.withColumnRenamed("s1", "source1_entity_id"), f"{work}/matches_tsv")
    return reports, whole


def chosen(text: str) -> tuple[str, ...]:
    """all; a,b; or from:to, both included.

    >>> chosen("block:features")
    ('block', 'prune', 'features')
    """
    if text == "all":
        return STAGES
    if ":" in text:
        a, b = text.split(":")
        return STAGES[STAGES.index(a or STAGES[0]) : STAGES.index(b or STAGES[-1]) + 1]
    names = tuple(text.split(","))
    if unknown := set(names) - set(STAGES):
        raise SystemExit(f"no stage {', '.join(sorted(unknown))}")
    return names


def main(argv: list[str] | None = None) -> None:
    from kindred.session import session

    p = argparse.ArgumentParser()
    p.add_argument("--data", required=True)
    p.add_argument("--work", required=True)
    p.add_argument("--trained", help="store of a train run, for mode test")
    p.add_argument("--mode", choices=("train", "test"), default="train")
    p.add_argument("--stages", type=chosen, default=STAGES)
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--set", action="append", default=[], metavar="NAME=JSON")
    a = p.parse_args(argv)
    values = json.loads(open(a.config).read()) if a.config else {}
    values |= {k: json.loads(v) for k, v in (x.split("=", 1) for x in a.set)}
    spark = session()
    store = Store(spark, a.work)
    cfg = Config.of(values)
    store.save_json("config.json", json.loads(cfg.json()))
    print(json.dumps(Linkage(spark, a.data, store, cfg, a.mode, Store(spark, a.trained) if a.trained else None).run(a.stages), indent=1, default=str))


if __name__ == "__main__":
    main()
