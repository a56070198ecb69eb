"""Raw records to normalised ones, with the resources that are learnt from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions.addresses import ADDRESS_SCHEMA, city_candidate, parse_address
from kindred.functions.names import NAME_SCHEMA, Segmenter, normalize_name
from kindred.functions.translit import Dictionary
from kindred.operators import tokens

INDIC = "[ऀ-෿]"
#: Entries up to which a learnt resource is sent to all tasks.
MOST_ENTRIES = 2_000_000


@dataclass(frozen=True)
class Resources:
    dictionary: Dictionary = Dictionary()
    segmenter: Segmenter = Segmenter()
    cities: dict[str, set] = field(default_factory=dict)

    def as_json(self) -> dict:
        return {"best": self.dictionary.best, "second": self.dictionary.second, "costs": self.segmenter.costs, "unknown": self.segmenter.unknown, "cities": {c: sorted(v) for c, v in self.cities.items()}}

    @classmethod
    def of_json(cls, d: dict) -> Resources:
        return cls(Dictionary(d["best"], d["second"]), Segmenter(d["costs"], d["unknown"]), {c: set(v) for c, v in d["cities"].items()})


def _small(df: DataFrame, count: str, most: int = MOST_ENTRIES) -> list:
    """The entries of a learnt resource.  Of more than ``most``, those stay whose count is at least the smallest one at
    which they fit: one threshold for all, raised as the records grow, because resources are sent to every task."""
    if df.count() > most:
        sizes = df.groupBy(F.col(count).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("c").desc()).collect()  # one row a count
        room, least = most, None
        for r in sizes:
            room -= r["n"]
            if room < 0:
                break
            least = r["c"]
        df = df.filter(F.col(count) >= F.lit(least)) if least is not None else df.limit(0)
    return df.collect()


def fit_dictionary(s1: DataFrame, pool: DataFrame, truth: DataFrame, min_count: int = 2, runner_up_share: float = 0.2) -> Dictionary:
    """Renderings of Indic tokens, from matched names and address components whose token counts agree."""
    indic = pool.filter(F.col("business_name").rlike(INDIC) | F.col("business_address").rlike(INDIC))
    j = truth.join(indic.select(F.col("entity_id").alias("cand"), F.col("business_name").alias("n2"), F.col("business_address").alias("a2")), "cand")
    j = j.join(s1.select(F.col("entity_id").alias("s1"), F.col("business_name").alias("n1"), F.col("business_address").alias("a1")), "s1")
    parts = j.select(F.split("a1", ",").alias("x"), F.split("a2", ",").alias("y")).filter(F.size("x") == F.size("y")).select(F.inline(F.arrays_zip("y", "x"))).select(F.col("y").alias("theirs"), F.col("x").alias("ours"))
    texts = j.select(F.col("n2").alias("theirs"), F.col("n1").alias("ours")).unionByName(parts).filter(F.col("theirs").rlike(INDIC))
    toks = lambda c: F.filter(F.transform(F.split(c, r"\s+"), lambda t: F.regexp_replace(t, r"[!-/:-@\[-`{-~]", "")), lambda t: t != "")
    aligned = tokens.aligned_pairs(texts, toks(F.col("theirs")), F.transform(toks(F.col("ours")), lambda t: F.lower(t))).filter(F.col("a").rlike(INDIC) & ~F.col("b").rlike(INDIC))
    rows = _small(tokens.top_two(aligned, min_count, runner_up_share), "n_best")
    return Dictionary({r["a"]: r["best"] for r in rows}, {r["a"]: r["second"] for r in rows if r["second"]})


def fit_segmenter(s1: DataFrame, pool: DataFrame, min_count: int = 3) -> Segmenter:
    """Word counts of all Latin names that are no domains."""
    names = s1.select("business_name").unionByName(pool.filter(~F.col("business_name").rlike(INDIC) & ~F.contains("business_name", F.lit("."))).select("business_name"))
    return Segmenter.of_counts({r["word"]: r["n"] for r in _small(tokens.word_counts(names, "business_name", min_count), "n")})


def fit_cities(s1: DataFrame, dictionary: Dictionary, min_count: int = 2) -> dict[str, set]:
    @F.pandas_udf("string")
    def city(address: pd.Series, country: pd.Series) -> pd.Series:
        return pd.Series([city_candidate(a, c, dictionary) for a, c in zip(address, country, strict=True)], dtype="object")

    found = s1.select("country", city("business_address", "country").alias("city")).filter("city IS NOT NULL")
    out: dict[str, set] = {}
    for r in _small(tokens.vocabulary(found, ["country", "city"], min_count), "n"):
        out.setdefault(r["country"], set()).add(r["city"])
    return out


def fit(s1: DataFrame, pool: DataFrame, truth: DataFrame | None, cfg: Config = Config()) -> Resources:
    d = fit_dictionary(s1, pool, truth, cfg.translit_min_count, cfg.translit_runner_up_share) if truth is not None else Dictionary()
    return Resources(d, fit_segmenter(s1, pool, cfg.segmenter_min_count), fit_cities(s1, d, cfg.city_min_count))


def extended(r: Resources, s1: DataFrame, cfg: Config = Config()) -> Resources:
    """With the cities of further records added to the known ones."""
    more = fit_cities(s1, r.dictionary, cfg.city_min_count)
    return Resources(r.dictionary, r.segmenter, {c: r.cities.get(c, set()) | more.get(c, set()) for c in {*r.cities, *more}})


def normalize(records: DataFrame, resources: Resources) -> DataFrame:
    """records with the columns of names and addresses; id is the entity id.  One Arrow pass, no shuffle."""
    shared = records.sparkSession.sparkContext.broadcast(resources)
    names = [x.split()[0] for x in f"{NAME_SCHEMA}, {ADDRESS_SCHEMA}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for b in batches:
            made = [{**normalize_name(n, r.dictionary, r.segmenter), **parse_address(a, c, r.cities, r.dictionary)} for n, a, c in zip(b.business_name, b.business_address, b.country, strict=True)]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    d = records.select(F.col("entity_id").alias("id"), "business_name", "business_address", "country", F.col("source").cast("int").alias("source"))
    return d.mapInPandas(run, f"id string, business_name string, business_address string, country string, source int, {NAME_SCHEMA}, {ADDRESS_SCHEMA}")


def retrieval_texts() -> dict[str, Column]:
    """The texts of a normalised record that similarity joins compare: name, name with place, address."""
    return {
        "name": F.concat_ws(" ", F.col("n_core"), F.nullif("n_alt1", F.lit(""))),
        "na": F.trim(F.concat(F.col("n_core"), F.lit(" | "), F.col("a_street"), F.lit(" "), F.col("a_city"))),
        "addr": F.concat_ws(" ", "a_hn", "a_street", "a_city", "a_postcode"),
    }
