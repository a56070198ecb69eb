"""Seeded records of one or more matches, with the noise that linkage has to see through."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = "ba be bi bo bu da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi vo za ze zo".split()
TRADES = "energy foods motors textiles medical systems logistics traders printing travels dental realty solar fitness bakery".split()
FORMS = (("Private Limited", "Pvt Ltd", "Pvt. Ltd."), ("Limited", "Ltd"), ("LLC", "L.L.C."), ("Incorporated", "Inc", "Inc."), ("Corporation", "Corp"), ("",))
STREETS = (("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Drive", "Dr"), ("Lane", "Ln"))
PLACES = {
    "US": (("Euclid", "OH"), ("Peoria", "IL"), ("Columbus", "OH"), ("Austin", "TX"), ("Salem", "OR"), ("Tampa", "FL")),
    "India": (("Lucknow", "Uttar Pradesh"), ("Bangalore", "Karnataka"), ("Pune", "Maharashtra"), ("Jaipur", "Rajasthan"), ("Patna", "Bihar")),
}
#: Weights of 0, 1, 2, ... matches of a record.
MATCHES = (5.6, 5.4, 17.0, 24.0, 22.0, 14.6, 7.5, 2.9, 0.9, 0.2)


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))


def _typo(r: random.Random, s: str) -> str:
    if len(s) < 4:
        return s
    i = r.randrange(1, len(s) - 1)
    return r.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + r.choice("aeiou") + s[i:]])


def entity(i: int, seed: int, kind: str) -> tuple[list[tuple], list[str]]:
    """(rows of (source, id, name, address, country), ids of the matches of the first row)"""
    r = random.Random(f"{seed}:{kind}:{i}")
    country = "US" if r.random() < 0.6 else "India"
    core = [_word(r) for _ in range(r.randint(1, 2))] + ([r.choice(TRADES)] if r.random() < 0.7 else [])
    form, (street, short), (city, state) = r.choice(FORMS), r.choice(STREETS), r.choice(PLACES[country])
    number, road = r.randint(1, 9999), _word(r).title()

    def name(noise: bool) -> str:
        words = list(core)
        if noise:
            x = r.random()
            if x < 0.15:
                words[0] = _typo(r, words[0])
            elif x < 0.25 and len(words) > 1:
                words = words[::-1]
            elif x < 0.32:
                return "".join(words) + ".com"
            elif x < 0.38:
                words[0] = words[0].replace("o", "0", 1)
            elif x < 0.42:
                return f"-- {' '.join(words).upper()} {r.choice(form)} **".strip()
            elif x < 0.46:
                return f"{_word(r).title()} dba {' '.join(words).title()} {r.choice(form)}".strip()
        return f"{' '.join(words).title()} {r.choice(form) if noise else form[0]}".strip()

    def address(noise: bool) -> str:
        if noise and r.random() < 0.08:
            return "null"
        parts = [f"{number} {road} {short if noise and r.random() < 0.5 else street}", city, state]
        if noise and r.random() < 0.2:
            parts = parts[1:] + parts[:1]
        if noise and r.random() < 0.1:
            parts[0] = parts[0].upper()
        return ", ".join(parts)

    rows = [(1, f"S1-{kind}{i}", name(False), address(False), country)]
    matched = []
    for k in range(r.choices(range(len(MATCHES)), MATCHES)[0]):
        s = r.choice((2, 3))
        matched.append(f"S{s}-{kind}{i}x{k}")
        rows.append((s, matched[-1], name(True), address(True), country))
    if r.random() < 0.3:  # a record like this one that belongs to nobody
        core[0] = _word(r)
        rows.append((2, f"S2-{kind}{i}z", name(True), address(True), country))
    return rows, matched


def generate(spark: SparkSession, n: int, seed: int = 3, kind: str = "a") -> tuple[DataFrame, DataFrame]:
    """(records with source, truth with s1 and ids); entities are made apart, so any number of tasks gives the same rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b.id:
                rows, matched = entity(int(i), seed, kind)
                out += [(*row, matched if row[0] == 1 else None) for row in rows]
            yield pd.DataFrame(out, columns=["source", "entity_id", "business_name", "business_address", "country", "ids"])

    every = spark.range(n).mapInPandas(run, "source int, entity_id string, business_name string, business_address string, country string, ids array<string>")
    return every.drop("ids"), every.filter("source = 1").select(F.col("entity_id").alias("s1"), "ids")


def write_dataset(spark: SparkSession, folder: str, split: str, n: int, seed: int = 3, with_truth: bool = True) -> None:
    """The layout that ``kindred.sources.tsv.read_split`` reads."""
    records, truth = generate(spark, n, seed, split)
    out = lambda d, name: d.write.mode("overwrite").options(header=True, sep="\t", quote="", emptyValue="").csv(f"{folder}/{split}_{name}.tsv")
    for s in (1, 2, 3):
        out(records.filter(F.col("source") == s).drop("source"), f"source{s}")
    if with_truth:
        out(truth.select(F.col("s1").alias("source1_entity_id"), F.array_join("ids", ",").alias("matched_entity_ids")), "ground_truth")
