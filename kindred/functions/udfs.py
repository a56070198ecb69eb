"""Arrow UDFs of the text functions that expressions cannot state, one pass for all columns of a record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kindred.functions import addresses, names
from kindred.functions import lexicon as lx
from kindred.functions.names import Segmenter
from kindred.functions.translit import Dictionary, script_class


def of_text(f, kind: str = "string"):
    """A column function from a function of one text; equal texts of a batch are worked out once, null gives null."""

    def run(s: pd.Series) -> pd.Series:
        done = {x: f(x) for x in s.dropna().unique()}
        return s.map(lambda x: done.get(x) if x is not None else None)

    return F.pandas_udf(run, kind)


def strip_accents():
    return of_text(lx.without_accents)


def lookup_key():
    return of_text(lx.lookup_key)


def city_key():
    return of_text(addresses.city_key)


def scripts():
    return of_text(script_class, "int")


def latin_tokens():
    return of_text(lambda t: " ".join(names.latin_tokens(t)))


def glue_letters():
    return of_text(lambda t: " ".join(names.glue_letters(t.split())))


def segment(segmenter: Segmenter):
    return of_text(lambda t: " ".join(segmenter.split(t)))


def name_columns(dictionary: Dictionary = Dictionary(), segmenter: Segmenter = Segmenter()):
    """A struct of the 13 columns of a name."""

    def run(s: pd.Series) -> pd.DataFrame:
        done = {x: names.normalize_name(x, dictionary, segmenter) for x in s.unique()}
        return pd.DataFrame([done[x] for x in s], columns=[c.split()[0] for c in names.NAME_SCHEMA.split(", ")])

    return F.pandas_udf(run, names.NAME_SCHEMA)


def address_columns(cities: dict[str, set] | None = None, dictionary: Dictionary = Dictionary()):
    """A struct of the 14 columns of an address, given the address and its country."""

    def run(a: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [addresses.parse_address(x, y, cities, dictionary) for x, y in zip(a, c, strict=True)]
        return pd.DataFrame(rows, columns=[k.split()[0] for k in addresses.ADDRESS_SCHEMA.split(", ")])

    return F.pandas_udf(run, addresses.ADDRESS_SCHEMA)
