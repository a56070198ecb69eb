"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import lexicon as lx


def plain_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[0-9a-z]+"), F.lit(0))


def sorted_key(tokens: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(tokens)), " ")


def digest_key(tokens: Column) -> Column:
    """A key as short for long texts as for names; no tokens, no key."""
    return F.when(F.size(tokens) > 0, F.md5(sorted_key(tokens))).otherwise(F.lit(""))


def core(tokens: Column) -> Column:
    """Tokens without legal forms and stop words, with a fallback that is empty only if there are no tokens."""
    content = F.filter(tokens, lambda t: ~t.isin(*sorted(lx.STOP_TOKENS)))
    bare = F.filter(content, lambda t: ~t.isin(*sorted(lx.LEGAL_TOKENS)))
    return F.when(F.size(bare) > 0, bare).when(F.size(content) > 0, content).otherwise(tokens)


def legal_forms(tokens: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(tokens, lambda t: t.isin(*sorted(lx.LEGAL_TOKENS)))))


def canonical(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in lx.LEGAL_FORM_OF.items() if pair[0] != pair[1] for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def host_base(url: Column) -> Column:
    """The label of a host that its last one or two labels are registered under."""
    return F.regexp_extract(F.lower(url), r"^(?:https?://)?(?:[^/]*\.)?([0-9a-z-]+)\.[a-z]+(?:[/?#:].*)?$", 1)


def char_grams(text: Column, n: int = 3) -> Column:
    """Character n-grams of each word with a space on both sides; a word that fits into one gram gives one.

    White space is that of the SQL (RE2): unlike Java's, a vertical tab is part of a word.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t\n\f\r ]+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        many = F.greatest(F.char_length(padded) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), many), lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(words, grams))


def id_fraction(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone: sampling and folds that any engine repeats."""
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
