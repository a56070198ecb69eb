"""Licence scans: an Aho-Corasick automaton over word sequences, a shunting-yard evaluation of licence expressions.

A text's words, joined by single spaces, run through one automaton that holds all notice phrases and the words of
identifier tags.  A tag's expression (``A OR B AND C WITH d``) is read from the raw line behind it, brought into
postfix order by precedence (WITH over AND over OR, brackets first) and evaluated against a set of allowed licences.
A tag's line may go on behind the expression (a comment's end, code, prose): the expression is the longest start of it
that is well-formed and names licences alone, by ``IDENTIFIER``, ``REFERENCE`` and, behind WITH, ``EXCEPTION``.

Defined results: a null or empty text has no words and no labels; very long texts are scanned whole; a tag without a
well-formed start gives the known identifiers that stand before the first other word, and evaluates to null; several
tags of a text must all be met to be allowed; repeated rows get a row each; an empty table gives no rows; a null id is
kept; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.arrow import batch, by_slices
from kindred.llm.common import table

#: Phrases by their words, and the label each gives.  The first three are the base of the scan.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("isc license", "isc"),
    ("creative commons attribution", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc0", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
TAG = "spdx license identifier"
ALLOWED = frozenset({"mit", "apache-2.0", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc0", "cc-by-4.0", "cc-by"})

_GAPS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACE = bytes.maketrans(_GAPS, b" " * len(_GAPS))
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_POWER = {"OR": 1, "AND": 2, "WITH": 3}
#: Identifiers of the SPDX list by family; references to texts outside of it; names of exceptions.
IDENTIFIER = re.compile(
    r"(?:mit(?:-0|-cmu|-modern-variant)?|isc|zlib|unlicense|wtfpl|ncsa|x11|curl|libpng(?:-2\.0)?|openssl|postgresql|ruby|vim|w3c|beerware|json|sleepycat"
    r"|0bsd|bsd-[1234]-clause(?:-[a-z-]+)?|bsl-1\.0|busl-1\.1|sspl-1\.0|ms-(?:pl|rl)|(?:psf|python|artistic|zpl|ofl|odbl|odc-by|pddl|upl|hpnd|cecill(?:-[bc])?|ecl|nasa|php|qpl|rpl|tcl)(?:-[0-9.]+)?"
    r"|apache(?:-2|-[0-9]+\.[0-9]+)|(?:a|l)?gpl-[0-9]+(?:\.[0-9]+)?(?:-only|-or-later)?|gfdl-[0-9]+\.[0-9]+(?:-only|-or-later)?"
    r"|(?:mpl|epl|eupl|cddl|cpl|afl|osl|lppl|ipl|apsl|cpal|npl|spl)-[0-9]+(?:\.[0-9]+)?[a-z]?(?:-no-copyleft-exception)?|cc0-1\.0|cc-by(?:-nc|-sa|-nd)*-[0-9]\.[0-9](?:-[a-z]+)?)\+?",
    re.IGNORECASE,
)
REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?(?:licenseref|additionref)-[a-z0-9.-]+", re.IGNORECASE)
EXCEPTION = re.compile(r"[a-z0-9.-]*(?:exception|syscall-note)[a-z0-9.-]*", re.IGNORECASE)


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, once A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


def parse(line: str) -> tuple[list[str], str, list[str]]:
    """(postfix order of the expression that the line starts with, its text, licences and exceptions it names).

    Without a well-formed start the order is empty, and the names are those before the first word that is none.

    >>> parse("MIT OR GPL-2.0-only WITH x-exception AND (0BSD OR ISC) */ int main")[0]
    ['MIT', 'GPL-2.0-only', 'x-exception', 'WITH', '0BSD', 'ISC', 'OR', 'AND', 'OR']
    """
    out: list[str] = []
    held: list[str] = []
    names: list[str] = []
    best: tuple[list[str], int, int] = ([], 0, 0)  # order, end in the line, how many names
    open_, after, at = True, "", 0  # whether an operand has to come next, and the last operator
    while m := _TOKEN.match(line, at):
        t, at = m[1], m.end()
        op = t.upper()
        if op in _POWER:
            if open_ or (op == "WITH" and out[-1] in _POWER):  # an exception is granted to a licence
                break
            while held and held[-1] != "(" and _POWER[held[-1]] >= _POWER[op]:
                out.append(held.pop())
            held.append(op)
            open_, after = True, op
            continue
        if t == "(":
            if not open_ or after == "WITH":
                break
            held.append(t)
            after = t
            continue
        if t == ")":
            if open_ or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            known = (EXCEPTION if after == "WITH" else IDENTIFIER).fullmatch(t) or REFERENCE.fullmatch(t)
            if not open_ or not known:
                break
            out.append(t)
            names.append(t.lower())
            open_, after = False, ""
        if "(" not in held:
            best = (out + held[::-1], at, len(names))
    order, end, n = best
    return order, line[:end].strip(), names[:n] if order else names


def evaluate(line: str, allowed: frozenset[str] = ALLOWED) -> tuple[list[str], bool | None, str]:
    """(names, whether the expression can be met by allowed licences alone, None if there is none, its text).

    An exception behind WITH only grants more, so that A WITH x is met where A is.
    """
    order, text, names = parse(line)
    if not order:
        return names, None, ""
    stack: list[bool] = []
    for t in order:
        if t in _POWER:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "WITH" else a and b if t == "AND" else a or b)
        else:
            stack.append(t.lower() in allowed)
    return names, stack[0], text


def automaton(phrases: tuple[tuple[str, str], ...] = BASE + NOTICES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, (p, _) in enumerate(phrases):
        a.add_word(f" {p} ", i)
    a.add_word(f" {TAG} ", -1)
    a.make_automaton()
    return a


def scan_text(a: ahocorasick.Automaton, text: str | None, phrases=BASE + NOTICES, n_base: int = len(BASE)) -> tuple:
    """(n_words, base hits, first, last, base labels, all labels, score, expressions, allowed, spans of (label, first word, words))."""
    w = words(text)
    line = b" ".join([b"", *w, b""]).decode("utf-8", "surrogatepass")
    hits, tags, labels = [], 0, set()
    seen, word = 0, 0
    for end, i in a.iter(line):
        if i < 0:
            tags += 1
            continue
        phrase, label = phrases[i]
        start = end - len(phrase) - 1  # of the space before it
        word += line.count(" ", seen, start) if start >= seen else -line.count(" ", start, seen)
        seen = start
        hits.append((i, word, label, phrase.count(" ") + 1))
        labels.add(label)
    base = [h for h in hits if h[0] < n_base]
    found, allowed = [], None
    if tags:
        for m in _TAG_LINE.finditer(text or ""):
            names, ok, expression = evaluate(m[1])
            labels.update(names)
            if ok is not None:
                found.append(expression)
                allowed = ok if allowed is None else allowed and ok
    n = sum(h[3] for h in hits)
    score = 1.0 if found else 1.0 - 0.75**n  # each word of a phrase adds to the certainty
    return (
        len(w), len(base), min((h[1] for h in base), default=None), max((h[1] for h in base), default=None),
        ",".join(sorted({h[2] for h in base})), ",".join(sorted(labels)), score, found, allowed, [{"label": h[2], "first_word": h[1], "n_words": h[3]} for h in hits],
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, labels, expressions, whether these are allowed, and every span."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, allowed boolean, spans array<struct<label:string,first_word:bigint,n_words:bigint>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_(), span]
    names = [x.split()[0] for x in schema.replace(kind, "id", 1).split(", ")]
    made: list = []

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(automaton())
        rows = [scan_text(made[0], t) for t in b.column(1).to_pylist()]
        out = pa.schema(list(zip(names, [b.column(0).type, *types], strict=True)))
        return batch(out, b.column(0), *zip(*rows, strict=True))

    return by_slices(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), f, schema)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    return d.select(d["id"].alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
