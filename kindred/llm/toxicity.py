"""Toxicity by a counterfactually regularised classifier.

A logistic model on which words, and which beginnings of words, occur in a text: beginnings let it know an insult's
other forms.  In every labelled text that names a group, the group's name is swapped for
another of its kind, and the squared change of the score before the link is penalised, by the word and by its beginnings: the model may not read toxicity
from a neutral mention of a group, so weights of names in one kind are drawn together and towards what their use bears.

The fit reads at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id, and at most
``MAX_FEATURES`` words, those that tell the classes apart best; both bounds are parameters.  Only these bounded
counts and word lists reach the driver.  Scoring reads whole texts, in one pass without a shuffle.

Defined results: a null or empty text has no words and gets the intercept's score; null labels are not learnt from;
of several labels of one id the largest counts; equal texts are learnt from once; without labels, or with one class
alone, the score is the rate of label 1 (0 without labels); a null id is scored and hashed like the empty string;
repeated rows are scored each; an empty table gives no rows.  Extra columns are kept by ``score`` and never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.arrow import by_slices
from kindred.llm.common import ALNUM_WORD, ascii_lower, table, tidy, words_of, written
from kindred.llm.licenses import words

MAX_TRAIN = 20_000
MAX_FEATURES = 4_096
MIN_DF = 5
PREFIXES = (4, 5, 6)
#: Names of groups by kind; swaps stay within a kind.
IDENTITY = {
    "gender": ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    "woman": ("woman", "man", "girl", "boy"),
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    "believers": ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    "origin": ("african", "asian", "european", "american", "arab", "hispanic", "latino", "indigenous"),
    "peoples": ("africans", "asians", "europeans", "americans", "arabs", "hispanics", "latinos"),
    "colour": ("black", "white", "brown"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    "ability": ("deaf", "blind", "disabled", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
    "status": ("immigrants", "refugees", "foreigners", "citizens", "migrants"),
}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def logit(self, text: str | None) -> float:
        w = self.weights
        # summed in a fixed order, so that a score does not depend on the order of a set
        return self.bias + sum(sorted(w[x] for x in w.keys() & features(text)))


def features(text: str | None) -> set[str]:
    """The words, and as ``abcd*`` the beginnings of PREFIXES characters of longer words."""
    found = {w.decode("utf-8", "surrogatepass") for w in set(words(text))}  # cut where the fit cuts: U+00A0 is no gap
    return found.union(*map(beginnings, found))


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


def with_starts(found: DataFrame) -> DataFrame:
    """found with the beginnings of its words in w as well: the column's ``features``."""

    def starts(n: int) -> Column:
        # lambdas of one parameter: a second one would be given the index
        return F.transform(F.filter("w", lambda x: F.char_length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))

    return found.withColumn("w", F.array_distinct(F.concat("w", *[starts(n) for n in PREFIXES])))


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _dot(ptr: np.ndarray, idx: np.ndarray, w: np.ndarray) -> np.ndarray:
    s = np.concatenate(([0.0], np.cumsum(w[idx])))
    return s[ptr[1:]] - s[ptr[:-1]]


def swapped(found: list[str], other: dict[str, str]) -> list[tuple[list[str], list[str]]]:
    """(what goes, what comes) among the ``features`` of a text when a name in it, each in turn, is replaced by its other."""
    own = set(found)
    names = own & other.keys()
    if not names:
        return []
    at_stake = {s for x in names for s in beginnings(x)}
    held = Counter(s for x in own if not x.endswith("*") and x[: PREFIXES[0]] + "*" in at_stake for s in beginnings(x))
    out = []
    for x in sorted(names):
        y = other[x]
        gone = [x, *(s for s in beginnings(x) if held[s] == 1 and s not in beginnings(y))]
        out.append((gone, [s for s in (y, *beginnings(y)) if s not in own]))
    return out


def fit_rows(rows: list[list[int]], y: np.ndarray, n: int, swaps: list[tuple[list[int], list[int], int]], l2: float = 1.0, fair: float = 20.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + l2/2 |w|^2 + fair/2 * the swaps' squared changes of the logit.

    rows: feature ids of each text; swaps: (ids that go, ids that come, how many labelled mentions do so).  Newton
    steps take the diagonal of the curvature, damped by momentum.
    """
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    idx = np.fromiter((i for r in rows for i in r), np.int64, int(ptr[-1]))
    row = np.repeat(np.arange(len(rows)), np.diff(ptr))
    swap = np.fromiter((k for k, (gone, come, _) in enumerate(swaps) for _ in (*gone, *come)), np.int64)
    moved = np.fromiter((i for gone, come, _ in swaps for i in (*gone, *come)), np.int64)
    sign = np.fromiter((x for gone, come, _ in swaps for x in (*[1.0] * len(gone), *[-1.0] * len(come))), float)
    times = np.array([t for _, _, t in swaps], float)
    w, bias = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m1, m2, mb1, mb2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_dot(ptr, idx, w) + bias, -30, 30)))
        e = p - y
        g = np.bincount(idx, weights=e[row], minlength=n) + l2 * w
        if len(swaps):
            change = fair * times * np.bincount(swap, weights=sign * w[moved], minlength=len(swaps))
            g += np.bincount(moved, weights=sign * change[swap], minlength=n)
        gb = e.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb1 / (1 - 0.9**t)) / (np.sqrt(mb2 / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


@tidy
def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, fair: float = 20.0) -> Model:
    """Learns from the labelled rows given; what is to be held out, the caller leaves out of labels."""
    marks = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_train)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(marks), "k")  # at most max_train rows
    found = with_starts(texts.select("y", F.array_distinct(words_of(ascii_lower(F.col("t")), ALNUM_WORD)).alias("w")))
    found = found.groupBy(F.xxhash64("w").alias("k")).agg(F.max("y").alias("y"), F.first("w").alias("w"))
    found = written(found, "toxicity-train")
    n, pos = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n == 0 or pos in (0, n):
        rate = min(max(pos / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model({}, float(np.log(rate / (1 - rate))))
    each = found.select("y", F.explode("w").alias("word"))
    # signed root of the likelihood ratio is what ranks words: sure and frequent signs come first
    df = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("dp")).filter(F.col("df") >= min_df)
    z = F.abs(F.col("dp") - F.col("df") * (pos / n)) / F.sqrt(F.col("df") * (pos / n) * (1 - pos / n))
    vocab = [r["word"] for r in df.orderBy(z.desc(), "word").limit(max_features).collect()]
    place = {w: i for i, w in enumerate(dict.fromkeys([*vocab, *(x for k in IDENTITY.values() for x in k)]))}
    names = docs.sparkSession.createDataFrame(list(place.items()), "word string, i int")
    coded = found.select("k", "y", F.explode("w").alias("word")).join(F.broadcast(names), "word").groupBy("k", "y").agg(F.sort_array(F.collect_list("i")).alias("i"))
    rows = sorted((r["k"], r["y"], r["i"]) for r in coded.collect())
    bare = found.select("k", "y").join(coded.select("k"), "k", "left_anti").groupBy("y").count().collect()  # texts without any of these words
    y = np.array([r[1] for r in rows] + [r["y"] for r in bare for _ in range(r["count"])], float)
    ids = [r[2] for r in rows] + [[] for r in bare for _ in range(r["count"])]
    other = {x: k[(j + 1) % len(k)] for k in IDENTITY.values() for j, x in enumerate(k)}

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = Counter()
            for w in b.column(0).to_pylist():
                total.update(tuple(tuple(sorted(place[x] for x in side if x in place)) for side in both) for both in swapped(w, other))
            sides = [pa.array([s[k] for s in total], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*sides, pa.array([*total.values()], pa.int64())], names=["gone", "come", "c"])

    mentions = found.select("w").mapInArrow(changes, "gone array<int>, come array<int>, c long").groupBy("gone", "come").agg(F.sum("c").alias("c"))  # a few for each name
    swaps = sorted((r["gone"], r["come"], r["c"]) for r in mentions.collect())
    w, bias = fit_rows(ids, y, len(place), swaps, fair=fair)
    return Model({x: float(w[i]) for x, i in place.items() if abs(w[i]) > 1e-6}, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score as last column; a column that has its name already is replaced."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([model.logit(t) for t in b.column(at).to_pylist()])
        s = pa.array(1 / (1 + np.exp(-np.clip(x, -40, 40))))
        return pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, score_col])

    return by_slices(docs, f, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
