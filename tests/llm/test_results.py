"""Results against SQL where it can express them, and against brute force where it cannot."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import decontamination, licenses, mixing, quality_rules, registry, sharding, simhash, suffix_dedup, suffix_tree, toxicity, warc
from kindred.llm.common import ALNUM_WORD, ascii_lower, table, words_of
from kindred.llm.components import components
from tests.oracle import same_rows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLE_SQL[name])


def linked(ids, near):
    """The smallest id that each id can reach."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text, n, seed=42):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) > n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), h


def test_simhash(spark, sf, docs):
    fp = {i: brute_fingerprint(t, 3)[0] for i, t in docs.items()}
    ids = sorted(docs)
    want = linked(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = registry.QUERIES["op1_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 8))
@settings(max_examples=40, deadline=None)
def test_tiles_find_all_pairs(values, radius):
    f = np.array(sorted(values, key=int.bit_count), np.uint64)[:, None]
    key = np.bitwise_count(f).astype(np.int64)[:, 0]
    got = {(int(a), int(b)) for x, y, _ in simhash.compare(f, f, key, key, key - radius, key + radius, radius) for a, b in zip(x, y, strict=True)}
    v = f[:, 0].tolist()
    assert got == {(i, j) for i in range(len(v)) for j in range(len(v)) if (v[i] ^ v[j]).bit_count() <= radius}


def test_small_blocks_give_the_same(spark, sf, monkeypatch):
    d = table(spark, sf, "documents")
    for args in ({}, {"shingle": 5, "radius": 52, "lanes": 4}, {"shingle": 5, "radius": 52, "lanes": 4, "sure": 20, "similarity": 0.8}):
        want = {r["id"]: r["component"] for r in simhash.near_duplicates(d, **args).collect()}
        with monkeypatch.context() as m:
            m.setattr(simhash, "BLOCK", 3)
            m.setattr(simhash, "MOST_BLOCK", 3)
            m.setattr(simhash, "STRIPE", 2)
            m.setattr(simhash, "PART", 2)
            assert {r["id"]: r["component"] for r in simhash.near_duplicates(d, **args).collect()} == want


def plain_jaccard(rows, shingle=5, similarity=0.8):
    """Component of each id, from all pairs of shingle sets, without fingerprints or bounds."""
    sets = {i: {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if (w := t.lower().split()) else set() for i, t in rows}
    ids = sorted(sets)
    return linked(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])])


def keep_one_keeps(spark, rows):
    return {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_copies_are_not_lost(spark):
    """A line stated some times more, and texts of a few words: what plain Jaccard links, the stage links."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    rows = []
    for i in range(0, 60, 2):
        line, own = words(14), words(190 + 4 * i)
        rows += [(i, f"{own} {line}"), (i + 1, f"{own} {line}" + f" {line}" * (3 + i % 4))]
    for i in range(100, 220, 2):
        t = words(8 + i % 3)
        rows += [(i, t), (i + 1, f"{t} {words(1)}")]
    rows += [(300 + i, t) for i, t in enumerate(("", "  ", "a", "a b", "a b c d e", "a b c d e f"))]
    want = plain_jaccard(rows)
    assert sum(want[i] == i for i, _ in rows) < len(rows) - 60
    assert keep_one_keeps(spark, rows) == {i for i in want if want[i] == i}


def test_shared_boilerplate_is_no_near_copy(spark):
    """One line stated often on either side brings fingerprints together, not shingle sets."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = words(14)
    rows = [(i, words(150) + f" {line}" * 40) for i in range(12)] + [(20 + i, words(40) + f" {line}" * 20) for i in range(12)]
    assert set(plain_jaccard(rows).values()) == {i for i, _ in rows}
    assert keep_one_keeps(spark, rows) == {i for i, _ in rows}
    # a chain within SURE bits of one another, and of the first, is judged text by text
    base = words(400).split()
    rows = [(i, " ".join(base[9 * i : 9 * i + 300])) for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.near_duplicates(d, shingle=5, radius=simhash.RADIUS, lanes=4, sure=256, similarity=0.99).collect()}
    assert got == plain_jaccard(rows, similarity=0.99) == {i: i for i, _ in rows}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = linked({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    assert got == want


def test_toxicity_held_out(spark):
    """Held-out accuracy, and group names that weigh alike."""
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op3_toxicity"](spark, d).collect()
    mark = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], r["predicted"], mark[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in mark]
    assert np.mean([p == y for _, p, y in held]) > 0.95
    pos, neg = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.96


def test_fit_learns_the_features_that_are_scored(spark):
    """The beginnings of all words of a text, at their own lengths."""
    gaps = "aaaaa\u00a0bbbbbb\u3000ccccccc\u0085dddddddd eeeee"
    assert set(toxicity.with_starts(spark.createDataFrame([(gaps,)], "t string").select(F.array_distinct(words_of(ascii_lower(F.col("t")), ALNUM_WORD)).alias("w"))).first()["w"]) == toxicity.features(gaps)
    text = " ".join(f"{x}ingness{i}" for i, x in enumerate(("alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "November", "été"))) + " four fiver sixsix"
    got = toxicity.with_starts(spark.createDataFrame([(text,)], "t string").select(F.array_distinct(words_of(ascii_lower(F.col("t")), ALNUM_WORD)).alias("w"))).first()["w"]
    assert set(got) == toxicity.features(text) and len(got) == len(set(got))
    rows = [(i, f"{' '.join(f'pad{i % 9}x{k}' for k in range(12))} {'rottenness' if i % 2 else 'pleasantry'}") for i in range(60)]
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert m.logit("rottenest") > 0 > m.logit("pleasantly")  # forms never seen, named after the tenth word


def test_swapped_names_score_alike(spark):
    """In these labels toxic texts name one group and clean ones another; the penalty keeps that out of the score."""
    rows = [(i, f"{'muslims' if i % 2 else 'christians'} {'awful scum' if i % 2 else 'kind folk'} filler{i % 7} text") for i in range(200)]
    rows += [(200 + i, f"{'awful scum' if i % 2 else 'kind folk'} filler{i % 7} text") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    gap = lambda m: abs(m.logit("muslims filler1") - m.logit("christians filler1"))
    free, fair = toxicity.fit(d, y, fair=0.0), toxicity.fit(d, y, fair=20.0)
    assert gap(fair) < 0.2 * gap(free) and fair.logit("awful scum") > 0 > fair.logit("kind folk")


def test_swaps_change_whole_feature_sets(spark):
    """What a swap is penalised for is what it changes of a text's features, beginnings included."""
    other = {x: k[(j + 1) % len(k)] for k in toxicity.IDENTITY.values() for j, x in enumerate(k)}
    for text in ("muslims filler text", "the muslims and muslim folk", "immigrants met immigration refugees", "old man and young girl", "american africans african americana", "nobody named"):
        want = []
        for x in sorted(set(text.split()) & other.keys()):
            after = toxicity.features(" ".join(other[x] if w == x else w for w in text.split()))
            want.append((toxicity.features(text) - after, after - toxicity.features(text)))
        assert [(set(a), set(b)) for a, b in toxicity.swapped(sorted(toxicity.features(text)), other)] == want
    # all weight can flow to beginnings: the fit must close the gap of the whole swap, not of the word alone
    ids = {x: i for i, x in enumerate(sorted(toxicity.features("muslims christians scum folk")))}
    texts = [("muslims scum", 1), ("christians folk", 0)] * 100 + [("scum", 1), ("folk", 0)] * 50
    rows = [sorted(ids[x] for x in toxicity.features(t)) for t, _ in texts]
    moves = Counter(tuple(tuple(ids[x] for x in side if x in ids) for side in both) for t, _ in texts for both in toxicity.swapped(sorted(toxicity.features(t)), {"muslims": "christians", "christians": "muslims"}))
    gap = {}
    for fair in (0.0, 20.0):
        w, _ = toxicity.fit_rows(rows, np.array([y for _, y in texts], float), len(ids), [(list(a), list(b), c) for (a, b), c in moves.items()], fair=fair)
        gap[fair] = abs(sum(w[ids[x]] for x in toxicity.features("muslims")) - sum(w[ids[x]] for x in toxicity.features("christians")))
    assert gap[20.0] < 0.2 * gap[0.0]


def test_quality_ablations(spark, sf):
    led = quality_rules.ledger(table(spark, sf, "documents"))
    bits = [r["fail_bits"] for r in led.collect()]
    byname = {r.name: 1 << r.bit for r in quality_rules.RULES}
    for r in quality_rules.ablations(led).collect():
        p = quality_rules.POLICIES[r["policy"]]
        m, b = quality_rules.mask(p), byname[r["rule"]]
        assert (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) == (sum(x & b > 0 for x in bits), sum(x & m == b for x in bits), sum(x & m == 0 for x in bits), sum(x & m & ~b == 0 for x in bits))


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, gone in zip(b, mark, strict=True) if not gone)
        out[i] = (len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, sf, docs, hot):
    got = suffix_dedup.removed(table(spark, sf, "documents"), hot=hot).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(docs)


def test_suffix_dedup_across_tasks(spark):
    """Many small tasks, low-entropy texts, copies and shared passages."""
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("ab "), 400)) for _ in range(6)]
    texts = {}
    for i in range(80):
        t = base[i % 6]
        k = int(rng.integers(0, 300))
        texts[i] = t[:k] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 40)))) + t[k:] if i % 3 else "ab" * int(rng.integers(10, 200)) + t[k:]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(16)
    for hot in (2000, 2):
        got = suffix_dedup.removed(df, hot=hot).collect()
        assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(texts)


def test_suffix_dedup_of_any_ids(spark, monkeypatch):
    """Ids that are strings, null or there twice are numbered in ranges; colliding hashes change nothing."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = words(30)
    texts = {f"k{i:03}": f"{words(int(rng.integers(0, 20)))} {shared if i % 3 else ''} {words(5)}" for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5)
    got = lambda d: {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removed(d).collect()}
    assert got(df) == brute_repeats(texts)
    rows = [(1, shared), (1, shared), (1, f"{shared} x"), (None, shared), (0, "short"), (None, None)]
    out = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    n = len(shared)
    assert sorted((str(r["id"]), r["n_removed"]) for r in out if r["id"] != 1) == [("0", 0), ("None", 0), ("None", n)]
    assert sorted(r["n_removed"] for r in out if r["id"] == 1) == [0, n, n]


def test_suffix_dedup_with_colliding_hashes(spark, sf, tmp_path):
    """With a polynomial hash of four bits the whole operator still gives what the bytes say."""
    import os
    import subprocess
    import sys

    code = """
import sys
import numpy as np
from kindred.llm import suffix_dedup
from kindred.session import session
from tests.llm.test_results import brute_repeats
import inspect, re, types
src = inspect.getsource(suffix_dedup).replace("return h ^ (h >> np.uint64(29))", "return (h ^ (h >> np.uint64(29))) & np.uint64(15)")
weak = types.ModuleType("weak")
sys.modules["weak"] = weak  # not importable by name in a worker: its functions travel by value
import cloudpickle
exec(compile(src, "weak", "exec"), weak.__dict__)
from pyspark import cloudpickle as cp
cp.register_pickle_by_value(weak)
spark = session("weak", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"})
rng = np.random.default_rng(5)
base = ["".join(rng.choice(list("abc "), 260)) for _ in range(3)]
texts = {i: base[i % 3][: 120 + 10 * i] + "".join(rng.choice(list("xyz"), 30)) for i in range(12)}
got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in weak.removed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
assert got == brute_repeats(texts), got
"""
    code = code.replace("import cloudpickle\n", "")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={**os.environ, "PYTHONPATH": root})


@given(st.text(alphabet="ab", min_size=1, max_size=120), st.integers(1, 12))
@settings(max_examples=40, deadline=None)
def test_suffix_sort(text, most):
    buf = np.frombuffer((text + "\0" * most).encode(), np.uint8)
    starts = np.arange(len(text))
    bucket = np.sort(starts % 3)
    order = suffix_dedup.suffix_sort(buf, suffix_dedup.Prefix(buf), starts, bucket, most)
    raw = buf.tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (bucket[i], raw[starts[i] : starts[i] + most], i))


def test_collisions_are_verified(monkeypatch):
    """With a hash that is always equal, the bytes decide."""
    monkeypatch.setattr(suffix_dedup.Prefix, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    text = b"abcdabceabcd"
    buf = np.frombuffer(text + b"\0\0\0\0", np.uint8)
    got = suffix_dedup.repeats(buf, np.arange(len(text)), np.zeros(len(text), np.int64), 4)
    seen, want = set(), []
    for i in range(len(text)):
        s = buf[i : i + 4].tobytes()
        want.append(s in seen)
        seen.add(s)
    assert got.tolist() == want


def test_licenses(spark, sf, docs):
    for r in registry.QUERIES["op8_licenses"](spark, sf).collect():
        w = [x.decode() for x in WORD.findall(docs[r["doc_id"]].encode().lower())]
        hits = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + phrase.count(" ") + 1] == phrase.split())
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def plain_labels(text):
    """Labels and score by a plain reading: phrases word by word, tags by trying each start of their line, longest first."""
    w = [x.decode() for x in WORD.findall((text or "").encode().lower())]
    found = [(label, len(p.split())) for p, label in licenses.BASE + licenses.NOTICES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, valid, tagged = {x for x, _ in found}, False, False
    licence = lambda t: bool(licenses.IDENTIFIER.fullmatch(t) or licenses.REFERENCE.fullmatch(t))
    for line in re.findall(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)", text or ""):
        toks = []
        for part in re.findall(r"[ \t]*(?:\(|\)|[A-Za-z0-9.+:-]+)|.", line):
            if not re.fullmatch(r"\(|\)|[A-Za-z0-9.+:-]+", part.strip(" \t")):
                break
            toks.append(part.strip(" \t"))

        def whole(t):  # OR over AND over WITH, by recursion
            for op in ("OR", "AND"):
                depth = 0
                for i in range(len(t) - 1, -1, -1):
                    depth += (t[i] == ")") - (t[i] == "(")
                    if depth == 0 and t[i].upper() == op:
                        return whole(t[:i]) and whole(t[i + 1 :])
            if len(t) == 3 and t[1].upper() == "WITH":
                return licence(t[0]) and bool(licenses.EXCEPTION.fullmatch(t[2]) or licenses.REFERENCE.fullmatch(t[2]))
            if len(t) > 2 and t[0] == "(" and t[-1] == ")":
                return whole(t[1:-1])
            return len(t) == 1 and licence(t[0])

        n = next((n for n in range(len(toks), 0, -1) if toks[:n].count("(") == toks[:n].count(")") and whole(toks[:n])), 0)
        if n:
            valid = True
            labels |= {t.lower() for t in toks[:n] if t not in "()" and t.upper() not in ("OR", "AND", "WITH")}
        else:
            tagged = True  # malformed: at most known names
    return labels, 1.0 if valid else 1.0 - 0.75 ** sum(n for _, n in found), tagged


TAGGED = (
    "SPDX-License-Identifier: MIT */ int main() { return 0; }",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC; see LICENSE for the rest",
    "// spdx-license-identifier: gpl-2.0-only with linux-syscall-note or bsd-3-clause and then some prose",
    "SPDX-License-Identifier: MIT and the text goes on",
    "SPDX-License-Identifier: LicenseRef-Own-1 AND DocumentRef-a:LicenseRef-b this is code",
    "SPDX-License-Identifier: GPL-3.0-or-later\nSPDX-License-Identifier: ISC\tunder the mit license",
    "SPDX-License-Identifier: ((MIT)) OR (Zlib AND (0BSD OR X11)) extra ) words (",
    "SPDX-License-Identifier: MIT WITH Apache-2.0 AND CC-BY-4.0",
    "SPDX-License-Identifier: Apache-2.0 OR",
    "spdx license identifier MIT without its colon, cc by nc",
    "no tag at all, all rights reserved",
    "",
    None,
)


def test_labels_and_scores(spark, docs):
    """Text behind an expression on its line gives no labels."""
    a = licenses.automaton()
    for text in (*TAGGED, *docs.values()):
        labels, score, malformed = plain_labels(text)
        r = licenses.scan_text(a, text)
        assert not malformed and set(filter(None, r[5].split(","))) == labels and r[6] == pytest.approx(score)
    of = lambda t: licenses.scan_text(a, t)[5]
    assert of(TAGGED[0]) == "mit" and of(TAGGED[3]) == "mit" and of(TAGGED[4]) == "documentref-a:licenseref-b,licenseref-own-1"
    for bad, names in (("int main", ""), ("(MIT OR foo", "mit"), ("OR MIT", ""), ("see the file", ""), ("", "")):
        assert (of(f"SPDX-License-Identifier: {bad}"), licenses.evaluate(bad)[1]) == (names, None)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TAGGED)], "doc_id long, text string")
    got = {r["id"]: (r["labels"], r["score"], r["allowed"]) for r in licenses.scan(rows).collect()}
    assert got == {i: (x[5], x[6], x[8]) for i, x in enumerate(licenses.scan_text(a, t) for t in TAGGED)}


def test_licence_expressions():
    say = lambda e: licenses.evaluate(e)[:2]
    assert say("MIT OR GPL-3.0") == (["mit", "gpl-3.0"], True)
    assert say("MIT AND GPL-3.0")[1] is False
    assert say("GPL-3.0 AND (MIT OR ISC)")[1] is False and say("(GPL-3.0 OR MIT) AND ISC")[1] is True
    assert say("Apache-2.0 WITH LLVM-exception")[1] is True
    for bad in ("", "(MIT", "AND MIT", "()", "WITH x-exception"):
        assert say(bad)[1] is None
    for longer in ("MIT OR", "MIT)", "MIT ISC", "MIT AND (ISC", "MIT WITH ISC"):
        assert say(longer) == (["mit"], True)
    r = licenses.scan_text(licenses.automaton(), "# SPDX-License-Identifier: MIT OR GPL-2.0-only\nUnder the MIT License, cc by-nc")
    assert r[5] == "cc-by-nc,gpl-2.0-only,mit" and r[6] == 1.0 and r[7] == ["MIT OR GPL-2.0-only"] and r[8] is True


def test_archives():
    records = [warc.record(i, f"http://x/{i}", f"<p>page {i}</p>".encode() * 40, hashlib.sha1(b"x").hexdigest(), "response", None) for i in range(60)]
    packed = warc.pack(records)
    assert int.from_bytes(packed[:4], "little") == warc.MAGIC and list(warc.unpack(packed)) == records
    assert list(warc.unpack(warc.pack(records[:2]))) == records[:2] and len(packed) < sum(map(len, records)) / 3
    with pytest.raises(ValueError):
        list(warc.unpack(packed[:-3]))


def test_many_archives(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "BUFFER", 4000)
    want = {r["page_id"]: hashlib.sha1(r["html"].encode()).hexdigest() for r in table(spark, sf, "pages").collect()}
    assert {r["page_id"]: r["payload_digest"] for r in warc.round_trip(table(spark, sf, "pages")).collect()} == want


def plain_tree(texts, learn, depth=suffix_tree.DEPTH, min_count=suffix_tree.MIN_COUNT, penalty=suffix_tree.PENALTY, d=suffix_tree.DISCOUNT):
    """Scores by the definitions, from plain counts of all contexts: (base, score) of each text, the states, p(next word behind a context)."""
    toks = [suffix_tree.tokens(t) for t in texts]
    train = [t for t, own in zip(toks, learn, strict=True) if own]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    follow: dict = {}
    for t in train:
        for i in range(len(t)):
            for k in range(min(depth, i) + 1):
                follow.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
    size = {s: sum(c.values()) for s, c in follow.items()}
    states = {}
    for s, c in follow.items():
        if s and size[s] >= min_count:
            up = follow[s[1:]]
            gain = sum(k * round(math.log(k / size[s] * (size[s[1:]] / up[w])) * suffix_tree.GAIN) for w, k in c.items())
            if gain > penalty * suffix_tree.GAIN * (len(c) - 1) if len(c) > 1 else len(up) > 1:
                states[s] = c

    def prob(ctx, w):
        while ctx and ctx not in states:
            ctx = ctx[1:]
        if not ctx:
            return (uni[w] + 0.1) / (n + 0.1 * (v + 1))
        c = states[ctx]
        return (max(c[w] - d, 0) + d * len(c) * prob(ctx[1:], w)) / size[ctx]

    base = [sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in toks]
    own = [sum(math.log10(prob(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(len(t))) for t in toks]
    return base, own, states, prob, uni


def test_suffix_tree(spark, sf, docs):
    ids = sorted(docs)
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i in ids]
    base, own, states, prob, uni = plain_tree([docs[i] for i in ids], learn)
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_suffix_tree"](spark, sf).collect()}
    toks = [suffix_tree.tokens(docs[i]) for i in ids]
    for i, t, b, s, l in zip(ids, toks, base, own, learn, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not l, len(t), sum(w in uni for w in t), sum(uni.values()))
        assert r["base_score"] == pytest.approx(b, rel=1e-9) and r["score"] == pytest.approx(s, rel=1e-9)
    # the tree is deep, grows with the corpus, and every state's distribution sums to one
    assert {len(s) for s in states} == set(range(1, suffix_tree.DEPTH + 1))
    half = plain_tree([docs[i] for i in ids[: len(ids) // 2]], learn[: len(ids) // 2])[2]
    assert len(half) < 0.7 * len(states)
    for s in sorted(states, key=lambda s: (-sum(states[s].values()), s))[:20]:
        unknown = 0.1 / (sum(uni.values()) + 0.1 * (len(uni) + 1))
        rest = prob(s, b"no such word")
        assert sum(prob(s, w) for w in uni) + rest == pytest.approx(1) and rest <= unknown
    held = [k for k, l in enumerate(learn) if not l]
    assert sum(own[k] for k in held) > sum(base[k] for k in held)


@pytest.mark.parametrize(("depth", "min_count"), [(1, 2), (2, 3), (4, 2), (8, 2)])
def test_suffix_tree_in_small_blocks(spark, depth, min_count):
    """Few words and many repeats, cut into many blocks: what is asked for and what is inferred agree with plain counts."""
    rng = np.random.default_rng(depth)
    phrase = [" ".join(rng.choice(list("abcde"), 9)) for _ in range(4)]
    texts = [" ".join([*rng.choice(list("abcdefg"), rng.integers(0, 12)), *(phrase[int(rng.integers(0, 4))] for _ in range(rng.integers(0, 3)))]) for _ in range(60)] + ["", None, phrase[0], phrase[0]]
    learn = [i % 5 != 0 for i in range(len(texts))]
    base, own, *_ = plain_tree(texts, learn, depth, min_count)
    d = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(zip(texts, learn, strict=True))], "doc_id long, text string, l boolean").repartition(3)
    got = {r["id"]: (r["base_score"], r["score"]) for r in suffix_tree.score(d, train=F.col("l"), depth=depth, min_count=min_count, block_bytes=200).collect()}
    assert got == {i: (pytest.approx(b), pytest.approx(s)) for i, (b, s) in enumerate(zip(base, own, strict=True))}


def test_blocks_hash_only_what_they_ask_for(monkeypatch):
    """Copied texts determine their next words early: longer sequences are hashed at few places, and what came packed is not packed again."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    copied = " ".join(f"w{k}" for k in rng.permutation(300))
    texts = pa.array([*[copied] * 6, " ".join(rng.choice(list("abc"), 200)), None, ""])
    block, words = suffix_tree.Block.of_texts(texts, np.array([True] * 8 + [False]))
    assert len(words) == len(set(words)) == 304 and words[0] == suffix_tree.END and [xxhash.xxh64_intdigest(w) for w in words] == block.hashes.tolist()
    block.counts = block.word_counts()
    hashed, plain = Counter(), suffix_tree.Block.grams

    def grams(self, n, i):
        hashed[n] += len(i)
        return plain(self, n, i)

    monkeypatch.setattr(suffix_tree.Block, "grams", grams)
    for levels in suffix_tree.rounds_of(5):
        before = block.packed()
        block = suffix_tree.Block.of_packed(before)
        keys, (own,) = block.count_ask(levels, 2)
        block.count_take(levels, 2, own)
        after = block.packed()
        assert len(keys) == len(own) and all(a is b for a, b in zip(before, after, strict=False))
    assert hashed[2] > 2 * 1800 and 0 < hashed[4] <= 2 * 200 and hashed[6] <= hashed[4]
    again = suffix_tree.Block.of_packed(block.packed())
    assert [x.tolist() for x in again.seen[1:]] == [x.tolist() for x in block.seen[1:]] and {x.dtype.itemsize for x in again.seen[1:]} == {4}
    tokens = [w for t in texts.to_pylist()[:8] for w in suffix_tree.tokens(t)]
    assert again.counts.tolist() == [Counter(tokens)[w] for w in words]


def test_blocks_do_not_matter(spark, sf):
    d = table(spark, sf, "documents")
    rows = lambda n: {r["id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in suffix_tree.score(d, block_bytes=n).collect()}
    assert rows(1 << 30) == rows(40_000)


def test_lookup_table():
    names = tuple(f"s{i}" for i in range(10))
    before = sharding.lookup(names, 1009)
    n = Counter(before)
    assert max(n.values()) - min(n.values()) <= 1
    after = sharding.lookup(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(before, after, strict=True) if names[a] != "s9")
    assert moved < 0.2 * 1009
    for bad in ((("a", "a"), 13), ((), 13), (names, 7), (names, 12)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_schedule_is_even(spark, sf):
    """Every stretch of the schedule is close to the target weights, and pieces fill their slots."""
    docs, plan, pieces = mixing.mix(table(spark, sf, "documents"), slots=2000)
    share = {r["src"]: r["target"] for r in docs.select("src", "target").distinct().collect()}
    total = sum(share.values())
    slots = sorted((r["slot"], r["src"]) for r in plan.collect())
    assert [s for s, _ in slots] == list(range(len(slots)))
    for lo in range(0, len(slots) - 500, 500):
        seen = Counter(s for _, s in slots[lo : lo + 500])
        assert all(abs(seen[s] - 500 * t / total) <= 4 for s, t in share.items())
    block = -(-int(total) // 2000)
    assert all(r[1] <= block for r in pieces.groupBy("slot").agg({"words": "sum"}).collect())


def test_small_sources_get_their_words(spark):
    """Sources whose target is a part of a block, or a few blocks, beside a large one."""
    rows = [(i, "w " * 100, "large") for i in range(400)]
    rows += [(1000 + i, "w " * (1 + i % 9), f"s{i % 60:02d}") for i in range(240)]
    docs, plan, pieces = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=500)
    of = {}
    for r in docs.collect():
        assert r["taken"] <= 2 * r["size"]
        of.setdefault(r["src"], [0, r["target"]])[0] += r["taken"]
    block = -(-int(sum(t for _, t in of.values())) // 500)
    assert block > 50 and sum(t < 1.5 * block for _, t in of.values()) == 60
    assert all(abs(taken - t) <= (0.51 if s != "0large" else 4 * block) for s, (taken, t) in of.items())
    assert pieces.agg({"words": "sum"}).first()[0] == sum(t for t, _ in of.values())
    assert {r["slot"] for r in plan.collect()} <= set(range(500))


def test_pipeline(spark, sf):
    """Each stage, on its own input, against plain Python."""
    docs = table(spark, sf, "documents")
    left = {r["doc_id"]: r for r in docs.collect()}
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    want = {i: r for i, r in left.items() if model.logit(r["text"]) < 0}
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: stages[name](spark, d, sf)
    d1 = step("toxicity", docs)
    assert {r["doc_id"] for r in d1.collect()} == set(want)

    fp, n = {}, {}
    for i, r in want.items():
        h = simhash.shingle_hashes(r["text"], 5)
        fp[i], n[i] = [simhash.majority(simhash._mixed(h, k)) for k in range(4)], max(1, len(h))
    ids = sorted(want)
    reps = {}
    for i in ids:
        reps.setdefault(tuple(fp[i]), []).append(i)
    size = {i: min(n[x] for x in group) for group in reps.values() for i in group}
    near = [(g[0], x) for g in reps.values() for x in g[1:]]
    heads = [g[0] for g in reps.values()]
    fits = lambda a, b: math.floor(size[a] / simhash.BAND) <= size[b] <= math.ceil(size[a] * simhash.BAND)
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(fp[a], fp[b], strict=True))
    alike = lambda a, b: simhash.jaccard(want[a]["text"], want[b]["text"], 5) >= 0.8
    loose = [(a, b, d) for k, a in enumerate(heads) for b in heads[k + 1 :] if (d := bits(a, b)) <= 52 and (fits(a, b) or fits(b, a))]
    groups = {}
    for i, g in linked(heads, [(a, b) for a, b, _ in loose]).items():
        groups.setdefault(g, []).append(i)
    near += [(a, b) for a, b, d in loose if d <= 24]
    near += [(a, b) for g in groups.values() for k, a in enumerate(g) for b in g[k + 1 :] if alike(a, b)]
    root = linked(ids, near)
    want = {i: want[i] for i in ids if root[i] == i}
    d2 = step("simhash_near_dedup", d1)
    assert {r["doc_id"] for r in d2.collect()} == set(want)

    items = [WORD.findall(r["text"].encode().lower()) for r in table(spark, sf, "benchmark").collect()]
    wins = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    clean = lambda t: not any(tuple(t[k : k + len(w)]) == w for w in wins for k in range(len(t) - len(w) + 1)) if len(t) < 400 else not ({tuple(t[k : k + 10]) for k in range(len(t) - 9)} & wins)
    want = {i: r for i, r in want.items() if clean(WORD.findall(r["text"].encode().lower()))}
    d3 = step("decontamination", d2)
    assert {r["doc_id"] for r in d3.collect()} == set(want)

    # sources end to end in the order of a hash, cut where the golden-ratio schedule stops
    key = {i: hashlib.sha256(f"{i}\x00{r['text']}".encode()).hexdigest() for i, r in want.items()}
    size = {i: len(r["text"].encode().split()) for i, r in want.items()}
    line = {}
    for i in sorted((i for i in want), key=lambda i: (hashlib.md5(key[i].encode()).hexdigest(), key[i])):
        line.setdefault(want[i]["source"], []).append(i)
    names = sorted(line)
    s = {x: sum(size[i] for i in line[x]) for x in names}
    w = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    total, target, free = 1.5 * sum(s.values()), {}, list(names)
    while True:  # the excess is reshared until no target is above its cap
        level = (total - sum(target.values())) / sum(w[x] for x in free)
        over = [x for x in free if level * w[x] > 2 * s[x]]
        target.update({x: 2.0 * s[x] for x in over})
        free = [x for x in free if x not in over]
        if not over:
            break
    target.update({x: level * w[x] for x in free})
    block = max(1, math.ceil(total / (1 << 20)))
    edge = np.cumsum([target[x] for x in names]) / total
    x = (np.arange(math.ceil(total / block)) + 0.5) * mixing.GOLDEN
    slots = np.bincount(np.searchsorted(edge, x - np.floor(x), side="right"), minlength=len(names))
    expected = Counter()
    for k, name in enumerate(names):
        o, most = 0, int(slots[k]) * block
        for i in line[name]:
            z = size[i]
            taken = max(0, min(o + z, most) - o) + max(0, min(o + s[name] + z, most) - o - s[name]) if z else 0
            expected[i] = int(taken / z + 0.5) if z else 0
            o += z
    d4 = step("mixing", d3)
    got = Counter(r["doc_id"] for r in d4.collect())
    assert got == +expected

    final = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in final) == got
    table_ = sharding.lookup()
    for r in final:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table_[slot]])
    assert decontamination.WINDOW == 10
