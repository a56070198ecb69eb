"""Repeated passages by a sparse suffix sort with hash-compared suffixes.

A byte goes where a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller id, or
earlier in the same one.  Sorting every suffix of a corpus is out of reach, so only suffixes that can matter are
sorted.  In each string of ``length`` bytes the ``GRAM``-byte string of least hash (the leftmost of these) is its
anchor; equal strings have equal anchors at the same place in them.  Strings that start one after another and share an anchor make a
segment.

1. Anchors are dealt out by hash; those whose hash occurs once, nearly all, are done with.
2. Of equal segments all but the first are repeats as a whole.  They are told apart by 128 bits of BLAKE2b of their bytes:
   their polynomial hashes could collide, and bringing all their bytes together would be a multiple of the input.
3. First segments whose anchor occurs in other segments too are sorted: the suffixes that start in them are put
   in order by mergesort; two suffixes are compared by a binary search for their common extension on prefix
   polynomial hashes, so that a comparison takes the logarithm of ``length`` steps.  Neighbours with a common extension of
   ``length`` are equal strings, of which the first one stays.  The whole order is verified on the bytes of all
   neighbours; a collision makes its bucket be decided by the bytes alone.

Hot anchors: a task that sees a hash twice passes its places on at once and sends one of them by hash, so a hash has
no more rows than there are tasks.  Equal segments are found by an aggregation with map-side combining.  An anchor
in more than ``HOT`` different segments has its strings compared through a native aggregation by their 128-bit digests
instead of in one task, with the same result.  Whole texts are read throughout; a document's own places are all that meets in one row.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; ids may be of any type with an
order; rows of one id, and those of a null id, are ordered by a hash of their text behind all others of smaller ids, null
last, and equal rows get rows each, of which one counts as the first; an empty table gives no rows; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.arrow import by_slices
from kindred.llm.common import drop_written, table, tidy, written

LENGTH = 100
GRAM = 32
HOT = 2000
OPEN, DECIDED, TOLD = range(3)
_SEED = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base, for each of two polynomial hashes modulo 2 ** 64.
_CODES = _SEED.integers(0, 2**64, (2, 256), np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_NONE = np.uint64(2**64 - 1)


class Prefix:
    """Prefix hashes of a buffer: the sum of code[b] * base ** place, so that any substring's hash takes two reads."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        n = len(buf)
        base = _BASES[which]
        inv = pow(base, -1, 2**64)
        self.back = _powers(inv, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[which][buf] * _powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


_held: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, by doubling; kept for the next buffer."""
    p = _held.get(base)
    if p is None or len(p) < n:
        size = 1 << max(16, int(n).bit_length())
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:
            p[done : 2 * done] = p[:done] * np.uint64(pow(base, done, 2**64))
            done *= 2
        _held[base] = p
    return p[:n]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, lengths)"""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens, lens


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, anchor, its hash, first start, last start) of all segments; places are counted from the text's begin."""
    buf, begin, lens = _joined(texts)
    none = np.array([], np.int64)
    if not len(buf) or lens.max() < length:
        return none, none, none.astype(np.uint64), none, none
    n, wide = len(buf), length - gram + 1
    h = Prefix(buf).of(np.arange(n - gram + 1), gram) if n >= gram else np.array([], np.uint64)
    val = np.full(n + wide, _NONE, np.uint64)
    val[: len(h)] = np.minimum(h, _NONE - np.uint64(1))
    at = np.arange(n + wide, dtype=np.int32)
    # least hash, leftmost, among wide grams from each place on: windows of doubling width, then two that overlap
    span = 1
    while 2 * span <= wide:
        right = val[span:] < val[:-span]
        at = np.where(right, at[span:], at[:-span])
        val = np.where(right, val[span:], val[:-span])
        span *= 2
    if span < wide:
        k = wide - span
        at = np.where(val[k:] < val[:-k], at[k:], at[:-k])
    doc = np.repeat(np.arange(len(texts)), np.maximum(lens - length + 1, 0))
    if not len(doc):
        return none, none, none.astype(np.uint64), none, none
    many = np.maximum(lens - length + 1, 0)
    start = np.arange(len(doc)) + np.repeat(begin - (np.cumsum(many) - many), many)  # places in the buffer where a string starts
    anchor = at[start].astype(np.int64)
    new = np.empty(len(doc), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    d = doc[first]
    return d, anchor[first] - begin[d], h[anchor[first]], start[first] - begin[d], start[last] - begin[d]


def lcp(p: Prefix, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common extension, up to most, of the suffixes at a and b: a binary search on prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = p.of(a, mid) == p.of(b, mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_sort(buf: np.ndarray, p: Prefix, starts: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes by (bucket, first ``most`` bytes); equal ones keep theirs.  bucket must be ascending.

    Bottom-up mergesort of all buckets at once: in each round every suffix finds its place among the sibling run by
    binary search, with a logarithmic comparison at each step.
    """
    n = len(starts)
    order = np.arange(n)
    if not n:
        return order
    cut = np.flatnonzero(np.diff(bucket)) + 1
    begin = np.concatenate(([0], cut))
    size = np.diff(np.concatenate((begin, [n])))
    base, full = np.repeat(begin, size), np.repeat(size, size)
    run = 1
    while run < size.max():
        active = np.flatnonzero(full > run)
        b, m = base[active], full[active]
        li = active - b
        mine = li // run
        sib = mine ^ 1
        lo = np.minimum(sib * run, m)
        hi = np.minimum(lo + run, m)
        left, right = lo.copy(), hi.copy()
        me = starts[order[active]]
        later = mine > sib  # the right run yields to equal suffixes of the left one
        while (open_ := left < right).any():
            i = np.flatnonzero(open_)
            mid = (left[i] + right[i]) // 2
            other = starts[order[b[i] + mid]]
            ext = lcp(p, other, me[i], most)
            end = ext >= most
            x = np.where(end, 0, buf[np.minimum(other + ext, len(buf) - 1)])
            y = np.where(end, 0, buf[np.minimum(me[i] + ext, len(buf) - 1)])
            before = (x < y) | (end & later[i])
            left[i] = np.where(before, mid + 1, left[i])
            right[i] = np.where(before, right[i], mid)
        pair = np.minimum(mine, sib) * run
        place = b + pair + (li - mine * run) + (left - lo)
        moved = order.copy()
        moved[place] = order[active]
        order = moved
        run *= 2
    return order


def repeats(buf: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For suffixes given in the order of first to last, whether an earlier one of the same bucket has the same first ``length`` bytes."""
    by = np.argsort(bucket, kind="stable")
    s, k = starts[by], bucket[by]
    p = Prefix(buf)
    order = suffix_sort(buf, p, s, k, length)
    t, kk, first = s[order], k[order], by[order]
    # the order is verified on the bytes of all neighbours: then equal strings stand side by side, the earliest in front
    same, wrong = np.zeros(max(0, len(t) - 1), bool), np.zeros(max(0, len(t) - 1), bool)
    span = np.arange(length)
    near = np.flatnonzero(kk[1:] == kk[:-1])
    for i in range(0, len(near), 1 << 15):
        x = near[i : i + (1 << 15)]
        one, two = buf[t[x][:, None] + span], buf[t[x + 1][:, None] + span]
        unlike = one != two
        at = unlike.argmax(axis=1)
        row = np.arange(len(x))
        differs = unlike[row, at]
        same[x] = ~differs
        wrong[x] = np.where(differs, one[row, at] > two[row, at], first[x] > first[x + 1])
    found = np.zeros(len(starts), bool)
    found[first[1:][same]] = True
    lost = np.bincount(order, minlength=len(s)) != 1  # comparisons that contradict each other can put two into one place
    for c in np.unique(np.concatenate((kk[1:][wrong], k[lost]))):  # a collision: the bytes alone decide
        rows, seen = np.flatnonzero(bucket == c), set()
        for r in rows.tolist():
            string = buf[starts[r] : starts[r] + length].tobytes()
            found[r] = string in seen
            seen.add(string)
    return found


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _batch(schema: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def _freed(*tables: DataFrame) -> None:
    """Removes written tables that are done with."""
    for t in tables:
        drop_written(t)


def _told(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each string as two numbers: unlike polynomial hashes they may stand for the bytes."""
    d = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in strings)
    both = np.frombuffer(d, np.int64).reshape(-1, 2) if d else np.zeros((0, 2), np.int64)
    return both[:, 0].copy(), both[:, 1].copy()


def _packed(p: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A segment's anchor, and how far its first string starts before it and its last string behind that, as one number."""
    return p << 20 | (p - a) << 10 | (z - a)


def _unpacked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = s >> 20
    a = p - (s >> 10 & 1023)
    return p, a, a + (s & 1023)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, s: the segments (packed) whose anchor's hash occurs elsewhere too."""
    if length - GRAM > 1000:
        raise ValueError("length is too large for packed segments")
    schema = "key long, kind int, doc long, s long"  # kind: place to decide, place decided, or a hash to be told of alone

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b):
            d, p, h, a, z = segments([_bytes(t) for t in b.column(1).to_pylist()], length)
            return b.column(0).to_numpy()[d], _packed(p, a, z), h

        parts, size = [], 0

        def out():
            doc, seg, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            many = np.empty(len(h), bool)
            many[order] = ~new | np.concatenate((~new[1:], [False]))
            lone = np.ones(len(h), bool)
            lone[order] = new  # one of each hash goes by hash
            spread = (doc * 1_000_003 + seg).astype(np.uint64) * np.uint64(_BASES[0])
            # of a hash seen twice here every place is decided; the hash is sent once more so that others learn of it
            tell = many & lone
            key = np.where(many, spread, h).view(np.int64)
            yield _batch(schema, key, np.where(many, DECIDED, OPEN).astype(np.int32), doc, seg)
            yield _batch(schema, h[tell].view(np.int64), np.full(int(tell.sum()), TOLD, np.int32), doc[tell], seg[tell])

        for b in batches:
            for i in range(0, b.num_rows, 512):
                x = rows(b.slice(i, 512))
                if len(x[0]):
                    parts.append(x)
                    size += len(x[0])
                if size >= 2_000_000:
                    yield from out()
                    parts, size = [], 0
        if parts:
            yield from out()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, state, doc, seg = (t.column(k).to_numpy() for k in ("key", "kind", "doc", "s"))
        done = state == DECIDED
        yield _batch("doc long, s long", doc[done], seg[done])
        key, state, doc, seg = (x[~done] for x in (key, state, doc, seg))
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        twice = order[~new | np.concatenate((~new[1:], [False]))] if len(s) else order
        twice = twice[state[twice] == OPEN]
        yield _batch("doc long, s long", doc[twice], seg[twice])

    return docs.mapInArrow(emit, schema).repartition("key").mapInArrow(pick, "doc long, s long")


def _digests(texts: DataFrame, length: int) -> DataFrame:
    """h (of the anchor), g1 and g2 (digest of the whole segment), doc, s, again: whether an earlier equal segment stands in the same task.

    texts: doc, text, s (array).  What is again is settled here; of each segment a task sends one on.
    """
    schema = "h long, g1 long, g2 long, doc long, s long, again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out():
            h, g1, g2, doc, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((seg, doc, g2, g1, h))
            h, g1, g2, doc, seg = (x[order] for x in (h, g1, g2, doc, seg))
            again = np.concatenate(([False], (h[1:] == h[:-1]) & (g1[1:] == g1[:-1]) & (g2[1:] == g2[:-1])))
            for i in range(0, len(h), 1 << 18):
                yield _batch(schema, *(x[i : i + (1 << 18)] for x in (h, g1, g2, doc, seg, again)))

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lists = part.column(2)
                seg = lists.flatten().to_numpy()
                d = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                texts = [_bytes(t) for t in part.column(1).to_pylist()]
                buf, begin, _ = _joined(texts)
                p, a, z = _unpacked(seg)
                # the anchor's place belongs to what makes segments equal
                strings = [texts[i][x:y] + bytes((at >> 8, at & 255)) for i, x, y, at in zip(d.tolist(), a.tolist(), (z + length).tolist(), (p - a).tolist(), strict=True)]
                h = Prefix(buf).of(begin[d] + p, GRAM).view(np.int64) if len(d) else np.array([], np.int64)
                parts.append((h, *_told(strings), part.column(0).to_numpy()[d], seg))
                size += len(seg)
            if size >= 2_000_000:
                yield from out()
                parts, size = [], 0
        if parts:
            yield from out()

    return texts.mapInArrow(run, schema)


def _spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals, ascending; such as touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _sort_task(length: int):
    schema = "doc long, a int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        h, doc, a, p = (t.column(k).to_numpy().astype(np.int64) for k in ("h", "doc", "a", "p"))
        order = np.lexsort((a, doc, h))
        edge = np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0))), [len(order)]))
        text = t.column("bytes")
        i = 0
        while i < len(edge) - 1:  # whole anchors, some MB of text at a time
            j, n = i, 0
            while j < len(edge) - 1 and (n < 20_000 or j == i):
                n += edge[j + 1] - edge[j]
                j += 1
            rows = order[edge[i] : edge[j]]
            i = j
            buf, begin, lens = _joined(text.take(pa.array(rows)).to_pylist())
            many = lens - length + 1
            seg = np.repeat(np.arange(len(rows)), many)
            off = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
            delta = (p[rows] - a[rows])[seg] - off  # how far before its anchor a string starts
            _, group = np.unique(h[rows], return_inverse=True)
            found = repeats(buf, begin[seg] + off, group[seg] * (2 * length) + delta, length)
            hit = np.flatnonzero(found)
            if len(hit):
                x = a[rows][seg[hit]] + off[hit]
                dd = doc[rows][seg[hit]]
                cut = np.concatenate(([True], (dd[1:] != dd[:-1]) | (x[1:] > x[:-1] + length) | (x[1:] < x[:-1])))
                s = np.flatnonzero(cut)
                e = np.concatenate((s[1:], [len(x)])) - 1
                yield _batch(schema, dd[s], x[s].astype(np.int32), (x[e] + length).astype(np.int32))

    return run, schema


def _candidates(base: DataFrame, length: int) -> DataFrame:
    """doc, id, n_bytes; s and text where a segment may be a repeat, sha where none can be."""
    places = written(anchors(base.select("doc", "text"), length), "suffix-anchors")
    per = places.groupBy("doc").agg(F.collect_list("s").alias("s"))
    text = F.coalesce("text", F.lit(""))
    some = F.col("s").isNotNull()
    out = written(base.join(per, "doc", "left").select("doc", "id", "s", F.when(some, F.col("text")).alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.when(~some, F.sha2(text.cast("binary"), 256)).alias("sha")), "suffix-texts")
    _freed(places)
    return out


def _told_apart(cand: DataFrame, length: int) -> DataFrame:
    """h, doc, s, first: segments, and whether each is the first of those equal to it."""
    every = written(_digests(cand.filter("s IS NOT NULL").select("doc", "text", "s"), length), "suffix-segments")
    # a task sends a segment once, so that no more rows than tasks meet here
    place = F.row_number().over(Window.partitionBy("h", "g1", "g2").orderBy("doc", "s"))
    one = every.filter(~F.col("again")).select("h", "doc", "s", (place == 1).alias("first"))
    out = written(one.unionByName(every.filter("again").select("h", "doc", "s", F.lit(False).alias("first"))), "suffix-firsts")
    _freed(every)
    return out


def _pieces(cand: DataFrame, segs: DataFrame, length: int) -> DataFrame:
    """h, doc, p, a, n, bytes: the texts of first segments whose anchor stands in n of them, two or more."""
    firsts = segs.filter("first").select("h", "doc", "s")
    # written, so that the join has a plain exchange on either side and a hot anchor can be split
    many = written(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-shared")
    per = firsts.join(many, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "s", "n")).alias("o"))
    raw = "h long, doc long, p int, a int, n long, bytes binary"

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(2)
        o = lists.flatten()
        h, seg, n = (o.field(i).to_numpy() for i in range(3))
        d = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        p, a, z = _unpacked(seg)
        t = [_bytes(x) for x in b.column(1).to_pylist()]
        strings = [t[i][x : y + length] for i, x, y in zip(d.tolist(), a.tolist(), z.tolist(), strict=True)]
        return _batch(raw, h, b.column(0).to_numpy()[d], p.astype(np.int32), a.astype(np.int32), n, pa.array(strings, pa.binary()))

    out = written(by_slices(cand.filter("s IS NOT NULL").select("doc", "text").join(per, "doc"), cut, raw), "suffix-pieces")
    _freed(many)
    return out


def _hot_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """doc, a, b: strings of pieces that are equal to an earlier one, by their digests and an aggregation."""

    def strings(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(5).to_pylist()
        many = np.fromiter((len(t) - length + 1 for t in texts), np.int64, len(texts))
        s = np.repeat(np.arange(len(texts)), many)
        off = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
        one, two = _told([texts[i][x : x + length] for i, x in zip(s.tolist(), off.tolist(), strict=True)])
        return _batch("g1 long, g2 long, doc long, a int", one, two, b.column(1).to_numpy()[s], (b.column(3).to_numpy()[s] + off).astype(np.int32))

    each = by_slices(pieces, strings, "g1 long, g2 long, doc long, a int")
    least = each.groupBy("g1", "g2").agg(F.min(F.struct("doc", "a")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g1", "g2", F.col("f.doc").alias("d0"), F.col("f.a").alias("a0"))
    return each.join(least, ["g1", "g2"]).filter("doc <> d0 OR a <> a0").select("doc", "a", (F.col("a") + length).alias("b"))


def _repeated(cand: DataFrame, length: int, hot: int) -> DataFrame:
    """doc, g: the byte ranges (a, b) of a document that go, in any order and overlapping."""
    segs = _told_apart(cand, length)
    pieces = _pieces(cand, segs, length)
    a = (F.shiftright("s", 20) - F.shiftright("s", 10).bitwiseAND(F.lit(1023).cast("long"))).cast("int")
    whole = segs.filter(~F.col("first")).select("doc", a.alias("a"), (a + F.col("s").bitwiseAND(F.lit(1023).cast("long")).cast("int") + length).alias("b"))
    run, schema = _sort_task(length)
    cold = pieces.filter(F.col("n") <= hot).drop("n").repartition("h").mapInArrow(run, schema)
    every = whole.unionByName(cold).unionByName(_hot_repeats(pieces.filter(F.col("n") > hot), length))
    out = written(every.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("g")), "suffix-gone")
    _freed(segs, pieces)
    return out


def _numbered(base: DataFrame) -> DataFrame:
    """base (id, text) with doc: a number that rises with the id, null ids last.

    Ids that are whole numbers, none null or twice, are the numbers.  Others are numbered in two levels: ids and hashes
    of texts, without the texts, are dealt out in ranges and numbered within each behind what stands in those before.
    Rows of one id are in the order of their texts' hashes; equal rows are brought together and numbered one by one.
    """
    n, ids = base.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if n == ids and dict(base.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        return base.withColumn("doc", F.col("id").cast("long"))
    h = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("")), 256)
    rows = base.withColumn("h", h)
    order = [F.col("id").asc_nulls_last(), F.col("h").asc()]
    ranged = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("m")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "suffix-ranges")
    each = ranged.groupBy("part").agg(F.sum("m").alias("c"))  # a row a range
    first = each.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("start"))
    inner = F.sum("m").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    numbers = written(ranged.withColumn("inner", inner).join(F.broadcast(first), "part").select(F.col("id").alias("id2"), F.col("h").alias("h2"), (F.col("start") + F.col("inner")).alias("doc")), "suffix-numbers")
    one = rows.groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m"))
    found = one.join(numbers, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")))
    return written(found.select("id", "text", F.explode(F.sequence("doc", F.col("doc") + F.col("m") - 1)).alias("doc")), "suffix-docs")


@tidy
def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of a, b: half-open byte ranges that go)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = _numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    cand = _candidates(base, length)
    gone = _repeated(cand, length, hot)

    def rest(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, g in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            t, spans = _bytes(text), _spans([(x["a"], x["b"]) for x in g or ()])
            sha, at = hashlib.sha256(), 0
            for x, y in spans:
                sha.update(t[at:x])
                at = y
            sha.update(t[at:])
            out.append((sum(y - x for x, y in spans), len(spans), sha.hexdigest(), [{"a": x, "b": y} for x, y in spans]))
        cols = list(zip(*out, strict=True))
        return _batch(end, b.column(0), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))))

    end = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:int,b:int>>"
    hit = by_slices(cand.filter("s IS NOT NULL").select("doc", "id", "text", "n_bytes").join(gone, "doc", "left").select("id", "text", "n_bytes", "g"), rest, end)
    zero, no_spans = F.lit(0).cast("long"), F.array().cast("array<struct<a:int,b:int>>")
    none = cand.filter("s IS NULL").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), no_spans.alias("spans"))
    return hit.unionByName(none)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
