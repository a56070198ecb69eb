"""SimHash near-dedup by tiled exact comparison.

A fingerprint has 64 bits for each of ``lanes`` words; a bit is set where over half of a text's shingle hashes have it.
Different fingerprints are compared exactly, by exclusive-or and bit counts on numpy tiles.  What cannot be within
the radius is never brought together: with a small radius a cell is the vector of the bit counts of the four quarters
of a fingerprint, and cells whose counts differ by more than the radius in all are skipped; with a large radius, where
bit counts no longer separate, a cell is a band of text lengths, and bands whose lengths bar the similarity are
skipped.  Inside a tile, rows are ordered by bit count (or length), and the same bounds cut the stripes to compare.

Where a similarity is asked for, fingerprints and lengths count each shingle of a text once, the radius follows from the
two lengths (``limits``), and the Jaccard similarity of the shingle sets decides every link: groups that ``sure`` bits join
are compared in tiles of a few texts, each with the group's first, and then what the radius joins and these links do not.

Equal fingerprints (with a similarity: of equal shingle sets) are one row throughout.  Cells are dealt out in blocks of bounded size, so a hot cell is many
tiles; a tile returns a star for each of its components instead of all pairs, and components are joined up by
``kindred.llm.components``.  The plan of tiles is a table too; nothing but sums of it reaches the driver.

Defined results: an empty or null text has fingerprint zero and is linked like any other; a null id is fingerprinted
but cannot be linked, its component is null; rows of equal id count as one document; the component of a document
that is like no other is its own id; an empty table gives no rows; very long texts are read whole; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import product
from math import ceil, comb
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.arrow import by_slices
from kindred.llm.common import anti_join, table, tidy, written
from kindred.llm.components import components

SEED = 42
#: Rows of a cell that meet as one block: an eighth of all, so that small inputs fill all tasks, within these bounds.
#: A row travels once for each block it meets, so blocks as large as a task can hold keep the shuffle down.
BLOCK, MOST_BLOCK = 4096, 32_768
STRIPE = 256
#: Rows up to which the plan of tiles (40 bytes each) is broadcast; its rows are counted before.
BROADCAST_TILES = 500_000
#: Texts of a block where similarities are verified.
PART = 64
#: Growth of text length from one band to the next, for large radii.
BAND = 1.34
#: Chance that a pair at exactly the similarity asked for is not compared, and the length from which radii are alike.
LOSS, ALIKE = 1e-6, 128


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words of the text, A-Z lower-cased, repeats included; of all words if fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([h(b" ".join(w), seed)] if w else [], np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: -shingle]))
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another hash from h: a fixed bijection for each lane; the first lane is h itself."""
    if lane == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of h."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


@cache
def limits(similarity: float, bits: int) -> np.ndarray:
    """[a, b]: the bits in which texts of a and b shingles at that Jaccard similarity can differ; -1 where lengths bar it.

    With i shingles shared, a bit differs where the majorities of Bin(i) + Bin(a - i) and Bin(i) + Bin(b - i) do, each
    bit independently; the limit leaves a chance of LOSS beyond.  Index ALIKE stands for all lengths from there on.
    """
    pmf = lambda k: np.array([comb(k, x) / 2**k for x in range(k + 1)])

    def above(k: int, own: int, x: np.ndarray) -> np.ndarray:
        """P(2 (x + Bin(own)) > k)."""
        tail = np.concatenate((np.cumsum(pmf(own)[::-1])[::-1], [0.0]))  # P(Bin >= j)
        return tail[np.clip(k // 2 - x + 1, 0, own + 1)]

    def most(p: float) -> int:
        left, r = 1.0, -1
        while left > LOSS and r < bits:
            r += 1
            left -= comb(bits, r) * p**r * (1 - p) ** (bits - r)
        return r

    out = np.full((ALIKE + 1, ALIKE + 1), -1, np.int64)
    for a in range(1, ALIKE + 1):
        for b in range(a, ALIKE + 1):
            i = ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if i <= a:
                x = np.arange(i + 1)
                pa, pb = above(a, a - i, x), above(b, b - i, x)
                out[a, b] = out[b, a] = most(float((pmf(i) * (pa * (1 - pb) + pb * (1 - pa))).sum()))
    far = out[ALIKE // 2 :, ALIKE // 2 :].max()  # longer texts differ in fewer bits
    near = np.arange(ALIKE + 1) >= int(similarity * ALIKE)
    out[ALIKE, near] = out[near, ALIKE] = far
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 1, distinct: bool = False) -> DataFrame:
    """id, n (shingles, one at least) and f0, f1, ... (64 bits each, as signed longs).

    With distinct each shingle of a text counts once, and a column s tells shingle sets apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{k}" for k in range(lanes)]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
        hashes = [np.unique(h) for h in hashes] if distinct else hashes
        cols = [pa.array(np.array([majority(_mixed(h, k)) for h in hashes], np.uint64).view(np.int64)) for k in range(lanes)]
        if distinct:
            cols.append(pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hashes], np.uint64).view(np.int64)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([max(1, len(h)) for h in hashes], pa.int64()), *cols], names=["id", "n", *names])

    names = [*names, "s"] if distinct else names
    return by_slices(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), f, f"id {kind}, n long, " + ", ".join(f"{x} long" for x in names))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def compare(own: np.ndarray, other: np.ndarray, own_key: np.ndarray, other_key: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (own, other) at ``radius`` bits or fewer, and their bits.  Both sides are ordered by key; low and high bound the keys that an own row can meet."""
    lanes = own.shape[1]
    dense = min(lanes, 2) if radius <= 56 else lanes  # two lanes of unlike texts differ in 64 bits
    for i in range(0, len(own), STRIPE):
        j0, j1 = np.searchsorted(other_key, low[i : i + STRIPE].min(), "left"), np.searchsorted(other_key, high[i : i + STRIPE].max(), "right")
        for j in range(j0, j1, 8192):
            x, y = own[i : i + STRIPE], other[j : min(j + 8192, j1)]
            d = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
            for k in range(1, dense):
                d = np.add(d, np.bitwise_count(x[:, k, None] ^ y[None, :, k]), dtype=np.uint8 if k < 3 else np.uint16)
            a, b = np.nonzero(d <= radius)
            bits = d[a, b].astype(np.int64)
            for k in range(dense, lanes):  # the other lanes only where the first two leave room
                bits = bits + np.bitwise_count(x[a, k] ^ y[b, k])
                near = bits <= radius
                a, b, bits = a[near], b[near], bits[near]
            if len(a):
                yield a + i, b + j, bits


def _cells(f0: str, radius: int) -> tuple:
    """(expression of a row's cell, the steps to cells that it can meet: how far, and where such a step is allowed)."""
    if radius <= 4:
        cell = sum((F.bit_count(F.shiftrightunsigned(F.col(f0), 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) * 17**k).cast("long") for k in range(4))
        steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
        digit = [F.pmod(F.floor(F.col("cell") / 17**k), F.lit(17)) for k in range(4)]
        return cell, [(sum(x * 17**k for k, x in enumerate(s)), reduce(and_, [(d + x).between(0, 16) for d, x in zip(digit, s, strict=True)])) for s in steps]
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("long"), [(x, F.lit(True)) for x in (-1, 0, 1)]


def _plan(counts: DataFrame, steps: list, block: int) -> DataFrame:
    """cell, part, tile, home, first: which blocks of which cells meet in which tile.

    A cell's rows are ``parts`` blocks.  A block is at home in tiles that hold it and, up to ``block`` rows at a time, the
    blocks behind it in order of (cell, part) which it can meet.  counts: cell, n: at most 17 ** 4 rows, or a few hundred.
    """
    cells = counts.select("cell", "n", F.ceil(F.col("n") / block).alias("parts"))
    each = cells.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    to = F.explode(F.array_compact(F.array(*[F.when(ok, F.col("cell") + x) for x, ok in steps]))).alias("cell2")
    theirs = cells.select(F.col("cell").alias("cell2"), F.ceil(F.col("n") / F.col("parts")).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part2"))
    pairs = each.select("cell", "part", to).join(theirs, "cell2").filter("cell2 > cell OR (cell2 = cell AND part2 > part)")
    before = F.sum("size").over(Window.partitionBy("cell", "part").orderBy("cell2", "part2").rowsBetween(Window.unboundedPreceding, -1))
    guests = pairs.withColumn("room", F.floor(F.coalesce(before, F.lit(0)) / block))
    number = F.shiftleft("cell", 46).bitwiseOR(F.shiftleft("part", 23)).bitwiseOR(F.col("room"))  # 17, 23 and 23 bits
    homes = each.select("cell", "part", F.lit(0).cast("long").alias("room")).unionByName(guests.select("cell", "part", "room").distinct().filter("room > 0"))
    homes = homes.select("cell", "part", number.alias("tile"), F.lit(True).alias("home"), (F.col("room") == 0).alias("first"))
    return homes.unionByName(guests.select(F.col("cell2").alias("cell"), F.col("part2").alias("part"), number.alias("tile"), F.lit(False).alias("home"), F.lit(False).alias("first")))


@tidy
def links(reps: DataFrame, radius: int, lanes: int = 1, sure: int | None = None, limit: np.ndarray | None = None) -> DataFrame:
    """a, b, sure: stars that join all of reps (rep, n, f0, ...) within the radius, tile by tile, and with ``sure`` also
    those that join them within ``sure`` bits alone, marked so; with ``limit`` the radius is that of a pair's lengths."""
    if limit is not None:
        radius = max(radius, int(limit.max()))
    fs = [f"f{k}" for k in range(lanes)]
    cell, steps = _cells("f0", radius)
    reps = reps.withColumn("cell", cell)
    counts = written(reps.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "simhash-cells")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    block = min(max(BLOCK, total // 8), MOST_BLOCK)
    where = written(_plan(counts, steps, block), "simhash-plan")
    parts = counts.select("cell", F.ceil(F.col("n") / block).alias("parts"))
    dealt = reps.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(*fs), F.col("parts")))
    dealt = dealt.join(F.broadcast(where) if where.count() <= BROADCAST_TILES else where, ["cell", "part"]).select("tile", "home", "first", "rep", "n", *fs)
    banded = radius > 4
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        tile, home, first, rep, n = (t.column(k).to_numpy() for k in ("tile", "home", "first", "rep", "n"))
        f = np.stack([t.column(x).to_numpy() for x in fs], axis=1).view(np.uint64)
        key = n if banded else np.bitwise_count(f).astype(np.int64).sum(axis=1)
        order = np.lexsort((rep, key, ~home, tile))
        tile, home, first, rep, key, n, f = (x[order] for x in (tile, home, first, rep, key, n, f))
        cuts = np.flatnonzero(np.diff(tile)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(tile)], strict=True):
            h = s + int(home[s:e].sum())
            own, other = slice(s, h), slice(h, e)
            low, high = (np.floor(key[own] / BAND), np.ceil(key[own] * BAND)) if banded else (key[own] - radius, key[own] + radius)
            size = e - s
            # what is joined at the radius, and at fewer bits where that is asked for
            stars = {k: np.arange(size) for k in ({False: radius} if sure is None else {False: radius, True: sure})}
            joined: dict[bool, list] = {k: [] for k in stars}
            held = 0

            def contract(stars=stars, joined=joined, size=size):
                for k in stars:  # many pairs become a few stars before more are gathered
                    x, y = (np.concatenate(z) for z in zip(*joined[k], (np.arange(size), stars[k]), strict=True))
                    stars[k], joined[k] = _forest(size, x, y), []

            # a home's own rows meet in its first tile alone; there they stand as guests as well
            sides = [(other, h - s)] + ([(own, 0)] if first[s] else [])
            for side, shift in sides:
                for x, y, bits in compare(f[own], f[side], key[own], key[side], low, high, radius):
                    if limit is not None:
                        fits = bits <= limit[np.minimum(n[own][x], ALIKE), np.minimum(n[side][y], ALIKE)]
                        x, y, bits = x[fits], y[fits], bits[fits]
                    joined[False].append((x, y + shift))
                    if sure is not None:
                        joined[True].append((x[bits <= sure], y[bits <= sure] + shift))
                    held += len(x)
                    if held > 1 << 20:
                        contract()
                        held = 0
            contract()
            ids = rep[s:e]
            for k, star in stars.items():
                out = np.flatnonzero(star != np.arange(size))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[star[out]]), pa.array(np.full(len(out), k))], names=["a", "b", "sure"])

    return dealt.repartition("tile").mapInArrow(run, f"a {kind}, b {kind}, sure boolean")


def jaccard(a: str | None, b: str | None, shingle: int) -> float:
    """Of the sets of shingles; 1 for two texts without words."""
    x, y = set(shingle_hashes(a, shingle).tolist()), set(shingle_hashes(b, shingle).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _similar(texts: list[str | None], shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of texts whose shingle sets have that Jaccard similarity, from one product of the incidence matrix."""
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    size = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc, at = doc[many[at] > 1], at[many[at] > 1]  # what one text alone has is shared with none
    _, at = np.unique(at, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
        i, j = np.searchsorted(at, [c, c + 8192])
        x = np.zeros((len(sets), 8192), np.float32)
        x[doc[i:j], at[i:j] - c] = 1
        both += (x @ x.T).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu((both >= similarity * union) | (union == 0), 1))


def _centred(members: DataFrame) -> DataFrame:
    """tile, rep: members (rep, loose, sure) by their sure component, up to PART in a tile, each tile with the component's first."""
    count = members.groupBy("sure").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    count = written(count, "simhash-sizes")  # plain exchanges on either side of the join
    m = members.join(count, "sure")
    m = m.select("sure", "rep", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / PART)).alias("part"))
    m = written(m, "simhash-stars")
    tile = F.xxhash64("sure", "part").alias("tile")
    return m.select(tile, "rep").unionByName(m.select("sure", "part").distinct().select(tile, F.col("sure").alias("rep"))).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """tile, rep: members (rep, loose, sure) so that any two of a loose group and of different sure components meet in a tile.

    A group of several sure components meets in tiles of two blocks of up to PART texts; blocks within one sure component
    are joined already and not compared.  Texts go to as many tiles as their group has blocks, and pairs never leave a tile.
    """
    several = members.groupBy("loose").agg(F.min("sure").alias("lo"), F.max("sure").alias("hi")).filter("lo <> hi").select("loose")
    # group tables are written, so that their joins have plain exchanges on either side and a large group can be split
    m = written(members.join(written(several, "simhash-groups"), "loose"), "simhash-members")
    count = m.groupBy("loose", "sure").agg(F.count(F.lit(1)).alias("n"))
    count = written(count, "simhash-counts")
    mixed = written(count.filter(F.col("n") < PART).groupBy("loose").agg(F.sum("n").alias("few")), "simhash-mixed")
    h = F.xxhash64("rep")
    large = F.col("n") >= PART
    parts = lambda c: F.ceil(F.col(c) / PART)
    block = F.when(large, F.concat_ws(":", F.col("sure").cast("string"), F.pmod(h, parts("n")).cast("string"))).otherwise(F.concat(F.lit("mixed:"), F.pmod(h, parts("few")).cast("string")))
    m = written(m.join(count, ["loose", "sure"]).join(mixed, "loose", "left").select("rep", "loose", block.alias("block"), F.when(large, F.col("sure")).alias("of")), "simhash-blocks")
    blocks = m.select("loose", "block", "of").distinct()
    other = blocks.select("loose", F.col("block").alias("block2"), F.col("of").alias("of2"))
    tiles = blocks.join(other, "loose").filter((F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False)))
    tile = F.xxhash64("loose", "block", "block2")
    rooms = tiles.select(tile.alias("tile"), "loose", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return m.select("rep", "loose", "block").join(rooms, ["loose", "block"]).select("tile", "rep")


def _verified(rooms: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """a, b: stars that join those of rooms (tile, rep) whose texts are similar enough, within each tile."""
    rooms = written(rooms, "simhash-rooms")
    wanted = rooms.select("rep").distinct()
    few = rooms.count() <= 200_000
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rep"), F.col(text_col).alias("t"))
    texts = written(texts.join(F.broadcast(wanted) if few else wanted, "rep", "left_semi").groupBy("rep").agg(F.min("t").alias("t")), "simhash-texts")  # of texts with one id the least stands for it
    kind = rooms.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        tile, rep = t.column("tile").to_numpy(), t.column("rep").to_numpy()
        order = np.lexsort((rep, tile))
        cuts = np.flatnonzero(np.diff(tile[order])) + 1
        for rows in np.split(order, cuts):
            a, b = _similar(t.column("t").take(pa.array(rows)).to_pylist(), shingle, similarity)
            star = _forest(len(rows), a, b)
            out = np.flatnonzero(star != np.arange(len(rows)))
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(rep[rows][out]), pa.array(rep[rows][star[out]])], names=["a", "b"])

    return rooms.join(texts, "rep").repartition("tile").mapInArrow(run, f"a {kind}, b {kind}")


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, lanes: int = 1, sure: int | None = None, similarity: float | None = None) -> DataFrame:
    """id, n, f0, ..., component: the smallest id that can be reached by links.

    Links are pairs of ``radius`` bits or fewer; with a similarity, pairs whose shingle sets reach it, of those that
    ``radius`` bits, or what ``limits`` says where that is more, join.
    """
    fs = [f"f{k}" for k in range(lanes)]
    one = fs if similarity is None else [*fs, "s"]
    prints = written(fingerprints(docs, id_col, text_col, shingle, lanes, similarity is not None), "simhash")
    # one row a fingerprint; with a similarity, a row a shingle set
    reps = written(prints.filter("id IS NOT NULL").groupBy(*one).agg(F.min("id").alias("rep"), F.min("n").alias("n")), "simhash-reps")
    if similarity is None:
        comp = components(links(reps, radius, lanes))
    else:
        limit = limits(similarity, 64 * lanes)
        found = written(links(reps, radius, lanes, sure, np.where(limit < 0, limit, np.maximum(limit, radius))), "simhash-links")
        named = lambda d, c: written(components(d), c).select(F.col("node").alias("rep"), F.col("component").alias(c))
        loose = named(found, "loose")
        within = lambda c: loose.join(c, "rep", "left").select("rep", "loose", F.coalesce("sure", "rep").alias("sure"))
        alike = lambda rooms: written(_verified(rooms, docs, id_col, text_col, shingle, similarity), "simhash-alike")
        # near ones against the first of their component; then all that is not joined by that
        certain = alike(_centred(written(within(named(found.filter("sure").select("a", "b"), "sure")), "simhash-near")))
        comp = components(certain.unionByName(alike(_blocks(written(within(named(certain, "sure")), "simhash-loose")))))
    named = reps.join(comp, F.col("rep") == F.col("node"), "left").select(*one, F.coalesce("component", "rep").alias("component"))
    out = prints.join(named, one, "left")
    return out.select("id", "n", *fs, F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


#: Of 256 bits.  A shingle vector at cosine c differs in arccos(c) / pi of the bits: texts that share 0.8 of their shingles
#: (Jaccard) in 39 of them, with a standard deviation of 6.  Pairs within SURE are verified first; RADIUS is the least radius.
SURE, RADIUS, LANES = 24, 52, 4


@tidy
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, sure: int = SURE, lanes: int = LANES) -> DataFrame:
    """docs without those that are near copies of one with a smaller id; null ids stay; all columns are kept."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius, lanes, sure, similarity)
    gone = found.filter(F.col("id") > F.col("component")).select(F.col("id").alias(id_col)).distinct()
    return anti_join(docs, gone, id_col)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return d.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
