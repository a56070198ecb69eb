"""LM scoring by a probabilistic suffix tree over words, of parameter depth, kept sharded.

Tokens are a text's words, A-Z lower-cased, and one end.  The root's distribution is the unigram one, (c + 0.1) /
(N + 0.1 (V + 1)).  A context of 1 to ``depth`` words that training texts have ``min_count`` times or more comes into
question as a state.  It is retained where its next words diverge from those behind its own suffix (one word less) by
more than they cost: the count times the Kullback-Leibler divergence of the two, in nats, exceeds ``penalty`` for each
different next word beyond the first.  So the tree grows with the corpus, and nothing but counts bounds it.  A state s with C
occurrences and K different next words gives w the probability (c - discount) / C + discount K / C * p(w), where c is
how often w follows (the first term is 0 without it) and p is that of the longest retained suffix of s: every state's
distribution sums to one.  A token is scored by the longest retained suffix of what stands before it.

Neither counts nor tree ever meet in one place.  Texts are cut into blocks of ``block_bytes``, which stay where they
are; a block asks for the sums of its own keys (words, word sequences by a 64-bit hash, contexts) and adds what it has
to them; keys are dealt out by hash, a message holds all of a block's keys for one of them, and the answers come back
in the order asked.  So a key of any frequency is one number a block.  Longer sequences are asked for only where their
context can still be a state and does not yet determine the next word, which most places in copied text do early.

Defined results: a null or empty text is its end alone; a null id is hashed like the empty string; repeated rows are
counted and scored each; without training texts every token is unknown; an empty table gives no rows; very long texts
are a block of their own; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import drop_written, table, tidy, written

#: Stands for the end; no word can be empty.
END = b""
ALPHA = 0.1
DEPTH = 5
MIN_COUNT = 2
PENALTY = 4.0
DISCOUNT = 0.75
BLOCK_BYTES = 6 << 20
#: How tables between the steps are written: their values are long and all different, so that a dictionary is of no use.
STORED = {"compression": "zstd", "parquet.enable.dictionary": "false"}
#: Gains and shares are summed as whole numbers of these parts, so that sums do not depend on their order; a context of
#: more than 65,000 occurrences may have its number of next words off by one in 130,000 of them.
GAIN, SHARE = 1 << 8, 1 << 16


def tokens(text: str | None) -> list[bytes]:
    t = (text or "").encode("utf-8", "surrogatepass").lower().split()
    t.append(END)
    return t


def held_out(id_col: Column, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, ascending; the place of each key among them)"""
    n, low, bits = len(keys), np.uint64((1 << 21) - 1), np.uint64(21)
    order, new = None, np.ones(n, bool)
    if n <= 1 << 21:  # upper bits and place are sorted as one number, which is several times as fast as an argsort
        s = keys & ~low
        s |= np.arange(n, dtype=np.uint64)
        s.sort()
        order = (s & low).view(np.int64)
        k = keys[order]
        np.not_equal(k[1:], k[:-1], out=new[1:])
        s >>= bits
        if (new[1:] & (s[1:] == s[:-1])).any():
            order = None  # keys that differ in the lower bits alone
    if order is None:
        order = np.argsort(keys)
        k = keys[order]
        np.not_equal(k[1:], k[:-1], out=new[1:])
    rank = np.cumsum(new)
    rank -= 1
    place = np.empty(n, np.int64)
    place[order] = rank
    return k[new], place


def summed(place: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Whole numbers added up by place; exact."""
    if not len(values) or float(np.abs(values).sum(dtype=np.float64)) < 1 << 52:  # doubles hold all partial sums
        return np.bincount(place, weights=values, minlength=n).astype(np.int64)
    out = np.zeros(n, np.int64)
    order = np.argsort(place, kind="stable")
    at = np.flatnonzero(np.diff(place[order], prepend=-1))
    out[place[order][at]] = np.add.reduceat(values[order], at)
    return out


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs, which the first byte says; from three on, first all
    the lowest bytes, then all the next: the upper ones are mostly 0 and cost next to nothing once compressed."""
    top = int(x.max()) if len(x) else 0
    width = max(1, -(-top.bit_length() // 8))
    if width <= 2:
        return bytes([width]) + x.astype(f"<u{width}").tobytes()
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(b: bytes, kind=np.int64) -> np.ndarray:
    width = b[0]
    if width <= 2:
        return np.frombuffer(b, f"<u{width}", offset=1).astype(kind)
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1)
    wide = np.uint64 if width > 4 else np.uint32
    out = planes[0].astype(wide)
    for k in range(1, width):
        out |= planes[k].astype(wide) << wide(8 * k)
    return out.astype(kind, copy=False)


def _counts(b: bytes) -> np.ndarray:
    """Unsigned numbers as they were packed, in half the memory where they are small."""
    return _unpacked(b, np.int32 if b[0] <= 3 else np.int64)


def _folded(x: np.ndarray) -> bytes:
    """Signed numbers, packed: small ones of either sign take few bytes."""
    return _packed(((x << 1) ^ (x >> 63)).view(np.uint64))


def _unfolded(b: bytes) -> np.ndarray:
    u = _unpacked(b, np.uint64)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def _bytes_of(words: pa.Array) -> list[bytes]:
    """Strings without nulls as bytes, cut from their buffer, which is several times as fast as ``to_pylist``."""
    if not len(words):
        return []
    wide = pa.types.is_large_string(words.type)
    at = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    whole = words.buffers()[2].to_pybytes() if at[-1] else b""
    return [whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


class Block:
    """Texts of one block as numbers: a code for each token, and for each code a hash and the word's count.

    seen[n][i] is how often the n tokens that end at i occur in training texts; 0 also stands for what cannot matter,
    and for places that have fewer tokens.  Places are taken by number, level by level: each level has fewer of them.
    """

    def __init__(self, lens: np.ndarray, learn: np.ndarray, codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray | None = None, seen: list[np.ndarray] | None = None):
        self.lens, self.learn, self.codes, self.hashes, self.counts = lens, learn, codes, hashes, counts
        self.seen = [np.array([]), *([] if counts is None else [counts[codes]]), *(seen or [])]
        self.starts = np.cumsum(lens) - lens
        self.train = np.repeat(learn, lens)
        self._bytes: list[bytes] = []

    @classmethod
    def of_texts(cls, texts: pa.Array, learn: np.ndarray) -> tuple[Block, list[bytes]]:
        """The block, and its words by code; texts are strings.  The tokens are those of ``tokens``."""
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat, many = parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False)
        some = pc.greater(pc.binary_length(flat), 0)
        upto = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(some.to_numpy(zero_copy_only=False), out=upto[1:])
        lens = np.diff(upto[np.cumsum(many)], prepend=0) + 1
        coded = flat.filter(some).dictionary_encode()
        words = [END, *_bytes_of(coded.dictionary)]
        codes, word = np.zeros(int(lens.sum()), np.int64), np.ones(int(lens.sum()), bool)
        word[np.cumsum(lens) - 1] = False  # an end, 0, behind each text
        codes[word] = coded.indices.to_numpy().astype(np.int64) + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return cls(lens.astype(np.int64), np.asarray(learn, bool), codes, hashes), words

    def packed(self) -> list[bytes]:
        if not self._bytes:
            c = self.codes
            self._bytes = [self.learn.tobytes(), _packed(self.lens), (c & 0xFFFF).astype("<u2").tobytes(), _packed(c >> 16), self.hashes.tobytes()]
        if self.counts is not None:
            known = [self.counts, *self.seen[2:]]
            self._bytes += map(_packed, known[len(self._bytes) - 5 :])
        return self._bytes

    @classmethod
    def of_packed(cls, b: list[bytes]) -> Block:
        codes = np.frombuffer(b[2], "<u2").astype(np.int64)
        if (upper := _unpacked(b[3])).any():
            codes |= upper << 16
        out = cls(_unpacked(b[1]), np.frombuffer(b[0], bool), codes, np.frombuffer(b[4], np.uint64), _counts(b[5]) if len(b) > 5 else None, [_counts(x) for x in b[6:]])
        out._bytes = list(b)
        return out

    def word_counts(self) -> np.ndarray:
        """How often the training texts of the block have each of its words."""
        return np.bincount(self.codes[self.train], minlength=len(self.hashes)).astype(np.int64)

    def grams(self, n: int, i: np.ndarray) -> np.ndarray:
        """A hash of the n tokens that end at each place of i, all of which have as many."""
        word, out = self.hashes * np.uint64(0xC2B2AE3D27D4EB4F), np.empty(len(i), np.uint64)
        for at in range(0, len(i), 1 << 14):  # a few pages at a time, which stay in the cache
            j = i[at : at + (1 << 14)] - (n - 1)
            x = self.hashes[self.codes[j]]
            for k in range(2, n + 1):
                j += 1
                x *= np.uint64(0x9E3779B97F4A7C15)
                x += word[self.codes[j]]
                x += np.uint64(k)
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(29)
            out[at : at + (1 << 14)] = x
        return out

    def before(self, x: np.ndarray) -> np.ndarray:
        """x as it stands one place before each place; 0 in front of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = 0
        return out

    def determined(self, up_to: int, min_count: int) -> np.ndarray:
        """Whether a context of fewer than ``up_to`` words has no other next word: then longer ones have none either."""
        out = np.zeros(len(self.codes), bool)
        for m in range(1, up_to):
            c = self.before(self.seen[m])
            out |= (c >= min_count) & (self.seen[m + 1] == c)
        return out

    def asked(self, levels: list[int], done: np.ndarray, min_count: int) -> list[np.ndarray]:
        """For each n of the levels the places whose last n tokens are to be counted, by what is known of fewer than the first.

        They are the same for equal tokens anywhere: the n tokens, and those before each, can be a state's.  A context
        that occurs has all its words in the text, so that nothing in front of a text is asked for.
        """
        known = self.seen[levels[0] - 1]
        out = [np.flatnonzero((self.before(known) >= min_count) & (known >= 1) & ~done)]
        for n in levels[1:]:
            i = out[-1]
            out.append(i[known[i - (n - levels[0] + 1)] >= min_count])
        return out

    def count_keys(self, levels: list[int], done: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(keys, the place among them of every asked place level by level, which places are asked)"""
        where = self.asked(levels, done, min_count)
        keys, place = grouped(np.concatenate([self.grams(n, i) for n, i in zip(levels, where, strict=True)]))
        return keys, place, where

    def count_ask(self, levels: list[int], min_count: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, place, where = self.count_keys(levels, self.determined(levels[0] - 1, min_count), min_count)
        mine = np.concatenate([self.train[i] for i in where])
        return keys, [np.bincount(place[mine], minlength=len(keys)).astype(np.int64)]

    def count_take(self, levels: list[int], min_count: int, answers: np.ndarray) -> None:
        done = self.determined(levels[0] - 1, min_count)
        _, place, where = self.count_keys(levels, done, min_count)
        if len(answers) and int(answers.max()) < 1 << 31:
            answers = answers.astype(np.int32)
        at = 0
        for n, i in zip(levels, where, strict=True):
            c = self.before(self.seen[n - 1])
            found = np.where(done, c, 0).astype(np.promote_types(c.dtype, answers.dtype), copy=False)
            found[i] = answers[place[at : at + len(i)]]
            at += len(i)
            self.seen.append(found)
            if n < levels[-1]:
                done |= (c >= min_count) & (found == c)

    def contexts(self, depth: int, min_count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth k the places with a context of k words that can be a state, its count, that with the next word, and which of the places before they are.

        A context of k words is as frequent as one of k + 1 at least, so that places become fewer.
        """
        for k in range(1, depth + 1):
            c = self.before(self.seen[1]) if k == 1 else self.seen[k][i - 1]
            ok = c >= min_count
            i, c = np.flatnonzero(ok) if k == 1 else i[ok], c[ok]
            yield i, c, self.seen[k + 1][i], ok

    def state_keys(self, depth: int, min_count: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
        """(keys, places among them, (where, count, count with the next word, which of the places before, which need sums) by level).

        Keys are of contexts that have other next words too; what determines its next word needs no sums.
        """
        levels = [(*x, x[2] < x[1]) for x in self.contexts(depth, min_count)]
        i, _, _, _, other = levels[0]
        word = self.codes[i[other] - 1]  # contexts of one word are told apart by their codes, unsorted
        there = np.bincount(word, minlength=len(self.hashes)) > 0
        rank = np.cumsum(there) - 1
        longer, place = grouped(np.concatenate([np.array([], np.uint64), *(self.grams(k, i[other] - 1) for k, (i, _, _, _, other) in enumerate(levels[1:], 2))]))
        keys, to = grouped(np.concatenate([self.hashes[there], longer]))
        place += np.count_nonzero(there)
        return keys, to[np.concatenate([rank[word], place])], levels

    def state_ask(self, depth: int, min_count: int, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums by context over the training texts: gain, and 1 / count of each next word, which add up to how many there are."""
        keys, place, levels = self.state_keys(depth, min_count)
        mine, gain, share = [], [], []
        for k, (i, c, with_w, _, other) in enumerate(levels, 1):
            i, c, with_w = i[other], c[other], with_w[other]
            mine.append(self.train[i])
            i, c, with_w = i[mine[-1]], c[mine[-1]], with_w[mine[-1]]
            up_w = self.seen[k][i]
            up = total if k == 1 else self.seen[k - 1][i - 1]
            gain.append(np.rint(np.log(with_w / c * (up / up_w)) * GAIN).astype(np.int64))
            share.append(np.rint(SHARE / with_w).astype(np.int64))
        at = place[np.concatenate(mine)]
        return keys, [summed(at, len(keys), np.concatenate(x)) for x in (gain, share)]

    def scores(self, depth: int, min_count: int, discount: float, total: int, distinct: int, answers: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text n_tokens, n_known, base score and score; answers as ``state_answer`` gives them."""
        _, place, levels = self.state_keys(depth, min_count)
        word = (self.counts + ALPHA) / (total + ALPHA * (distinct + 1))
        p, at = word[self.codes], 0
        fixed = np.zeros(len(p), bool)  # whether the context one word shorter determines its next word
        for i, c, with_w, ok, other in levels:
            kinds = np.zeros(len(i), np.int64)
            n = int(other.sum())
            kinds[other] = answers[place[at : at + n]]
            at += n
            determines = kinds == 0  # this next word, or one that does not stand here
            kept = (kinds > 0) | (determines & ~fixed[ok])
            j, left = i[kept], discount * np.maximum(kinds[kept], 1)
            p[j] = (np.maximum(with_w[kept] - discount, 0) + left * p[j]) / c[kept]
            fixed = determines
        add = lambda x: np.add.reduceat(x, self.starts)
        return self.lens, add((self.counts > 0).astype(np.int64)[self.codes]), add(np.log10(word)[self.codes]), add(np.log10(p))


def state_answer(gain: np.ndarray, share: np.ndarray, penalty: float) -> np.ndarray:
    """How many next words a state has, negative if it is not retained; 0 for a context with one next word."""
    kinds = np.rint(share / SHARE).astype(np.int64)
    return np.where(gain > penalty * GAIN * (kinds - 1), kinds, -kinds)


def rounds_of(depth: int) -> list[list[int]]:
    """Lengths of sequences that are counted in one round: few are left to be asked for beyond three tokens."""
    longer = list(range(4, depth + 2))
    return [[n] for n in (2, 3) if n <= depth + 1] + [longer[i : i + 3] for i in range(0, len(longer), 3)]


_ASK = "p int, block long, keys binary, sums array<binary>"
_ANSWER = "block long, p int, answer binary"


def _batch(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _dealt(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending keys: a part is a range of their upper halves."""
    if not len(keys):
        return []
    p = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.diff(p.astype(np.int64), prepend=-1))
    return list(zip(p[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True))


_apart = False


def _settled() -> None:
    """Sets apart what a worker has imported: Spark has it collect garbage behind each task, which else walks through all of it."""
    global _apart
    if not _apart:  # asking gc how much is apart would count it all
        gc.collect()
        gc.freeze()
        _apart = True


def _read(address: str, columns: list[str]) -> pa.Table:
    """Columns of the one row in a file that a finished job wrote to the shared folder, by the address that Spark gives."""
    from pyarrow import fs, parquet

    _settled()
    store, path = fs.FileSystem.from_uri(address)
    with store.open_input_file(path) as file:
        return parquet.read_table(file, columns=columns, use_threads=False)


def _messages(states: DataFrame, parts: int, ask) -> DataFrame:
    """What the blocks ask: keys ascending, and the sums that they bring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, address in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, sums = ask(Block.of_packed(_read(address, ["state"]).column("state")[0].as_py()))
                rows = [(p, block, keys[x:y].tobytes(), [_folded(s[x:y]) for s in sums]) for p, x, y in _dealt(keys, parts)]
                if rows:
                    yield _batch(rows, ("p", "block", "keys", "sums"), (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())))

    return states.select("block", F.input_file_name().alias("address")).mapInArrow(run, _ASK).repartition(parts, "p")


def _answers(messages: DataFrame, name: str, answer=lambda s: s) -> DataFrame:
    """The sums of all blocks for each key, in the order asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, keys, sums = [], [], []
        for b in batches:
            for p, block, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where.append((block, p, len(k) // 8))
                keys.append(np.frombuffer(k, np.uint64))
                sums.append([_unfolded(x) for x in s])
        if not where:
            return
        different, place = grouped(np.concatenate(keys))
        total = answer(*(summed(place, len(different), np.concatenate(x)) for x in zip(*sums, strict=True)))
        at = 0
        for i in range(0, len(where), 64):
            rows = []
            for block, p, n in where[i : i + 64]:
                rows.append((block, p, _folded(total[place[at : at + n]])))
                at += n
            yield _batch(rows, ("block", "p", "answer"), (pa.int64(), pa.int32(), pa.binary()))

    return written(messages.mapInArrow(run, _ANSWER), name, **STORED)


def _told(states: DataFrame, answers: DataFrame, parts: int, f, schema: str) -> DataFrame:
    """f(block number, ids, block, its answers) for each block: a table of the schema.

    Only answers travel.  A block lies in a file of its own, of a table that a finished job wrote to the shared folder;
    the task that gets its answers reads that file (through ``pyarrow.fs``, by the address that Spark gives).
    """
    where = states.select("block", F.lit(-1).alias("p"), F.input_file_name().cast("binary").alias("answer"))

    def run(key, t):
        order = np.argsort(t.column("p").to_numpy())
        got = t.column("answer").take(pa.array(order)).to_pylist()  # the address stands in front of the answers
        own = _read(got[0].decode(), ["block", "ids", "state"])
        if own.column("block").to_pylist() != [key[0].as_py()]:
            raise ValueError(f"{got[0].decode()} does not hold block {key[0]}")
        block = Block.of_packed(own.column("state")[0].as_py())
        return f(key[0].as_py(), own.column("ids").combine_chunks(), block, np.concatenate([np.array([], np.int64), *map(_unfolded, got[1:])]))

    both = where.unionByName(answers.select("block", "p", "answer"))
    return both.repartition(parts, "block").groupBy("block").applyInArrow(run, schema)


def _cut(rows: DataFrame, schema: str, block_bytes: int) -> DataFrame:
    """Blocks of the rows (id, text, learn) as they lie: block, ids, state and words (by code, joined by spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, n = 0, 0

        def out():
            ids, texts, learn = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            block, words = Block.of_texts(texts, learn.to_numpy(zero_copy_only=False))
            number = TaskContext.get().partitionId() << 32 | n
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number]), whole, pa.array([block.packed()], pa.list_(pa.binary())), pa.array([b" ".join(words)], pa.binary())], names=["block", "ids", "state", "words"])

        for b in batches:
            at = 0
            for i, nbytes in enumerate(pc.binary_length(b.column(1)).fill_null(0).to_pylist()):
                size += nbytes
                if size >= block_bytes:
                    held.append(b.slice(at, i + 1 - at))
                    yield out()
                    held, size, n, at = [], 0, n + 1, i + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield out()

    return written(rows.mapInArrow(run, f"{schema}, words binary"), "lm-blocks", maxRecordsPerFile=1, **STORED)


def _word_answers(blocks: DataFrame, parts: int) -> DataFrame:
    """Counts of words in all training texts, by the words themselves; block -1: how many tokens and different words a part has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, address in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = _read(address, ["state", "words"])
                block, words = Block.of_packed(own.column("state")[0].as_py()), pc.split_pattern(own.column("words").cast(pa.string()), " ").chunk(0).flatten()
                order, mine = np.argsort(block.hashes), block.word_counts()
                dealt = _dealt(block.hashes[order], parts)
                by_part = pa.ListArray.from_arrays(pa.array([*(x for _, x, _ in dealt), len(order)], pa.int32()), words.take(pa.array(order)))
                joined = pc.binary_join(by_part, " ").cast(pa.binary()).to_pylist()
                rows = [(p, number, w, [_folded(mine[order[x:y]])]) for (p, x, y), w in zip(dealt, joined, strict=True)]
                yield _batch(rows, ("p", "block", "keys", "sums"), (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary())))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, words, counts = [], [], []
        for b in batches:
            for p, block, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words.append(k)
                counts.append(_unfolded(s[0]))
                where.append((block, p, len(counts[-1])))
        if not where:
            return
        coded = pc.split_pattern(pa.array(words, pa.string()), " ").flatten().dictionary_encode()
        total = summed(coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), np.concatenate(counts))
        place = coded.indices.to_numpy()
        rows, at = [(-1, 0, _folded(np.array([total.sum(), (total > 0).sum()], np.int64)))], 0
        for block, p, n in where:
            rows.append((block, p, _folded(total[place[at : at + n]])))
            at += n
        yield _batch(rows, ("block", "p", "answer"), (pa.int64(), pa.int32(), pa.binary()))

    asked = blocks.select("block", F.input_file_name().alias("address")).mapInArrow(ask, _ASK).repartition(parts, "p")
    return written(asked.mapInArrow(answer, _ANSWER), "lm-answers", **STORED)


@tidy
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, depth: int = DEPTH, min_count: int = MIN_COUNT, penalty: float = PENALTY, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; train says which rows are learnt from."""
    if depth < 1 or not 0 < discount < 1:
        raise ValueError("depth must be one at least, discount between 0 and 1")
    learn = ~held_out(F.col(id_col)) if train is None else train
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    schema = f"block long, ids array<{kind}>, state array<binary>"
    states = _cut(rows, schema, block_bytes)
    parts = max(1, states.count())

    answers = _word_answers(states, parts)
    sums = [_unfolded(r["answer"]) for r in answers.filter("block = -1").collect()]  # two numbers a part
    total, distinct = (int(sum(int(s[i]) for s in sums)) for i in (0, 1))

    def kept(number: int, ids, block: Block) -> pa.Table:
        return pa.table([pa.array([number], pa.int64()), ids, pa.array([block.packed()], pa.list_(pa.binary()))], names=["block", "ids", "state"])

    def with_words(number, ids, block, got):
        counts = np.empty(len(block.hashes), np.int64)
        counts[np.argsort(block.hashes)] = got
        block.counts = counts
        return kept(number, ids, block)

    def step(f, name="lm-states"):
        nonlocal states, answers
        after = written(_told(states.filter("block >= 0"), answers.filter("block >= 0"), parts, f, schema), name, maxRecordsPerFile=1, **STORED)
        drop_written(states)
        drop_written(answers)
        states = after

    step(with_words)
    for levels in rounds_of(depth):

        def counted(number, ids, block, got, levels=levels):
            block.count_take(levels, min_count, got)
            return kept(number, ids, block)

        answers = _answers(_messages(states, parts, lambda b, levels=levels: b.count_ask(levels, min_count)), "lm-answers")
        step(counted)
    answers = _answers(_messages(states, parts, lambda b: b.state_ask(depth, min_count, total)), "lm-answers", lambda g, s: state_answer(g, s, penalty))

    def end(number, ids, block, got):
        n, known, base, own = block.scores(depth, min_count, discount, total, distinct, got)
        return pa.table([ids.flatten(), pa.array(block.learn), *(pa.array(x, t) for x, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (own, pa.float64())))], names=["id", "learn", "n_tokens", "n_known", "base_score", "score"])

    scored = _told(states, answers, parts, end, f"id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
