"""LM scoring by deleted interpolation.

Tokens are the lower-cased words of a text and its end; events are the words of the training texts and one class for all
others, as in the baseline.  Three maximum-likelihood levels are mixed: uniform, unigram, and a bigram of words.  Every
pair of neighbouring words is counted exactly, whatever its rank.  The bigram's weight depends on the frequency bucket of
its context, the word before.
A deleted part of the training texts stays out of the model's counts; on its counts expectation-maximisation learns the
weights, and the share of tokens that are new there is the probability of an unknown word.  Scores use the counts of all
training texts.

Counts are unbounded.  The most frequent words (a bounded head, see pieces.py) have numbers that every task knows; all
others travel as bytes.  Pairs are dealt to owners, whose number follows the tokens: a pair of head words by its hash, any
other by its first word outside the head, whose count the owner knows.  They move as sorted, compressed columns (`packed`).
The most frequent pairs are scored where a text is read; every other pair of a run of texts meets its counts at its owner,
which returns a sum for each text.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import fold_of, table, written
from mnemo.llm.pieces import HEAD_TERMS, head_condition

#: Frequency buckets of a context: 0, then octaves.
BUCKETS = 48
#: One training text in so many is deleted from the counts and teaches the weights.
DELETED = 100
EM_STEPS = 15
#: Tokens of a run of texts, after which a task hands its pairs on, and tokens an owner of pairs serves.
RUN_TOKENS = 1 << 20
OWNER_TOKENS = 1 << 20
#: Bytes of text that are split into words at once, and that are counted at once; a longer text is one piece.
SPLIT_BYTES, COUNT_BYTES = 1 << 20, 1 << 22
#: Tasks that owners are dealt to, at most, unless the session shuffles to more.
MOST_TASKS = 4096
#: Sums return from owners in units of 1e-9.
UNIT = 1e9
#: Frequencies that part the levels of frequent pairs, an eighth of an octave each.
LEVELS = np.unique(np.ceil(2.0 ** (np.arange(8 * 48) / 8)).astype(np.int64))
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)
TRAINING, APART, HELD, WORDS = range(4)


def pieces_of(batch: pa.RecordBatch, column: int, most: int):
    """The rows of a batch in slices of at most so many bytes of text, or of one row."""
    ends, lo = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A to Z lower-cased, parted at exactly the six separators, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, many = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a text's border separators leave empty ones
    if not real.all():
        words, many = words.filter(pa.array(real)), np.bincount(np.repeat(np.arange(len(many)), many)[real], minlength=len(many))
    return words, many


def _count_words(batches):
    for whole in batches:
        for b in pieces_of(whole, 0, COUNT_BYTES):
            for apart in (False, True):
                seen = pc.value_counts(words_of(b.column(0).filter(pc.equal(b.column(1), apart)))[0])
                term, n = seen.field(0).cast(pa.binary()), seen.field(1)
                none = pa.array(np.zeros(len(n), dtype=np.int64))
                rows = pa.record_batch([term, n, n if apart else none], names=["term", "n", "d"])
                yield from (rows.slice(i, 100_000) for i in range(0, rows.num_rows, 100_000))
            pa.default_memory_pool().release_unused()  # a worker would keep it for later tasks


def packed(words: list[bytes], *columns: np.ndarray) -> bytes:
    """Words and equally long columns of 64-bit values; the first column as differences, all by byte planes, compressed."""
    text = b" ".join(words)
    columns = [np.ascontiguousarray(c).view(np.uint64) for c in columns]
    columns[0] = np.diff(columns[0], prepend=np.uint64(0))
    widths = [(int(c.max()).bit_length() + 7) // 8 if len(c) else 0 for c in columns]
    planes = [c.view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True)]
    sizes = np.array([len(text), len(words), len(columns[0]), len(columns), *widths], dtype=np.int64).tobytes()
    whole = b"".join([sizes, text, *planes])
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(whole, asbytes=True)


def unpacked(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    whole = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    size, n_words, rows, n_columns = np.frombuffer(whole, dtype=np.int64, count=4).tolist()
    widths = np.frombuffer(whole, dtype=np.int64, count=n_columns, offset=32).tolist()
    at = 32 + 8 * n_columns
    words = whole[at : at + size].split(b" ") if n_words else []
    at, columns = at + size, []
    for w in widths:
        cells = np.zeros((rows, 8), dtype=np.uint8)
        cells[:, :w] = np.frombuffer(whole, dtype=np.uint8, count=w * rows, offset=at).reshape(w, rows).T
        columns.append(cells.view(np.uint64).ravel())
        at += w * rows
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return words, columns


class Numbers:
    """Numbers of words in a run: 0 stands before and after each text, head words have theirs everywhere, others follow."""

    def __init__(self, head: dict[bytes, int]):
        self.head, self.size, self.own = head, len(head), {}

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all texts, and how many each text has; different words are looked up once."""
        words, many = words_of(texts)
        words = words.dictionary_encode()
        names = words.dictionary.cast(pa.binary()).to_pylist()
        found = np.fromiter(map(self.head.get, names, repeat(0)), dtype=np.uint64, count=len(names))
        own, first = self.own, self.size + 1
        for i in np.flatnonzero(found == 0).tolist():
            found[i] = own.setdefault(names[i], first + len(own))
        many = many + 1
        inside = np.ones(int(many.sum()) + 1, dtype=bool)
        inside[0] = False
        inside[np.cumsum(many)] = False
        at = np.zeros(len(inside), dtype=np.uint64)
        at[inside] = found[words.indices.to_numpy(zero_copy_only=False)]
        return at[:-1] << _HIGH | at[1:], many

    def dealt(self, keys: np.ndarray, columns: list[np.ndarray], owners: int):
        """(owner, packed words, first, second, columns) of sorted pairs; the words of a pack are numbered there."""
        first, second, size = keys >> _HIGH, keys & _LOW, np.uint64(self.size)
        own = list(self.own)
        of = np.array([0, *map(zlib.crc32, own)], dtype=np.uint64)
        place = lambda x: np.where(x > size, x - size, np.uint64(0)).astype(np.int64)
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> _HIGH
        owner = np.where(first > size, of[place(first)], np.where(second > size, of[place(second)], mixed)) % np.uint64(owners)
        order = np.argsort(owner.astype(np.uint16) if owners <= 1 << 16 else owner, kind="stable")  # 16 bits are sorted by radix
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for x in np.split(order, cuts) if len(order) else ():
            a, b = first[x], second[x]
            used = np.unique(np.concatenate([a[a > size], b[b > size]]))
            near = lambda c: np.where(c > size, size + np.uint64(1) + np.searchsorted(used, c).astype(np.uint64), c)  # noqa: B023, E731
            yield int(owner[x[0]]), packed([own[i] for i in (used - size - np.uint64(1)).tolist()], near(a), near(b), *(c[x] for c in columns))


def _count_pairs(shared, owners: int):
    """(owner, kind, blob): pairs of runs of texts with their counts, apart for training, deleted and held-out texts."""
    most = RUN_TOKENS

    def run(batches):
        numbers, seen, size = Numbers(shared.value[0]), ([], [], []), 0
        for whole in batches:
            for b in pieces_of(whole, 0, SPLIT_BYTES):
                pairs, many = numbers.pairs(b.column(0))
                held, apart = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                kinds = np.repeat(np.where(held, HELD, np.where(apart, APART, TRAINING)), many)
                for kind, runs in enumerate(seen):
                    runs.append(pairs[kinds == kind])
                size += len(pairs)
                if size > most:
                    yield from _pair_rows(numbers, seen, owners)
                    numbers, seen, size = Numbers(numbers.head), ([], [], []), 0
        yield from _pair_rows(numbers, seen, owners)

    return run


def _pair_rows(numbers: Numbers, seen: tuple[list, ...], owners: int):
    for kind, runs in enumerate(seen):
        if sum(map(len, runs)):
            keys, times = np.unique(np.concatenate(runs), return_counts=True)
            for owner, blob in numbers.dealt(keys, [times], owners):
                yield pa.record_batch([pa.array([owner], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["owner", "kind", "blob"])
    pa.default_memory_pool().release_unused()


def _deal_words(owners: int):
    """(owner, kind, blob) of words outside the head with their counts."""

    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            counts = [b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            owner = np.array([zlib.crc32(w) for w in words], dtype=np.int64) % owners
            order = np.argsort(owner, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else ():
                blob = packed([words[i] for i in x.tolist()], *(c[x] for c in counts))
                yield pa.record_batch([pa.array([owner[x[0]]], pa.int32()), pa.array([WORDS], pa.int32()), pa.array([blob], pa.binary())], names=["owner", "kind", "blob"])

    return run


_COUNTED = pa.schema([("owner", pa.int32()), ("pairs", pa.binary()), ("words", pa.binary()), ("asks", pa.list_(pa.binary())), ("levels", pa.list_(pa.int64()))])


def _add_up(shared, owners: int):
    """An owner's pairs with their counts, the counts of its words, and the words that other owners know."""

    def run(key, group):
        owner, size = key[0].as_py(), len(shared.value[0])
        own, known, keys, n, d = {}, {}, [], [], []
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
            words, (first, second, *rest) = unpacked(blob)
            if kind == WORDS:
                known.update(zip(words, zip(first.tolist(), second.tolist(), strict=True), strict=True))
                continue
            keys.append(_renumbered(words, first, second, own, size))
            n.append(rest[0] if kind != HELD else np.zeros_like(rest[0]))
            d.append(rest[0] if kind == APART else np.zeros_like(rest[0]))
        if not keys:
            return _COUNTED.empty_table()
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        n2, d2 = (np.bincount(at, np.concatenate(x), len(pairs)).astype(np.int64) for x in (n, d))
        words = list(own)
        asked = np.array([zlib.crc32(w) % owners != owner for w in words], dtype=np.int64)
        counts = np.array([known.get(w, (0, 0)) for w in words], dtype=np.int64).reshape(-1, 2)
        frequent = n2[((pairs >> _HIGH) <= size) & ((pairs & _LOW) <= size) & (n2 > 0)]
        levels = np.bincount(np.searchsorted(LEVELS, frequent, "right") - 1, minlength=1)
        asks = [w for w, x in zip(words, asked.tolist(), strict=True) if x]
        row = {"owner": [owner], "pairs": [packed(words, pairs >> _HIGH, pairs & _LOW, n2, d2)], "words": [packed([], asked, counts[:, 0], counts[:, 1])], "asks": [asks], "levels": [levels.tolist()]}
        return pa.table(row, schema=_COUNTED)

    return run


def _renumbered(words: list[bytes], first: np.ndarray, second: np.ndarray, own: dict[bytes, int], size: int) -> np.ndarray:
    """Pairs of a pack by the owner's numbers of words, which grow by those that are new."""
    of = np.array([0, *(own.setdefault(w, size + 1 + len(own)) for w in words)], dtype=np.uint64)
    size = np.uint64(size)
    near = lambda c: np.where(c > size, of[np.where(c > size, c - size, np.uint64(0)).astype(np.int64)], c)
    return near(first) << _HIGH | near(second)


class Pairs:
    """The pairs of an owner, unpacked: keys in order, n2, d2, and counts of both words; -1 where another owner knows."""

    def __init__(self, pairs: bytes, words: bytes, head: tuple, answers: dict[bytes, tuple[int, int]]):
        self.words, (first, second, n2, d2) = unpacked(pairs)
        asked, n, d = (x.view(np.int64) for x in unpacked(words)[1])
        if len(asked) and asked.any():
            far = np.flatnonzero(asked)
            told = np.array([answers.get(self.words[i], (-1, -1)) for i in far.tolist()], dtype=np.int64)
            n, d = n.copy(), d.copy()
            n[far], d[far] = told[:, 0], told[:, 1]
        self.size, self.keys = len(head[0]), first << _HIGH | second
        all_n, all_d = np.concatenate([head[1], n]), np.concatenate([head[2], d])
        first, second = first.astype(np.int64), second.astype(np.int64)
        self.first, self.second, self.n2, self.d2 = first, second, n2.view(np.int64), d2.view(np.int64)
        self.nc, self.dc, self.n1, self.d1 = all_n[first], all_d[first], all_n[second], all_d[second]


def _pair_table(shared):
    """Rows (ctx, term, n2, d2, nc, dc, n1, d1) of owners' pairs; n1 and d1 are -1 where another owner knows them."""

    def run(batches):
        names = [b"", *shared.value[0]]
        for b in batches:
            for blob, counts, least, deleted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                p = Pairs(blob, counts, shared.value, {})
                text = names + p.words
                wanted = np.flatnonzero((p.d2 >= deleted) & ((p.n2 >= least) & (p.first <= p.size) & (p.second <= p.size) if least else True))
                for lo in range(0, len(wanted), 100_000):
                    x = wanted[lo : lo + 100_000]
                    words = [pa.array([text[i] for i in c[x].tolist()], pa.binary()) for c in (p.first, p.second)]
                    yield pa.record_batch(words + [pa.array(c[x]) for c in (p.n2, p.d2, p.nc, p.dc, p.n1, p.d1)], names=["ctx", "term", "n2", "d2", "nc", "dc", "n1", "d1"])

    return run


def counted_pairs(texts: DataFrame, terms: DataFrame, shared, owners: int, tasks: int) -> DataFrame:
    """A row an owner: owner, pairs, words, asks (words of other owners), levels (frequencies of pairs of head words)."""
    runs = texts.select("t", "held_out", "apart").mapInArrow(_count_pairs(shared, owners), "owner int, kind int, blob binary")
    words = terms.select("term", "n", "d").mapInArrow(_deal_words(owners), "owner int, kind int, blob binary")
    dealt = runs.unionByName(words).repartition(tasks, "owner").groupBy("owner")
    return dealt.applyInArrow(_add_up(shared, owners), "owner int, pairs binary, words binary, asks array<binary>, levels array<long>")


def pair_rows(counted: DataFrame, terms: DataFrame, shared, least: int = 0, deleted: int = 0) -> DataFrame:
    """A row for every pair (ctx, term, n2, d2, nc, dc, n1, d1): training counts of the pair, of its context and of its
    word, each in all training texts and in their deleted part.  With `least`, only pairs of head words that occur so often
    in training; with `deleted`, only those that occur so often in the deleted part."""
    asked = counted.select("pairs", "words", F.lit(least), F.lit(deleted))
    rows = asked.mapInArrow(_pair_table(shared), "ctx binary, term binary, n2 long, d2 long, nc long, dc long, n1 long, d1 long")
    far = rows.where("n1 < 0").drop("n1", "d1").join(terms.select("term", F.col("n").alias("n1"), F.col("d").alias("d1")), "term", "left")
    return rows.where("n1 >= 0").unionByName(far.na.fill(0, ["n1", "d1"]))


def _bucket(c):
    return F.when(c > 0, F.length(F.bin(c))).otherwise(F.lit(0))


def learn_weights(pairs: DataFrame, n: int, v: int) -> tuple[np.ndarray, float, float]:
    """Bigram weights by bucket, the unigram's weight against uniform, and the probability of an unknown word.

    Every pair of the deleted texts meets its counts in the other training texts, n tokens.  The expectation sums are
    aggregates over that table; a row per bucket reaches the driver in each step.
    """
    before, c = F.col("nc") - F.col("dc"), F.col("n1") - F.col("d1")
    p2 = F.when(before > 0, (F.col("n2") - F.col("d2")) / before).otherwise(F.lit(0.0))
    seen = written(pairs.where("d2 > 0").select(_bucket(before).alias("bucket"), p2.alias("p2"), c.alias("c"), F.col("d2").alias("times")), "lm-deleted")
    known = seen.where("c > 0").select("bucket", "p2", (F.col("c") / float(max(n, 1))).alias("p1"), "times")
    count = seen.agg(F.sum("times").alias("all"), F.sum(F.when(F.col("c") == 0, F.col("times")).otherwise(F.lit(0))).alias("new")).first()
    unknown = ((count.new or 0) + 0.5) / ((count["all"] or 0) + 1.0)
    two, one = np.full(BUCKETS, 0.5), 0.9
    two[0] = 0.0
    for _ in range(EM_STEPS if count["all"] else 0):
        weight = F.element_at(F.lit(two.tolist()), F.col("bucket") + 1)
        w2, w1, w0 = weight * F.col("p2"), (1 - weight) * one * F.col("p1"), (1 - weight) * (1 - one) / max(v, 1)
        times = F.col("times") / (w2 + w1 + w0)
        got = known.groupBy("bucket").agg(F.sum(w2 * times).alias("a"), F.sum(w1 * times).alias("b"), F.sum("times").alias("n")).collect()
        for r in got:
            two[r.bucket] = (r.a + 0.5) / (r.n + 1.0) if r.bucket else 0.0
        a, b, m = (sum(x) for x in zip(*((r.a, r.b, r.n) for r in got), strict=True)) if got else (0.0, 0.0, 0)
        one = min(0.9999, (b + 0.5) / (m - a + 1.0))
    return np.minimum(two, 0.9999), one, unknown


def log_probability(n2, nc, n1, two: np.ndarray, one: float, unknown: float, n: int, v: int) -> np.ndarray:
    """log10 of the probability of a word after its context, by training counts of the pair, the context and the word."""
    weight = two[np.frexp(nc.astype(np.float64))[1]]
    mixed = weight * n2 / np.maximum(nc, 1) + (1 - weight) * (one * n1 / max(n, 1) + (1 - one) / max(v, 1))
    return np.log10(np.where(n1 > 0, (1 - unknown) * mixed, unknown))


def pair_scores(pairs: DataFrame, two: np.ndarray, one: float, unknown: float, n: int, v: int) -> DataFrame:
    """(term, n, base, lp, new) by pair: both words with a space between, training count, logs of its word's count + 1 and
    of its probability, and whether its word is unknown."""

    def run(batches):
        for b in batches:
            n2, nc, n1 = (b.column(i).to_numpy() for i in (1, 2, 3))
            lp = log_probability(n2, nc, n1, two, one, unknown, n, v)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.log10(n1 + 1.0)), pa.array(lp), pa.array((n1 == 0).astype(np.int64))], names=["term", "n", "base", "lp", "new"])

    both = pairs.select(F.concat("ctx", F.lit(b" "), "term").alias("term"), "n2", "nc", "n1")
    return both.mapInArrow(run, "term binary, n long, base double, lp double, new long")


def _score(shared, frequent, owners: int):
    """(owner, run, home, blob): what is known of each text of a run, at any owner, and its other pairs, at theirs."""
    most = RUN_TOKENS

    def run(batches):
        from pyspark import TaskContext

        head, n, _ = shared.value
        base, new = np.log10(n + 1.0), n == 0
        number = TaskContext.get().partitionId() << 32
        numbers, docs, size = Numbers(head), [], 0
        for whole in batches:
            for b in pieces_of(whole, 2, SPLIT_BYTES):
                pairs, many = numbers.pairs(b.column(2))
                ids, held = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
                docs.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), held, many, pairs))
                size += len(pairs)
                if size > most:
                    yield from _run_rows(number, numbers, docs, base, new, frequent.value, owners)
                    number, numbers, docs, size = number + 1, Numbers(head), [], 0
        if docs:
            yield from _run_rows(number, numbers, docs, base, new, frequent.value, owners)

    return run


def _run_rows(number: int, numbers: Numbers, docs: list, base, new, frequent: tuple, owners: int):
    size, (best, lp) = numbers.size, frequent
    ids, none, held, tokens, keys = (np.concatenate(x) for x in zip(*docs, strict=True))
    of = np.repeat(np.arange(len(ids)), tokens)
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    term = (keys & _LOW).astype(np.int64)
    near = term <= size
    total = lambda at, x: np.bincount(of[at], x, len(ids))
    base_sum, unknown = total(near, base[term[near]]), total(near, new[term[near]])
    at = np.minimum(np.searchsorted(best, keys), max(len(best) - 1, 0))
    found = best[at] == keys if len(best) else np.zeros(len(keys), dtype=bool)
    score = total(found, lp[at[found]])
    home = packed([], ids, none.astype(np.int64), held.astype(np.int64), tokens, unknown.astype(np.int64), base_sum, score)
    rows = [((number ^ number >> 32) % owners, True, home)]
    left, of = keys[~found], of[~found]
    first = np.flatnonzero(np.diff(left, prepend=~left[:1]) | (np.diff(of, prepend=-1) != 0).astype(np.uint64)) if len(left) else np.zeros(0, dtype=np.int64)
    times = np.diff(first, append=len(left))
    rows += [(owner, False, blob) for owner, blob in numbers.dealt(left[first], [of[first], times], owners)]
    for i in range(0, len(rows), 1000):
        owner, at_home, blobs = zip(*rows[i : i + 1000], strict=True)
        yield pa.record_batch([pa.array(owner, pa.int32()), pa.array([number] * len(owner), pa.int64()), pa.array(at_home), pa.array(blobs, pa.binary())], names=["owner", "run", "home", "blob"])
    pa.default_memory_pool().release_unused()


_RETURNED = pa.schema([("run", pa.int64()), ("home", pa.bool_()), ("blob", pa.binary())])


def _look_up(shared, weights: tuple):
    """Sums of an owner's pairs for the texts of each run; a run's home rows pass."""

    def run(counted, runs):
        table_of, rows = None, {"run": [], "home": [], "blob": []}
        counted = counted.to_pylist()
        answers = {r["term"]: (r["n"], r["d"]) for r in counted if r["pairs"] is None}
        for r in counted:
            if r["pairs"] is not None:
                table_of = Pairs(r["pairs"], r["words"], shared.value, answers)
                n1 = np.maximum(table_of.n1, 0)  # words that no owner knows are new
                lp, base, new = log_probability(table_of.n2, table_of.nc, n1, *weights), np.log10(n1 + 1.0), n1 == 0
                own = {w: table_of.size + 1 + i for i, w in enumerate(table_of.words)}
        for number, home, blob in zip(*(runs.column(c).to_pylist() for c in ("run", "home", "blob")), strict=True):
            if not home:
                words, (first, second, of, times) = unpacked(blob)
                keys = _renumbered(words, first, second, own, table_of.size)
                at = np.searchsorted(table_of.keys, keys)
                docs, place = np.unique(of, return_inverse=True)
                far = np.where(second > table_of.size, times, np.uint64(0)).astype(np.float64)  # head words were summed at home
                sums = (np.bincount(place, x, len(docs)) for x in (times * -lp[at] * UNIT, far * base[at] * UNIT, far * new[at]))
                blob = packed([], docs, *(np.rint(x).astype(np.int64) for x in sums))
            rows["run"].append(number)
            rows["home"].append(home)
            rows["blob"].append(blob)
        return pa.table(rows, schema=_RETURNED)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _gather(group):
    """The texts of a run with all their sums."""
    homes, sums = [], []
    for home, blob in zip(group.column("home").to_pylist(), group.column("blob").to_pylist(), strict=True):
        (homes if home else sums).append([c.view(np.int64) for c in unpacked(blob)[1]])
    (ids, none, held, tokens, unknown, base, score), = homes
    parts = [np.zeros(len(ids), dtype=np.int64) for _ in range(3)]
    for docs, *back in sums:
        for total, x in zip(parts, back, strict=True):
            total[docs] += x
    return pa.table({
        "doc_id": pa.array(ids, mask=none.astype(bool)),
        "held_out": held.astype(bool),
        "n_tokens": tokens,
        "n_known": tokens - unknown - parts[2],
        "base_sum": base.view(np.float64) + parts[1] / UNIT,
        "score": score.view(np.float64) - parts[0] / UNIT,
    })


def frequent_from(counted: DataFrame, most: int) -> int:
    """The least frequency from which on at most `most` pairs of head words are left."""
    rows = counted.select(F.posexplode("levels").alias("level", "c")).groupBy("level").agg(F.sum("c").alias("c")).collect()  # a row per level
    least = 1 << 62
    for r in sorted(rows, key=lambda r: -r.level):
        most -= r.c
        if most < 0:
            break
        least = int(LEVELS[r.level])
    return least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, head_terms: int = HEAD_TERMS, deleted: int = DELETED) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null counts as the empty text, which has the end token alone.  Documents whose crc32(id) mod parts is held teach
    nothing.  Repeated rows each count and are each scored; other columns of docs are not read.  An empty table gives
    an empty result; without training documents every token is unknown.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, parts) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.withColumn("apart", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(deleted)) == 0)
    training = texts.where(~F.col("held_out"))
    counted = training.select("t", "apart").mapInArrow(_count_words, "term binary, n long, d long")
    terms = written(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "lm-words")
    total = terms.agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("v")).first()
    end = training.agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("apart").cast("long")).alias("apart")).first()
    ends, ends_apart = end["all"], end.apart or 0
    n, v = (total.n or 0) + ends, total.v + (ends > 0)
    left = n - (total.d or 0) - ends_apart
    owners = 1 + n // OWNER_TOKENS
    tasks = min(owners, max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    in_head = head_condition(terms, head_terms)
    best = terms.where(in_head).sort(F.desc("n"), "term").toArrow()  # head_terms rows and LONG_TERMS long ones at most
    numbers = {w: i + 1 for i, w in enumerate(best.column(0).to_pylist())}
    shared = share((numbers, np.array([ends, *best.column(1).to_pylist()]), np.array([ends_apart, *best.column(2).to_pylist()])))
    others = terms.where(~in_head)
    counted = written(counted_pairs(texts, others, shared, owners, tasks), "lm-pairs")
    two, one, unknown = learn_weights(pair_rows(counted, others, shared, deleted=1), left, v)
    if not n:
        unknown = 1.0
    weights = (two, one, unknown, n, v)
    scored = pair_scores(pair_rows(counted, others, shared, least=frequent_from(counted, head_terms)), *weights)
    frequent = scored.select("term", "lp").toArrow()  # head_terms rows at most
    at = {b"": 0, **numbers}
    keys = np.array([at[a] << 32 | at[b] for a, b in (x.split(b" ") for x in frequent.column(0).to_pylist())], dtype=np.uint64)
    order = np.argsort(keys)
    fixed = share((keys[order], frequent.column(1).to_numpy()[order]))

    asked = counted.select("owner", F.explode("asks").alias("term")).join(others, "term")
    known = counted.select("owner", "pairs", "words").unionByName(asked, allowMissingColumns=True).repartition(tasks, "owner").groupBy("owner")
    runs = texts.select("doc_id", "held_out", "t").mapInArrow(_score(shared, fixed, owners), "owner int, run long, home boolean, blob binary").repartition(tasks, "owner").groupBy("owner")
    sums = known.cogroup(runs).applyInArrow(_look_up(shared, weights), "run long, home boolean, blob binary")
    found = written(sums.groupBy("run").applyInArrow(_gather, _SCORED), "lm-scores")
    fixed.destroy()  # executors would keep the heads
    shared.unpersist()
    base = F.col("base_sum") - F.col("n_tokens") * math.log10(n + v + 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
