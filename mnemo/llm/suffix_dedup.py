"""Suffix-array dedup: remove every byte covered by a 400-byte string that also starts somewhere else.

1. Anchors.  Each 400-byte window has one anchor, the least 128-byte hash in it (winnowing); equal windows have equal
   anchors at equal offsets, and consecutive windows share theirs.  Only windows whose anchor occurs again can repeat.
2. Contexts.  The bytes of consecutive windows with one anchor, when that anchor occurs again, form a context.  Equal
   contexts are folded with a count before they meet; a context seen twice repeats in whole.
3. Suffix arrays.  Contexts are packed by anchor, and each pack gets a suffix array by two-stage sorting: suffixes
   smaller than their successor are sorted directly, by ranks of their own kind over depths that double; all others are
   induced by scanning the buckets of the first byte in order.  Neighbours with a common prefix of 400 bytes are repeats.
   An anchor with very many different contexts is first divided: its windows go to blocks by their offset, keyed by the
   bytes that all windows of the block share, so no task holds an unbounded group.
4. Repeats go back to their documents as runs of windows.  Equal texts are handled by their key: of 400 bytes or more,
   they go whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import discard, table, written

LENGTH, GRAM = 400, 128
SPAN = LENGTH - GRAM + 1
#: Bytes of text whose anchors are found together; contexts of one pack (a suffix array) are about as many.
RUN_BYTES, PACK_BYTES = 1 << 21, 1 << 18
#: Different contexts of one anchor beyond which its windows are divided into blocks of so many offsets.
MOST_CONTEXTS, BLOCK = 256, 32
#: Tasks over packs at most; a task sorts its packs one after the other.
MOST_TASKS = 1024
#: Pieces that an anchor with very many contexts is dealt to while it is set apart.
SALTS = 32
_rng = np.random.Generator(np.random.PCG64(2))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_ALL = (1 << 64) - 1
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
        done += m
    return out


def _gram_hashes(buf: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on."""
    n = len(buf)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[buf] * _powers(n, inverse), dtype=np.uint64)])
    h = (sums[size:] - sums[:-size]) * _powers(n - size + 1, _BASE)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _least_places(h: np.ndarray) -> np.ndarray:
    """For each window of at most 2^24 hashes, the place of the least one; of equal hashes the last."""
    least = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    return (_LOW - (least & _LOW)).astype(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: (text number, anchor hash, first window, number of windows, anchor's place after the first window)."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    h = _gram_hashes(buf)
    if len(h) < SPAN:
        return (np.zeros(0, dtype=np.int64),) * 5
    step = int(_LOW) + 2 - SPAN  # windows of a slice whose places fit in _LOW; slices overlap by SPAN - 1 hashes
    at = np.concatenate([_least_places(h[i : i + step + SPAN - 1]) + i for i in range(0, len(h) - SPAN + 1, step)])
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    a = at[q]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])) if len(q) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(q)))
    return owner[first], h[a[first]].view(np.int64), q[first] - starts[owner[first]], count, a[first] - q[first]


def _runs(texts: list[bytes], most: int = RUN_BYTES):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _find_anchors(batches):
    """The different anchors of each text and how many runs of windows each has."""
    for b in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in b.column(3).to_pylist()]
        for at, own in _runs(texts):
            who, h, *_ = anchors(own)
            names, times, ends = [], [], [0]
            for k in range(len(own)):
                lo, hi = np.searchsorted(who, [k, k + 1])
                n, c = np.unique(h[lo:hi], return_counts=True)
                names.append(n)
                times.append(c)
                ends.append(ends[-1] + len(n))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(kind))) for x, kind in ((names, np.int64), (times, np.int64))]
            some = b.slice(at, len(own))
            digest = pa.array([hashlib.sha256(t).digest() for t in own], pa.binary())
            yield pa.record_batch([some.column(0), some.column(1), some.column(2), pa.array([len(t) for t in own], pa.int64()), digest, *lists], names=["doc_id", "k1", "k2", "n_bytes", "sha", "anchor", "times"])


def _cut(batches):
    """Contexts of each text at its anchors in `again`, equal ones of a text folded: (k1, k2, anchor, lead, n, context, starts)."""
    names = ["k1", "k2", "anchor", "lead", "n", "context", "starts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    for b in batches:
        for k1, k2, t, again in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw, found = t.encode("utf-8", "surrogatepass"), {}
            _, h, q, n, lead = anchors([raw])
            for i in np.flatnonzero(np.isin(h, np.array(again, dtype=np.int64))).tolist():
                found.setdefault((int(h[i]), int(lead[i]), int(n[i]), raw[q[i] : q[i] + n[i] + LENGTH - 1]), []).append(int(q[i]))
            cols = [[], [], [], [], [], [], []]
            for (anchor, before, many, context), starts in found.items():
                for c, x in zip(cols, (k1, k2, anchor, before, many, context, starts), strict=True):
                    c.append(x)
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)


def suffix_array(symbols: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (ties in any order), by two-stage sorting.

    symbols: uint8, ending in the only 0.
    """
    n = len(symbols)
    s = symbols.astype(np.int16)
    step = np.sign(np.append(s[1:] - s[:-1], -1))
    place = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(place[::-1])[::-1]
    rising = step[after] > 0  # smaller than its successor
    rising[n - 1] = True  # the end is the least suffix
    small = _sorted_small(symbols, rising, depth)

    head = symbols[small]
    borders = np.searchsorted(head, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.unique(symbols).tolist():
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        falling = [level]
        while len(level):  # runs of the same symbol, one step a level
            before = level[level > 0] - 1
            level = before[(symbols[before] == c) & ~rising[before]]
            falling.append(level)
        bucket = np.concatenate([*falling, small[borders[c] : borders[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rising[before] & (symbols[before] > c)]
        if len(before):
            sym = symbols[before]
            turn = np.argsort(sym, kind="stable")
            before, sym = before[turn], sym[turn]
            edge = np.flatnonzero(np.diff(sym)) + 1
            for part, x in zip(np.split(before, edge), sym[np.append(0, edge)].tolist(), strict=True):
                waiting[x].append(part)
    return np.concatenate(out)


def _sorted_small(symbols: np.ndarray, rising: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, sorted directly.

    The first round compares 8 symbols.  In later rounds a group of ties with `known` equal symbols is compared by the
    ranks of suffixes of the same kind that start inside those symbols, so that depths about double: the last such start
    before the run of symbols that the known ones end in, since its kind hangs on known symbols alone and it lies at
    the same distance in the whole group.  A group without one compares the next 8 symbols.
    """
    n, index = len(symbols), np.arange(len(symbols))
    words = _words(symbols)
    run_start = np.maximum.accumulate(np.where(np.concatenate([[True], symbols[1:] != symbols[:-1]]), index, 0))
    last_small = np.maximum.accumulate(np.where(rising, index, -1))
    small = np.flatnonzero(rising)
    small = small[np.argsort(words[small])]
    key = words[small]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n, dtype=np.int64)  # of a small suffix: the first place of its group
    rank[small] = np.maximum.accumulate(np.where(new, np.arange(len(small)), 0))
    known = np.full(n, 8, dtype=np.int64)  # symbols that the suffixes of its group share
    open_places = np.arange(len(small))
    while True:
        alone = new[open_places] & np.append(new, True)[open_places + 1]
        open_places = open_places[~alone & (known[small[open_places]] < depth)]
        if not len(open_places):
            return small
        at = small[open_places]
        group = rank[at]
        end = np.minimum(at + known[at], n) - 1
        jump = last_small[np.maximum(run_start[end] - 1, 0)]
        far = np.minimum(at + known[at], n - 1)
        key, reach = rank[jump], jump - at + known[jump]
        if (near := jump <= at).any():
            key[near] = np.unique(words[far[near]], return_inverse=True)[1]
            reach[near] = known[at[near]] + 8
        inner = np.argsort(group * (n + 1) + key)
        at, group, key, reach = at[inner], group[inner], key[inner], reach[inner]
        small[open_places] = at
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        new[open_places] = first
        rank[at] = np.maximum.accumulate(np.where(first, open_places, 0))
        known[at] = reach


def _words(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each position on as one number that orders like them."""
    padded = np.concatenate([symbols, np.zeros(8, dtype=np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(symbols)].copy().view(">u8")[:, 0].astype(np.uint64)


def common_prefixes(symbols: np.ndarray, array: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For neighbours in the array, whether they share `depth` symbols."""
    a, b = array[:-1], array[1:]
    same = np.zeros(len(a), dtype=bool)
    if len(symbols) < depth:
        return same
    alive = np.flatnonzero((a + depth <= len(symbols)) & (b + depth <= len(symbols)))
    for at in (0, depth - 1, depth // 2):  # most neighbours differ in one of these
        alive = alive[symbols[a[alive] + at] == symbols[b[alive] + at]]
    rows = np.lib.stride_tricks.sliding_window_view(symbols, depth)
    for i in range(0, len(alive), 2048):
        some = alive[i : i + 2048]
        same[some] = (rows[a[some]] == rows[b[some]]).all(axis=1)
    return same


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its windows occur in another place of the list."""
    symbols = np.frombuffer(b"\xff".join([*contexts, b""]), dtype=np.uint8) + np.uint8(2)  # bytes of UTF-8 are below 0xF5; the border becomes 1
    symbols = np.append(symbols, np.uint8(0))
    array = suffix_array(symbols)
    same = common_prefixes(symbols, array)
    hit = np.zeros(len(symbols), dtype=bool)
    hit[array[:-1][same]] = True
    hit[array[1:][same]] = True
    ends = np.cumsum([len(c) + 1 for c in contexts])
    return [hit[e - len(c) - 1 : e - LENGTH] for c, e in zip(contexts, ends, strict=True)]


def _to_runs(hit: np.ndarray, base: int = 0) -> list[int]:
    """Starts and ends, one after the other, of runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return (edge + base).tolist()


def _sort_packs(group: pa.Table) -> pa.Table:
    contexts, many = group.column("context").to_pylist(), group.column("times").to_pylist()
    hits = repeated_windows(contexts)
    runs = [_to_runs(np.ones(len(h), dtype=bool) if m > 1 else h) for h, m in zip(hits, many, strict=True)]
    return pa.table([group.column("anchor"), group.column("digest"), pa.array(runs, pa.list_(pa.int32()))], names=["anchor", "digest", "runs"])


def _divide(batches):
    """Contexts of an anchor with many of them, as blocks of windows: (anchor, digest, base, core, context, times)."""
    for b in batches:
        rows = []
        for anchor, digest, lead, context, times in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            n = len(context) - LENGTH + 1
            at = 0
            while at < n:
                block = (lead - at) // BLOCK
                stop = min(n, lead - block * BLOCK + 1)
                shared = context[lead - block * BLOCK : lead - block * BLOCK + LENGTH - BLOCK + 1]  # in every window of the block
                rows.append((anchor, digest, at, xxhash.xxh3_64_intdigest(shared) - (1 << 63), block, context[at : stop - 1 + LENGTH], times))
                at = stop
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "digest", "base", "core", "block", "context", "times"])


def _keep(batches):
    """(k1, k2, spans, kept) from a text and the runs of its repeated windows: the removed runs of bytes, and the remaining bytes."""
    names, kinds = ["k1", "k2", "spans", "kept"], [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [])
        size = 0
        for k1, k2, t, runs in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            change = np.zeros(len(raw) + 1, dtype=np.int32)
            for r in runs:
                lo, hi = np.array(r["runs"][0::2], dtype=np.int64), np.array(r["runs"][1::2], dtype=np.int64)
                for s in r["starts"]:
                    np.add.at(change, lo + s, 1)
                    np.add.at(change, hi + s + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = _to_runs(gone)
            spans = [{"start": lo, "end": hi} for lo, hi in zip(edges[0::2], edges[1::2], strict=True)]
            for c, x in zip(cols, (k1, k2, spans, raw[~gone].tobytes()), strict=True):
                c.append(x)
            size += len(cols[3][-1])
            if size >= RUN_BYTES:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)
                cols, size = ([], [], [], []), 0
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=names)


def _packs(contexts: DataFrame) -> int:
    """How many packs hold a table of contexts."""
    return max(1, int((contexts.agg(F.sum(F.octet_length("context")).alias("b")).first().b or 0) // PACK_BYTES))


def _solved(docs: DataFrame, id_col: str, text_col: str, most_contexts: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts by key; sizes and digests of every row; copies of each text; spans and remaining bytes of texts that lose something to other places."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.select("doc_id", F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(2), "t").alias("k2"), "t")
    schema = "doc_id long, k1 long, k2 long, n_bytes long, sha binary, anchor array<long>, times array<long>"
    found = written(texts.mapInArrow(_find_anchors, schema), "suffix-anchors")
    copies = written(found.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "suffix-copies")

    one = found.where(F.size("anchor") > 0).join(copies, (found["doc_id"].eqNullSafe(F.col("rep"))) & (found["k1"] == copies["k1"]) & (found["k2"] == copies["k2"]), "left_semi")
    each = one.select("k1", "k2", F.explode(F.arrays_zip("anchor", "times")).alias("w")).select("k1", "k2", "w.anchor", "w.times")
    again = each.groupBy(F.col("anchor").alias("again")).agg(F.sum("times").alias("c")).where("c > 1").select("again")
    kept = each.join(again, F.col("anchor") == F.col("again"), "left_semi")
    lists = kept.groupBy("k1", "k2").agg(F.collect_set("anchor").alias("again"))  # at most a row per anchor of one text
    lists = lists.join(copies.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "rep", "again")
    same = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    held = written(texts.join(lists, same).select("k1", "k2", "t", "again").dropDuplicates(["k1", "k2"]), "suffix-texts")

    cut = held.mapInArrow(_cut, "k1 long, k2 long, anchor long, lead int, n int, context binary, starts array<int>")
    cut = written(cut.withColumn("digest", F.unhex(F.sha2("context", 256))), "suffix-contexts")
    folded = cut.groupBy("anchor", "lead", "context").agg(F.sum(F.size("starts").cast("long")).alias("times"), F.count(F.lit(1)).alias("c"))
    folded = written(folded.select("anchor", F.unhex(F.sha2("context", 256)).alias("digest"), "lead", "context", "times"), "suffix-folded")
    sizes = folded.groupBy(F.col("anchor").alias("of")).agg(F.count(F.lit(1)).alias("different"))
    large = sizes.where(F.col("different") > most_contexts).select("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salted = folded.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    of_large = (F.col("anchor") == F.col("of")) & (F.col("salt") == F.col("of_salt"))
    packs = _packs(folded)
    sort_schema = "anchor long, digest binary, runs array<int>"
    few = salted.join(large, of_large, "left_anti").select("anchor", "digest", "context", "times", F.pmod("anchor", F.lit(packs)).alias("pack"))
    parts = [few.repartition(min(packs, MOST_TASKS), "pack").groupBy("pack").applyInArrow(_sort_packs, sort_schema)]
    if large.take(1):
        many = salted.join(large, of_large, "left_semi").select("anchor", "digest", "lead", "context", "times")
        divided = written(many.mapInArrow(_divide, "anchor long, digest binary, base int, core long, block int, context binary, times long"), "suffix-divided")
        blocks = _packs(divided)
        block = divided.groupBy("anchor", "block", "core", "context").agg(F.sum("times").alias("times"))
        block = block.withColumn("sub", F.unhex(F.sha2("context", 256))).withColumn("pack", F.pmod(F.xxhash64("anchor", "block", "core"), F.lit(blocks)))
        keyed = block.select(F.xxhash64("anchor", "block", "core").alias("anchor"), F.col("sub").alias("digest"), "context", "times", "pack")
        solved = keyed.repartition(min(blocks, MOST_TASKS), "pack").groupBy("pack").applyInArrow(_sort_packs, sort_schema).select(F.col("anchor").alias("ka"), F.col("digest").alias("kd"), "runs")
        back = divided.withColumn("sub", F.unhex(F.sha2("context", 256))).withColumn("ka", F.xxhash64("anchor", "block", "core"))
        back = back.join(solved, (back["ka"] == solved["ka"]) & (back["sub"] == solved["kd"])).where(F.size("runs") > 0)
        parts.append(back.groupBy("anchor", "digest").agg(F.flatten(F.collect_list(F.expr("transform(runs, x -> x + base)"))).alias("runs")))
    sorted_runs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sorted_runs = written(sorted_runs.where(F.size("runs") > 0).select(F.col("anchor").alias("sa"), F.col("digest").alias("sd"), "runs"), "suffix-runs")
    hits = cut.select("k1", "k2", "anchor", "digest", "starts").join(sorted_runs, (F.col("anchor") == F.col("sa")) & (F.col("digest") == F.col("sd")))
    per_text = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("runs", "starts")).alias("hits"))
    partly = held.select("k1", "k2", "t").join(per_text, ["k1", "k2"]).mapInArrow(_keep, "k1 long, k2 long, spans array<struct<start:long,end:long>>, kept binary")
    partly = written(partly, "suffix-partly")
    discard(cut)
    discard(folded)
    return texts, found, copies, partly


def _whole(n_bytes):
    """Whether a row of a join with `copies` is lost in whole: equal texts of 400 bytes or more."""
    return (F.coalesce("copies", F.lit(1)) > 1) & (n_bytes >= LENGTH)


def _spans(n_bytes):
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), n_bytes.cast("long").alias("end")))
    return F.when(_whole(n_bytes), all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, spans (removed runs of bytes: start, end), kept (the remaining bytes, concatenated).

    A repeat may begin or end inside a character, so the remaining bytes need not be valid UTF-8.  Rules as in repeats_removed.
    """
    texts, _, copies, partly = _solved(docs, id_col, text_col, most_contexts)
    known = written(copies.where("copies > 1").select("k1", "k2", "copies").join(partly, ["k1", "k2"], "full"), "suffix-known-texts")
    raw = F.col("t").cast("binary")
    kept = F.when(_whole(F.octet_length("t")), F.lit(b"")).otherwise(F.coalesce("kept", raw))
    return texts.join(known, ["k1", "k2"], "left").select("doc_id", _spans(F.octet_length("t")).alias("spans"), kept.alias("kept"))


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs of bytes: start, end).

    Null counts as the empty text.  Texts under 400 bytes lose nothing; equal texts of 400 bytes or more, repeated rows
    among them, lose all.  Matches never cross documents, and are judged on the input.  Other columns of docs are not
    read.  An empty table gives an empty result.
    """
    _, found, copies, partly = _solved(docs, id_col, text_col, most_contexts)
    # Only texts that lose something are looked up; the table is written, so that Spark can split the copies of one text.
    partly = partly.select("k1", "k2", "spans", F.sha2("kept", 256).alias("kept_sha256"))
    known = written(copies.where("copies > 1").select("k1", "k2", "copies").join(partly, ["k1", "k2"], "full"), "suffix-known")
    size = F.col("n_bytes")
    out = found.select("doc_id", "k1", "k2", "n_bytes", "sha").join(known, ["k1", "k2"], "left")
    kept = F.when(_whole(size), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
    out = out.select("doc_id", "n_bytes", _spans(size).alias("spans"), kept.alias("kept_sha256"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and `changed`, whether the document loses anything."""
    rows = repeats_removed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"))
