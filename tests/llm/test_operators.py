"""Each operator against a brute-force version on small tables, and on odd rows."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.llm import exact_dedup, html_text, language_model, mixing, near_join, pieces, quality, sampled_pieces, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def per_row(rows, *cols):
    """Multiset of (doc_id, cols...)."""
    return collections.Counter((r.doc_id, *[getattr(r, c) for c in cols]) for r in rows)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


# Exact dedup


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(table, bits):
    rows = texts(table)
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    want = collections.Counter((i, best[t], len(by[t]), i == best[t], sha(t.encode())) for i, t in rows)
    got = exact_dedup.exact_groups(table, capacity=8, key_bits=bits).collect()
    assert per_row(got, "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_filter(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def test_directory_doubles(spark):
    entries = spark.range(4000).selectExpr("xxhash64(id) as key")
    slots, depth = exact_dedup.directory(entries, 4000, 100)
    rows = slots.collect()
    load = collections.Counter()
    keys = [r.key & (1 << 64) - 1 for r in entries.collect()]
    where = {r.slot: r.bucket for r in rows}
    for k in keys:
        load[where[k >> (64 - depth)]] += 1
    assert max(load.values()) <= 100 and len({r.local_depth for r in rows}) >= 1 and len(load) > 40


# Suffix arrays


def brute_repeats(rows):
    count = collections.Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    out = collections.Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g)))] += 1
    return out


def test_suffix_array_order():
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (1, 2, 17, 200):
        s = np.append(rng.integers(1, 3, n).astype(np.uint8), np.uint8(0))
        raw = s.tobytes()
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_anchors_beyond_field(monkeypatch):
    """The field of places narrowed from 2^24 to 2^10 bytes: anchors of a longer text stay those of its windows alone."""
    raw = np.random.Generator(np.random.PCG64(9)).integers(97, 123, 6000).astype(np.uint8).tobytes()
    raw = raw[:300] + raw[4000:4700] + raw[1000:]  # one passage of 700 bytes twice, the second time beyond the field
    monkeypatch.setattr(suffix_dedup, "_LOW", np.uint64((1 << 10) - 1))
    texts = [raw[:900], raw]
    who, h, first, many, lead = suffix_dedup.anchors(texts)
    got = [(int(k), int(q) + j, int(x), int(p) - j) for k, x, q, n, p in zip(who, h, first, many, lead, strict=True) for j in range(n)]
    assert [(k, q) for k, q, _, _ in got] == [(k, q) for k, t in enumerate(texts) for q in range(len(t) - 399)]
    for k, q, x, p in got[::37]:
        (_, (y, *_), _, _, (o, *_)) = suffix_dedup.anchors([texts[k][q : q + 400]])
        assert (x, p) == (y, o)


def test_anchors_of_a_very_long_text():
    """A passage beyond 16 MiB of one text has the anchors that it has by itself."""
    rng = np.random.Generator(np.random.PCG64(11))
    raw = rng.integers(97, 123, 17_600_000).astype(np.uint8).tobytes()
    piece = raw[17_200_000:17_204_000]
    _, there, first, *_ = suffix_dedup.anchors([raw])
    _, alone, *_ = suffix_dedup.anchors([piece])
    inside = there[(first >= 17_200_000) & (first < 17_203_600)]
    assert len(inside) > 5 and set(inside.tolist()) <= set(alone.tolist())


@pytest.mark.parametrize("most", [1500, 2])
def test_suffix_dedup(spark, docs, most):
    rows = [(i, t) for i, t in texts(docs) if len(t) < 6000][:110]
    a = rows[0][1][:500].ljust(500, "q")
    rows += [(9001, "x" * 300 + a), (9002, a + "y" * 450), (9003, a[:399]), (9004, None), (9005, "z" * 900), (9006, "ab" * 300), (9007, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.repeats_removed(df, most_contexts=most).collect()
    assert per_row(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(i, (t or "").encode()) for i, t in rows])


def test_suffix_dedup_odd(odd):
    got = suffix_dedup.repeats_removed(odd).collect()
    assert per_row(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(i, t.encode()) for i, t in texts(odd)])
    assert suffix_dedup.repeats_removed(odd.limit(0)).count() == 0


def test_suffix_dedup_gives_spans_and_bytes(spark, docs, odd, monkeypatch):
    """The removed runs and the remaining bytes themselves, from which the digests follow; small runs, so a batch is given in pieces."""
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    some = [(i, t) for i, t in texts(docs) if len(t) < 6000][:60]
    a = "ü" * 250 + some[0][1][:500].ljust(500, "q")
    some += [(9001, "xyz" + a), (9002, a + "é" * 450), (9003, "é" * 130 + "z"), (9004, None), (9004, "cd" * 300), (9004, "cd" * 300)]
    for df in (spark.createDataFrame(some, "doc_id long, text string"), odd):
        rows = {(i, t.encode()) for i, t in texts(df)}
        want = collections.Counter()
        for (i, _, *figures), n in brute_repeats([(i, t.encode()) for i, t in texts(df)]).items():
            want[(i, *figures)] += n
        got = suffix_dedup.without_repeats(df).collect()
        assert collections.Counter((r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) for r in got) == want
        for r in got:  # the spans, cut out of a text of this id, leave the remaining bytes
            ends = [0, *[x for s in r.spans for x in s]]
            assert any(i == r.doc_id and b"".join(t[x:y] for x, y in zip(ends[0::2], [*ends[1::2], len(t)], strict=True)) == bytes(r.kept) for i, t in rows)
        digests = suffix_dedup.repeats_removed(df).collect()
        assert sorted(map(repr, [(r.doc_id, r.spans) for r in digests])) == sorted(map(repr, [(r.doc_id, r.spans) for r in got]))
    assert suffix_dedup.without_repeats(odd.limit(0)).count() == 0


def test_suffix_dedup_query(spark):
    rows = suffix_dedup.op2_suffix_dedup(spark, SF).collect()
    assert rows[0].__fields__ == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed"]
    assert {r.changed for r in rows} == {True, False} and all(r.changed == (r.n_removed > 0) for r in rows)


# Toxicity


def test_fold():
    assert toxicity.fold("Ｉd1ОT, lóser!") == toxicity.fold("idiot loser") == " idiot ioser "


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lex = toxicity.learn(more, labels)
    assert lex == toxicity.learn(more.repartition(7), labels)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(more, labels).where("held_out").collect()
    held = [r for r in got if r.doc_id in known]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.9
    assert lex.score("what a stupid idiot and a pathetic moron") > 0.5 > lex.score("the quiet garden is open in the morning")
    assert lex.score("what a 5tupid 1d1ot and a path3tic m0ron") > 0.5
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0


def test_exceptions_cancel():
    lex = toxicity.Lexicon({"trash": 5.0}, frozenset(["<the trash"]), (-3.0, 1.0, 1.0))
    assert lex.matches(toxicity.fold("such trash")) and not lex.matches(toxicity.fold("empty the trash"))


def test_near_hot_keys(spark):
    """Rows of a hot key, of others and of none meet their values once, and a hot key's rows part."""
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else f"k{i}") for i in range(3000)], "i int, k string")
    values = rows.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n")
    got = near_join._spread(rows, values, "k", "n", 3000, "left")
    assert collections.Counter((r.i, r.k, r.n) for r in got.collect()) == {(i, k, {"hot": 1500, None: None}.get(k, 1)): 1 for i, k in rows.collect()}
    assert near_join._spread(rows, values, "k", "n", 3000).count() == rows.where("k is not null").count()
    assert near_join._spread(rows.limit(0), values.limit(0), "k", "n", 0).count() == 0


# Language model


def test_lm_base(table):
    rows = texts(table)
    c, n, ends = collections.Counter(), 0, 0
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            w = t.encode().lower().split()
            c.update(w)
            n, ends = n + len(w) + 1, ends + 1
    v = len(c) + 1
    got = language_model.lm_scores(table, head_terms=300, deleted=5).collect()
    want = collections.Counter()
    for i, t in rows:
        w = t.encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want[(i, held[i], len(w) + 1, sum(x in c for x in w) + 1, n, round(base, 4))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_beats_base(spark):
    got = language_model.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_pairs_are_exact(spark):
    """Words beyond any rank keep a context of their own, and scores take the counts of the deleted texts in."""
    rows = [(i, f"a{i % 1500} b{i % 1500} b{(i + 7) % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    real = language_model.pair_scores
    language_model.pair_scores = lambda pairs, *a: seen.update(pairs=pairs, a=a) or real(pairs, *a)
    try:
        got = {r.doc_id: r for r in language_model.lm_scores(df, head_terms=100, deleted=5).collect()}
    finally:
        language_model.pair_scores = real
    pairs, before, words = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not got[i].held_out:
            w = ["", *t.split(), ""]
            pairs.update(zip(w, w[1:]))
            before.update(w[:-1])
            words.update(w[1:])
    two, one, unknown, n, v = seen["a"]
    for r in seen["pairs"].sample(0.2, 3).collect():
        a, b = r.ctx.decode(), r.term.decode()
        assert (r.n2, r.nc, r.n1) == (pairs[a, b], before[a], words[b])
    for i, t in rows[:200]:
        w, want = ["", *t.split(), ""], 0.0
        for a, b in zip(w, w[1:]):
            x = two[before[a].bit_length()]
            p2 = pairs[a, b] / max(before[a], 1)
            want += math.log10((1 - unknown) * (x * p2 + (1 - x) * (one * words[b] / n + (1 - one) / v)) if words[b] else unknown)
        assert abs(got[i].score - want) < 1e-6


def test_lm_probabilities_sum_to_one(spark):
    """Over all words that can follow a context, the end and the unknown word among them, for seen and unseen contexts."""
    rng = np.random.Generator(np.random.PCG64(4))
    texts = [[f"v{min(int(rng.zipf(1.5)), 40)}" for _ in range(rng.integers(0, 9))] for _ in range(200)]
    pairs, before, words = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        w = ["", *t, ""]
        pairs.update(zip(w, w[1:]))
        before.update(w[:-1])
        words.update(w[1:])
    contexts = ["", *[c for c in sorted(before) if c][:12], "never seen"]
    rows = [(c.encode(), x.encode(), pairs[c, x], 0, before[c], 0, words[x], 0) for c in contexts for x in [*words, "unknown word"]]
    table = spark.createDataFrame(rows, "ctx binary, term binary, n2 long, d2 long, nc long, dc long, n1 long, d1 long")
    two = np.minimum(np.linspace(0.0, 0.9, language_model.BUCKETS), 0.9999)
    got = language_model.pair_scores(table, two, 0.95, 0.02, sum(words.values()), len(words)).collect()
    sums = collections.Counter()
    for (c, *_), r in zip(rows, got, strict=True):
        sums[c] += 10**r.lp
    assert len(sums) == len(contexts) and all(abs(x - 1) < 1e-9 for x in sums.values())


@pytest.mark.parametrize("limits", [{}, {"RUN_TOKENS": 300, "OWNER_TOKENS": 500}])
@pytest.mark.parametrize("head_terms", [30, 100_000])
def test_lm_scores_by_brute_force(spark, monkeypatch, limits, head_terms):
    """Frequent words and rare, in and outside the head, over one owner and many, runs of few texts and of all."""
    for name, value in limits.items():
        monkeypatch.setattr(language_model, name, value)
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(i, " ".join(f"w{int(rng.zipf(1.4)) % 4000}" + "é" * 30 * int(x == 3) for x in rng.integers(0, 9, rng.integers(0, 40)))) for i in range(400)]
    rows += [(None, "w1 w2"), (None, ""), (7, "only here"), (7, "w" * 5000 + " w1")] + [(1000 + i, "long" * 20 + " w1 " + "long" * 20) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real, seen = language_model.learn_weights, {}
    monkeypatch.setattr(language_model, "learn_weights", lambda pairs, *a: seen.update(w=real(pairs, *a), deleted={(r.ctx, r.term): tuple(r) for r in pairs.collect()}) or seen["w"])
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.score, 5)) for r in language_model.lm_scores(df, head_terms=head_terms, deleted=5).collect())
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    apart = {r.doc_id for r in df.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(5)) == 0).collect()}
    n2, d2, nc, dc, n1, d1 = (collections.Counter() for _ in range(6))
    for i, t in rows:
        w = ["", *t.split(), ""]
        for c2, cc, c1 in [(n2, nc, n1)] * (not held[i]) + [(d2, dc, d1)] * (not held[i] and i in apart):
            c2.update(zip(w, w[1:]))
            cc.update(w[:-1])
            c1.update(w[1:])
    assert {(bytes(a).decode(), bytes(b).decode(), *r) for a, b, *r in seen["deleted"].values()} == {(a, b, n2[a, b], d2[a, b], nc[a], dc[a], n1[b], d1[b]) for a, b in d2}
    (two, one, unknown), n, v = seen["w"], sum(n1.values()), len(n1)
    want = collections.Counter()
    for i, t in rows:
        w, score = ["", *t.split(), ""], 0.0
        for a, b in zip(w, w[1:]):
            x = two[nc[a].bit_length()]
            score += math.log10((1 - unknown) * (x * n2[a, b] / max(nc[a], 1) + (1 - x) * (one * n1[b] / n + (1 - one) / v)) if n1[b] else unknown)
        want[(i, held[i], len(w) - 1, sum(n1[b] > 0 for b in w[1:]), round(score, 5))] += 1
    assert got == want


def test_lm_packs():
    words, columns = [b"a", "é".encode()], [np.array([1, 5, 5, 2**40]), np.array([0, -1, 7, 3]), np.array([0, 1, 2, 2**62])]
    back, same = language_model.unpacked(language_model.packed(words, *columns))
    assert back == words and all((x.view(np.int64) == y).all() for x, y in zip(same, columns, strict=True))
    back, same = language_model.unpacked(language_model.packed([], np.zeros(0, dtype=np.int64)))
    assert back == [] and len(same[0]) == 0


def test_head_holds_long_terms(spark):
    rows = [(b"x" * 100, 900), (b"y" * 100, 5), (b"z" * 5000, 900), (b"s", 700), (b"t", 3)]
    terms = spark.createDataFrame(rows, "term binary, n long")
    got = terms.where(pieces.head_condition(terms, 1, 1)).collect()
    assert {bytes(r.term) for r in got} == {b"x" * 100, b"s"}


def test_lm_empty(odd):
    assert language_model.lm_scores(odd.limit(0)).count() == 0


# Near duplicates


def test_bands():
    bands, rows = near_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= near_join.RECALL


def test_near_links(table):
    rows = texts(table)
    sets = []
    for _, t in rows:
        w = t.encode().split()
        m = min(5, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    links = collections.defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 10 >= 8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    want = collections.Counter()
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        want[(i, min(ids) if ids else None, len(links[a]))] += 1
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in near_join.near_links(table).collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}


def shared_ids(spark):
    """Two texts under id 1, a near copy of each, a repeated row, and near copies without ids."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (None, c), (None, c + " z"), (4, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_key", F.lit(1)).withColumn("text_key", F.lit(2))


def test_near_shared_ids(spark):
    docs = shared_ids(spark)
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in near_join.near_links(docs).collect())
    assert got == {(1, 1, 1): 1, (1, 1, 2): 1, (2, 1, 1): 1, (3, 1, 2): 2, (None, None, 1): 2, (4, 4, 0): 1}
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 2, None: 1, 4: 1}


def test_near_one_of_repeats(spark):
    a = " ".join(f"a{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (2, a + " z", "x")], "doc_id long, text string, lang string")
    one, two = (near_join.one_of_each(docs.repartition(n)).collect() for n in (1, 3))
    assert one == two and len(one) == 1 and one[0].doc_id == 1


def test_near_bucket_tiles(spark, monkeypatch):
    """A wide component of chance candidates is verified bucket by bucket; every link is counted once."""
    rng = np.random.Generator(np.random.PCG64(11))
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        # texts of one chain share half of their words with the next ones, few are near copies
        words = base[i % 30 :] + [f"c{(i // 3) * 5 + k}" for k in range(40)] + [f"d{i // 3}"] * 3
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(near_join.near_links(docs).collect())
    monkeypatch.setattr(near_join, "TILE", 4)
    # both ways, whatever their cost, and the one that costs less
    for bias in (0, 1, 10**6):
        monkeypatch.setattr(near_join, "COMPONENT_COST", bias)
        assert sorted(near_join.near_links(docs).collect()) == whole
    grams = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    want = [sum(a != b and len(grams[a] & grams[b]) * 10 >= 8 * len(grams[a] | grams[b]) for b in range(90)) for a in range(90)]
    assert [r.n_links for r in whole] == want and sum(want) > 0


def test_near_tiles(spark, monkeypatch):
    """A component over many tiles gives the same links."""
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[:-1] + [f"z{i}"])) for i in range(40)]
    monkeypatch.setattr(near_join, "TILE", 7)
    got = near_join.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}
    assert near_join.near_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Language model


def test_words_of_pieces():
    """Arrow kernels part texts at exactly the six separators and lower A to Z alone."""
    odd = ["", " ", "a", " A b\t\nC ", "\x0b\x0cx\r", "Äß\u00a0É\u2003k \x1c\x1d\x85 z\x00Z", "İ I", "  two   gaps  "]
    words, many = language_model.words_of(pa.array(odd))
    want = [t.encode().lower().split() for t in odd]
    assert words.cast(pa.binary()).to_pylist() == [w for x in want for w in x] and many.tolist() == [len(x) for x in want]
    batch = pa.record_batch([pa.array(odd)], names=["t"])
    for most in (1, 5, 1000):
        pieces = list(language_model.pieces_of(batch, 0, most))
        assert [t for b in pieces for t in b.column(0).to_pylist()] == odd
        assert all(b.num_rows == 1 or sum(len(t.encode()) for t in b.column(0).to_pylist()) <= most for b in pieces)


# HTML


def test_html():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head</h1><p>one <b>two</b>&amp;three<p>four<br>five
    <ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol><table><tr><th>A<th>Bee<tr><td>long cell<td>1</table>
    <div hidden>gone</div><div style="color:red; display: none">gone</div><script>if (a < b) "</p>"</script><!-- gone --><pre>k
  l</pre><noembed>gone</noembed>tail"""
    out = html_text.render(page)
    assert out == "Head\n\none two&three\n\nfour\nfive\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\nA          Bee\nlong cell  1\n\nk\n  l\n\ntail"
    for bad in ("", "<", "<p", "</div></p></table>", "<table><tr><td>a<table><tr><td>b", "<a href='x", "<li>" * 3000, "<div>" * 3000 + "deep", "a &#0; &bogus; &lt", "<!-- open", "<![CDATA[x]]>"):
        html_text.render(bad)
    assert html_text.render("<div>" * 3000 + "deep") == "deep"


def random_page(rng, depth=0):
    """(markup, its visible words in order), words numbered so that each is unique."""
    out, words = [], []

    def word():
        random_page.n += 1
        return f"w{random_page.n}"

    for _ in range(rng.integers(1, 5)):
        kind = rng.choice(["text", "div", "p", "ul", "table", "hidden", "script", "inline", "comment", "select"]) if depth < 5 else "text"
        a = word()
        if kind == "text":
            out.append(f" {a} ")
            words.append(a)
        elif kind in ("div", "p", "ul", "inline"):
            inner, own = random_page(rng, depth + 1)
            out.append({"div": f"<div class='x>y'>{inner}</div>", "p": f"<section><p>{a}</section>{inner}", "ul": f"<ul><li>{a}<li>{inner}</ul>", "inline": f"<b title=it's><i>{inner}</i></b>"}[kind])
            words += ([a] if kind in ("p", "ul") else []) + own
        elif kind == "table":
            cells = [word() for _ in range(4)]
            out.append("<table><tbody><tr><td>{}<td><b>{}</b><tr><th>{}</th><td>{}</table>".format(*cells))
            words += cells
        elif kind == "hidden":
            inner, _ = random_page(rng, depth + 1)
            out.append(rng.choice(["<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<dialog>{}</dialog>", "<template>{}</template>"]).format(inner))
        elif kind == "script":
            out.append(f"<script>if (a < b) '{a}'</script>")
        elif kind == "comment":
            out.append(f"<!-- {a} <p> -->")
        else:
            b = word()
            out.append(f"<select><option>{a}<option selected>{b}</select>")
            words.append(b)
    return "".join(out), words


def test_html_random_pages():
    """All visible words, in order and nothing else, on pages whose visible words are known."""
    rng, random_page.n = np.random.Generator(np.random.PCG64(6)), 0
    for _ in range(300):
        page, words = random_page(rng)
        assert re.findall(r"w\d+", html_text.render(page)) == words, page


def test_html_layout():
    render = html_text.render
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td>D<td>E</table>") == "A  B\n   C\nD  E"
    wide = "w" * 90
    assert render(f"<table><tr><td>{wide}<td>q<tr><td>s<td>t</table>") == f"{wide}  q\ns{' ' * 91}t"
    assert render("<div hidden>" + "<b>" * 2000 + "secret</div>end") == "end"
    assert render("<table><tr><td>" * 1000 + "x") == "x" and render("<table><div>" * 2000 + "y") == "y"
    assert render("<textarea>a &amp;\n b</textarea><math><mi>m</mi></math><svg><title>no</title><text>s</text></svg>") == "a &\n bms"
    big = "<table>" + f"<tr><td>{'z' * 100_000}<td>1" + "<tr><td>s<td>t" * 2000 + "</table>"
    assert len(render(big)) < 200_000


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (1, "<p>a")], "page_id long, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0)]
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for p, r in zip(real.orderBy("page_id").collect(), html_text.extract(real).orderBy("page_id").collect(), strict=True):
        title = re.search(r"<h1>(.*?)</h1>", p.html)
        assert "track(" not in r.text and (not title or html.unescape(title[1])[:20] in r.text)


# Token counts


@pytest.mark.parametrize("head", [300_000, 50])
def test_token_counts(table, head):
    tok = token_counts.load_tokenizer("byte_bpe_50k.json")
    rows = texts(table)
    want = collections.Counter((i, len(t.encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True))
    assert per_row(token_counts.token_counts(table, head_terms=head).collect(), "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_in_parts(monkeypatch):
    """A task's memory does not grow with the rows of a batch: 400 texts of 50 kB, none of whose words is known."""
    import tracemalloc
    import types

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rows = [" ".join(f"w{i % 97}x{k}" for k in range(6000)) for i in range(400)]
    batch = pa.record_batch([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["doc_id", "t"])
    want = rows[-1]
    del rows
    run = token_counts._per_document("byte_bpe_50k.json", types.SimpleNamespace(value={}))
    split = token_counts.PreTokens("byte_bpe_50k.json")
    seen, last, sizes, least = set(), None, 0, 1 << 60
    tracemalloc.start()
    for out in run(iter([batch])):
        seen.update(out.column("rid").to_pylist())
        last, sizes, least = out.slice(out.num_rows - 1), sizes + out.num_rows, min(least, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and sizes == len(seen) == 400 and least > 0
    assert last.column("doc_id").to_pylist() == [399] and last.column("tail")[0].as_py() == split(want)[0]


def test_token_counts_empty(odd):
    assert token_counts.token_counts(odd.limit(0)).count() == 0


# Quality


def brute_quality(t):
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if c[(w[k], w[k + 1], w[k + 2])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered), failed


def test_quality(table):
    rows = texts(table)
    got = quality.quality_figures(table).collect()
    assert per_row(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter((i, *brute_quality(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_exact_path(spark, docs):
    """The path for colliding hashes gives the same counts."""
    from pyspark.sql import functions as F

    words = docs.select("doc_id", "text", F.expr("split(trim(text), '[\\\\x20\\\\x09-\\\\x0D]+')").alias("w"))
    sql = quality.repeat_words_sql("w")
    only = re.sub(r"size\(w\) > \d+", "size(w) > 3", sql)
    assert words.select("doc_id", F.expr(sql).alias("n")).collect() == words.select("doc_id", F.expr(only).alias("n")).collect()


def test_quality_keeps_good_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.quality_figures(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").collect()
    assert all(r.kept for r in got if labels.get(r.doc_id) == 1)
    assert not any(r.kept for r in got if labels.get(r.doc_id) == 0)
    assert quality.quality_figures(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Mixing


def test_targets():
    assert mixing.source_targets([100, 100, 100]) == [50.0, 100.0, 150.0]
    t = mixing.source_targets([10, 1000, 5, 0])
    assert t[0] == 30.0 and t[2] == 15.0 and t[3] == 0.0 and math.isclose(sum(t), 1015)
    assert mixing.source_targets([]) == []


def test_split_tree():
    out = mixing.split_tree([50, 3, 0, 200], 7, 1)
    assert out.sum(axis=1).tolist() == [50, 3, 0, 200] and set(out.sum(axis=0)) <= {36, 37}
    assert (out == mixing.split_tree([50, 3, 0, 200], 7, 1)).all()


def test_mix(docs):
    a, b = (sorted(map(tuple, mixing.mix_plan(docs).collect())) for _ in range(2))
    assert a == b
    got, source = mixing.mix_plan(docs).collect(), {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    names = sorted(set(source.values()))
    sums = [sum(size[i] for i in size if source[i] == s) for s in names]
    want = dict(zip(names, mixing.source_targets(sums), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and math.isclose(r.target, want[source[r.doc_id]]) and r.taken <= 3 * r.size and r.taken == r.copies * r.size and len(r.shards) == r.copies
        taken[source[r.doc_id]] += r.taken
    assert sum(abs(taken[s] - want[s]) for s in names) < 0.05 * sum(sums)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r.copies for r in got)


def test_mix_shards(docs):
    """Every copy lies in a shard of its own stretch: valid numbers, and shard sizes as the tree deals them."""
    shards = 8
    got = mixing.mix_plan(docs, shards=shards).collect()
    assert all(0 <= x < shards for r in got for x in r.shards) and all(len(r.shards) == r.copies for r in got)
    load = collections.Counter(x for r in got for x in r.shards)
    assert set(load) == set(range(shards)) and max(load.values()) < 2 * min(load.values()) + 20
    lone = docs.limit(1)  # one document: all its copies are fills or epochs
    assert all(0 <= x < shards for r in mixing.mix_plan(lone, shards=shards).collect() for x in r.shards)


def test_mix_odd(spark, odd):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == odd.count() and {r.doc_id for r in got if r.size == 0} == {3, 4, 5}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix_plan(odd.limit(0)).count() == 0


def test_mix_repeated_ids(spark):
    """Rows that share an id, or everything, are each taken as the plan says, and reruns agree."""
    rows = [(i // 3, f"{'w ' * (i % 7 + 1)}{i if i % 2 else ''}", f"s{i % 2}", str(i)) for i in range(90)] + [(1, "w w", "s0", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shards string")
    plan = collections.Counter()
    for r in mixing.mix_plan(docs).collect():
        plan[(r.doc_id, r.size)] += r.copies
    one, two = (collections.Counter(map(tuple, mixing.mixed(docs.repartition(n)).collect())) for n in (1, 4))
    assert one == two
    mix = collections.Counter()
    for (i, t, _, _), n in one.items():
        mix[(i, len(t.split()))] += n
    assert mix == +plan


# SentencePiece


def test_pieces_lossless(table):
    got = sampled_pieces.encoded(table)
    rows = got.collect()
    want = collections.Counter((i, sha(t.encode())) for i, t in texts(table))
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in rows) and per_row(rows, "decoded_sha256") == want
    back = collections.Counter((r.doc_id, r.text) for r in sampled_pieces.decoded(got).collect())
    assert back == collections.Counter(texts(table))
    again = collections.Counter((r.doc_id, tuple(r.ids)) for r in sampled_pieces.encoded(table.repartition(3)).collect())
    assert again == collections.Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert sampled_pieces.encoded(table.limit(0)).count() == 0


def test_pieces_distribution():
    """Sampled segmentations of a word follow the exact path weights."""
    v = sampled_pieces.Vocabulary()

    def paths(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in v.weight:
                for rest, w in paths(s[k:]):
                    yield (v.weight[s[:k]][0], *rest), v.weight[s[:k]][1] * w

    want = dict(paths(" then"))
    total, n = sum(want.values()), 20_000
    ids, per = sampled_pieces.Lattice(v).sample(["then"] * n, np.arange(n).astype(np.uint64))
    seen, at = collections.Counter(), 0
    for k in per.tolist():
        seen[tuple(ids[at : at + k].tolist())] += 1
        at += k
    assert all(abs(seen[p] / n - w / total) < 0.02 for p, w in want.items()) and set(seen) <= set(want)


def test_pieces_in_parts(monkeypatch):
    """Bounds of memory do not change what is drawn: small draws, filters and tables give the same pieces."""
    text = " ".join(f"word{i % 50} thén{i % 7}" for i in range(3000)) + " " + "x" * 300 + "漢" * 40
    seeds = np.array([3, 4, 5], dtype=np.uint64)
    whole = sampled_pieces.Lattice(sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0)).sample([text, "", "one two"], seeds)
    for name, value in (("DRAW_CHARS", 500), ("FILTER_CHARS", 60), ("MOST_EDGES", 100), ("_DECODED", 64)):
        monkeypatch.setattr(sampled_pieces, name, value)
    lattice = sampled_pieces.Lattice(sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0))
    parts = lattice.sample([text, "", "one two"], seeds)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == parts[1].tolist() and whole[1][1] == 0
    assert sampled_pieces._checked(lattice.v, parts[0][: parts[1][0]], text) == (True, sha(text.encode()))


def test_very_long_text(monkeypatch):
    """A text of 2 MB, with a chunk of 200,000 characters, is drawn in bounded memory."""
    import tracemalloc

    text = "some words " * 160_000 + "thenadi" * 30_000 + " tail"
    v = sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0)
    tracemalloc.start()
    ids, per = sampled_pieces.Lattice(v).sample([text], np.array([1], dtype=np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and sampled_pieces._checked(v, ids, text)[0] and per.tolist() == [len(ids)]


def test_long_chunk_distribution():
    v = sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0)
    lattice, n = sampled_pieces.Lattice(v), 20_000
    ids, per = lattice.sample(["then"] * n, np.arange(n).astype(np.uint64))
    short = collections.Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(per)[:-1]))
    long = collections.Counter(tuple(lattice._draw_long(" then", k).tolist()) for k in range(n))
    assert set(long) == set(short) and all(abs(long[p] - short[p]) < 0.02 * n for p in short)


def test_long_chunks_filter_alike():
    v = sampled_pieces.Vocabulary()
    a, b = sampled_pieces.Lattice(v), sampled_pieces.Lattice(v)
    a._filter_short([" thendingha"])
    b._filter_long(" thendingha")
    ends = lambda x: sorted(x.upto.all()[x.upto.all() < 2].tolist())
    assert len(a.upto.all()) == len(b.upto.all()) and len(ends(a)) == len(ends(b))


def test_chunks_filter_alike_in_any_company():
    """The cumulative probabilities of a chunk are the same to the last bit alone and among others, of any lengths."""
    v = sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0)
    chunks = sorted({f" {'thendingha'[i % 7 :]}{i}{'é漢𝔘'[i % 3] * (i % 4)}" for i in range(3000)} | {" ", "   ", " the", "a"}, key=len, reverse=True)
    together = sampled_pieces.Lattice(v)
    together._filter_short(chunks)
    for c in chunks[::97] + chunks[-4:]:
        alone, i = sampled_pieces.Lattice(v), together.known[c]
        alone._filter_short([c])
        end = int(together.ends.all()[i])
        base = end - len(c)
        for e in range(1, len(c) + 1):
            a, b = int(together.first.all()[base + e]), int(alone.first.all()[e])
            while True:
                assert together.upto.all()[a] == alone.upto.all()[b] and together.back.all()[a] - base == alone.back.all()[b]
                if alone.upto.all()[b] == 2.0:
                    break
                a, b = a + 1, b + 1


def test_short_chunks_filter_in_small_tables():
    """No work is spent on pieces that are longer than the chunks."""
    import tracemalloc

    lattice = sampled_pieces.Lattice(sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0))
    chunks = [chr(0x4E00 + i) + chr(0x61 + k) for i in range(1000) for k in range(26)]
    tracemalloc.start()
    lattice._filter_short(chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 350 * 2 * len(chunks)


def test_piece_lookup():
    """Every piece is found by its hash, those whose first place is taken too, and nothing else is."""
    v = sampled_pieces.vocabulary(sampled_pieces.MODEL, 1.0)
    for k, look in v.by_length.items():
        probe = np.concatenate([look.hashes[::-1], look.hashes ^ np.uint64(1), look.hashes[:9]])
        at, ids, weights = look.find(probe)
        got = dict(zip(at.tolist(), zip(ids.tolist(), weights.tolist(), strict=True), strict=True))
        known = dict(zip(look.hashes.tolist(), zip(look.ids.tolist(), look.weights.tolist(), strict=True), strict=True))
        assert len(got) == len(at) and got == {i: known[h] for i, h in enumerate(probe.tolist()) if h in known}
    assert sum(len(x.hashes) for x in v.by_length.values()) == len(v.weight) and max(len(x.tables) for x in v.by_length.values()) > 1
