"""N-gram Jaccard self-join by MinHash banding.

1. One pass turns each text into its set of word 5-gram hashes, a 128-bit key of the whole set, and band hashes; bands
   and rows are chosen for the target recall.  Texts with equal sets form a class with a representative.
2. Band hashes are shuffled; buckets of two or more classes tie their members to the bucket's least member.  Those stars
   join into candidate components, so that a pair which meets in many bands is verified once.
3. A component's members go to one task, or, beyond TILE, to tiles of two blocks each; there every pair is verified on the
   full n-gram sets by matrix products.  Tiles emit a row per member (its number of links and a star edge), never pairs.
   A larger component whose buckets are small, as chains of chance collisions make it, is verified bucket by bucket
   instead, which takes only its candidate pairs; a pair that meets in several bands counts in the first.  Of the two
   ways, both of which are exact, a component takes the one that reads fewer copies of texts.
4. Star edges of verified links join into classes.

Copies and buckets are folded by partial aggregates before they meet, so a group of copies with a third of all rows
costs a row per task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import discard, first_of_repeats, table, written

N_GRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.99999, 160
#: Members of a component that one block holds; a task holds two blocks.
TILE = 512
#: Cost of a text copy in a component's tiles against one in a bucket's, which carries band hashes.
COMPONENT_COST = 1
#: A key of one in so many rows or more is hot.  At most so many keys are, so their list is broadcast.
HOT = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest chance candidates, for which pairs at the threshold meet with the given probability within the hash budget."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word n-grams; a shorter text is one n-gram, an empty one has none."""

    def __init__(self, n: int = N_GRAM):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.encode("utf-8", "surrogatepass").split(), self.known
        if len(known) > 400_000:
            known.clear()
        try:
            h = np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], dtype=np.uint64)
        if not len(h):
            return h
        m = min(self.n, len(h))
        out = np.full(len(h) - m + 1, m, dtype=np.uint64)
        for i in range(m):
            out = _mix(out * _ODD + h[i : i + len(out)])
        return np.unique(out)


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """One signed 64-bit hash per band over the minima of its rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(grams), 2048):
        x = _mix(grams[i : i + 2048])
        least = np.minimum(least, (x[:, None] * a + b).min(axis=0))
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out * _ODD + least.reshape(bands, rows)[:, r])
    return out.view(np.int64)


def _sign(n: int, bands: int, rows: int):
    def run(batches):
        grams_of = Shingles(n)
        for b in batches:
            keys, sizes, hashes = [], [], []
            for t in b.column(1).to_pylist():
                g = grams_of(t)
                keys.append(xxhash.xxh3_128_digest(g.tobytes()))
                sizes.append(len(g))
                hashes.append(band_hashes(g, bands, rows) if len(g) else np.zeros(0, dtype=np.int64))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_key", "set_key", "n_grams", "bands"])

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) for the undirected edges (a, b): alternating large and small stars, each round a written table.

    A component is named by its least node.  Rounds grow with the logarithm of a component's diameter.
    """
    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that a hub's neighbours can be split among tasks in the join
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = written(small, name)
        now = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(stars)
        discard(least)
        stars = new
        if now == before:
            break
        before = now
    comps = stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return comps.unionByName(comps.select(F.col("comp").alias("node"), "comp").distinct())


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Boolean matrix of Jaccard >= num/den between two lists of sorted hash arrays, from exact intersection sizes."""
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(flat_l), np.unique(flat_r), assume_unique=True)
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    both = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(flat, row):
        at = np.searchsorted(shared, flat)
        ok = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == flat) if len(shared) else np.zeros(len(flat), dtype=bool)
        at, row = at[ok], row[ok]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    (at_l, r_l), (at_r, r_r) = places(flat_l, row_l), places(flat_r, row_r)
    step = 4096
    for i in range(0, len(shared), step):
        width = min(step, len(shared) - i)
        x, y = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        a, b = np.searchsorted(at_l, [i, i + width])
        x[r_l[a:b], at_l[a:b] - i] = 1
        a, b = np.searchsorted(at_r, [i, i + width])
        y[r_r[a:b], at_r[a:b] - i] = 1
        both += x @ y.T
    inter = both.astype(np.int64)
    union = sizes_l[:, None] + sizes_r[None, :] - inter
    return inter * den >= num * union


def _roots(pairs: np.ndarray) -> np.ndarray:
    """First member of each member's component under the links (boolean square matrix)."""
    root = np.arange(len(pairs))
    while True:
        new = np.array([min(root[i], root[row].min()) if row.any() else root[i] for i, row in enumerate(pairs)], dtype=np.int64)
        if (new == root).all():
            return root
        root = new


def _met(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix of whether two rows agree in any column."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for a, b in zip(left.T, right.T, strict=True):
        out |= a[:, None] == b
    return out


def _verify(n: int, num: int, den: int):
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        d = group.to_pydict()
        grams_of, tiles = Shingles(n), {}
        for k, key in enumerate(zip(d["cell"], d["band"], d["i"], d["j"], strict=True)):
            tiles.setdefault(key, []).append(k)
        nodes, links, roots = [], [], []
        for (_, band, i, j), rows in tiles.items():
            parts = [[k for k in rows if d["block"][k] == b] for b in ([i] if i == j else [i, j])]
            if not all(parts):
                continue
            grams = [[grams_of(d["t"][k]) for k in p] for p in parts]
            many = [np.array([d["copies"][k] for k in p], dtype=np.int64) for p in parts]
            met = [np.array([d["bands"][k][:band] for k in p], dtype=np.int64).reshape(len(p), -1) if band > 0 else np.zeros((len(p), 0), dtype=np.int64) for p in parts]
            if i == j:
                square = linked(grams[0], grams[0], num, den) & ~_met(met[0], met[0])
                np.fill_diagonal(square, False)
                count = square @ many[0]
            else:
                yes = linked(grams[0], grams[1], num, den) & ~_met(met[0], met[1])
                a = len(parts[0])
                square = np.zeros((a + len(parts[1]),) * 2, dtype=bool)
                square[:a, a:], square[a:, :a] = yes, yes.T
                count = np.concatenate([yes @ many[1], yes.T @ many[0]])
            own = [d["node"][k] for p in parts for k in p]
            nodes.extend(own)
            links.extend(count.tolist())
            roots.extend(own[r] for r in _roots(square).tolist())
        return pa.table([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], schema=schema)

    return run


def _place():
    """Orders rows by id, NULL last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def _spread(rows: DataFrame, values: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined on key to values, a row a key, whose `size` column says how many of all `total` rows have the key; the
    rows of a hot key, and those without a key, are dealt to up to HOT tasks instead of one."""
    values = values.withColumn("__salts", F.floor(F.col(size) * HOT / F.lit(max(total, 1))).cast("int") + 1)
    hot = values.where("__salts > 1").select(F.col(key).alias("__hot"), F.col("__salts").alias("__many"))
    salts = F.when(F.col(key).isNull(), F.lit(HOT)).otherwise(F.coalesce("__many", F.lit(1)))
    own = F.xxhash64(*[F.col(c) for c in rows.columns])
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(own, salts).cast("int")).drop("__hot", "__many")
    each = values.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return dealt.join(each, [key, "__salt"], how).drop("__salt")


def _cells(met: DataFrame, buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, cells): where a member's pairs are verified, each cell with its name, band (-1 for a whole component) and
    number of blocks; one component, or at most as many buckets as there are bands."""
    blocks = lambda size: F.ceil(F.col(size) / TILE)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    wide = sizes.where(F.col("size") > TILE)
    by_bucket = buckets.join(comps, F.col("least") == F.col("node")).join(wide, "comp").groupBy("comp").agg(F.sum(F.col("n") * blocks("n")).alias("cost"))
    sizes = sizes.join(by_bucket, "comp", "left").withColumn("blocks", blocks("size"))
    whole = F.col("cost").isNull() | (F.col("size") * F.col("blocks") * COMPONENT_COST <= F.col("cost"))
    placed = _spread(comps, written(sizes.withColumn("whole", whole), "near-sizes"), "comp", "size", comps.count())
    one = placed.where("whole").select("node", F.array(F.struct(F.col("comp").alias("cell"), F.lit(-1).alias("band"), "blocks")).alias("cells"))
    many = met.join(placed.where("not whole").select("node"), "node").join(buckets.select("band", "hash", "n"), ["band", "hash"])
    name = F.encode(F.concat_ws(":", "band", "hash"), "utf-8")
    many = many.groupBy("node").agg(F.collect_list(F.struct(name.alias("cell"), "band", blocks("n").alias("blocks"))).alias("cells"))  # a row a band
    return one.unionByName(many)


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> DataFrame:
    """near_links with text_key, a hash of the text, and class_key, the class's own name (NULL without n-grams)."""
    bands, rows = choose_bands(threshold, recall)
    num, den = round(threshold * 1000), 1000
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = texts.withColumn("text_key", F.xxhash64("t"))
    signed = written(texts.mapInArrow(_sign(n, bands, rows), "doc_id long, text_key long, set_key binary, n_grams long, bands array<long>"), "near-signed")
    full = signed.where("n_grams > 0")
    # A class of equal sets is named by its set's key; ids stand for nothing here, since texts may share one.
    sets = full.groupBy("set_key").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    sets = written(sets.select("set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "copies", "bands"), "near-sets")
    met = written(sets.select(F.col("set_key").alias("node"), F.posexplode("bands").alias("band", "hash")), "near-bands")
    buckets = written(met.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    stars = met.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
    comps = written(components(stars, "near-candidates"), "near-components")
    cells = written(_cells(met, buckets, comps), "near-cells")
    discard(met)

    packs = max(1, (cells.agg(F.sum(F.size("cells")).alias("n")).first().n or 0) // TILE)
    member = cells.join(sets.select(F.col("set_key").alias("node"), "copies", "rep", F.col("text_key").alias("rep_text"), "bands"), "node")
    held = texts.join(member, (F.col("text_key") == F.col("rep_text")) & F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    placed = held.select("node", "copies", "t", "bands", F.explode("cells").alias("at")).select("node", "copies", "t", "bands", "at.*")
    placed = placed.withColumn("bands", F.when(F.col("band") > 0, F.col("bands"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiled = tiled.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cell"), F.lit(packs))).otherwise(F.xxhash64("cell", "i", "j"))
    found = written(tiled.withColumn("pack", pack).drop("blocks").groupBy("pack").applyInArrow(_verify(n, num, den), "node binary, links long, root binary"), "near-links")
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    grown = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes")
    named = grown.join(sets.select(F.col("set_key").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("members"))
    classes = _spread(grown, written(named, "near-names"), "comp", "members", grown.count()).select(F.col("node").alias("of_class"), "class_id", F.col("comp").alias("class_key"))
    known = sets.join(per_node, F.col("set_key") == F.col("node"), "left").join(classes, F.col("set_key") == F.col("of_class"), "left")
    known = known.select("set_key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_key", "set_key").alias("class_key"))
    rows = signed.select("doc_id", "n_grams", "text_key", F.when(F.col("n_grams") > 0, F.col("set_key")).alias("set_key"))
    out = _spread(rows, written(known, "near-known"), "set_key", "copies", signed.count(), "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("rep", "doc_id").alias("rep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n_grams", "text_key", "class_key",
    )


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, rep_id, copies, n_grams.

    Two documents are linked when their sets of word n-grams have a Jaccard similarity of the threshold or more; class_id
    is the least doc_id that links lead to, n_links the number of other documents linked to the document itself, rep_id
    the least doc_id with the same n-gram set and copies the number of documents with it.  A text of fewer than n words
    is one n-gram; null and empty texts have none and are linked to nothing.  Every row is a document of its own, whether
    its id is null, repeated with the same text or repeated with another; null ids name a class only where it has no
    other.  Other columns of docs are not read.  An empty table gives an empty result.
    """
    return _linked(docs, id_col, text_col, n, threshold, recall).drop("text_key", "class_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of docs, a row with its least id; all columns stay, whatever their names.

    Of several texts under that id the one with the least hash stays, and of rows that repeat it the one with the least
    hash of all columns.  Rows without n-grams are in no class and all stay.
    """
    links = written(_linked(docs, id_col, text_col, N_GRAM, THRESHOLD, RECALL).where("n_grams > 0").select("class_key", "doc_id", "text_key"), "near-classes")
    first = written(links.groupBy("class_key").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-firsts")
    marked = _spread(links, first, "class_key", "rows", links.count()).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), (F.col("first") == _place()).alias("stays"))
    marked = written(marked, "near-marked")
    mine = docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__key"))
    kept = docs.join(marked.where("not stays").select("__id", "__key").distinct(), mine, "left_anti")
    again = marked.where("stays").groupBy("__id", "__key").count().where("count > 1").select("__id", "__key")
    return first_of_repeats(kept, again, mine)


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"))


#: Brute force: every pair that shares an n-gram.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n, md5(string_agg(md5(g::varchar), ',' order by md5(g::varchar))) as k from g group by doc_id),
c as (select doc_id, n, min(doc_id) over (partition by k) as rep, count(*) over (partition by k) as copies from n),
reps as (select rep, n, copies from c where doc_id = rep),
p as (select a.doc_id as a, b.doc_id as b, count(*) as meet from g a join g b on a.g = b.g and a.doc_id <> b.doc_id join reps ra on ra.rep = a.doc_id join reps rb on rb.rep = b.doc_id group by 1, 2),
e as (select a, b, rb.copies as copies from p join reps ra on ra.rep = a join reps rb on rb.rep = b where meet * 1000 >= 800 * (ra.n + rb.n - meet)),
walk(a, b) as (select rep, rep from reps union select walk.a, e.b from walk join e on e.a = walk.b),
cls as (select a, min(b) as class_id from walk group by a),
l as (select a, sum(copies) as links from e group by a)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, (coalesce(links, 0) + coalesce(c.copies, 1) - 1)::bigint as n_links, coalesce(c.rep, d.doc_id) as rep_id, coalesce(c.copies, 1) as copies, coalesce(c.n, 0) as n_grams
from documents d left join c on c.doc_id = d.doc_id left join cls on cls.a = c.rep left join l on l.a = c.rep
"""
