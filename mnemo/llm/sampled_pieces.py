"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is a path through the lattice of vocabulary pieces.  Forward filtering sums the weights of all paths that reach a
position; backward sampling then draws, from the end, each piece in proportion to the weight that flows through it.
No piece holds a space after another character, so every path visits the borders before runs of spaces, and the lattice
falls apart exactly into chunks (spaces and the word after them).  Chunks are filtered once per worker and remembered;
all draws of a batch run together over one table of edges.  Draws are hashes of (row key, chunk, step), so any rerun, on
any partitioning, gives the same pieces.

The vocabulary is a BPE model without unigram probabilities: the piece of merge rank r weighs (r + 2)^-sharpness (Zipf's
law).  Characters without a piece, the mark for spaces among them, become byte pieces.  Encoding adds one space in
front, as the model does, and decoding removes exactly that one.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import table

MODEL = "piece_bpe_32k.model"
#: Larger values keep closer to the few frequent long pieces, 0 draws pieces evenly.
SHARPNESS = 1.0
#: Edges that a worker remembers (20 bytes each), characters of chunks that it draws together and that it filters together.
MOST_EDGES, DRAW_CHARS, FILTER_CHARS = 3_000_000, 1 << 19, 1 << 16
#: Bytes of whole texts that make one batch of results, where no single text is larger.
RUN_BYTES = 1 << 20
_CHUNK = re.compile(r" *[^ ]+| +")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE, _ALL = 0xD1342543DE82EF95, (1 << 64) - 1
#: Chunks up to this length are filtered together; no product of so many weights underflows.
_SHORT = 32
#: Chunks beyond this length leave no edges: they are filtered and drawn one by one, at 12 bytes a character.
_LONG = 4096
#: Pieces that are decoded together.
_DECODED = 1 << 16
#: Weight of a character that has no piece.
_FALLBACK = 1e-6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces with weights, surfaces with plain spaces, and the byte pieces."""

    def __init__(self, name: str = MODEL, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
        self.size, self.weight, self.byte = sp.get_piece_size(), {}, [0] * 256
        surface = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
            else:
                plain = piece.replace("▁", " ")
                rank = -sp.get_score(i)
                # runs of spaces carry a score far below all ranks; they weigh as the first merge
                self.weight[plain] = (i, (2.0 + (rank if rank < 1e6 else 0.0)) ** -sharpness)
                surface.append(plain.encode())
        self.longest = max(map(len, self.weight))
        self.by_length = {}
        for k in {len(p) for p in self.weight}:
            own = [(h[-1], i, w) for p, (i, w) in self.weight.items() if len(p) == k for *_, (_, h) in [_suffix_hashes(np.array([*map(ord, p)], dtype=np.uint64), k)]]
            self.by_length[k] = _Lookup(*map(np.array, zip(*own, strict=True)))
        self.splits = not any(re.search("[^ ] ", p) for p in self.weight)
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.length = np.array([len(s) for s in surface], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def chunks(self, text: str, most: int):
        """Lists of the chunks of a text with its added space, of about `most` characters each; the empty text has none."""
        if not text:
            return
        if not self.splits:
            yield [" " + text]
        elif len(text) < most:
            yield _CHUNK.findall(" " + text)
        else:
            some, size = [], 0
            for m in _CHUNK.finditer(" " + text):
                some.append(m.group())
                size += len(some[-1])
                if size >= most:
                    yield some
                    some, size = [], 0
            yield some

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, the added spaces included."""
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.surface[at]


@lru_cache(maxsize=2)
def vocabulary(name: str, sharpness: float) -> Vocabulary:
    """The vocabulary of a worker, which all its tasks share."""
    return Vocabulary(name, sharpness)


class Lattice:
    """Filtered chunks as one table of edges.

    Node x of the table is a position in a chunk; its edges, longest piece first, lead back to earlier positions.
    upto holds the cumulative probability of a node's edges, and first the place of its first edge.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # chunk -> its number
        self.ends = _Grown(np.int64)  # of a chunk: its last node
        self.sizes = _Grown(np.int64)  # its length
        self.first = _Grown(np.int64)
        self.upto, self.back, self.piece = _Grown(np.float64), _Grown(np.int64), _Grown(np.int32)
        self.odd: dict[str, int] = {}  # character without a piece -> pseudo id
        self.bytes_of: list[list[int]] = []  # its byte pieces, by pseudo id - size

    def _pseudo(self, char: str) -> int:
        if char not in self.odd:
            self.odd[char] = self.v.size + len(self.bytes_of)
            self.bytes_of.append([self.v.byte[b] for b in char.encode("utf-8", "surrogatepass")])
        return self.odd[char]

    def filter(self, chunks: list[str]) -> None:
        """Forward filtering of new chunks, the short ones in slices of FILTER_CHARS characters."""
        short = [c for c in chunks if len(c) <= _SHORT]
        short.sort(key=len, reverse=True)
        ends = np.cumsum(np.fromiter(map(len, short), dtype=np.int64, count=len(short)))
        at = 0
        while at < len(short):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FILTER_CHARS)) + 1
            self._filter_short(short[at:to])
            at = to
        for c in chunks:
            if len(c) > _SHORT:
                self._filter_long(c)

    def _filter_short(self, chunks: list[str]) -> None:
        """Chunks in falling order of length.  Cells are (end, chunk): all first characters, then all second ones, ..., so
        that the cells of one end are a slice, and the chunks that have one are the first of them."""
        v, text = self.v, "".join(chunks)
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        start, longest = np.cumsum(size) - size, int(size[0])
        have = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chunks of e characters or more, from e = 1
        off = np.concatenate([[0], np.cumsum(have)])  # the cells of end e are off[e - 1] : off[e]
        n = int(off[-1])
        end = np.repeat(np.arange(1, longest + 1), have)
        owner = np.arange(n) - off[end - 1]
        row = start[owner] + end - 1  # of a cell: its character in the text
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[row].astype(np.uint64) + np.uint64(1)
        # found[k]: cells where a piece of k characters ends, its weight and id; dense[k]: weights of all cells from end k on
        found, dense, h, power = {}, {}, np.zeros(n, dtype=np.uint64), 1
        for k in range(1, min(longest, v.longest) + 1):
            term = code * np.uint64(power)
            for e in range(k, longest + 1):
                h[off[e - 1] : off[e]] += term[off[e - k] : off[e - k] + have[e - 1]]
            power = power * _BASE & _ALL
            if k in v.by_length:
                at, ids, weights = v.by_length[k].find(h[off[k - 1] :])
                dense[k] = np.zeros(n - off[k - 1])
                dense[k][at] = weights
                found[k] = (at + off[k - 1], ids, weights)
        single, piece = dense.get(1, np.zeros(n)), np.zeros(n, dtype=np.int32)
        if 1 in found:
            piece[found[1][0]] = found[1][1]
        lone = np.flatnonzero(single == 0)
        single[lone] = _FALLBACK
        piece[lone] = [self._pseudo(text[i]) for i in row[lone].tolist()]
        dense[1], found[1] = single, (np.arange(n), piece, single)  # every cell has a piece of one character

        m = len(chunks)
        alpha = np.zeros(m + n)  # the chunks' starts, then the cells
        alpha[:m] = 1.0
        for e in range(1, longest + 1):
            lo, many = off[e - 1], have[e - 1]
            total = alpha[m + lo : m + lo + many]
            for k in range(1, min(e, v.longest) + 1):
                if k in dense:
                    before = m + off[e - k - 1] if e > k else 0
                    total += alpha[before : before + many] * dense[k][lo - off[k - 1] : lo - off[k - 1] + many]
        base = self.first.n + start + np.arange(m)  # a chunk has one node more than characters
        node = base[owner] + end
        edges = np.zeros(n, dtype=np.int64)
        for at, *_ in found.values():
            edges[at] += 1
        per_row = np.empty(n, dtype=np.int64)
        per_row[row] = edges
        opens = np.cumsum(per_row) - per_row
        first = np.zeros(n + m, dtype=np.int64)
        first[node - self.first.n] = self.upto.n + opens[row]
        place, run = opens[row], np.zeros(n)
        count = int(edges.sum())
        upto, back, pieces = np.full(count, 2.0), np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int32)
        starts = np.concatenate([[0], m + off])  # where alpha has the cells of an end, from end 0
        for k in sorted(found, reverse=True):
            at, ids, weights = found[k]
            to = place[at]
            if k > 1:
                run[at] += alpha[starts[end[at] - k] + owner[at]] * weights
                upto[to] = run[at] / alpha[m + at]
                place[at] += 1
            back[to] = node[at] - k
            pieces[to] = ids
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + m), strict=True))
        self.ends.add(base + size)
        self.sizes.add(size)
        self.first.add(first)
        self.upto.add(upto)
        self.back.add(back)
        self.piece.add(pieces)

    def _filter_long(self, chunk: str) -> None:
        """The same for one chunk of any length; weights are rescaled where they get small."""
        weight, longest, base = self.v.weight, self.v.longest, self.first.n
        alpha, uptos, backs, pieces, first = [1.0], [], [], [], [0]
        for e in range(1, len(chunk) + 1):
            own = [(alpha[s] * got[1], s, got[0]) for s in range(max(0, e - longest), e) if (got := weight.get(chunk[s:e])) is not None]
            if chunk[e - 1] not in weight:
                own.append((alpha[e - 1] * _FALLBACK, e - 1, self._pseudo(chunk[e - 1])))
            total, run = sum(w for w, _, _ in own), 0.0
            first.append(self.upto.n + len(uptos))
            for w, s, i in own:
                run += w
                uptos.append(run / total)
                backs.append(base + s)
                pieces.append(i)
            uptos[-1] = 2.0
            alpha.append(total)
            if total < 1e-100:  # only the last `longest` weights are read again
                low = max(0, e + 1 - longest)
                alpha[low:] = [x / total for x in alpha[low:]]
        self.known[chunk] = len(self.known)
        self.ends.add(np.array([base + len(chunk)]))
        self.sizes.add(np.array([len(chunk)]))
        self.first.add(np.array(first))
        self.upto.add(np.array(uptos))
        self.back.add(np.array(backs))
        self.piece.add(np.array(pieces))

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and the number of pieces of each."""
        per, got, waiting, size = np.zeros(len(texts), dtype=np.int64), [], [], 0

        def draw() -> None:
            nonlocal waiting, size
            if waiting:
                counts = np.array([len(c) for c, *_ in waiting], dtype=np.int64)
                order = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - [done for *_, done in waiting], counts)
                seed = np.repeat(np.array([seeds[i] for _, i, _ in waiting], dtype=np.uint64), counts)
                ids, n = self._draw(list(chain.from_iterable(c for c, *_ in waiting)), seed + (order.astype(np.uint64) + np.uint64(1)) * _GOLD)
                np.add.at(per, [i for _, i, _ in waiting], np.add.reduceat(n, np.cumsum(counts) - counts))
                got.append(ids)
            waiting, size = [], 0

        for i, text in enumerate(texts):
            done = 0  # chunks of the text so far
            for chunks in self.v.chunks(text, DRAW_CHARS):
                for alone, some in _set_apart(chunks) if len(text) > _LONG else [(False, chunks)]:
                    if alone:
                        draw()
                        ids = self._draw_long(some[0], int(seeds[i]) + (done + 1) * int(_GOLD) & _ALL)
                        per[i] += len(ids)
                        got.append(ids)
                    else:
                        waiting.append((some, i, done))
                        size += sum(map(len, some))
                        if size >= DRAW_CHARS:
                            draw()
                    done += len(some)
        draw()
        return np.concatenate([np.zeros(0, dtype=np.int32), *got]), per

    def _draw(self, keys: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of chunks in a row, and the number of pieces of each; all draws run together."""
        if self.upto.n > MOST_EDGES:
            self.clear()
        number = list(map(self.known.get, keys))
        if None in number:
            self.filter(list(dict.fromkeys([k for k, i in zip(keys, number, strict=True) if i is None])))
            number = list(map(self.known.get, keys))
        number = np.array(number, dtype=np.int64)
        now = self.ends.all()[number]
        stop = now - self.sizes.all()[number]
        first, upto, back, piece = self.first.all(), self.upto.all(), self.back.all(), self.piece.all()
        seed = _mix(seeds)
        steps, active, length, steps_done = [], np.arange(len(now)), np.zeros(len(now), dtype=np.int64), 0
        while len(active):
            u = _unit(seed, steps_done)
            edge = first[now]
            more = np.flatnonzero(upto[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[upto[edge[more]] <= u[more]]
            steps.append((active, piece[edge]))
            now = back[edge]
            on = now > stop
            length[active] = steps_done + 1
            active, now, stop, seed = active[on], now[on], stop[on], seed[on]
            steps_done += 1
        last = np.cumsum(length) - 1
        ids = np.empty(int(length.sum()), dtype=np.int32)
        for t, (who, got) in enumerate(steps):  # drawn from the end
            ids[last[who] - t] = got
        return self._spelled(ids, length)

    def _spelled(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pseudo ids replaced by byte pieces."""
        odd = ids >= self.v.size
        if not odd.any():
            return ids, per
        wide = np.ones(len(ids), dtype=np.int64)
        runs = [self.bytes_of[i - self.v.size] for i in ids[odd].tolist()]
        wide[odd] = [len(r) for r in runs]
        ends = np.concatenate([[0], np.cumsum(wide)])
        border = np.concatenate([[0], np.cumsum(per)])
        ids = np.repeat(ids, wide)
        ids[np.repeat(odd, wide)] = [b for r in runs for b in r]
        return ids, np.diff(ends[border])

    def _draw_long(self, chunk: str, seed: int) -> np.ndarray:
        """Piece ids of one chunk of any length: only the forward weights are kept, edges are found again where the path goes.

        The weight of position e is alpha[e] / 1e100 ** scale[e].
        """
        weight, longest, n = self.v.weight, self.v.longest, len(chunk)
        alpha, scale, recent, now = array("d", [1.0]), array("i", [0]), [1.0], 0
        for e in range(1, n + 1):
            total = 0.0 if chunk[e - 1] in weight else recent[-1] * _FALLBACK
            for k in range(1, min(e, longest) + 1):
                if (got := weight.get(chunk[e - k : e])) is not None:
                    total += recent[-k] * got[1]
            if total < 1e-100:
                recent, now, total = [x * 1e100 for x in recent[-longest:]], now + 1, total * 1e100
            recent.append(total)
            if len(recent) > 1024:
                del recent[:-longest]
            alpha.append(total)
            scale.append(now)
        out, e, done = array("i"), n, 0
        seeds = _mix(np.array([seed], dtype=np.uint64))
        while e:
            if done % 4096 == 0:
                draws = _unit(seeds, np.arange(done, done + 4096, dtype=np.uint64)).tolist()
            own = [(alpha[s] * 1e100 ** (scale[e] - scale[s]) * got[1], s, got[0]) for s in range(max(0, e - longest), e) if (got := weight.get(chunk[s:e])) is not None]
            if chunk[e - 1] not in weight:
                own.append((alpha[e - 1] * 1e100 ** (scale[e] - scale[e - 1]) * _FALLBACK, e - 1, self._pseudo(chunk[e - 1])))
            left = draws[done % 4096] * sum(w for w, _, _ in own)
            for w, s, i in own:
                left -= w
                if left < 0:
                    break
            out.append(i)
            e, done = s, done + 1
        return self._spelled(np.frombuffer(out, dtype=np.int32)[::-1].copy(), np.array([len(out)]))[0]


class _Lookup:
    """Pieces of one length by their hashes: tables of 2^16 places, each for the pieces whose place in all before is taken."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.hashes, self.ids, self.weights, self.tables = hashes.astype(np.uint64), ids.astype(np.int32), weights.astype(np.float64), []
        left, odd = np.arange(len(hashes)), int(_GOLD)
        while len(left):
            own, kept = np.full(1 << 16, -1, dtype=np.int16 if len(hashes) < 1 << 15 else np.int32), self._places(self.hashes[left], odd)
            own[kept] = left
            self.tables.append((odd, own))
            left, odd = left[own[kept] != left], odd * _BASE & _ALL

    @staticmethod
    def _places(h: np.ndarray, odd: int) -> np.ndarray:
        return (h * np.uint64(odd)) >> np.uint64(48)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places where h has the hash of a piece, each once, and the pieces' ids and weights."""
        at, places, got = None, [], []
        for odd, own in self.tables:
            rest = h if at is None else h[at]
            which = own[self._places(rest, odd)]
            some = np.flatnonzero(which >= 0)
            which = which[some]
            ok = self.hashes[which] == rest[some]
            some = some if at is None else at[some]
            places.append(some[ok])
            got.append(which[ok])
            at = some[~ok]  # a piece of a later table has its place here taken by another
        which = np.concatenate(got)
        return np.concatenate(places), self.ids[which], self.weights[which]


class _Grown:
    """An array that grows by a quarter at a time."""

    def __init__(self, kind):
        self.a, self.n = np.empty(1 << 12, dtype=kind), 0

    def add(self, x: np.ndarray) -> None:
        if (m := self.n + len(x)) > len(self.a):
            bigger = np.empty(m + m // 4, dtype=self.a.dtype)
            bigger[: self.n] = self.a[: self.n]
            self.a = bigger
        self.a[self.n : m] = x
        self.n = m

    def all(self) -> np.ndarray:
        return self.a[: self.n]


def _suffix_hashes(code: np.ndarray, longest: int):
    """(k, hash of the k characters that end at each position), k rising."""
    h, power = np.zeros(len(code), dtype=np.uint64), 1
    for k in range(1, longest + 1):
        if k > len(code):
            return
        h[k - 1 :] += (code[: len(code) - k + 1] + np.uint64(1)) * np.uint64(power)
        power = power * _BASE & _ALL
        yield k, h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(seed: np.ndarray, step) -> np.ndarray:
    """Draws in 0..1 for a step of each seed."""
    at = np.asarray(step, dtype=np.uint64) * _GOLD if np.ndim(step) else np.uint64(int(step) * int(_GOLD) & _ALL)
    return (_mix(seed + at) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _set_apart(chunks: list[str]):
    """(alone, chunks): the chunks in order, each one beyond _LONG by itself."""
    if max(map(len, chunks), default=0) <= _LONG:
        return [(False, chunks)] if chunks else []
    return [(alone, [c]) if alone else (False, list(some)) for alone, some in groupby(chunks, lambda c: len(c) > _LONG) for c in (some if alone else [None])]


def _runs(sizes: list[int]):
    """Slices of rows of about RUN_BYTES bytes."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > RUN_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def _checked(v: Vocabulary, ids: np.ndarray, text: str) -> tuple[bool, str]:
    """Whether pieces decode to the text, and the digest of what they decode to."""
    raw, digest, same, at = memoryview(text.encode("utf-8", "surrogatepass")), hashlib.sha256(), True, 0
    for i in range(0, len(ids), _DECODED):
        back = v.decode(ids[i : i + _DECODED])[0 if i else 1 :].tobytes()
        same = same and back == raw[at : at + len(back)]
        at += len(back)
        digest.update(back)
    return same and at == len(raw), digest.hexdigest()


def _encode(name: str, sharpness: float):
    def run(batches):
        lattice = Lattice(vocabulary(name, sharpness))
        for b in batches:
            for part in _runs(pc.binary_length(b.column(1)).to_pylist()):
                rows = b.slice(part.start, part.stop - part.start)
                own = rows.column(1).to_pylist()
                ids, per = lattice.sample(own, rows.column(2).to_numpy().view(np.uint64))
                ends = np.concatenate([[0], np.cumsum(per)])
                checked = [_checked(lattice.v, ids[ends[i] : ends[i + 1]], t) for i, t in enumerate(own)]
                yield pa.record_batch(
                    [rows.column(0), pa.array(per, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array([x for x, _ in checked]), pa.array([x for _, x in checked])],
                    names=["doc_id", "n_pieces", "ids", "lossless", "decoded_sha256"],
                )

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = MODEL, sharpness: float = SHARPNESS, seed: int = 10) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids (sampled), lossless, decoded_sha256 (of the decoded text in UTF-8).

    Draws are seeded by the id, so rows that repeat an id and text get the same pieces; a null id is an id of its own.
    Null counts as the empty text, which has no pieces.  Other columns of docs are not read.  An empty table gives an
    empty result.  A worker holds MOST_EDGES filtered edges, DRAW_CHARS characters of draws and RUN_BYTES of texts, or one
    larger text, at a time.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("seed"))
    return texts.mapInArrow(_encode(name, sharpness), "doc_id long, n_pieces long, ids array<int>, lossless boolean, decoded_sha256 string")


def _decode(name: str):
    def run(batches):
        v = vocabulary(name, SHARPNESS)
        for b in batches:
            texts = [v.decode(np.asarray(x or [], dtype=np.int64))[1:].tobytes().decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(pieces: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = MODEL) -> DataFrame:
    """(doc_id, text) from piece ids; null counts as no pieces, which decode to the empty text."""
    return pieces.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(name), "doc_id long, text string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
