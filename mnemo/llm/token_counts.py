"""Token counts without token ids.

Byte-level BPE never merges across pre-tokens, so a text's token count is the sum of its pre-tokens' counts.  Pieces are
counted once per distinct pre-token of the whole corpus, and documents join their pre-token frequencies to that table:
the frequent head is a bounded broadcast, the tail a shuffled join (see pieces.py).
"""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import table, written
from mnemo.llm.pieces import HEAD_TERMS, head_of, to_map

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of texts that a task splits together, where no single text is larger.
RUN_BYTES = 1 << 20
#: Different pre-tokens that a task counts before it sends them on; those of one run of texts may come on top.
MOST_SEEN = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


class PreTokens:
    """Splits texts as the tokenizer does: added tokens first, then the pattern on what lies between."""

    def __init__(self, name: str):
        self.added = [t.content for t in load_tokenizer(name).get_added_tokens_decoder().values()]
        self.find = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of added tokens found in the text."""
        if not any(a in text for a in self.added):
            return self.find(text), 0
        parts = regex.split("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))), text)
        return [x for p in parts for x in self.find(p)], len(parts) - 1


def _runs(batches, column: int):
    """Slices of the batches with about RUN_BYTES of texts, so that memory does not grow with the rows of a batch."""
    for b in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            if size and size + n > RUN_BYTES:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        yield b.slice(at)


def _term_counts(name: str):
    def run(batches):
        split, seen = PreTokens(name), Counter()
        for b in _runs(batches, 0):
            for t in b.column(0).to_pylist():
                seen.update(split(t)[0])
            if len(seen) > MOST_SEEN:
                yield from _flats(seen)
                seen = Counter()
        if seen:
            yield from _flats(seen)

    return run


def _flat(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


def _flats(seen: Counter, rows: int = 100_000):
    whole = _flat(seen)
    yield from (whole.slice(i, rows) for i in range(0, whole.num_rows, rows))


def _piece_counts(name: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tok = load_tokenizer(name)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):  # encodings of a few terms at a time
                b = whole.slice(i, 1000)
                counts = [len(e.ids) for e in tok.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["term", "n", "pieces"])

    return run


def _per_document(name: str, head):
    def run(batches):
        import itertools

        split, known = PreTokens(name), head.value
        get, number = known.get, itertools.count()
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 40
        for b in _runs(batches, 1):
            sums, tails, ids, sizes = [], [], [], []
            for t in b.column(1).to_pylist():
                terms, extra = split(t)
                found = list(map(get, terms))
                if None in found:
                    tails.append([x for x, c in zip(terms, found, strict=True) if c is None])
                    sums.append(sum(filter(None, found)) + extra)
                else:
                    tails.append([])
                    sums.append(sum(found) + extra)
                ids.append(part + next(number))
                sizes.append(len(t.encode()))
            yield pa.record_batch([pa.array(ids, pa.int64()), b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tails, pa.list_(pa.string()))], names=["rid", "doc_id", "n_bytes", "head_tokens", "tail"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json", limit: int = 512, head_terms: int = HEAD_TERMS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null counts as the empty text, which has no tokens.  Strings of added tokens inside a text count as one token each,
    the library's default.  Repeated rows are counted each; other columns of docs are not read.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    terms = texts.select("t").mapInArrow(_term_counts(name), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    terms = written(terms.mapInArrow(_piece_counts(name), "term string, n long, pieces long"), "pre-tokens")
    head = head_of(terms, head_terms)
    shared = spark.sparkContext.broadcast(to_map(head, "pieces"))
    per_doc = written(texts.mapInArrow(_per_document(name, shared), "rid long, doc_id long, n_bytes long, head_tokens long, tail array<string>"), "pre-token-tails")
    shared.destroy()  # reused workers would keep the head
    tail = per_doc.select("rid", F.explode("tail").alias("term")).join(terms.select("term", "pieces"), "term")
    tail = tail.groupBy("rid").agg(F.sum("pieces").alias("tail_tokens"))
    total = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return per_doc.drop("tail").join(tail, "rid", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
