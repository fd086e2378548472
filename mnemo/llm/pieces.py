"""Counting over a vocabulary too large to broadcast: a bounded head in every task, the tail through a join.

Terms are counted over all documents.  Those above a frequency that at most HEAD_TERMS terms reach (and of at most
HEAD_BYTES bytes) form the head, with a smaller number of longer ones; tasks hold it as a dict, whose size is bounded by
these parameters whatever the input.  Occurrences of all other terms leave a task and meet the counts in a shuffle, so
every term is served and none is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The head holds so many terms at most (about 50 MB as a dict) ...
HEAD_TERMS = 300_000
#: ... of so many bytes each at most.
HEAD_BYTES = 40
#: Of longer terms, up to so many bytes, the head holds so many (8 MB).
LONG_TERMS, LONG_BYTES = 2_000, 4096


def head_condition(terms: DataFrame, most: int = HEAD_TERMS, most_long: int = LONG_TERMS):
    """Of terms (term, n, ...), whether a row is in the head: frequencies that at most `most` short and `most_long` long
    terms reach."""
    size = F.octet_length("term")
    level = F.floor(F.log2("n") * 8)  # an eighth of an octave: a few hundred levels at most
    held = terms.where(size <= LONG_BYTES).groupBy((size > HEAD_BYTES).alias("long"), level.alias("level"))
    rows = sorted(held.agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.level)
    chosen = F.lit(False)
    for long, room in ((False, most), (True, most_long)):
        least = None
        for r in (r for r in rows if r.long == long):
            room -= r.c
            if room < 0:
                break
            least = r.level
        if least is not None:
            chosen = chosen | ((size > HEAD_BYTES) & (size <= LONG_BYTES) if long else size <= HEAD_BYTES) & (level >= least)
    return chosen


def head_of(terms: DataFrame, most: int = HEAD_TERMS) -> DataFrame:
    """The rows of terms (term, n, ...) that are in the head."""
    return terms.where(head_condition(terms, most))


def to_map(head: DataFrame, value: str) -> dict[str, int]:
    """A head as a dict, for a broadcast."""
    t = head.select("term", value).toArrow()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
