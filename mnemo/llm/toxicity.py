"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers case, strips accents and zero-width characters, and maps homoglyphs and digit substitutions to one letter
each, in the lexicon and in texts alike.  Lexicon entries are word beginnings, so that inflections match; their weights
are smoothed log-odds of document frequencies in labelled texts.  Two-word phrases around a match that labelled clean
texts use are exceptions and cancel it.  A text's matched weight is normalised by its length and mapped to 0..1 by a
logistic curve, fitted on labelled texts that the lexicon has not seen.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import fold_of, table

#: At most about so many labelled rows train the lexicon and the curve; a documented bound, drawn by a hash of the id.
MAX_LABELLED = 24_000
#: Shortest and longest word beginning in the lexicon.
SHORTEST, LONGEST = 4, 14
#: Entries: least toxic documents, least log-odds, most entries.
LEAST_TOXIC, LEAST_ODDS, MOST_ENTRIES = 6, 2.5, 20_000

#: Characters that look like a Latin letter (Cyrillic, Greek and others), and digits or signs that stand
#: for one.  i, l and 1 fold to one letter, since either may be meant.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ø": "o", "ł": "i", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i",
}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_TABLE = {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys(map(ord, _INVISIBLE), None) | dict.fromkeys(range(0x300, 0x370), None)
_TABLE |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$"}
_ASCII = str.maketrans({k: v for k, v in _TABLE.items() if k < 128})


def fold(text: str) -> str:
    """Folded text: words parted by single spaces, one space before and after."""
    t = text.lower()
    t = t.translate(_ASCII) if t.isascii() else unicodedata.normalize("NFKD", t).translate(_TABLE)
    return f" {' '.join(t.split())} "


@dataclass
class Lexicon:
    """Word beginnings with weights, phrases that cancel a match, and the curve (intercept, slope of density, slope of mass)."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.5)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for w, weight in self.weights.items():
                self._machine.add_word(f" {w}", (len(w), weight))
            if self.weights:
                self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the longest entry at each word that matches one and is no exception."""
        if not self.weights:
            return []
        best: dict[int, tuple[int, float]] = {}
        for last, (size, weight) in self.machine().iter(folded):
            best[last - size + 1] = (size, weight)  # longer entries at one start come later
        out = []
        for at, (size, weight) in best.items():
            if not self.exceptions or not any(p in self.exceptions for p in phrases(folded, at)):
                out.append((at, at + size, weight))
        return out

    def figures(self, folded: str) -> tuple[float, float]:
        """Matched weight per hundred words, and the matched weight itself, both damped by a logarithm."""
        mass = sum(w for _, _, w in self.matches(folded))
        words = folded.count(" ") - 1
        return math.log1p(100.0 * mass / (words + 20.0)), math.log1p(mass)

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.figures(fold(text))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def phrases(folded: str, at: int) -> tuple[str, str]:
    """The word that starts at `at` with the word before it, and with the word after it."""
    end = folded.find(" ", at)
    before = folded.rfind(" ", 0, max(0, at - 1))
    after = folded.find(" ", end + 1)
    return f"<{folded[before + 1 : end]}", f">{folded[at : after if after > 0 else len(folded)].rstrip()}"


def _beginnings(batches):
    """Document frequencies of word beginnings, by label."""
    toxic, clean = Counter(), Counter()
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            heads = {w[:k] for w in set(fold(t).split()) for k in range(min(SHORTEST, len(w)), min(LONGEST, len(w)) + 1)}
            (toxic if y else clean).update(heads)
    keys = list(toxic | clean)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["head", "toxic", "clean"])


def choose_entries(rows, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries: for a family of word beginnings, the shortest whose odds are near the best below it.

    rows: (head, toxic documents, clean documents).  A beginning that only one longer one continues gives way to it.
    """
    odds = {h: math.log((t + 0.5) / (n_toxic + 1.0)) - math.log((c + 0.5) / (n_clean + 1.0)) for h, t, c in rows}
    count = {h: t for h, t, _ in rows}
    good = {h for h in odds if odds[h] >= LEAST_ODDS and count[h] >= LEAST_TOXIC}
    longer: dict[str, list[str]] = {}
    for h in good:
        longer.setdefault(h[:-1], []).append(h)
    out: dict[str, float] = {}
    for h in sorted(good, key=lambda x: (len(x), x)):
        if any(h[:k] in out for k in range(1, len(h))):
            continue
        while (more := longer.get(h)) and len(more) == 1 and count[more[0]] >= 0.95 * count[h]:
            h = more[0]
        out[h] = odds[h]
    return dict(sorted(out.items(), key=lambda x: (-count[x[0]] * x[1], x[0]))[:MOST_ENTRIES])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps on (density, mass), lightly regularised."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _probe(shared):
    def run(batches):
        lex = shared.value
        for b in batches:
            folded = [fold(t) for t in b.column(0).to_pylist()]
            fig = [lex.figures(f) for f in folded]
            near = [[p for at, _, _ in lex.matches(f) for p in phrases(f, at)] for f in folded]
            yield pa.record_batch([b.column(1), pa.array([x for x, _ in fig], pa.float64()), pa.array([y for _, y in fig], pa.float64()), pa.array(near, pa.list_(pa.string()))], names=["y", "density", "mass", "near"])

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from labelled rows whose crc32(id) mod 5 is not 0: folds 1 to 3 give entries, fold 4 exceptions and curve.

    Rows without a label, a text or an id teach nothing; of an id labelled twice the larger label holds.  Equal texts
    teach once, under the larger label and in the fold of their least id, however rows are partitioned.  Without toxic
    or clean rows the lexicon is empty and every score is the base rate.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold_of(id_col, 5) != 0)).groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "lid"), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    # about max_labelled rows of 12 bytes: a size that the parameter bounds
    rows = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(known), F.col("did") == F.col("lid"))
    rows = rows.groupBy("t").agg(F.max("y").alias("y"), F.min("lid").alias("least")).select("t", "y", fold_of("least", 5).alias("part"))
    first = rows.where("part != 4").select("t", "y")
    sums = {r.y: r.n for r in first.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    heads = first.mapInArrow(_beginnings, "head string, toxic long, clean long").groupBy("head").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= LEAST_TOXIC)
    odds = F.log((F.col("t") + 0.5) / (sums.get(1, 0) + 1.0)) - F.log((F.col("c") + 0.5) / (sums.get(0, 0) + 1.0))
    lex = Lexicon(choose_entries([tuple(r) for r in heads.where(odds >= LEAST_ODDS).collect()], sums.get(1, 0), sums.get(0, 0)))
    if not sums.get(1) or not sums.get(0):
        lex.weights = {}
    shared = spark.sparkContext.broadcast(lex)
    probe = rows.where("part = 4").select("t", "y").mapInArrow(_probe(shared), "y int, density double, mass double, near array<string>").toPandas()
    toxic, clean = Counter(), Counter()
    for y, near in zip(probe["y"], probe["near"], strict=True):
        (toxic if y else clean).update(set(near))
    exceptions = frozenset(p for p, c in clean.items() if c >= 5 and c > 4 * toxic[p])
    y = probe["y"].to_numpy(dtype=float)
    if len(y) and 0 < y.sum() < len(y) and lex.weights:
        curve = fit_curve(probe[["density", "mass"]].to_numpy(dtype=float), y)
    else:
        rate = (sums.get(1, 0) + 0.5) / (sums.get(1, 0) + sums.get(0, 0) + 1.0)
        curve = (math.log(rate / (1 - rate)) if sums.get(1) != 0 and sums else -4.0, 0.0, 0.0)
    return Lexicon(lex.weights, exceptions, curve)


def scorer(spark, lex: Lexicon):
    """A column function text -> score in 0..1; null scores as the empty text."""
    shared = spark.sparkContext.broadcast(lex)

    def score(texts: pd.Series) -> pd.Series:
        one = shared.value.score
        return pd.Series([one(t or "") for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5).

    Null and empty texts get the curve's value for a text without matches.  Repeated rows are scored each; only the id
    and the text are read, and the id only for the fold.  An empty table gives an empty result.
    """
    score = scorer(docs.sparkSession, learn(docs, labels, id_col, text_col))
    out = docs.select(F.col(id_col).alias("doc_id"), (fold_of(id_col, 5) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
