"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every figure is a built-in expression over the text column, so the whole filter is a single Project above the scan
(no shuffle, no Python).  Arrays that several expressions need are bound once as lambda variables (see let), since
Catalyst would otherwise split the text again for every use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import table

#: Function words of the corpus languages (en, fr, de, es) for the stop-word ratio.
STOP_WORDS = (
    "the and of to in is that for it with as was on are by this be at or from "
    "de la le les et des en un une que qui du pour dans avec est "
    "der die und das ist den von zu mit sich auf ein des nicht "
    "el los las del por con para es se una al lo no su"
)


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.  A ratio over an empty denominator is 0.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("shouts_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.5),
)

_WS = r"' \\t\\n\\x0b\\x0c\\r'".replace(r"\\x0b", r"\\u000B").replace(r"\\x0c", r"\\u000C").replace("\\\\", "\\")
_GAP = r"'[\\x20\\x09-\\x0D]+'"
_MASK = (1 << 24) - 1


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and gives it to body under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _covered(positions: str) -> str:
    """Words inside three-word windows that start at the given sorted distinct positions."""
    step = "acc + if(k = size(p) - 1, 3L, least(3L, p[k + 1] - p[k]))"
    return let(positions, "p", f"if(size(p) = 0, 0L, aggregate(sequence(0, size(p) - 1), 0L, (acc, k) -> {step}))")


def repeat_words_sql(words: str) -> str:
    """Words in three-word windows found twice or more, for the SQL name of a word array.

    Texts whose window hashes all differ have none.  In the others, windows are sorted as (40-bit hash, 24-bit position)
    in one primitive array, and equal neighbours are compared word by word.  A hash that two different windows share, or
    a text of 2^24 words, takes the exact path, which sorts the words themselves.
    """
    w, n = words, f"size({words})"
    windows = f"transform(slice({w}, 1, {n} - 2), (x, i) -> xxhash64(x, {w}[i + 1], {w}[i + 2]))"
    hashed = f"sort_array(transform(h, (v, i) -> shiftleft(v, 24) | cast(i as bigint)))"
    at = lambda j: f"cast(s[{j}] & {_MASK}L as int)"
    same = " and ".join(f"{w}[{at('j')} + {d}] = {w}[{at('j - 1')} + {d}]" for d in range(3))
    from_hash = _covered(f"sort_array(array_distinct(flatten(transform(js, j -> array(s[j] & {_MASK}L, s[j - 1] & {_MASK}L)))))")
    exact_sort = f"sort_array(transform(slice({w}, 1, {n} - 2), (x, i) -> struct(x as a, {w}[i + 1] as b, {w}[i + 2] as c, cast(i as bigint) as i)))"
    pairs = "filter(sequence(1, size(t) - 1), j -> t[j].a = t[j - 1].a and t[j].b = t[j - 1].b and t[j].c = t[j - 1].c)"
    exact = let(exact_sort, "t", _covered(f"sort_array(array_distinct(flatten(transform({pairs}, j -> array(t[j].i, t[j - 1].i)))))"))
    near = "filter(sequence(1, size(s) - 1), j -> shiftright(s[j], 24) = shiftright(s[j - 1], 24))"
    fast = let(hashed, "s", let(near, "js", f"case when size(js) = 0 then 0L when forall(js, j -> {same}) then {from_hash} else -1L end"))
    checked = let(fast, "r", f"if(r < 0, {exact}, r)")
    some = let(windows, "h", f"if(size(array_distinct(h)) = size(h), 0L, {checked})")
    return f"case when {n} < 4 then 0L when {n} > {_MASK} then {exact} else {some} end"


def base_sql(text: str) -> dict[str, str]:
    """SQL of the raw counts that every rule starts from; text is the SQL name of a non-null string."""
    trimmed = f"btrim({text}, {_WS})"
    words = f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, {_GAP}))"
    stops = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS.split())))
    inner = {
        "n_words": "cast(size(w) as bigint)",
        "word_chars": "cast(length(array_join(w, '')) as bigint)",
        "n_stop_words": f"cast(size(filter(w, x -> x in ({stops}))) as bigint)",
        "n_repeat_words": repeat_words_sql("w"),
    }
    both = let(words, "w", "struct(" + ", ".join(f"{v} as {k}" for k, v in inner.items()) + ")")
    lines = f"filter(split({text}, '\\n'), l -> btrim(l, {_WS}) != '')"
    dup = let(lines, "ls", "struct(cast(size(ls) as bigint) as n_lines, cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines)")
    return {
        "word_figures": both,
        "line_figures": dup,
        "n_symbols": f"cast(regexp_count({text}, '[#*$%&|<>]') as bigint)",
        "n_shouts": f"cast(regexp_count({text}, '!') as bigint)",
        "n_ellipsis_lines": f"cast(regexp_count({text}, '\\\\.\\\\.\\\\.[\\\\x20\\\\t]*(?:\\\\n|$)') as bigint)",
    }


def metrics() -> dict[str, object]:
    """The ratios that rules may name, over the raw counts."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "shouts_per_word": per("n_shouts", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def compile_rules(rules=RULES):
    """One boolean Column that is true when every rule of the table holds."""
    known, out = metrics(), F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (known[r.metric] >= F.lit(r.low))
        if r.high is not None:
            out = out & (known[r.metric] <= F.lit(r.high))
    return out


def quality_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: raw counts, base_failed and kept.

    Null counts as the empty text, which has no words and fails.  Repeated rows are judged one by one; other columns
    of docs are not read, so their names cannot clash.  An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", *(F.expr(v).alias(k) for k, v in base_sql("t").items()))
    d = d.select("doc_id", "word_figures.*", "line_figures.*", "n_symbols", "n_shouts", "n_ellipsis_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"),
        "n_lines", "n_shouts", "n_stop_words", "n_ellipsis_lines",
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = quality_figures(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL of op8, from the same threshold table."""
    per = lambda a, b: f"(case when {b} > 0 then {a} / {b} else 0 end)"
    terms = {
        "n_words": "n_words", "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "shouts_per_word": per("n_shouts", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"), "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }
    rules = [f"{terms[r.metric]} >= {r.low}" for r in RULES if r.low is not None] + [f"{terms[r.metric]} <= {r.high}" for r in RULES if r.high is not None]
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    ws = r"[\x20\x09-\x0D]"
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
b as (select doc_id, t, list_filter(string_split_regex(t, '{ws}+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
p as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from b),
g as (select doc_id, i, a, lead(a) over o as b, lead(a, 2) over o as c from p window o as (partition by doc_id order by i)),
r as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g where c is not null),
v as (select doc_id, count(distinct i + k) as n_repeat_words from r, (values (0), (1), (2)) z(k) where n > 1 group by doc_id),
m as (select b.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
 len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(regexp_extract_all(t, '!')) as n_shouts,
 len(list_filter(w, lambda x: x in ({stops}))) as n_stop_words, len(regexp_extract_all(t, '\.\.\.[\x20\t]*(?:\n|$)')) as n_ellipsis_lines
 from b left join v on b.doc_id = v.doc_id),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(rules)} as kept from f
"""
