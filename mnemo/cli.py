"""A line-oriented shell: python -m mnemo.cli [store folder].

Statements end with a semicolon; lines that start with a dot are commands: .help .tables .schema [table] .explain <select>
.quit.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from mnemo.errors import EngineError
from mnemo.session import Engine

HELP = ".help  .tables  .schema [table]  .explain <select>  .quit"


def grid(df: DataFrame, most: int = 1000) -> str:
    """Rows as an ASCII grid, NULL spelled out; of more than `most` rows the first are shown, and it says so."""
    rows = [tuple("NULL" if v is None else str(v) for v in r) for r in df.limit(most + 1).collect()]
    cut, rows = len(rows) > most, rows[:most]
    widths = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    show = lambda cells: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(cells, widths, strict=True)) + "|"
    return "\n".join([line, show(df.columns), line, *map(show, rows), *([line] if rows else []), f"first {most} rows, there are more" if cut else f"{len(rows)} row{'s' * (len(rows) != 1)}"])


def answer(engine: Engine, text: str) -> str | None:
    """What the shell prints for one command or statement; None ends it."""
    text = text.strip()
    if text.startswith("."):
        word, _, rest = text.partition(" ")
        if word in (".quit", ".exit"):
            return None
        if word == ".tables":
            return "\n".join(engine.table_names())
        if word == ".schema":
            return "\n\n".join(engine.render_schema(t) for t in ([rest.strip()] if rest.strip() else engine.table_names()))
        if word == ".explain":
            return engine.explain(rest.rstrip("; "))
        return HELP
    try:
        got = engine.execute(text)
    except EngineError as e:
        return f"{type(e).__name__}: {e}"
    return grid(got) if isinstance(got, DataFrame) else f"ok, {got.rows_affected} row{'s' * (got.rows_affected != 1)}"


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("mnemo").getOrCreate()
    engine, held = Engine(spark, argv[0] if argv else None), ""
    for line in sys.stdin:
        if not held and line.startswith("."):
            out = answer(engine, line)
        else:
            held += line
            if not held.rstrip().endswith(";"):
                continue
            out, held = answer(engine, held), ""
        if out is None:
            break
        print(out, flush=True)
    engine.close()


if __name__ == "__main__":
    main(sys.argv[1:])
