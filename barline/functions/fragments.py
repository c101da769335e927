"""Window expressions over a panel as SQL text.

The text is standard SQL but for three names that engines spell differently: PCTL (a linearly interpolated quantile),
LASTNN (the last value that isn't null) and BROUND (half to even). `render` spells them for Spark or for DuckDB, so one
statement of a rule serves the engine and the SQL that it is held against.

Missing values are null, never NaN. A comparison with null holds for nothing; where a rule negates one, `no` and `yes`
make it false first.
"""

from __future__ import annotations

import re

BY_TICKER = "PARTITION BY ticker ORDER BY date"
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")
SPELLING = {
    "spark": {"PCTL(": "percentile(", "BROUND(": "bround("},
    "duckdb": {"PCTL(": "quantile_cont(", "BROUND(": "round_even("},
}


def render(expr: str, dialect: str) -> str:
    """expr for an engine: "spark" or "duckdb"."""
    out, at = [], 0
    while (i := expr.find("LASTNN(", at)) >= 0:
        depth, j = 1, i + len("LASTNN(")
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[j], 0)
            j += 1
        inner = render(expr[i + len("LASTNN(") : j - 1], dialect)
        out += [expr[at:i], f"last({inner}, true)" if dialect == "spark" else f"last_value({inner} IGNORE NULLS)"]
        at = j
    text = "".join(out) + expr[at:]
    for name, spelled in SPELLING[dialect].items():
        text = text.replace(name, spelled)
    return _DECIMAL.sub(r"\1e0", text)  # 0.5 would be a decimal number, 0.5e0 is a double in both


def _edge(n: int) -> str:
    return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"


def frame(first: int | None, last: int) -> str:
    """Rows of a ticker from first to last, counted from the current one; first None: from the beginning."""
    return f"({BY_TICKER} ROWS BETWEEN {'UNBOUNDED PRECEDING' if first is None else _edge(first)} AND {_edge(last)})"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY_TICKER})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({BY_TICKER})"


def roll(agg: str, x: str, n: int, least: int | None = None, before: int = 0) -> str:
    """An aggregate of the last n rows, null below `least` values (all n, if not given); before=1 leaves today out."""
    over = frame(-(n - 1) - before, -before)
    return f"CASE WHEN count({x}) OVER {over} >= {n if least is None else least} THEN {agg}({x}) OVER {over} END"


def quantile(x: str, q: float, n: int, least: int) -> str:
    over = frame(-(n - 1), 0)
    return f"CASE WHEN count({x}) OVER {over} >= {least} THEN PCTL({x}, {q}) OVER {over} END"


def running(agg: str, x: str) -> str:
    return f"{agg}({x}) OVER {frame(None, 0)}"


def fill(x: str) -> str:
    """The last value that isn't null."""
    return f"LASTNN({x}) OVER {frame(None, 0)}"


def div(a: str, b: str) -> str:
    """a by b, null where b is 0."""
    return f"(({a}) / nullif(({b}), 0))"


def no(p: str) -> str:
    return f"(NOT coalesce({p}, false))"


def yes(p: str) -> str:
    return f"coalesce({p}, false)"


#: Rows after which the powers of an exponential average are rebased. A frame reaches back over two blocks at most.
EWM_BLOCK = 500


def ewm(x: str, span: int, least: int, row: str = "rn") -> str:
    """The exponentially weighted mean over the rows so far, weights adjusted for the start, null below `least` values.

    With r rows counted from a ticker's first, the weight decay^(now - r) is decay^now * decay^-r and the first factor
    cancels. So that powers stay in range on series of any length, the frame is the last EWM_BLOCK rows (weights beyond
    are below 1e-20 for spans up to 20) and r is counted from a point that both blocks of the frame share: rows of the
    block before the current one are scaled down by a whole block.
    """
    grow = 1 / (1 - 2 / (span + 1))
    over = frame(-EWM_BLOCK + 1, 0)
    weight = f"power({grow!r}, ({row} % {EWM_BLOCK}) * 1.0)"
    older = f"(floor({row} / {EWM_BLOCK}.0) % 2)"
    value = {side: f"sum(CASE WHEN {older} = {side} THEN {x} * {weight} END) OVER {over}" for side in (0, 1)}
    base = {side: f"sum(CASE WHEN {older} = {side} AND {x} IS NOT NULL THEN {weight} END) OVER {over}" for side in (0, 1)}
    scale = repr((1 / grow) ** EWM_BLOCK)

    def both(parts: dict[int, str]) -> str:
        zero, one = (f"coalesce({parts[side]}, 0.0)" for side in (0, 1))
        return f"(CASE WHEN {older} = 0 THEN {zero} + {one} * {scale} ELSE {one} + {zero} * {scale} END)"

    return f"CASE WHEN count({x}) OVER {frame(None, 0)} >= {least} THEN {div(both(value), both(base))} END"


def pct_rank(x: str, by: str = "date") -> str:
    """Rank over the values that aren't null, ties averaged, by their number."""
    ties = f"count(*) OVER (PARTITION BY {by}, {x})"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + ({ties} - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def tercile(rank: str) -> str:
    return f"CASE WHEN {rank} <= 1.0 / 3 THEN 0 WHEN {rank} <= 2.0 / 3 THEN 1 WHEN {rank} IS NOT NULL THEN 2 END"


def clip(x: str, low: float | None = None, high: float | None = None) -> str:
    """x within bounds; null stays null."""
    inner = x if high is None else f"least({x}, {high})"
    inner = inner if low is None else f"greatest({inner}, {low})"
    return f"CASE WHEN {x} IS NOT NULL THEN {inner} END"
