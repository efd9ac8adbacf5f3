"""Expressions that operators share, as SQL text."""

from __future__ import annotations

ROWS = "PARTITION BY code ORDER BY ts"


def last(n: int, keys: str = ROWS) -> str:
    """The frame of the last n rows."""
    return f"({keys} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(call: str, n: int, least: int = 1, of: str = "close", keys: str = ROWS) -> str:
    """``call`` over the last n rows, null below ``least`` values."""
    frame = last(n, keys)
    whole = f"{call} OVER {frame}"
    return whole if least <= 1 else f"CASE WHEN count({of}) OVER {frame} >= {least} THEN {whole} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({ROWS})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({ROWS})"


def ratio(a: str, b: str, default: str = "NULL") -> str:
    """a / b; ``default`` where b is zero or either is null."""
    quotient = f"(({a}) / nullif({b}, 0))"
    return quotient if default == "NULL" else f"coalesce({quotient}, {default})"


def average_rank(x: str, keys: str) -> str:
    """Rank within ``keys``, ties sharing the mean of their ranks: one window serves both terms."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys} ORDER BY {x} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0)"


def edge_bucket(x: str, edges: list[str]) -> str:
    """0-based bucket of x among sorted inner ``edges``; a bucket holds its right edge."""
    return "(" + " + ".join(f"CASE WHEN {x} > {e} THEN 1 ELSE 0 END" for e in edges) + ")"


def clip(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def correlation(a: str, b: str, over: str = "") -> str:
    """Pearson's r, null for a constant side (``corr`` itself raises there under ANSI)."""
    of = f" OVER {over}" if over else ""
    return f"(covar_pop({a}, {b}){of} / nullif(stddev_pop({a}){of} * stddev_pop({b}){of}, 0))"
