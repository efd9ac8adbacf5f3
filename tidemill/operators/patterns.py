"""Candlestick patterns as predicates over the last bars, and what follows them.

A pattern is a condition over a bar (o, h, l, c), the bars before it (o1, c1, ... o4, c4)
and the mean body of ten bars; its value is 1 for a rising, -1 for a falling signal.
"""

from __future__ import annotations

from collections.abc import Callable

from tidemill.plans.flow import Flow

AHEAD = 2


def _body(i: str = "") -> str:
    return f"abs(c{i} - o{i})"


def _up(i: str = "") -> str:
    return f"c{i} > o{i}"


def _down(i: str = "") -> str:
    return f"c{i} < o{i}"


def _above(i: str = "") -> str:
    return f"(h{i} - greatest(o{i}, c{i}))"


def _below(i: str = "") -> str:
    return f"(least(o{i}, c{i}) - l{i})"


_SMALL, _LONG = f"{_body()} < 0.3 * mean_body", f"{_body()} > 1.3 * mean_body"
_LONG1, _LONG2, _SMALL1 = f"{_body('1')} > mean_body", f"{_body('2')} > mean_body", f"{_body('1')} < 0.5 * mean_body"
#: Rising and falling condition of each pattern; one of them may be missing.
PATTERNS: dict[str, tuple[str | None, str | None]] = {
    "doji": (f"{_body()} <= 0.1 * (h - l)", None),
    "dragonfly_doji": (f"{_body()} <= 0.1 * (h - l) AND {_above()} <= 0.1 * (h - l) AND {_below()} > 0.3 * (h - l)", None),
    "gravestone_doji": (None, f"{_body()} <= 0.1 * (h - l) AND {_below()} <= 0.1 * (h - l) AND {_above()} > 0.3 * (h - l)"),
    "long_legged_doji": (f"{_body()} <= 0.1 * (h - l) AND {_above()} > 0.3 * (h - l) AND {_below()} > 0.3 * (h - l)", None),
    "hammer": (f"{_body()} > 0 AND {_below()} > 2 * {_body()} AND {_above()} < 0.3 * {_body()} AND c1 < c3", None),
    "hanging_man": (None, f"{_body()} > 0 AND {_below()} > 2 * {_body()} AND {_above()} < 0.3 * {_body()} AND c1 > c3"),
    "inverted_hammer": (f"{_body()} > 0 AND {_above()} > 2 * {_body()} AND {_below()} < 0.3 * {_body()} AND c1 < c3", None),
    "shooting_star": (None, f"{_body()} > 0 AND {_above()} > 2 * {_body()} AND {_below()} < 0.3 * {_body()} AND c1 > c3"),
    "marubozu": (f"{_up()} AND {_body()} > 0.95 * (h - l)", f"{_down()} AND {_body()} > 0.95 * (h - l)"),
    "closing_marubozu": (f"{_up()} AND {_LONG} AND {_above()} < 0.05 * (h - l)", f"{_down()} AND {_LONG} AND {_below()} < 0.05 * (h - l)"),
    "belt_hold": (f"{_up()} AND {_LONG} AND {_below()} < 0.05 * (h - l)", f"{_down()} AND {_LONG} AND {_above()} < 0.05 * (h - l)"),
    "spinning_top": (f"{_up()} AND {_SMALL} AND {_above()} > {_body()} AND {_below()} > {_body()}", f"{_down()} AND {_SMALL} AND {_above()} > {_body()} AND {_below()} > {_body()}"),
    "high_wave": (f"{_up()} AND {_SMALL} AND {_above()} > 2 * mean_body AND {_below()} > 2 * mean_body", f"{_down()} AND {_SMALL} AND {_above()} > 2 * mean_body AND {_below()} > 2 * mean_body"),
    "long_line": (f"{_up()} AND {_LONG} AND {_above()} < 0.3 * {_body()} AND {_below()} < 0.3 * {_body()}", f"{_down()} AND {_LONG} AND {_above()} < 0.3 * {_body()} AND {_below()} < 0.3 * {_body()}"),
    "short_line": (f"{_up()} AND {_SMALL} AND {_above()} < {_body()} AND {_below()} < {_body()}", f"{_down()} AND {_SMALL} AND {_above()} < {_body()} AND {_below()} < {_body()}"),
    "engulfing": (f"{_up()} AND {_down('1')} AND c >= o1 AND o <= c1 AND {_body()} > {_body('1')}", f"{_down()} AND {_up('1')} AND o >= c1 AND c <= o1 AND {_body()} > {_body('1')}"),
    "harami": (f"{_up()} AND {_down('1')} AND {_LONG1} AND c < o1 AND o > c1", f"{_down()} AND {_up('1')} AND {_LONG1} AND o < c1 AND c > o1"),
    "harami_cross": (f"{_down('1')} AND {_LONG1} AND {_body()} <= 0.1 * (h - l) AND greatest(o, c) < o1 AND least(o, c) > c1", f"{_up('1')} AND {_LONG1} AND {_body()} <= 0.1 * (h - l) AND greatest(o, c) < c1 AND least(o, c) > o1"),
    "piercing": (f"{_down('1')} AND {_LONG1} AND {_up()} AND o < c1 AND c > (o1 + c1) / 2 AND c < o1", None),
    "dark_cloud_cover": (None, f"{_up('1')} AND {_LONG1} AND {_down()} AND o > c1 AND c < (o1 + c1) / 2 AND c > o1"),
    "on_neck": (None, f"{_down('1')} AND {_LONG1} AND {_up()} AND o < l1 AND abs(c - l1) <= 0.05 * mean_body"),
    "thrusting": (None, f"{_down('1')} AND {_LONG1} AND {_up()} AND o < l1 AND c > c1 AND c <= (o1 + c1) / 2"),
    "counter_attack": (f"{_down('1')} AND {_LONG1} AND {_up()} AND {_LONG} AND abs(c - c1) <= 0.05 * mean_body", f"{_up('1')} AND {_LONG1} AND {_down()} AND {_LONG} AND abs(c - c1) <= 0.05 * mean_body"),
    "kicking": (f"{_down('1')} AND {_up()} AND {_LONG1} AND {_LONG} AND l > h1", f"{_up('1')} AND {_down()} AND {_LONG1} AND {_LONG} AND h < l1"),
    "matching_low": (f"{_down('1')} AND {_down()} AND abs(c - c1) <= 0.05 * mean_body", None),
    "homing_pigeon": (f"{_down('1')} AND {_down()} AND {_LONG1} AND o < o1 AND c > c1", None),
    "separating_lines": (f"{_down('1')} AND {_up()} AND abs(o - o1) <= 0.05 * mean_body", f"{_up('1')} AND {_down()} AND abs(o - o1) <= 0.05 * mean_body"),
    "doji_star": (f"{_down('1')} AND {_LONG1} AND {_body()} <= 0.1 * (h - l) AND greatest(o, c) < c1", f"{_up('1')} AND {_LONG1} AND {_body()} <= 0.1 * (h - l) AND least(o, c) > c1"),
    "morning_star": (f"{_down('2')} AND {_LONG2} AND {_SMALL1} AND greatest(o1, c1) < c2 AND {_up()} AND c > (o2 + c2) / 2", None),
    "evening_star": (None, f"{_up('2')} AND {_LONG2} AND {_SMALL1} AND least(o1, c1) > c2 AND {_down()} AND c < (o2 + c2) / 2"),
    "three_white_soldiers": (f"{_up()} AND {_up('1')} AND {_up('2')} AND c > c1 AND c1 > c2 AND o > o1 AND o < c1 AND o1 > o2 AND o1 < c2", None),
    "three_black_crows": (None, f"{_down()} AND {_down('1')} AND {_down('2')} AND c < c1 AND c1 < c2 AND o < o1 AND o > c1 AND o1 < o2 AND o1 > c2"),
    "three_inside": (f"{_down('2')} AND {_LONG2} AND {_up('1')} AND c1 < o2 AND o1 > c2 AND {_up()} AND c > o2", f"{_up('2')} AND {_LONG2} AND {_down('1')} AND o1 < c2 AND c1 > o2 AND {_down()} AND c < o2"),
    "three_outside": (f"{_down('2')} AND {_up('1')} AND c1 > o2 AND o1 < c2 AND {_up()} AND c > c1", f"{_up('2')} AND {_down('1')} AND o1 > c2 AND c1 < o2 AND {_down()} AND c < c1"),
    "three_line_strike": (f"{_up('3')} AND {_up('2')} AND {_up('1')} AND c2 > c3 AND c1 > c2 AND {_down()} AND o > c1 AND c < o3", f"{_down('3')} AND {_down('2')} AND {_down('1')} AND c2 < c3 AND c1 < c2 AND {_up()} AND o < c1 AND c > o3"),
    "advance_block": (None, f"{_up()} AND {_up('1')} AND {_up('2')} AND c > c1 AND c1 > c2 AND {_body()} < {_body('1')} AND {_body('1')} < {_body('2')} AND {_above()} > {_above('1')}"),
    "identical_three_crows": (None, f"{_down()} AND {_down('1')} AND {_down('2')} AND c < c1 AND c1 < c2 AND abs(o - c1) <= 0.1 * mean_body AND abs(o1 - c2) <= 0.1 * mean_body"),
    "two_crows": (None, f"{_up('2')} AND {_LONG2} AND {_down('1')} AND c1 > c2 AND {_down()} AND o < o1 AND o > c1 AND c < c2 AND c > o2"),
    "stick_sandwich": (f"{_down('2')} AND {_up('1')} AND l1 > c2 AND {_down()} AND abs(c - c2) <= 0.05 * mean_body", None),
    "tri_star": (f"{_body()} <= 0.1 * (h - l) AND {_body('1')} <= 0.1 * (h1 - l1) AND {_body('2')} <= 0.1 * (h2 - l2) AND greatest(o1, c1) < least(o2, c2)", f"{_body()} <= 0.1 * (h - l) AND {_body('1')} <= 0.1 * (h1 - l1) AND {_body('2')} <= 0.1 * (h2 - l2) AND least(o1, c1) > greatest(o2, c2)"),
    "rising_three_methods": (f"{_up('4')} AND {_body('4')} > mean_body AND {_down('3')} AND {_down('2')} AND {_down('1')} AND l1 > l4 AND h3 < h4 AND {_up()} AND c > c4", f"{_down('4')} AND {_body('4')} > mean_body AND {_up('3')} AND {_up('2')} AND {_up('1')} AND h1 < h4 AND l3 > l4 AND {_down()} AND c < c4"),
    "breakaway": (f"{_down('4')} AND {_body('4')} > mean_body AND {_down('3')} AND o3 < c4 AND c2 < c3 AND c1 < c2 AND {_up()} AND c > o3 AND c < c4", f"{_up('4')} AND {_body('4')} > mean_body AND {_up('3')} AND o3 > c4 AND c2 > c3 AND c1 > c2 AND {_down()} AND c < o3 AND c > c4"),
    "tasuki_gap": (f"{_up('2')} AND {_up('1')} AND o1 > c2 AND {_down()} AND o < c1 AND o > o1 AND c < o1 AND c > c2", f"{_down('2')} AND {_down('1')} AND o1 < c2 AND {_up()} AND o > c1 AND o < o1 AND c > o1 AND c < c2"),
    "takuri": (f"{_body()} <= 0.1 * (h - l) AND {_above()} <= 0.1 * (h - l) AND {_below()} > 2 * mean_body", None),
    "rickshaw_man": (f"{_body()} <= 0.1 * (h - l) AND {_above()} > 0.3 * (h - l) AND {_below()} > 0.3 * (h - l) AND abs((o + c) / 2 - (h + l) / 2) <= 0.1 * (h - l)", None),
}


def _values() -> dict[str, str]:
    return {k: f"CASE {f'WHEN {up} THEN 1 ' if up else ''}{f'WHEN {down} THEN -1 ' if down else ''}ELSE 0 END" for k, (up, down) in PATTERNS.items()}


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    return {"candle_patterns": flow.run(flow.queries["candle_patterns"], {"lineitem": "l_suppkey"})}, {}


def add(flow: Flow) -> None:
    before = ", ".join(f"lag({n}, {i}) OVER w AS {n[0]}{i}" for i in range(1, 5) for n in ("open", "high", "low", "close"))
    values = _values()
    flow.step(
        candle_bars=f"SELECT code, ts, open AS o, high AS h, low AS l, close AS c, {before}, avg(abs(close - open)) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_body, lead(close, {AHEAD}) OVER w / nullif(close, 0) - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)",
        # a sign a pattern: bars of the same hits are summed before patterns are told apart
        candle_hits="SELECT hits, count(*) AS n, count_if(fwd > 0) AS n_up, count_if(fwd < 0) AS n_down, sum(fwd) AS s FROM (SELECT fwd, concat(" + ", ".join(f"CASE {f'WHEN {up} THEN {chr(39)}+{chr(39)} ' if up else ''}{f'WHEN {down} THEN {chr(39)}-{chr(39)} ' if down else ''}ELSE ' ' END" for up, down in PATTERNS.values()) + ") AS hits FROM candle_bars WHERE fwd IS NOT NULL) x GROUP BY hits",
    )
    names = ", ".join(f"({i}, '{k}')" for i, k in enumerate(PATTERNS, 1))
    self_join = "WITH b AS (SELECT code, ts, open, high, low, close, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM bars), v AS (SELECT b0.code, b0.ts, b0.open AS o, b0.high AS h, b0.low AS l, b0.close AS c, " + ", ".join(f"b{i}.{n} AS {n[0]}{i}" for i in range(1, 5) for n in ("open", "high", "low", "close")) + f", (SELECT avg(abs(z.close - z.open)) FROM b z WHERE z.code = b0.code AND z.i BETWEEN b0.i - 9 AND b0.i) AS mean_body, f.close / nullif(b0.close, 0) - 1 AS fwd FROM b b0 " + " ".join(f"LEFT JOIN b b{i} ON b{i}.code = b0.code AND b{i}.i = b0.i - {i}" for i in range(1, 5)) + f" LEFT JOIN b f ON f.code = b0.code AND f.i = b0.i + {AHEAD})"
    flow.pair(
        candle_patterns=(
            f"""SELECT pattern, signal, sum(n) AS n, round(sum(CASE WHEN signal > 0 THEN n_up ELSE n_down END) / cast(sum(n) AS double), 6) AS win_rate, round(sum(s) / sum(n), 7) AS mean_fwd FROM (
                SELECT p.p AS pattern, CASE substring(hits, p.i, 1) WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END AS signal, n, n_up, n_down, s FROM candle_hits CROSS JOIN (VALUES {names}) AS p(i, p)) x WHERE signal <> 0 GROUP BY pattern, signal""",
            self_join + ", u AS (SELECT fwd, unnest([" + ", ".join(f"'{k}'" for k in PATTERNS) + "]) AS pattern, unnest([" + ", ".join(values.values()) + "]) AS signal FROM v WHERE fwd IS NOT NULL) SELECT pattern, signal, count(*) AS n, round(count(*) FILTER (WHERE sign(signal) = sign(fwd))::DOUBLE / count(*), 6) AS win_rate, round(avg(fwd), 7) AS mean_fwd FROM u WHERE signal <> 0 GROUP BY ALL",
        ),
    )
