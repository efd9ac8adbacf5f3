"""Validation of factors: significance, quantiles, lagged stability indices, cross-sectional regressions.

Every query has a DuckDB statement of its own. Thresholds are arguments of the steps; where
the small tables cannot reach a production threshold, a second query has a smaller one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import average_rank, correlation
from tidemill.functions.special import STUDENT_P_DUCKDB, student_p_sql
from tidemill.plans.flow import Flow

HORIZONS = (1, 5, 10, 20)
#: Days by which a stability index is lagged.
LAGS = (0, 35, 70)
FEATURES = ("beta", "volatility", "liquidity", "k_hat", "c_hat", "momentum", "size")


def quantile_bucket(x: str, edges: str) -> str:
    """1-based bucket of x among the distinct sorted ``edges`` (an array); a bucket holds its right edge."""
    return f"greatest(size(filter({edges}, e -> e < {x})), 1)"


def _quantiles(flow: Flow, name: str, bins: int, least: int) -> None:
    shares = ", ".join(f"{i / bins}" for i in range(bins + 1))
    flow.step(**{
        f"{name}_edges": f"SELECT ts, h, array_distinct(percentile(f, array({shares}))) AS edges, count(*) AS n FROM ranked WHERE h <= 20 GROUP BY ts, h HAVING count(*) >= {least}",
        f"{name}_means": f"SELECT r.ts, r.h, {quantile_bucket('r.f', 'e.edges')} AS q, size(e.edges) - 1 AS n_bins, avg(r.y) AS y, count(*) AS n FROM ranked r JOIN {name}_edges e ON r.ts = e.ts AND r.h = e.h GROUP BY r.ts, r.h, {quantile_bucket('r.f', 'e.edges')}, size(e.edges)",
    })


def _quantiles_duckdb(bins: int, least: int) -> str:
    """Tables e (edges) and g (means) for a statement of their own."""
    shares = ", ".join(f"{i / bins}" for i in range(bins + 1))
    return f"""e AS (SELECT ts, h, list_sort(list_distinct(quantile_cont(f, [{shares}]))) AS edges FROM ranked WHERE h <= 20 GROUP BY ALL HAVING count(*) >= {least}),
        g AS (SELECT r.ts, r.h, greatest(len([x FOR x IN edges IF x < r.f]), 1) AS q, len(edges) - 1 AS n_bins, avg(r.y) AS y, count(*) AS n FROM ranked r JOIN e USING (ts, h) GROUP BY ALL)"""


def _by_industry(least: int) -> tuple[str, str]:
    """IC within industries of at least ``least`` codes a date; every key has a row."""
    return (
        f"""SELECT k.factor, k.h, k.industry, coalesce(i.n_dates, 0) AS n_dates, round(i.ic_mean, 7) AS ic_mean, CASE WHEN i.n_dates IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status FROM (
            SELECT DISTINCT f.factor, h.h, m.industry FROM (VALUES ('momentum'), ('size')) AS f(factor) CROSS JOIN (VALUES (1), (5), (10), (20)) AS h(h) CROSS JOIN (SELECT DISTINCT industry FROM master) m) k
          LEFT JOIN (SELECT factor, h, industry, count(*) AS n_dates, avg(ic) AS ic_mean FROM (SELECT factor, h, industry, ts, {correlation('a', 'b')} AS ic FROM (
            SELECT factor, h, industry, ts, {average_rank('value', 'factor, h, industry, ts')} AS a, {average_rank('y', 'factor, h, industry, ts')} AS b FROM tested_long WHERE factor IN ('momentum', 'size')) x GROUP BY factor, h, industry, ts HAVING count(*) >= {least}) d
            WHERE ic IS NOT NULL GROUP BY factor, h, industry) i ON i.factor = k.factor AND i.h = k.h AND i.industry = k.industry""",
        f"""WITH d AS (SELECT factor, h, industry, ts, corr(a, b) AS ic FROM (SELECT *, rank() OVER (PARTITION BY factor, h, industry, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, h, industry, ts, value) - 1) / 2 AS a,
            rank() OVER (PARTITION BY factor, h, industry, ts ORDER BY y) + (count(*) OVER (PARTITION BY factor, h, industry, ts, y) - 1) / 2 AS b FROM (
              SELECT factor, industry, ts, value, unnest([1, 5, 10, 20]) AS h, unnest([y1, y5, y10, y20]) AS y FROM tested_factors WHERE value IS NOT NULL AND factor IN ('momentum', 'size')) WHERE y IS NOT NULL) GROUP BY ALL HAVING count(*) >= {least})
          SELECT factor, h, industry, count(ic) AS n_dates, round(avg(ic), 7) AS ic_mean, if(count(ic) = 0, 'insufficient_data', 'ok') AS status FROM (SELECT * FROM (SELECT unnest(['momentum', 'size']) AS factor) f CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS h) g CROSS JOIN (SELECT DISTINCT industry FROM master) m) LEFT JOIN d USING (factor, h, industry) GROUP BY ALL""",
    )


def add(flow: Flow) -> None:
    _quantiles(flow, "deciles", 10, 50)
    _quantiles(flow, "fifths", 5, 10)
    flow.step(
        ic_10=f"SELECT ts, h, count(*) AS n, {correlation('rf', 'ry')} AS ic FROM ranked WHERE h <= 20 GROUP BY ts, h HAVING count(*) >= 10 AND count(DISTINCT f) > 1 AND count(DISTINCT y) > 1",
        tested_factors="""SELECT f.code, f.ts, f.industry, n.factor, CASE n.factor WHEN 'momentum' THEN f.f WHEN 'size' THEN f.size WHEN 'rho' THEN e.rho ELSE e.distance END AS value, f.y1, f.y5, f.y10, f.y20
            FROM forward f LEFT JOIN eigen e ON e.code = f.code CROSS JOIN (VALUES ('momentum'), ('size'), ('rho'), ('distance')) AS n(factor)""",
        tested_long="SELECT code, ts, industry, factor, value, h, y FROM (SELECT code, ts, industry, factor, value, h.h, CASE h.h WHEN 1 THEN y1 WHEN 5 THEN y5 WHEN 10 THEN y10 ELSE y20 END AS y FROM tested_factors CROSS JOIN (VALUES (1), (5), (10), (20)) AS h(h) WHERE value IS NOT NULL) x WHERE y IS NOT NULL",
        tested_ranks=f"SELECT factor, h, ts, industry, value, y, {average_rank('value', 'factor, h, ts')} AS a, {average_rank('y', 'factor, h, ts')} AS b, fifth FROM (SELECT l.*, 1 + " + " + ".join(f"CASE WHEN value > e{i} AND e{i} > e{i - 1} THEN 1 ELSE 0 END" for i in range(1, 5)) + " AS fifth FROM tested_long l JOIN tested_edges e ON e.factor = l.factor AND e.h = l.h AND e.ts = l.ts) x",
        # a bucket holds its right edge; equal edges make one
        tested_edges="SELECT factor, h, ts, min(value) AS e0, " + ", ".join(f"percentile(value, 0.{2 * i}) AS e{i}" for i in range(1, 5)) + " FROM tested_long GROUP BY factor, h, ts",
        tested_daily=f"""SELECT factor, h, ts, count(*) AS n, {correlation('a', 'b')} AS ic, avg(CASE WHEN fifth = 1 THEN y END) AS q1, avg(CASE WHEN fifth = 2 THEN y END) AS q2, avg(CASE WHEN fifth = 3 THEN y END) AS q3,
            avg(CASE WHEN fifth = 4 THEN y END) AS q4, avg(CASE WHEN fifth = 5 THEN y END) AS q5 FROM tested_ranks GROUP BY factor, h, ts HAVING count(*) >= 10 AND count(DISTINCT value) > 1""",
        tested_all="""SELECT factor, h, sum(n) AS n_obs, count(*) AS n_dates, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t,
            avg(q1) AS q1, avg(q2) AS q2, avg(q3) AS q3, avg(q4) AS q4, avg(q5) AS q5 FROM tested_daily GROUP BY factor, h""",
        industry_median="SELECT industry, ts, median(close) AS med FROM factors GROUP BY industry, ts HAVING count(*) >= 3",
        industry_forward="SELECT industry, ts, fwd FROM (SELECT industry, ts, lead(med, 5) OVER (PARTITION BY industry ORDER BY ts) / nullif(med, 0) - 1 AS fwd FROM industry_median) x WHERE fwd IS NOT NULL",
        # the index as of a date h days back: both kinds of rows in one window, no range join
        lagged_rows=f"""SELECT industry, lag_days, known_at, kind, ts, fwd, si FROM (
            SELECT industry, l.lag_days, asof_date + l.lag_days AS known_at, 0 AS kind, cast(NULL AS date) AS ts, cast(NULL AS double) AS fwd, si FROM si_time CROSS JOIN (VALUES {', '.join(f'({d})' for d in LAGS)}) AS l(lag_days)
            UNION ALL SELECT industry, l.lag_days, ts, 1, ts, fwd, NULL FROM industry_forward CROSS JOIN (VALUES {', '.join(f'({d})' for d in LAGS)}) AS l(lag_days)) x""",
        lagged_si="SELECT industry, lag_days, ts, fwd, si FROM (SELECT industry, lag_days, kind, ts, fwd, last_value(si) ignore nulls OVER (PARTITION BY industry, lag_days ORDER BY known_at, kind ROWS UNBOUNDED PRECEDING) AS si FROM lagged_rows) x WHERE kind = 1 AND si IS NOT NULL",
        lagged_ic=f"SELECT lag_days, ts, count(*) AS n, {correlation('a', 'b')} AS ic FROM (SELECT lag_days, ts, {average_rank('si', 'lag_days, ts')} AS a, {average_rank('fwd', 'lag_days, ts')} AS b FROM lagged_si) x GROUP BY lag_days, ts HAVING count(*) >= 5",
        rolling_lagged="SELECT lag_days, ts, ord, CASE WHEN count(ic) OVER w >= 30 THEN avg(ic) OVER w END AS ic_60 FROM (SELECT *, row_number() OVER (PARTITION BY lag_days ORDER BY ts) AS ord FROM lagged_ic) x WINDOW w AS (PARTITION BY lag_days ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
        code_means=f"SELECT code, avg(r) AS mean_ret, count(*) AS n FROM (SELECT code, close / nullif(lag(close, 20) OVER (PARTITION BY code ORDER BY ts), 0) - 1 AS r FROM bars) x GROUP BY code",
        code_features="""SELECT f.code, f.beta, f.volatility, f.liquidity, kc.k AS k_hat, kc.c AS c_hat, r.momentum, r.size FROM (
            SELECT code, covar_samp(r, ri) / nullif(var_samp(ri), 0) AS beta, stddev_samp(r) AS volatility, median(volume) AS liquidity FROM (SELECT code, volume, CASE WHEN ri IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN ri END AS ri FROM paired_returns) x GROUP BY code HAVING count(r) >= 50) f
            JOIN (SELECT code, avg(f) AS momentum, ln(1 + avg(size)) AS size FROM factors WHERE f IS NOT NULL GROUP BY code) r ON r.code = f.code LEFT JOIN kc ON kc.code = f.code""",
        # returns over the last dates that a code shares with its index
        paired_returns="""SELECT code, ts, volume, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY ts), 0) - 1 AS r, index_close / nullif(lag(index_close) OVER (PARTITION BY code ORDER BY ts), 0) - 1 AS ri FROM shared_dates WHERE nth <= 168 AND n_shared >= 100""",
        shared_dates="""SELECT s.code, s.ts, s.volume, s.close, i.close AS index_close, row_number() OVER (PARTITION BY s.code ORDER BY s.ts DESC) AS nth, count(*) OVER (PARTITION BY s.code) AS n_shared
            FROM bars s JOIN master m ON s.code = m.code JOIN index_bars i ON i.index_code = m.index_code AND i.ts = s.ts""",
        studied="SELECT c.*, i.q AS q FROM code_features c LEFT JOIN (SELECT code, q FROM insample WHERE model = 2) i ON i.code = c.code",
        studied_long="SELECT code, q, stack(7, " + ", ".join(f"'{f}', {f}" for f in FEATURES) + ") AS (feature, value) FROM studied WHERE q IS NOT NULL",
    )
    p_t = student_p_sql("t", "n_dates - 1")
    p_ic = student_p_sql("ic * sqrt((n - 2) / nullif(1 - ic * ic, 0))", "n - 2")
    duck_p = lambda t, n: STUDENT_P_DUCKDB.format(t=t, n=n)
    flow.pair(
        ic_significance=(
            f"SELECT h, n, round(ic_mean, 8) AS ic_mean, round(t, 6) AS t, round({student_p_sql('t', 'n - 1')}, 7) AS p FROM (SELECT h, count(*) AS n, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t FROM ic GROUP BY h) x",
            f"SELECT h, n, round(m, 8) AS ic_mean, round(t, 6) AS t, round({duck_p('t', 'n - 1')}, 7) AS p FROM (SELECT h, count(*) AS n, avg(ic) AS m, avg(ic) * sqrt(count(*)) / nullif(sqrt(var_samp(ic)), 0) AS t FROM ic GROUP BY h)",
        ),
        cross_section_ic=(
            f"SELECT ts, h, n, round(ic, 8) AS ic, round({p_ic}, 7) AS p FROM ic_10",
            f"""SELECT ts, h, n, round(ic, 8) AS ic, round({duck_p('(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)))', '(n - 2)')}, 7) AS p FROM (SELECT ts, h, count(*) AS n, corr(rf, ry) AS ic FROM (
                SELECT ts, h, f, y, rank() OVER (PARTITION BY ts, h ORDER BY f) + (count(*) OVER (PARTITION BY ts, h, f) - 1) / 2 AS rf, rank() OVER (PARTITION BY ts, h ORDER BY y) + (count(*) OVER (PARTITION BY ts, h, y) - 1) / 2 AS ry FROM ranked WHERE h <= 20) GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT f) > 1 AND count(DISTINCT y) > 1)""",
        ),
        decile_returns=(
            "SELECT h, q, count(*) AS n_dates, round(avg(y), 8) AS mean_ret FROM deciles_means GROUP BY h, q",
            f"WITH {_quantiles_duckdb(10, 50)} SELECT h, q, count(*) AS n_dates, round(sum(y) / count(y), 8) AS mean_ret FROM g GROUP BY ALL",
        ),
        decile_spread=(
            "SELECT ts, h, round(max(CASE WHEN q = n_bins THEN y END) - max(CASE WHEN q = 1 THEN y END), 8) AS long_short FROM deciles_means GROUP BY ts, h",
            f"WITH {_quantiles_duckdb(10, 50)} SELECT ts, h, round((any_value(y) FILTER (WHERE q = n_bins)) - (any_value(y) FILTER (WHERE q = 1)), 8) AS long_short FROM g GROUP BY ALL",
        ),
        fifth_returns=(
            "SELECT ts, h, q, n, round(y, 8) AS mean_ret FROM fifths_means",
            f"WITH {_quantiles_duckdb(5, 10)} SELECT ts, h, q, n, round(y, 8) AS mean_ret FROM g",
        ),
        factor_validation=(
            f"SELECT factor, h, n_obs, n_dates, round(ic_mean, 7) AS ic_mean, round(ic_std, 7) AS ic_std, round(ir, 6) AS ir, round({p_t}, 6) AS p, " + ", ".join(f"round(q{i}, 7) AS q{i}" for i in range(1, 6)) + ", round(q5 - q1, 7) AS spread FROM tested_all",
            f"""WITH u AS (SELECT * FROM (UNPIVOT (SELECT code, ts, factor, value, y1 AS "1", y5 AS "5", y10 AS "10", y20 AS "20" FROM tested_factors WHERE value IS NOT NULL) ON "1", "5", "10", "20" INTO NAME h VALUE y)), o AS (SELECT factor, h, ts, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM u WHERE y IS NOT NULL GROUP BY ALL),
                d AS (SELECT factor, h, ts, count(*) AS n, corr(a, b) AS ic, """ + ", ".join(f"avg(y) FILTER (WHERE w = {i}) AS q{i}" for i in range(1, 6)) + f""" FROM (SELECT u.factor, u.h, u.ts, value, y, greatest(len([x FOR x IN edges IF x < value]), 1) AS w,
                  rank() OVER (PARTITION BY factor, h, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, h, ts, value) - 1) / 2 AS a, rank() OVER (PARTITION BY factor, h, ts ORDER BY y) + (count(*) OVER (PARTITION BY factor, h, ts, y) - 1) / 2 AS b FROM u JOIN o USING (factor, h, ts)) GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT value) > 1)
              SELECT factor, h::INT AS h, n_obs, n_dates, round(m, 7) AS ic_mean, round(s, 7) AS ic_std, round(m / nullif(s, 0), 6) AS ir, round({duck_p('(m / nullif(s, 0) * sqrt(n_dates))', '(n_dates - 1)')}, 6) AS p, """ + ", ".join(f"round(q{i}, 7) AS q{i}" for i in range(1, 6)) + """, round(q5 - q1, 7) AS spread
              FROM (SELECT factor, h, sum(n) AS n_obs, count(*) AS n_dates, avg(ic) AS m, stddev_samp(ic) AS s, """ + ", ".join(f"avg(q{i}) AS q{i}" for i in range(1, 6)) + " FROM d GROUP BY ALL)",
        ),
        validation_by_industry=_by_industry(30),
        validation_by_industry_small=_by_industry(4),
        factor_top_ten=(
            "SELECT factor, h, round(ic_mean, 7) AS ic_mean, round(ir, 6) AS ir, nth FROM (SELECT *, row_number() OVER (ORDER BY round(abs(ic_mean) * abs(ir), 8) DESC, factor, h) AS nth FROM tested_all WHERE ir IS NOT NULL) x WHERE nth <= 10",
            "WITH r AS (SELECT list({'f': factor, 'h': h, 'm': ic_mean, 'i': ir} ORDER BY round(abs(ic_mean * ir), 8) DESC, factor, h) AS l FROM tested_all WHERE ir IS NOT NULL) SELECT l[p].f AS factor, l[p].h AS h, round(l[p].m, 7) AS ic_mean, round(l[p].i, 6) AS ir, p AS nth FROM r, range(1, 11) g(p) WHERE p <= len(l)",
        ),
        full_evaluation=(
            f"""SELECT i.h, i.n_obs, CASE WHEN i.n_obs < 1000 THEN 'too few rows' ELSE '' END AS note, round(i.m, 8) AS ic_mean, round(i.s, 8) AS ic_std, round(i.m / nullif(i.s, 0), 6) AS icir, round(i.m / nullif(i.s, 0) * sqrt(i.n_dates), 5) AS ic_t, round(i.positive, 6) AS positive, round(i.size, 8) AS ic_abs,
                round(max(CASE WHEN i.h = 20 THEN i.m END) OVER (PARTITION BY 1), 8) AS decay_20, round(d.long_short, 8) AS long_short, round(d.sharpe, 5) AS sharpe, round(t.turnover, 6) AS turnover FROM (
                SELECT h, sum(n) AS n_obs, count(*) AS n_dates, avg(ic) AS m, stddev_samp(ic) AS s, avg(abs(ic)) AS size, avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END) AS positive FROM ic_10 GROUP BY h) i
              LEFT JOIN (SELECT h, avg(s) AS long_short, avg(s) / nullif(stddev_samp(s), 0) * sqrt(250) AS sharpe FROM (SELECT ts, h, max(CASE WHEN q = n_bins THEN y END) - max(CASE WHEN q = 1 THEN y END) AS s FROM deciles_means GROUP BY ts, h) x GROUP BY h) d ON d.h = i.h
              CROSS JOIN (SELECT avg(turnover) AS turnover FROM (SELECT 1 - {correlation('a', 'b')} AS turnover FROM (SELECT month, {average_rank('r', 'month')} AS a, {average_rank('p', 'month')} AS b FROM (
                SELECT n.month, n.r, o.r AS p FROM monthly_rank n JOIN month_order m ON n.month = m.month JOIN monthly_rank o ON o.month = m.before AND o.code = n.code) x) z GROUP BY month HAVING count(*) >= 30) y) t""",
            f"""WITH {_quantiles_duckdb(10, 50)},
                tt AS (SELECT month, 1 - corr(a, b) AS v FROM (SELECT month, rank() OVER (PARTITION BY month ORDER BY r) + (count(*) OVER (PARTITION BY month, r) - 1) / 2 AS a, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2 AS b FROM (
                  SELECT n.month, n.r, o.r AS p FROM monthly_rank n ASOF JOIN (SELECT DISTINCT month AS before FROM monthly_rank) k ON n.month > k.before JOIN monthly_rank o ON o.month = k.before AND o.code = n.code)) GROUP BY month HAVING count(*) >= 30),
                ls AS (SELECT h, ts, (any_value(y) FILTER (WHERE q = n_bins)) - (any_value(y) FILTER (WHERE q = 1)) AS s FROM g GROUP BY ALL)
              SELECT h, sum(n) AS n_obs, if(sum(n) < 1000, 'too few rows', '') AS note, round(avg(ic), 8) AS ic_mean, round(sqrt(var_samp(ic)), 8) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0), 5) AS ic_t, round(count(*) FILTER (WHERE ic > 0)::DOUBLE / count(*), 6) AS positive, round(avg(abs(ic)), 8) AS ic_abs,
                (SELECT round(avg(ic), 8) FROM ic_10 WHERE h = 20) AS decay_20, (SELECT round(avg(s), 8) FROM ls WHERE ls.h = ic_10.h) AS long_short, (SELECT round(avg(s) / nullif(stddev_samp(s), 0) * sqrt(250), 5) FROM ls WHERE ls.h = ic_10.h) AS sharpe, (SELECT round(avg(v), 6) FROM tt) AS turnover FROM ic_10 GROUP BY h""",
        ),
        common_forward_returns=(
            """SELECT code, ts, round(y1, 8) AS fwd_1, round(y3, 8) AS fwd_3, round(y6, 8) AS fwd_6 FROM (SELECT *, count(y6) OVER (PARTITION BY ts) AS n FROM (SELECT code, ts, lead(close, 1) OVER w / nullif(close, 0) - 1 AS y1, lead(close, 3) OVER w / nullif(close, 0) - 1 AS y3,
                lead(close, 6) OVER w / nullif(close, 0) - 1 AS y6 FROM bars_m WINDOW w AS (PARTITION BY code ORDER BY ts)) a) b CROSS JOIN (SELECT count(DISTINCT code) AS n_codes FROM bars_m) c WHERE n = n_codes""",
            """WITH l AS (SELECT code, list({'t': ts, 'c': close} ORDER BY ts) AS l FROM bars_m GROUP BY code), r AS (SELECT code, l[i].t AS ts, l[i + 1].c / nullif(l[i].c, 0) - 1 AS y1, l[i + 3].c / nullif(l[i].c, 0) - 1 AS y3, l[i + 6].c / nullif(l[i].c, 0) - 1 AS y6 FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS i FROM l))
              SELECT code, ts, round(y1, 8) AS fwd_1, round(y3, 8) AS fwd_3, round(y6, 8) AS fwd_6 FROM r WHERE ts IN (SELECT ts FROM r WHERE y6 IS NOT NULL GROUP BY ts HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM bars_m))""",
        ),
        lagged_si_ic=(
            "SELECT lag_days, ts, n, round(ic, 6) + 0e0 AS ic FROM lagged_ic",
            f"""WITH q AS (SELECT industry, ts, fwd, lag_days, ts - lag_days::INT AS at FROM industry_forward, (SELECT unnest([{', '.join(map(str, LAGS))}]) AS lag_days)),
                j AS (SELECT q.*, s.si FROM q ASOF JOIN si_time s ON q.industry = s.industry AND q.at >= s.asof_date)
              SELECT lag_days, ts, count(*) AS n, round(corr(a, b), 6) + 0 AS ic FROM (SELECT lag_days, ts, rank() OVER (PARTITION BY lag_days, ts ORDER BY si) + (count(*) OVER (PARTITION BY lag_days, ts, si) - 1) / 2 AS a, rank() OVER (PARTITION BY lag_days, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY lag_days, ts, fwd) - 1) / 2 AS b FROM j WHERE si IS NOT NULL) GROUP BY ALL HAVING count(*) >= 5""",
        ),
        rolling_lagged_ic=(
            "SELECT lag_days, ts, round(ic_60, 6) AS ic_60 FROM rolling_lagged WHERE ord >= 60 AND (ord - 60) % 20 = 0",
            """WITH o AS (SELECT lag_days, list({'t': ts, 'v': ic} ORDER BY ts) AS l FROM lagged_ic GROUP BY lag_days)
              SELECT lag_days, l[i].t AS ts, round(if(len(list_filter(l[i - 59:i], lambda z: z.v IS NOT NULL)) >= 30, list_avg([z.v FOR z IN l[i - 59:i]]), NULL), 6) AS ic_60 FROM (SELECT lag_days, l, unnest(range(60, len(l) + 1, 20)) AS i FROM o)""",
        ),
        lagged_ic_summary=(
            f"""SELECT lag_days, n, round(ic_mean, 4) AS ic_mean, round(ic_std, 4) AS ic_std, round(ic_mean / nullif(ic_std, 0), 4) AS ir, round(p_mean, 4) AS p_mean, CASE WHEN p_mean < 0.05 AND abs(ic_mean) > 0.05 THEN 'significant' WHEN abs(ic_mean) > 0.02 THEN 'weak' ELSE 'none' END AS verdict FROM (
                SELECT lag_days, count(*) AS n, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(p) AS p_mean FROM (SELECT lag_days, ic, {p_ic} AS p FROM lagged_ic WHERE ic IS NOT NULL) x GROUP BY lag_days) y""",
            f"""WITH s AS (SELECT lag_days, count(*) AS n, avg(ic) AS m, sqrt(var_samp(ic)) AS d, avg({duck_p('(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)))', '(n - 2)')}) AS p FROM lagged_ic WHERE ic IS NOT NULL GROUP BY ALL)
              SELECT lag_days, n, round(m, 4) AS ic_mean, round(d, 4) AS ic_std, round(m / nullif(d, 0), 4) AS ir, round(p, 4) AS p_mean, if(p < 0.05 AND abs(m) > 0.05, 'significant', if(abs(m) > 0.02, 'weak', 'none')) AS verdict FROM s""",
        ),
        industry_proxy=(
            """SELECT code, ts, cast(greatest(ceil((before + nth - 1) / (total - 1.0) * 20 - 1e-9), 1) AS int) AS proxy FROM (SELECT b.code, b.ts, row_number() OVER (PARTITION BY b.code ORDER BY b.ts) AS nth, o.before, o.total FROM bars b JOIN (
                SELECT code, coalesce(sum(n) OVER (ORDER BY mean_ret, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY 0) AS total FROM code_means WHERE mean_ret IS NOT NULL) o ON o.code = b.code) x""",
            """WITH r AS (SELECT b.code, b.ts, row_number() OVER (ORDER BY m.mean_ret, b.code, b.ts) AS r FROM bars b JOIN code_means m USING (code) WHERE m.mean_ret IS NOT NULL), n AS (SELECT count(*) AS n FROM r)
              SELECT code, ts, greatest(ceil((r - 1) / (n - 1) * 20 - 1e-9), 1)::INT AS proxy FROM r, n""",
        ),
        time_series_ic_significant=(
            f"""SELECT code, n, round(ic, 6) AS ic, round(p, 6) AS p FROM (SELECT code, n, ic, {p_ic} AS p FROM (SELECT code, count(*) AS n, {correlation('rx', 'ry')} AS ic FROM (SELECT code, {average_rank('x', 'code')} AS rx, {average_rank('y', 'code')} AS ry FROM (
                SELECT code, close / nullif(lag(close, 5) OVER w, 0) - 1 AS x, lead(close, 5) OVER w / nullif(close, 0) - 1 AS y FROM bars WINDOW w AS (PARTITION BY code ORDER BY ts)) a WHERE x IS NOT NULL AND y IS NOT NULL) b GROUP BY code HAVING count(*) >= 30) c) d WHERE p < 0.05""",
            f"""WITH l AS (SELECT code, list(close ORDER BY ts) AS c FROM bars GROUP BY code), v AS (SELECT code, c[i] / nullif(c[i - 5], 0) - 1 AS x, c[i + 5] / nullif(c[i], 0) - 1 AS y FROM (SELECT code, c, unnest(range(6, len(c) - 4)) AS i FROM l)),
                z AS (SELECT code, count(*) AS n, corr(a, b) AS ic FROM (SELECT code, rank() OVER (PARTITION BY code ORDER BY x) + (count(*) OVER (PARTITION BY code, x) - 1) / 2 AS a, rank() OVER (PARTITION BY code ORDER BY y) + (count(*) OVER (PARTITION BY code, y) - 1) / 2 AS b FROM v) GROUP BY code HAVING count(*) >= 30)
              SELECT code, n, round(ic, 6) AS ic, round(p, 6) AS p FROM (SELECT *, {duck_p('(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)))', '(n - 2)')} AS p FROM z) WHERE p < 0.05""",
        ),
        cross_sectional_study=(
            "SELECT code, " + ", ".join(f"round({f}, 5) AS {f}" for f in FEATURES) + ", round(q, 4) + 0e0 AS q FROM studied",
            """WITH a AS (SELECT s.code, s.ts, s.volume, s.close, i.close AS x, count(*) OVER (PARTITION BY s.code) AS n FROM bars s JOIN master m USING (code) JOIN index_bars i ON i.index_code = m.index_code AND i.ts = s.ts QUALIFY n >= 100 AND rank() OVER (PARTITION BY s.code ORDER BY s.ts DESC) <= 168),
                p AS (SELECT a.code, a.volume, a.close / nullif(b.close, 0) - 1 AS r, a.x / nullif(b.x, 0) - 1 AS z FROM a ASOF LEFT JOIN a b ON a.code = b.code AND a.ts > b.ts),
                o AS (SELECT code, regr_slope(r, z) AS beta, stddev_samp(r) FILTER (WHERE z IS NOT NULL) AS volatility, median(volume) AS liquidity FROM p GROUP BY code HAVING count(r + z) >= 50)
              SELECT code, """ + ", ".join(f"round({f}, 5) AS {f}" for f in FEATURES) + ", (SELECT round(any_value(i.q), 4) + 0 FROM insample i WHERE i.code = o.code AND i.model = 2) AS q FROM o JOIN (SELECT * EXCLUDE (beta, volatility, liquidity) FROM code_features) c USING (code)",
        ),
        study_correlations=(
            f"""SELECT feature, n, round(ic, 5) AS rho, round({p_ic}, 5) AS p, row_number() OVER (ORDER BY round(abs(ic), 8) DESC, feature) AS nth FROM (SELECT feature, count(*) AS n, {correlation('a', 'b')} AS ic FROM (
                SELECT feature, {average_rank('round(value, 8)', 'feature')} AS a, {average_rank('round(q, 8)', 'feature')} AS b FROM studied_long WHERE value IS NOT NULL) x GROUP BY feature) y""",
            f"""WITH u AS (UNPIVOT (SELECT round(q, 8) AS q, {', '.join(f'round({f}, 8) AS {f}' for f in FEATURES)} FROM studied WHERE q IS NOT NULL) ON {', '.join(FEATURES)} INTO NAME feature VALUE value),
                z AS (SELECT feature, count(*) AS n, corr(a, b) AS ic FROM (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS a, rank() OVER (PARTITION BY feature ORDER BY q) + (count(*) OVER (PARTITION BY feature, q) - 1) / 2 AS b FROM u) GROUP BY ALL)
              SELECT feature, n, round(ic, 5) AS rho, round({duck_p('(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)))', '(n - 2)')}, 5) AS p, row_number() OVER (ORDER BY round(abs(ic), 8) DESC, feature) AS nth FROM z""",
        ),
        study_quartiles=(
            """SELECT feature, quartile, count(*) AS n, round(avg(q), 4) AS q_mean, round(median(q), 4) AS q_median, round(avg(value), 4) AS feature_mean FROM (SELECT s.feature, s.q, s.value, greatest(size(filter(e.edges, x -> x < s.value)), 1) AS quartile FROM studied_long s
                JOIN (SELECT feature, array_distinct(percentile(value, array(0.0, 0.25, 0.5, 0.75, 1.0))) AS edges FROM studied_long WHERE value IS NOT NULL GROUP BY feature) e ON e.feature = s.feature WHERE s.value IS NOT NULL) x GROUP BY feature, quartile""",
            f"""WITH u AS (UNPIVOT (SELECT q, {', '.join(FEATURES)} FROM studied WHERE q IS NOT NULL) ON {', '.join(FEATURES)} INTO NAME feature VALUE value), e AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM u GROUP BY feature)
              SELECT feature, 1 + (value > a)::INT + (value > b)::INT + (value > c)::INT AS quartile, count(*) AS n, round(avg(q), 4) AS q_mean, round(quantile_cont(q, 0.5), 4) AS q_median, round(avg(value), 4) AS feature_mean FROM u JOIN e USING (feature) GROUP BY ALL""",
        ),
        weights_asof=(
            """SELECT code, ts, round(coalesce(weight, 0), 6) AS weight FROM (SELECT code, ts, kind, last_value(weight) ignore nulls OVER (PARTITION BY code ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS weight FROM (
                SELECT code, ts, 1 AS kind, cast(NULL AS double) AS weight FROM bars UNION ALL SELECT code, month_end, 0, weight FROM month_weights) x) y WHERE kind = 1""",
            "SELECT b.code, b.ts, round(coalesce(w.weight, 0), 6) AS weight FROM bars b ASOF LEFT JOIN month_weights w ON b.code = w.code AND b.ts >= w.month_end",
        ),
        last_dates=(
            "SELECT b.code, b.ts, round(b.close, 6) AS close FROM bars b JOIN (SELECT ts FROM (SELECT DISTINCT ts FROM bars) d ORDER BY ts DESC LIMIT 5) l ON b.ts = l.ts",
            "SELECT code, ts, round(close, 6) AS close FROM bars QUALIFY dense_rank() OVER (ORDER BY ts DESC) <= 5",
        ),
        bollinger=(
            """SELECT code, ts, round((ma_5 + ma_10 + ma_20 + ma_60) / 4, 6) AS bbi, round(ma_20 + 2 * std_20, 4) AS upper_band, round(ma_20 - 2 * std_20, 4) AS lower_band, round(4 * std_20 / (ma_20 + 1e-12), 6) AS width,
                round(CASE WHEN std_20 < 1e-6 THEN 0e0 ELSE (close - (ma_20 - 2 * std_20)) / (4 * std_20 + 1e-12) END, 5) AS place FROM averaged""",
            """WITH l AS (SELECT code, list({'t': ts, 'c': close} ORDER BY ts) AS l FROM bars GROUP BY code), w AS (SELECT code, l[i].t AS ts, l[i].c AS c, [z.c FOR z IN l[greatest(i - 4, 1):i]] AS a, [z.c FOR z IN l[greatest(i - 9, 1):i]] AS b, [z.c FOR z IN l[greatest(i - 19, 1):i]] AS d, [z.c FOR z IN l[greatest(i - 59, 1):i]] AS e FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
                s AS (SELECT code, ts, c, (list_avg(a) + list_avg(b) + list_avg(d) + list_avg(e)) / 4 AS bbi, list_avg(d) AS m, CASE WHEN len(d) > 1 THEN list_stddev_samp(d) END AS s FROM w)
              SELECT code, ts, round(bbi, 6) AS bbi, round(m + 2 * s, 4) AS upper_band, round(m - 2 * s, 4) AS lower_band, round(4 * s / (m + 1e-12), 6) AS width, round(CASE WHEN s < 1e-6 THEN 0 ELSE (c - m + 2 * s) / (4 * s + 1e-12) END, 5) AS place FROM s""",
        ),
        percent_b=(
            "SELECT code, ts, round(coalesce(CASE WHEN n = 20 AND std_20 > 1e-6 THEN (close - (ma_20 - 2 * std_20)) / (4 * std_20) END, 0.5), 5) AS percent_b FROM (SELECT *, count(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM averaged) x",
            """WITH l AS (SELECT code, list({'t': ts, 'c': close} ORDER BY ts) AS l FROM bars GROUP BY code), w AS (SELECT code, l[i].t AS ts, l[i].c AS c, i, [z.c FOR z IN l[greatest(i - 19, 1):i]] AS d FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS i FROM l))
              SELECT code, ts, round(if(i >= 20 AND list_stddev_samp(d) > 1e-6, (c - list_avg(d)) / (4 * list_stddev_samp(d)) + 0.5, 0.5), 5) AS percent_b FROM w""",
        ),
        money_flow=(
            """SELECT code, ts, round(CASE WHEN nth >= 14 THEN CASE WHEN down_sum < 1e-9 THEN CASE WHEN up_sum < 1e-9 THEN 50e0 ELSE 100e0 END ELSE 100 - 100 / (1 + up_sum / down_sum) END ELSE 50e0 END, 6) AS mfi FROM (SELECT code, ts, sum(up_flow) OVER w AS up_sum, sum(down_flow) OVER w AS down_sum, count(*) OVER w AS nth FROM flows
                WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) x""",
            """WITH o AS (SELECT code, ts, typical, volume, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM changed), f AS (SELECT a.code, a.ts, a.i, CASE WHEN a.typical > b.typical THEN a.typical * a.volume ELSE 0 END AS u, CASE WHEN a.typical < b.typical THEN a.typical * a.volume ELSE 0 END AS d FROM o a LEFT JOIN o b ON a.code = b.code AND a.i = b.i + 1)
              SELECT a.code, a.ts, round(CASE WHEN a.i < 14 THEN 50 WHEN sum(b.d) < 1e-9 THEN if(sum(b.u) < 1e-9, 50, 100) ELSE 100 * sum(b.u) / (sum(b.u) + sum(b.d)) END, 6) AS mfi FROM f a JOIN f b ON a.code = b.code AND b.i BETWEEN a.i - 13 AND a.i GROUP BY a.code, a.ts, a.i""",
        ),
        obv_zscore=(
            """SELECT code, ts, round(last_value(z) ignore nulls OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING), 5) AS obv_z FROM (SELECT code, ts, CASE WHEN n = 20 THEN CASE WHEN s < 1e-6 THEN 0e0 ELSE (obv - m) / (s + 1e-9) END END AS z FROM (
                SELECT *, avg(obv) OVER w AS m, stddev_samp(obv) OVER w AS s, count(*) OVER w AS n FROM obv WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) x) y""",
            """WITH l AS (SELECT code, list({'t': ts, 'v': obv} ORDER BY ts) AS l FROM obv GROUP BY code), w AS (SELECT code, i, l[i].t AS ts, l[i].v AS v, [z.v FOR z IN l[greatest(i - 19, 1):i]] AS d FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS i FROM l))
              SELECT code, ts, round(CASE WHEN i >= 20 THEN if(list_stddev_samp(d) < 1e-6, 0, (v - list_avg(d)) / (list_stddev_samp(d) + 1e-9)) END, 5) AS obv_z FROM w""",
        ),
    )
    flow.step(month_weights="SELECT p.code, e.month_end, p.weight + 0e0 AS weight FROM (SELECT c.code, o.month, CASE WHEN k.code IS NOT NULL THEN 0.1 ELSE 0.0 END AS weight FROM (SELECT DISTINCT code FROM picks) c CROSS JOIN (SELECT DISTINCT month FROM picks) o LEFT JOIN picks k ON k.code = c.code AND k.month = o.month) p JOIN (SELECT cast(date_trunc('month', ts) AS date) AS month, max(ts) AS month_end FROM bars GROUP BY cast(date_trunc('month', ts) AS date)) e ON e.month = p.month")


def study_regression(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    """Least squares of q on the z-scored features, with t and p of each coefficient.

    Only the sums of products of the columns (a matrix of the features' number squared)
    reach the driver.
    """
    rows = flow.run("SELECT q, " + ", ".join(FEATURES) + " FROM studied WHERE q IS NOT NULL AND " + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = ("q", *FEATURES)
        data = rows(spark, sf_dir)
        centre = data.agg(*(F.avg(c).alias(c) for c in names)).first()
        shifted = [F.col(c) - F.lit(centre[c] or 0.0) for c in names]
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = data.agg(F.count(F.lit(1)).alias("n"), *(F.sum(shifted[i] * shifted[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
        n = sums["n"]
        s = np.zeros((len(names), len(names)))
        for i, j in pairs:
            s[i, j] = s[j, i] = sums[f"s{i}_{j}"] or 0.0
        scale = np.sqrt(np.diag(s)[1:] / max(n, 1))
        scale[scale == 0] = 1.0
        gram, right = s[1:, 1:] / np.outer(scale, scale), s[1:, 0] / scale
        inverse = np.linalg.pinv(gram)
        theta = inverse @ right
        free = n - len(FEATURES) - 1
        left = max(s[0, 0] - theta @ right, 0.0)
        error = np.sqrt(np.maximum(np.diag(inverse), 0) * left / free) if free > 0 else np.full(len(theta), np.nan)
        r2 = float(1 - left / s[0, 0]) if s[0, 0] > 0 else None
        out = [(f, float(b), float(b / e) if e > 0 else None, int(max(free, 0)), n, r2) for f, b, e in zip(FEATURES, theta, error, strict=True)]
        made = spark.createDataFrame(out, "feature string, coefficient double, t double, free int, n long, r2 double")
        return made.withColumn("p", F.expr(student_p_sql("t", "free"))).drop("free")

    return query


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    return {"study_regression": study_regression(flow)}, {}
