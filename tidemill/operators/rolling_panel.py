"""Validation of factors that are fitted anew at each date, stability against rolling returns, audit of fits."""

from __future__ import annotations

from tidemill.functions.exprs import average_rank, correlation
from tidemill.functions.special import STUDENT_P_DUCKDB, student_p_sql
from tidemill.plans.flow import Flow

#: Changes of the fitted parameters from one date to the next, and days ahead.
FACTORS = ("dk", "dc", "drho", "dtheta")
HORIZONS = (1, 5, 10, 20)
#: Codes that a date needs, industries that a day needs, and the frame of rolling means over days.
CODES, INDUSTRIES, FRAME, STRIDE = 10, 5, 60, 20
#: Shares of well-conditioned fits, in percent, above which all of them or the well-conditioned ones serve.
WHOLE, PART = 50, 10
SHARES = "0.0, 0.2, 0.4, 0.6, 0.8, 1.0"
CELLS = [(f, h) for f in FACTORS for h in HORIZONS]


def _known_rank(x: str, known: str, keys: str) -> str:
    """Rank of x among rows with ``known``, ties sharing their mean: one order of x serves every ``known``."""
    upto = f"count({known}) OVER (PARTITION BY {keys} ORDER BY {x})"
    equal = f"count({known}) OVER (PARTITION BY {keys} ORDER BY {x} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return f"{upto} - ({equal} - 1) / 2e0"


def add(flow: Flow) -> None:
    grid = ", ".join(f"('{f}', {h})" for f, h in CELLS)
    fifths = ", ".join(f"avg(CASE WHEN fifth = {i} THEN y END) AS q{i}" for i in range(1, 6))
    means = ", ".join(f"avg(q{i}) AS q{i}" for i in range(1, 6))
    rounded = ", ".join(f"round(q{i}, 7) AS q{i}" for i in range(1, 6))
    flow.step(
        rolling_panel="SELECT e.code, e.asof_date AS ts, f.industry, " + ", ".join(f"round(e.{f}, 9) AS {f}" for f in FACTORS) + ", " + ", ".join(f"f.y{h}" for h in HORIZONS)
        + " FROM evolved e JOIN forward f ON f.code = e.code AND f.ts = e.asof_date WHERE " + " AND ".join(f"e.{f} IS NOT NULL" for f in FACTORS),
        rolling_ranks="SELECT *, " + ", ".join(f"{_known_rank(f, f'y{h}', 'ts')} AS {f}_{h}" for f, h in CELLS) + ", " + ", ".join(f"{_known_rank(f'y{h}', f'y{h}', 'ts')} AS r{h}" for h in HORIZONS) + " FROM rolling_panel",
        rolling_edges="SELECT ts, " + ", ".join(f"array_distinct(percentile(CASE WHEN y{h} IS NOT NULL THEN {f} END, array({SHARES}))) AS {f}_{h}_edges" for f, h in CELLS) + " FROM rolling_panel GROUP BY ts",
        rolling_long="SELECT ts, stack(" + f"{len(CELLS)}, " + ", ".join(f"'{f}', {h}, {f}, y{h}, {f}_{h}, r{h}, {f}_{h}_edges" for f, h in CELLS) + ") AS (factor, h, value, y, a, b, edges) FROM (SELECT r.*, " + ", ".join(f"e.{f}_{h}_edges" for f, h in CELLS) + " FROM rolling_ranks r JOIN rolling_edges e ON e.ts = r.ts) x",
        rolling_daily=f"SELECT factor, h, ts, count(*) AS n, {correlation('a', 'b')} AS ic, {fifths} FROM (SELECT factor, h, ts, y, a, b, greatest(size(filter(edges, x -> x < value)), 1) AS fifth FROM rolling_long WHERE y IS NOT NULL) x GROUP BY factor, h, ts HAVING count(*) >= {CODES}",
        rolling_all=f"SELECT factor, h, sum(n) AS n_obs, count(ic) AS n_dates, avg(ic) AS m, stddev_samp(ic) AS s, {means} FROM rolling_daily GROUP BY factor, h",
        si_daily=f"""SELECT ts, count(*) AS n, {correlation('a', 'b')} AS ic FROM (SELECT ts, {average_rank('si', 'ts')} AS a, {average_rank('fwd', 'ts')} AS b FROM (
            SELECT f.ts, s.si, f.fwd FROM industry_forward f JOIN si_all s ON s.industry = f.industry) x) y GROUP BY ts HAVING count(*) >= {INDUSTRIES}""",
        # over dates, after aggregation
        forward_days="SELECT ts, row_number() OVER (ORDER BY ts) AS ord FROM (SELECT DISTINCT ts FROM industry_forward) x",
    )
    t = "(m / nullif(s, 0) * sqrt(n_dates))"
    day_t = "(ic * sqrt((n - 2) / nullif(1 - ic * ic, 0)))"
    p_day = lambda p: f"CASE WHEN 1 - ic * ic < 1e-12 THEN 0e0 ELSE {p} END"
    unpivoted = """x AS (UNPIVOT (SELECT ts, dk, dc, drho, dtheta, y1 AS "1", y5 AS "5", y10 AS "10", y20 AS "20" FROM rolling_panel) ON dk, dc, drho, dtheta INTO NAME factor VALUE value), u AS (UNPIVOT x ON "1", "5", "10", "20" INTO NAME h VALUE y),
        o AS (SELECT factor, h, ts, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM u GROUP BY ALL),
        d AS (SELECT factor, h::INT AS h, ts, count(*) AS n, CASE WHEN count(DISTINCT value) > 1 AND count(DISTINCT y) > 1 THEN corr(a, b) END AS ic, """ + ", ".join(f"avg(y) FILTER (WHERE w = {i}) AS q{i}" for i in range(1, 6)) + f""" FROM (SELECT factor, h, ts, value, y, greatest(len([v FOR v IN edges IF v < value]), 1) AS w,
          rank() OVER (PARTITION BY factor, h, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, h, ts, value) - 1) / 2 AS a, rank() OVER (PARTITION BY factor, h, ts ORDER BY y) + (count(*) OVER (PARTITION BY factor, h, ts, y) - 1) / 2 AS b FROM u JOIN o USING (factor, h, ts)) GROUP BY ALL HAVING count(*) >= {CODES})"""
    flow.pair(
        rolling_factor_validation=(
            f"""SELECT g.factor, g.h, coalesce(n_obs, 0) AS n_obs, coalesce(n_dates, 0) AS n_dates, round(m, 7) AS ic_mean, round(s, 7) AS ic_std, round(m / nullif(s, 0), 6) AS ir, round({student_p_sql(t, 'n_dates - 1')}, 6) AS p, {rounded}, round(q5 - q1, 7) AS spread,
                CASE WHEN coalesce(n_dates, 0) = 0 THEN 'insufficient_data' ELSE 'ok' END AS status FROM (VALUES {grid}) AS g(factor, h) LEFT JOIN rolling_all r ON r.factor = g.factor AND r.h = g.h""",
            f"""WITH {unpivoted}, k AS (SELECT factor, h, sum(n) AS n_obs, count(ic) AS n_dates, avg(ic) AS m, stddev_samp(ic) AS s, {means} FROM d GROUP BY ALL)
                SELECT factor, h, coalesce(n_obs, 0) AS n_obs, coalesce(n_dates, 0) AS n_dates, round(m, 7) AS ic_mean, round(s, 7) AS ic_std, round(m / nullif(s, 0), 6) AS ir, round({STUDENT_P_DUCKDB.format(t=t, n='(n_dates - 1)')}, 6) AS p, {rounded}, round(q5 - q1, 7) AS spread, if(coalesce(n_dates, 0) > 0, 'ok', 'insufficient_data') AS status
                FROM (SELECT unnest(['dk', 'dc', 'drho', 'dtheta']) AS factor) f CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS h) g LEFT JOIN k USING (factor, h)""",
        ),
        rolling_ic_by_year=(
            "SELECT factor, h, year(ts) AS y, count(ic) AS n_dates, round(avg(ic), 7) AS ic_mean, round(stddev_samp(ic), 7) AS ic_std FROM rolling_daily GROUP BY factor, h, year(ts)",
            f"WITH {unpivoted} SELECT factor, h, year(ts) AS y, count(ic) AS n_dates, round(avg(ic), 7) AS ic_mean, round(stddev_samp(ic), 7) AS ic_std FROM d GROUP BY ALL",
        ),
        si_rolling_ic=(
            f"""SELECT ts, round(ic, 7) AS ic, round(p, 6) AS p, cast(round(n, 0) AS int) AS n_industries FROM (SELECT ts, ord, avg(ic) OVER w AS ic, avg(p) OVER w AS p, avg(n) OVER w AS n FROM (
                SELECT d.ts, d.ord, s.ic, s.n, s.p FROM forward_days d LEFT JOIN (SELECT ts, ic, n, {p_day(student_p_sql(day_t, 'n - 2'))} AS p FROM si_daily WHERE ic IS NOT NULL) s ON s.ts = d.ts) x
              WINDOW w AS (ORDER BY ord ROWS BETWEEN {FRAME - 1} PRECEDING AND CURRENT ROW)) y WHERE ord >= {FRAME} AND (ord - {FRAME}) % {STRIDE} = 0 AND ic IS NOT NULL""",
            f"""WITH c AS (SELECT ts, count(*) AS n, corr(a, b) AS ic FROM (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY si) + (count(*) OVER (PARTITION BY ts, si) - 1) / 2 AS a, rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2 AS b
                  FROM industry_forward JOIN (SELECT industry, si FROM si_all) USING (industry)) GROUP BY ts HAVING count(*) >= {INDUSTRIES} AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1),
                e AS (SELECT ts, ic, n, {p_day(STUDENT_P_DUCKDB.format(t=day_t, n='(n - 2)'))} AS p FROM c), l AS (SELECT list(ts ORDER BY ts) AS l FROM (SELECT DISTINCT ts FROM industry_forward))
                SELECT l[i] AS ts, round(avg(ic), 7) AS ic, round(avg(p), 6) AS p, round(avg(n))::INT AS n_industries FROM (SELECT l, unnest(generate_series({FRAME}, len(l), {STRIDE})) AS i FROM l) g JOIN e ON e.ts BETWEEN l[i - {FRAME - 1}] AND l[i] GROUP BY ALL""",
        ),
        identifiability_report=(
            "SELECT n_total, " + ", ".join(f"n_{c}, round(100e0 * n_{c} / n_total, 1) AS pct_{c}" for c in _CLASSES) + f""", r2_25, r2_50, r2_75, cond_25, cond_50, cond_75, CASE WHEN 100e0 * n_well_conditioned / n_total > {WHOLE} THEN 'use well-conditioned fits' WHEN 100e0 * n_well_conditioned / n_total >= {PART} THEN 'demote to well-conditioned fits' ELSE 'not usable' END AS recommendation
                FROM (SELECT count(*) AS n_total, """ + ", ".join(f"count(CASE WHEN {column} = '{c}' THEN 1 END) AS n_{c}" for c, column in _CLASSES.items())
            + ", " + ", ".join(f"round(percentile(r2, {q / 100}), 6) AS r2_{q}, round(percentile(cond, {q / 100}), 2) AS cond_{q}" for q in (25, 50, 75)) + " FROM kc) x WHERE n_total > 0",
            "WITH c AS (SELECT class, count(*) AS n FROM (SELECT unnest([identification, quality]) AS class FROM kc) GROUP BY class), m AS (SELECT map_from_entries(list((class, n))) AS m FROM c), q AS (SELECT count(*) AS n, quantile_cont(r2, [0.25, 0.5, 0.75]) AS r, quantile_cont(cond, [0.25, 0.5, 0.75]) AS k FROM kc) SELECT n AS n_total, "
            + ", ".join(f"coalesce(m['{c}'], 0) AS n_{c}, round(100 * coalesce(m['{c}'], 0) / n, 1) AS pct_{c}" for c in _CLASSES) + ", " + ", ".join(f"round(r[{i}], 6) AS r2_{q}, round(k[{i}], 2) AS cond_{q}" for i, q in enumerate((25, 50, 75), 1))
            + f", ['not usable', 'demote to well-conditioned fits', 'use well-conditioned fits'][1 + (100 * coalesce(m['well_conditioned'], 0) / n >= {PART})::INT + (100 * coalesce(m['well_conditioned'], 0) / n > {WHOLE})::INT] AS recommendation FROM m, q WHERE n > 0",
        ),
    )


#: Classes of fits, and the column that holds them.
_CLASSES = {"well_conditioned": "identification", "ill_conditioned": "identification", "unidentifiable": "identification", "singular": "identification", "good": "quality", "weak": "quality", "poor": "quality", "uninformative": "quality"}
