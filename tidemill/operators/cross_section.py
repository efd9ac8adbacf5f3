"""Cross-sectional operators: ranks, information coefficients, quantiles, neutralisation."""

from __future__ import annotations

from tidemill.functions.exprs import average_rank, correlation, edge_bucket, last, lead, ratio
from tidemill.plans.flow import Flow


def add(flow: Flow) -> None:
    flow.step(
        factors=f"""SELECT b.code, b.ts, b.close, {ratio('b.close', 'lag(b.close, 5) OVER (PARTITION BY b.code ORDER BY b.ts)')} - 1 AS f,
            avg(b.amount) OVER (PARTITION BY b.code ORDER BY b.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS size, m.industry, m.exchange FROM bars b JOIN master m ON b.code = m.code""",
        forward="SELECT *, " + ", ".join(f"{ratio(lead('close', h), 'close')} - 1 AS y{h}" for h in (1, 5, 10, 20, 40, 60)) + " FROM factors",
        observed="SELECT code, ts, industry, exchange, f, size, h.h, CASE h.h " + " ".join(f"WHEN {h} THEN y{h}" for h in (1, 5, 10, 20, 40, 60)) + " END AS y FROM forward CROSS JOIN (VALUES (1), (5), (10), (20), (40), (60)) AS h(h)",
        ranked=f"SELECT code, ts, industry, exchange, h, f, y, {average_rank('f', 'ts, h')} AS rf, {average_rank('y', 'ts, h')} AS ry FROM observed WHERE f IS NOT NULL AND y IS NOT NULL",
        ic=f"SELECT ts, h, count(*) AS n, {correlation('rf', 'ry')} AS ic FROM ranked GROUP BY ts, h HAVING count(*) >= 20 AND count(DISTINCT f) > 1 AND count(DISTINCT y) > 1",
        quintile_edges="SELECT ts, h, " + ", ".join(f"percentile(f, {q}) AS e{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8))) + ", count(*) AS n FROM ranked GROUP BY ts, h",
        quintiles=f"SELECT r.ts, r.h, {edge_bucket('f', ['e0', 'e1', 'e2', 'e3'])} + 1 AS q, avg(y) AS y FROM ranked r JOIN quintile_edges e ON r.ts = e.ts AND r.h = e.h WHERE e.n >= 10 GROUP BY r.ts, r.h, {edge_bucket('f', ['e0', 'e1', 'e2', 'e3'])} + 1",
        monthly_rank="SELECT code, month, avg(rf) AS r FROM (SELECT code, cast(date_trunc('month', ts) AS date) AS month, row_number() OVER (PARTITION BY ts ORDER BY f, code) AS rf FROM factors WHERE f IS NOT NULL) x GROUP BY code, month",
        month_order="SELECT month, lag(month) OVER (ORDER BY month) AS before FROM (SELECT DISTINCT month FROM monthly_rank) x",
        demeaned="""SELECT code, ts, f - avg(f) OVER (PARTITION BY ts, industry) AS df, s - avg(s) OVER (PARTITION BY ts, industry) AS ds, count(*) OVER (PARTITION BY ts) AS n FROM (
            SELECT code, ts, industry, f, ln(1 + size) AS s FROM factors WHERE f IS NOT NULL AND size IS NOT NULL) x""",
        slopes="SELECT ts, sum(df * ds) / nullif(sum(ds * ds), 0) AS slope FROM demeaned GROUP BY ts",
    )
    flow.query(
        daily_rank_ic="SELECT ts, h, n, round(ic, 8) AS ic FROM ic",
        ic_summary="""SELECT h, count(*) AS n_dates, round(avg(ic), 8) AS ic_mean, round(stddev_samp(ic), 8) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir,
            round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0), 5) AS t, round(avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0e0 END), 8) AS positive, round(avg(abs(ic)), 8) AS ic_abs FROM ic GROUP BY h""",
        ic_decay="SELECT h, round(avg(ic), 8) AS ic_mean FROM ic GROUP BY h",
        ic_by_year="SELECT h, year(ts) AS y, count(*) AS n, round(avg(ic), 8) AS ic_mean, round(stddev_samp(ic), 8) AS ic_std FROM ic GROUP BY h, year(ts)",
        ic_top_year="SELECT h, max_by(y, struct(a, y)) AS top_year FROM (SELECT h, year(ts) AS y, round(abs(avg(ic)), 10) AS a FROM ic GROUP BY h, year(ts)) x GROUP BY h",
        ic_by_exchange=f"""SELECT exchange, h, count(*) AS n_dates, round(avg(ic), 8) AS ic_mean FROM (SELECT exchange, ts, h, {correlation('a', 'b')} AS ic FROM (
            SELECT exchange, ts, h, {average_rank('f', 'exchange, ts, h')} AS a, {average_rank('y', 'exchange, ts, h')} AS b FROM ranked) x GROUP BY exchange, ts, h HAVING count(*) >= 20) z GROUP BY exchange, h""",
        ic_rolling="""SELECT ts, h, round(roll, 8) AS ic_60 FROM (SELECT ts, h, avg(ic) OVER (PARTITION BY h ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS roll,
            row_number() OVER (PARTITION BY h ORDER BY ts) AS ord FROM ic) x WHERE ord >= 60 AND (ord - 60) % 20 = 0""",
        quantile_returns="SELECT h, q, count(*) AS n_dates, round(avg(y), 8) AS mean_ret FROM quintiles GROUP BY h, q",
        quantile_summary="""SELECT h, round(avg(d), 8) AS mean, round(stddev_samp(d), 8) AS sd, round(avg(d) * 250, 6) AS ann_ret, round(stddev_samp(d) * sqrt(250), 6) AS ann_vol,
            round(avg(d) / nullif(stddev_samp(d), 0) * sqrt(250), 5) AS sharpe FROM (SELECT ts, h, max(CASE WHEN q = 5 THEN y END) - max(CASE WHEN q = 1 THEN y END) AS d FROM quintiles GROUP BY ts, h) x WHERE d IS NOT NULL GROUP BY h""",
        monthly_turnover=f"""SELECT month, round(1 - {correlation('a', 'b')}, 8) AS turnover FROM (SELECT month, {average_rank('r', 'month')} AS a, {average_rank('p', 'month')} AS b FROM (
            SELECT n.month, n.r, o.r AS p FROM monthly_rank n JOIN month_order m ON n.month = m.month JOIN monthly_rank o ON o.month = m.before AND o.code = n.code) x) z GROUP BY month HAVING count(*) >= 30""",
        rank_z="""SELECT code, ts, round((r - avg(r) OVER (PARTITION BY ts)) / nullif(stddev_samp(r) OVER (PARTITION BY ts), 0), 8) AS z FROM (
            SELECT code, ts, cast(row_number() OVER (PARTITION BY ts ORDER BY f, code) AS double) AS r FROM factors WHERE f IS NOT NULL) x""",
        rank_pct=f"SELECT code, ts, round({average_rank('f', 'ts')} / count(*) OVER (PARTITION BY ts), 8) AS pct FROM factors WHERE f IS NOT NULL",
        cross_zscore="SELECT code, ts, round((f - avg(f) OVER (PARTITION BY ts)) / nullif(stddev_samp(f) OVER (PARTITION BY ts), 0), 6) AS z FROM factors WHERE f IS NOT NULL",
        neutralised="SELECT d.code, d.ts, round(df - slope * ds, 8) AS residual FROM demeaned d JOIN slopes s ON d.ts = s.ts WHERE n >= 32",
        industry_return="""SELECT industry, ts, n, round(lead(med, 5) OVER (PARTITION BY industry ORDER BY ts) / nullif(med, 0) - 1, 8) AS fwd FROM (
            SELECT industry, ts, count(*) AS n, median(close) AS med FROM factors GROUP BY industry, ts HAVING count(*) >= 3) x""",
        validation="""SELECT i.h, n_obs, n_dates, round(ic_mean, 8) AS ic_mean, round(icir, 6) AS icir, round(q1, 8) AS q1, round(q5, 8) AS q5, round(q5 - q1, 8) AS spread FROM (
            SELECT h, sum(n) AS n_obs, count(*) AS n_dates, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir FROM ic GROUP BY h) i JOIN (
            SELECT h, avg(CASE WHEN q = 1 THEN y END) AS q1, avg(CASE WHEN q = 5 THEN y END) AS q5 FROM quintiles GROUP BY h) q ON i.h = q.h""",
        decile_selection="""SELECT f.ts, f.code, CASE WHEN f.f >= hi THEN 'top' ELSE 'bottom' END AS side FROM factors f JOIN (SELECT ts, percentile(f, 0.9) AS hi, percentile(f, 0.1) AS lo, count(f) AS n, row_number() OVER (ORDER BY ts) AS ord
            FROM factors WHERE f IS NOT NULL GROUP BY ts) e ON f.ts = e.ts WHERE n >= 30 AND (ord - 1) % 5 = 0 AND (f.f >= hi OR f.f <= lo)""",
        lead_lag=f"""SELECT code, ts, round(CASE WHEN count(r) OVER {last(20)} >= 20 THEN {correlation('r', 'ri', last(20))} END, 5) AS corr_20 FROM (SELECT b.code, b.ts, b.close / nullif(lag(b.close, 5) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS r,
            i.close / nullif(lag(i.close, 5) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS ri FROM bars b JOIN master m ON b.code = m.code JOIN index_bars i ON i.index_code = m.index_code AND i.ts = b.ts) x WHERE r IS NOT NULL""",
        factor_correlation=f"""SELECT ts, round({correlation('a', 'b')}, 6) + 0e0 AS rho FROM (SELECT ts, {average_rank('f', 'ts')} AS a, {average_rank('size', 'ts')} AS b FROM factors WHERE f IS NOT NULL AND size IS NOT NULL) x GROUP BY ts HAVING count(*) >= 5""",
        composite_factor="""SELECT code, ts, round(0.6 * zf - 0.4 * zs, 6) AS composite FROM (SELECT code, ts, (f - avg(f) OVER (PARTITION BY ts)) / nullif(stddev_samp(f) OVER (PARTITION BY ts), 0) AS zf,
            (ln(1 + size) - avg(ln(1 + size)) OVER (PARTITION BY ts)) / nullif(stddev_samp(ln(1 + size)) OVER (PARTITION BY ts), 0) AS zs FROM factors WHERE f IS NOT NULL) x""",
    )
