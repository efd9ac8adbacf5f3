"""Studies over fits and selections: ablation of the model, paired comparison, pools, rotation."""

from __future__ import annotations

from tidemill.functions.exprs import ROWS, average_rank, correlation, edge_bucket, lag, lead, rolling
from tidemill.plans.flow import Flow

#: Right ends of the bins of a difference of ICs, and the bins' names.
BIN_ENDS = ("-0.1", "-0.05", "0", "0.05", "0.1")
BINS = ("(-inf,-0.1]", "(-0.1,-0.05]", "(-0.05,0]", "(0,0.05]", "(0.05,0.1]", "(0.1,inf)")


def _determinant(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _third(column: int) -> str:
    """Cramer's rule for regressor ``column`` of three, over the sums of ``sums``."""
    s = [["s00", "s01", "s02"], ["s01", "s11", "s12"], ["s02", "s12", "s22"]]
    swapped = [[("p0", "p1", "p2")[r] if c == column else s[r][c] for c in range(3)] for r in range(3)]
    return f"{_determinant(swapped)} / nullif({_determinant(s)}, 0)"


def add(flow: Flow) -> None:
    flow.step(
        drifted=f"SELECT *, {lead('beta')} - beta AS beta_dot FROM displaced",
        extended="""SELECT code, ts, 0 AS part, ax / 1e3 AS a, beta * bx / 1e3 AS g, beta_dot * mx / 1e3 AS b, -dx / 1e3 AS x1, -ux / 1e3 AS x2 FROM drifted WHERE ax IS NOT NULL AND beta_dot IS NOT NULL
            UNION ALL SELECT code, ts, 1, ay / 1e3, beta * by_ / 1e3, beta_dot * my / 1e3, -dy / 1e3, -uy / 1e3 FROM drifted WHERE ax IS NOT NULL AND beta_dot IS NOT NULL""",
        designs="""SELECT code, ts, part, m.m AS model, a - CASE WHEN m.m < 2 THEN g ELSE 0 END - CASE WHEN m.m IN (1, 3) THEN b ELSE 0 END AS y, CASE WHEN m.m >= 2 THEN g ELSE 0e0 END AS x0, x1, x2,
            row_number() OVER (PARTITION BY code, m.m ORDER BY part, ts) <= floor(0.7 * count(*) OVER (PARTITION BY code, m.m)) AS train FROM extended CROSS JOIN (VALUES (0), (1), (2), (3)) AS m(m)""",
        sums="SELECT code, model, s.s AS scope, count(*) AS n, " + ", ".join(f"sum({x} * {y}) AS {k}" for k, x, y in (
            ("s00", "x0", "x0"), ("s01", "x0", "x1"), ("s02", "x0", "x2"), ("s11", "x1", "x1"), ("s12", "x1", "x2"), ("s22", "x2", "x2"), ("p0", "x0", "y"), ("p1", "x1", "y"), ("p2", "x2", "y"), ("yy", "y", "y")))
        + ", sum(y) AS sy FROM designs CROSS JOIN (VALUES ('all'), ('train')) AS s(s) WHERE s.s = 'all' OR train GROUP BY code, model, s.s",
        thetas=f"""SELECT code, model, scope, n, yy, sy, p0, p1, p2, CASE WHEN model >= 2 THEN {_third(0)} END AS q,
            CASE WHEN model >= 2 THEN {_third(1)} ELSE (p1 * s22 - p2 * s12) / nullif(s11 * s22 - s12 * s12, 0) END AS k,
            CASE WHEN model >= 2 THEN {_third(2)} ELSE (s11 * p2 - s12 * p1) / nullif(s11 * s22 - s12 * s12, 0) END AS c FROM sums""",
        insample="SELECT code, model, n, q, k, c, (coalesce(q, 0) * p0 + k * p1 + c * p2 - sy * sy / n) / nullif(yy - sy * sy / n, 0) AS r2 FROM thetas WHERE scope = 'all'",
        tested="""SELECT d.code, d.model, d.y, coalesce(t.q, 0) * d.x0 + t.k * d.x1 + t.c * d.x2 AS f FROM designs d JOIN thetas t ON d.code = t.code AND d.model = t.model WHERE t.scope = 'train' AND NOT d.train""",
        oos=f"""SELECT code, model, count(*) AS n, {correlation('ry', 'rf')} AS ic, 1 - sum((y - f) * (y - f)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0) AS r2 FROM (
            SELECT code, model, y, f, {average_rank('round(y, 8)', 'code, model')} AS ry, {average_rank('round(f, 8)', 'code, model')} AS rf FROM tested) x GROUP BY code, model""",
        delta_ic="SELECT a.code, a.ic - b.ic AS delta_ic, b.ic AS ic_0, a.ic AS ic_3 FROM oos a JOIN oos b ON a.code = b.code WHERE a.model = 3 AND b.model = 0",
        industry_bars="SELECT m.industry, b.ts, sum(b.volume) AS volume, round(sum(b.amount), 2) AS amount FROM bars b JOIN master m ON b.code = m.code GROUP BY m.industry, b.ts",
        industry_beta=f"""SELECT code, count(*) AS n, avg(CASE WHEN ix * ix + iy * iy > 1e-12 THEN (sx * ix + sy * iy) / (ix * ix + iy * iy) ELSE 0e0 END) AS beta FROM (SELECT code, ts, sv - {lag('sv')} AS sx, sa - {lag('sa')} AS sy, iv - {lag('iv')} AS ix, ia - {lag('ia')} AS iy FROM (
            SELECT b.code, b.ts, b.volume AS sv, b.amount AS sa, i.volume AS iv, i.amount AS ia FROM bars b JOIN master m ON b.code = m.code JOIN industry_bars i ON i.industry = m.industry AND i.ts = b.ts) p) x WHERE sx IS NOT NULL GROUP BY code""",
        pooled=f"""SELECT code, ts, close, CASE WHEN stoch > 0.05 AND flow > 0.05 THEN 'momentum' ELSE 'reversal' END AS pool, mom, lead(close) OVER ({ROWS}) / nullif(close, 0) - 1 AS ret FROM (
            SELECT code, ts, close, (close - {rolling('min(low)', 14)}) / nullif({rolling('max(high)', 14)} - {rolling('min(low)', 14)}, 0) - 0.5 AS stoch, {rolling('avg(signed_volume)', 20)} / nullif({rolling('avg(volume)', 20)}, 0) AS flow,
              close / nullif({lag('close', 20)}, 0) - 1 AS mom FROM flows) x""",
        rebalances="SELECT ts, (row_number() OVER (ORDER BY ts) - 1) % 5 = 0 AS day FROM (SELECT DISTINCT ts FROM bars) d",
        pool_picks="""SELECT p.pool, p.ts, p.code, p.ret, row_number() OVER (PARTITION BY p.pool, p.ts ORDER BY CASE WHEN p.pool = 'momentum' THEN -p.mom ELSE p.mom END, p.code) AS nth FROM pooled p JOIN rebalances r ON p.ts = r.ts WHERE r.day AND p.mom IS NOT NULL""",
        window_ends="SELECT ts, lead(ts) OVER (ORDER BY ts) AS until FROM rebalances WHERE day",
        holdings="""SELECT w.ts, w.until, s.code FROM window_ends w JOIN (SELECT ts, industry FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(ret, 10) DESC, industry) AS nth FROM industry_return_20 WHERE n >= 2) a WHERE nth <= 3) t ON t.ts = w.ts
            JOIN master s ON s.industry = t.industry WHERE w.until IS NOT NULL""",
        rotation="""SELECT h.ts, avg(e.close / nullif(b.close, 0) - 1) AS ret, count(*) AS n FROM holdings h JOIN bars b ON b.code = h.code AND b.ts = h.ts JOIN bars e ON e.code = h.code AND e.ts = h.until GROUP BY h.ts""",
    )
    flow.store("designs", "thetas", "oos")
    flow.query(
        ablation_fits="SELECT code, model, n, round(q, 4) + 0e0 AS q_hat, round(k, 4) + 0e0 AS k_hat, round(c, 4) + 0e0 AS c_hat, round(r2, 5) + 0e0 AS r2 FROM insample",
        ablation_oos="SELECT code, model, n, round(ic, 4) + 0e0 AS ic, round(r2, 4) + 0e0 AS r2 FROM oos",
        ablation_summary="""SELECT i.model, count(*) AS n, round(median(i.r2), 4) AS r2_median, round(percentile(i.r2, 0.25), 4) AS r2_25, round(percentile(i.r2, 0.75), 4) AS r2_75, round(median(o.ic), 4) AS ic_median, round(median(abs(i.q - 1)), 4) AS q_drift FROM insample i JOIN oos o ON i.code = o.code AND i.model = o.model GROUP BY i.model""",
        ablation_verdict="""SELECT CASE WHEN beta_drift AND q_off AND gain THEN 'go' WHEN beta_drift AND gain THEN 'partial: beta drift' WHEN q_off AND gain THEN 'partial: q' WHEN gain THEN 'marginal' WHEN beta_drift OR q_off THEN 'weak' ELSE 'stop' END AS verdict, beta_drift, q_off, gain FROM (
            SELECT (SELECT median(b.r2 - a.r2) FROM insample a JOIN insample b ON a.code = b.code WHERE a.model = 0 AND b.model = 1) > 0.005 AS beta_drift, (SELECT median(abs(q - 1)) FROM insample WHERE model = 2) > 0.1 AS q_off, (SELECT median(delta_ic) FROM delta_ic) > 0.02 AS gain) x""",
        q_drift_distribution="SELECT model, count(*) AS n, round(median(abs(q - 1)), 4) AS median_abs, round(percentile(abs(q - 1), 0.25), 4) AS p25, round(percentile(abs(q - 1), 0.75), 4) AS p75, round(avg(CASE WHEN abs(q - 1) > 0.3 THEN 1e0 ELSE 0e0 END), 4) AS above FROM insample WHERE model >= 2 GROUP BY model",
        delta_ic_summary="SELECT count(*) AS n, round(avg(delta_ic), 4) AS mean, round(median(delta_ic), 4) AS median, round(stddev_samp(delta_ic), 4) AS sd, " + ", ".join(f"round(percentile(delta_ic, {p / 100}), 4) AS p{p}" for p in (5, 10, 25, 75, 90, 95)) + ", round(min(delta_ic), 4) AS lo, round(max(delta_ic), 4) AS hi, round(avg(CASE WHEN delta_ic > 0 THEN 1e0 ELSE 0e0 END), 4) AS above_0 FROM delta_ic",
        delta_ic_buckets=f"SELECT b.bucket, count(d.code) AS n FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(BINS))}) AS b(i, bucket) LEFT JOIN (SELECT code, {edge_bucket('delta_ic', list(BIN_ENDS))} AS i FROM delta_ic) d ON d.i = b.i GROUP BY b.bucket",
        q_quartiles="""SELECT quartile, count(*) AS n, round(avg(q), 4) AS q_mean, round(median(k), 4) AS k_median FROM (SELECT i.code, i.q, i.k, CASE WHEN i.q > e.b THEN CASE WHEN i.q > e.c THEN 4 ELSE 3 END ELSE CASE WHEN i.q > e.a THEN 2 ELSE 1 END END AS quartile
            FROM insample i CROSS JOIN (SELECT percentile(q, 0.25) AS a, percentile(q, 0.5) AS b, percentile(q, 0.75) AS c FROM insample WHERE model = 2) e WHERE i.model = 2) x GROUP BY quartile""",
        paired_drivers="""SELECT m.code, round(m.beta, 8) AS beta_market, round(i.beta, 8) AS beta_industry, m.beta * i.beta < 0 AS sign_flipped, abs(m.beta) < 0.5 * abs(i.beta) AS attenuated, abs(m.beta) > 1.5 * abs(i.beta) AS amplified FROM (
            SELECT code, avg(beta) AS beta FROM movement GROUP BY code) m JOIN industry_beta i ON m.code = i.code""",
        paired_gate="SELECT count(*) AS n, count_if(m.beta * i.beta < 0) AS flipped, count_if(abs(m.beta) < 0.5 * abs(i.beta)) AS attenuated FROM (SELECT code, avg(beta) AS beta FROM movement GROUP BY code) m JOIN industry_beta i ON m.code = i.code",
        regressor_correlation=f"SELECT code, round({correlation('x1', 'x2')}, 5) AS corr_kc, round({correlation('y', 'x2')}, 5) AS corr_yc FROM designs WHERE model = 0 GROUP BY code",
        pool_split="SELECT pool, ts, count(*) AS n FROM pooled GROUP BY pool, ts",
        pool_backtest="SELECT pool, count(*) AS n_dates, round(avg(r), 6) AS mean_ret, round(stddev_samp(r), 6) AS sd FROM (SELECT pool, ts, avg(ret) AS r FROM pool_picks WHERE nth <= 5 AND ret IS NOT NULL GROUP BY pool, ts) x GROUP BY pool",
        rotation_backtest="SELECT ts, n, round(ret, 8) AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS nav FROM rotation WHERE ret > -1",
        rotation_by_year="SELECT year(ts) AS y, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM rotation WHERE ret > -1 GROUP BY year(ts)",
        industry_pairs="SELECT industry, n, round(k, 6) AS k, round(c, 6) AS c, nth FROM (SELECT *, row_number() OVER (ORDER BY round(c / nullif(k, 0), 8) DESC NULLS LAST, industry) AS nth FROM sector_si) x WHERE nth <= 6",
        si_histogram="SELECT bin, count(*) AS n FROM (SELECT least(4, cast(floor(si * 5) AS int)) AS bin FROM si_time) x GROUP BY bin",
        si_latest_top="SELECT industry, round(si, 6) AS si, nth FROM (SELECT industry, si, row_number() OVER (ORDER BY round(si, 10) DESC, industry) AS nth FROM si_time WHERE asof_date = (SELECT max(asof_date) FROM si_time)) x WHERE nth <= 10",
        factor_panel="""SELECT code, factor, round(value, 6) AS value FROM (SELECT code, 'rho' AS factor, rho AS value FROM eigen UNION ALL SELECT code, 'distance', distance FROM eigen UNION ALL SELECT code, 'k', k FROM eigen UNION ALL SELECT code, 'c', c FROM eigen
            UNION ALL SELECT code, 'ratio', c / nullif(k, 0) FROM eigen) x WHERE value IS NOT NULL""",
        gain_at_three="SELECT code, round(1 / sqrt((cos(0.002) - 2 * cos(0.001) + 1 + c * (cos(0.001) - 1) + k) * (cos(0.002) - 2 * cos(0.001) + 1 + c * (cos(0.001) - 1) + k) + (sin(0.002) - 2 * sin(0.001) + c * sin(0.001)) * (sin(0.002) - 2 * sin(0.001) + c * sin(0.001))), 5) AS gain_dc, round(1 / nullif(abs(4 - 2 * c + k), 0), 5) AS gain_pi FROM eigen WHERE k > 0.001",
        state_share_ic=f"""SELECT state, count(*) AS n, round({correlation('a', 'b')}, 6) AS ic FROM (SELECT state, {average_rank('share', 'state')} AS a, {average_rank('ret', 'state')} AS b FROM (SELECT s.state, s.code, s.n / t.total AS share, r.ret FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) s
            JOIN (SELECT code, cast(count(*) AS double) AS total FROM states GROUP BY code) t ON s.code = t.code JOIN (SELECT code, max_by(close, ts) / min_by(close, ts) - 1 AS ret FROM bars GROUP BY code) r ON r.code = s.code) x) y GROUP BY state HAVING count(*) >= 3""",
        focus_groups="SELECT code, state, round(n / total, 8) AS share FROM (SELECT s.code, s.state, s.n, cast(t.total AS double) AS total FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) s JOIN (SELECT code, count(*) AS total FROM states GROUP BY code) t ON s.code = t.code) x WHERE state IN ('against', 'follow', 'returning') AND n >= 0.2 * total",
        oos_distribution="SELECT count(*) AS n, round(median(hit), 6) AS hit_median, round(percentile(hit, 0.25), 6) AS hit_25, round(percentile(hit, 0.75), 6) AS hit_75 FROM (SELECT code, avg(CASE WHEN (vx - sx) * ax + (vy - sy) * ay > 0 THEN 1e0 ELSE 0e0 END) AS hit FROM (SELECT code, sx, sy, ax, ay, sx + beta * bx - 0.1 * dx - 0.2 * ux AS vx, sy + beta * by_ - 0.1 * dy - 0.2 * uy AS vy FROM displaced WHERE ax IS NOT NULL) x GROUP BY code) y",
        rolling_self_force=f"""SELECT code, ts, round({rolling('avg(fx)', 10).replace('9 PRECEDING AND CURRENT ROW', '10 PRECEDING AND 1 PRECEDING')}, 2) + 0e0 AS fx_10 FROM (SELECT code, ts, ax - beta * bx + 0.1 * dx + 0.2 * ux AS fx FROM displaced WHERE ax IS NOT NULL) x""",
        factor_union="""SELECT coalesce(a.code, b.code) AS code, coalesce(a.ts, b.ts) AS ts, round(a.f, 8) AS momentum, round(b.gap, 8) AS gap FROM (SELECT code, ts, f FROM factors WHERE f IS NOT NULL) a
            FULL OUTER JOIN (SELECT code, ts, close / nullif(ma_20, 0) - 1 AS gap FROM averaged WHERE std_20 IS NOT NULL) b ON a.code = b.code AND a.ts = b.ts""",
        pool_left_joins="""SELECT a.code, a.ts, round(a.f, 8) AS momentum, round(b.drawdown, 8) AS drawdown FROM factors a LEFT JOIN (SELECT code, ts, close / max(close) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars WHERE volume > 30) b ON a.code = b.code AND a.ts = b.ts""",
        kc_override="""SELECT kc.code, round(coalesce(o.k, kc.k, 0), 6) AS k, round(coalesce(o.c, kc.c, 0), 6) AS c, CASE WHEN o.code IS NOT NULL THEN 'explicit' WHEN kc.k IS NOT NULL THEN 'fit' ELSE 'zero' END AS source FROM kc LEFT JOIN (VALUES (1, 0.25, 0.75), (3, 0.5, 1.0)) AS o(code, k, c) ON kc.code = o.code""",
        common_with_all="SELECT a.ts FROM (SELECT DISTINCT ts FROM bars WHERE code % 2 = 0) a JOIN (SELECT DISTINCT ts FROM bars WHERE code % 2 = 1) b ON a.ts = b.ts",
        missing_codes="SELECT code FROM master EXCEPT SELECT code FROM bars WHERE ts >= date '1998-01-01' AND volume > 40",
        long_format="SELECT code, ts, 'close' AS kind, round(close, 6) AS value FROM bars UNION ALL SELECT code, ts, 'volume', volume FROM bars UNION ALL SELECT code, ts, 'amount', amount FROM bars",
        correlation_decay=f"""SELECT part, count(*) AS n, round({correlation('f', 'y')}, 5) AS corr FROM (SELECT f.code, f.f, f.y5 AS y, CASE WHEN row_number() OVER (PARTITION BY f.code ORDER BY f.ts) <= 0.7 * count(*) OVER (PARTITION BY f.code) THEN 'in' ELSE 'out' END AS part FROM forward f WHERE f.f IS NOT NULL AND f.y5 IS NOT NULL) x GROUP BY part""",
        candidate_frequency="""SELECT code, count(*) AS hits FROM (SELECT b.ts, b.code, row_number() OVER (PARTITION BY b.ts ORDER BY b.f DESC, b.code) AS nth FROM factors b JOIN rebalances r ON b.ts = r.ts WHERE r.day AND b.f IS NOT NULL) x WHERE nth <= 5 GROUP BY code""",
        two_layer_alpha="""SELECT t.ts, count(*) AS n, round(avg(CASE WHEN nth <= 10 THEN ret END) - avg(ret), 8) AS alpha FROM (SELECT ts, y1 AS ret, row_number() OVER (PARTITION BY ts ORDER BY f DESC, code) AS nth FROM forward WHERE f IS NOT NULL AND y1 IS NOT NULL) t GROUP BY t.ts HAVING count(*) >= 20""",
        indicator_ic_aggregate="""SELECT count(*) AS n, round(median(ic), 6) AS median, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(avg(ic) / (stddev_samp(ic) + 1e-9), 5) AS ir, count(CASE WHEN ic > 0 THEN 1 END) AS above_0, count(CASE WHEN ic > 0.05 THEN 1 END) AS above_5, count(CASE WHEN ic < -0.05 THEN 1 END) AS below_5 FROM ic WHERE h = 5""",
        ic_distribution="SELECT h, round(percentile(ic, 0.25), 6) AS q25, round(percentile(ic, 0.5), 6) AS q50, round(percentile(ic, 0.75), 6) AS q75, count_if(ic > 0) AS up, count_if(ic < 0) AS down FROM ic GROUP BY h",
        spike_scales="""SELECT w.code, round(w.v / nullif(m.v, 0), 8) AS volume_ratio, round(w.r / nullif(m.r, 0), 6) AS range_ratio FROM (SELECT code, avg(volume) AS v, avg(high - low) AS r FROM bars GROUP BY code) w JOIN (SELECT code, avg(volume) AS v, avg(high - low) AS r FROM bars_m GROUP BY code) m ON w.code = m.code""",
        granularity_gate="SELECT w.code, w.n AS weekly, m.n AS monthly, w.n >= 3 * m.n AND w.n >= 200 AS adopt FROM (SELECT code, count(*) AS n FROM bars GROUP BY code) w FULL OUTER JOIN (SELECT code, count(*) AS n FROM bars_m GROUP BY code) m ON w.code = m.code",
        candle_chart="SELECT code, ts, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS colour, round(CASE WHEN n5 = 5 THEN ma_5 END, 6) AS ma_5, round(CASE WHEN n10 = 10 THEN ma_10 END, 6) AS ma_10, round(CASE WHEN n20 = 20 THEN ma_20 END, 6) AS ma_20 FROM (SELECT *, count(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5, count(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n10, count(close) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n20 FROM averaged) x",
    )
