"""A security's move against its benchmark's: projection, states, forces, fits, stability.

Moves are changes of (volume, amount). A move is projected on the benchmark's; what is
left is the security's own. All of it is row arithmetic and window functions over one
shuffle by code; fits are closed forms over sums.
"""

from __future__ import annotations

from tidemill.functions.exprs import ROWS, clip, lag, lead
from tidemill.plans.flow import Flow

#: States by precedence of their rules' names in reports.
STATES = ("follow", "weak_div", "accelerating", "independent", "against", "returning", "resonance", "none")
#: The most frequent state, the first in the order of the labels among equals.
FIRST_OF_MOST = "max_by(state, struct(n, -CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATES)) + " END))"


def classify(k: str, c: str) -> dict[str, str]:
    """Expressions of the stability of [[1, 1], [-k, 1 - c]]: roots, radius, wedge, class."""
    disc = f"({c} * {c} - 4 * {k})"
    radius = f"""(CASE WHEN {disc} > 1e-8 THEN greatest(abs((2 - {c} + sqrt(greatest({disc}, 0))) / 2), abs((2 - {c} - sqrt(greatest({disc}, 0))) / 2))
        WHEN {disc} < -1e-8 THEN sqrt((2 - {c}) * (2 - {c}) / 4 + greatest(-{disc}, 0) / 4) ELSE abs(2 - {c}) / 2 END)"""
    wedge = f"({k} > 1e-8 AND {c} > {k} + 1e-8 AND {c} < 2 + {k} / 2 - 1e-8)"
    minus_one = f"({disc} >= -1e-8 AND (abs((2 - {c} - sqrt(greatest({disc}, 0))) / 2 + 1) < 1e-8 OR abs((2 - {c} + sqrt(greatest({disc}, 0))) / 2 + 1) < 1e-8))"
    plus_one = f"({disc} >= -1e-8 AND (abs((2 - {c} - sqrt(greatest({disc}, 0))) / 2 - 1) < 1e-8 OR abs((2 - {c} + sqrt(greatest({disc}, 0))) / 2 - 1) < 1e-8))"
    label = f"""(CASE WHEN abs({k}) < 1e-8 AND abs({c} - {k}) < 1e-8 THEN 'jordan_drift' WHEN abs({k}) < 1e-8 THEN 'marginal_const'
        WHEN {radius} < 1 - 1e-8 THEN CASE WHEN {disc} < -1e-8 THEN 'stable_oscillatory' WHEN {disc} > 1e-8 THEN 'stable_overdamped' ELSE 'stable_critical_damping' END
        WHEN {radius} > 1 + 1e-8 THEN CASE WHEN {k} < -1e-8 THEN 'anti_restoring' WHEN {disc} < -1e-8 THEN 'oscillatory_divergent' ELSE 'monotonic_divergent' END
        WHEN {minus_one} THEN 'critical_period2' WHEN {plus_one} THEN 'critical_real_unit' WHEN {disc} < -1e-8 THEN 'critical_periodic' ELSE 'critical_real_unit' END)"""
    stability = f"(CASE WHEN abs({k}) < 1e-8 THEN 'critical' WHEN {radius} < 1 - 1e-8 THEN 'schur_stable' WHEN {radius} > 1 + 1e-8 THEN 'unstable' ELSE 'critical' END)"
    mode = f"(CASE WHEN {disc} > 1e-8 THEN 'real_distinct' WHEN {disc} < -1e-8 THEN 'complex_conjugate' ELSE 'real_double' END)"
    response = f"(CASE WHEN {k} < 0 THEN 'anti_damped' WHEN abs({k} - {c}) < 1e-9 THEN 'critical' WHEN {k} < {c} THEN 'overdamped' ELSE 'underdamped' END)"
    return {"disc": disc, "radius": radius, "wedge": wedge, "class": label, "stability": stability, "mode": mode, "response": response, "distance": f"least({k}, {c} - {k}, 2 + {k} / 2 - {c})"}


def add(flow: Flow) -> None:
    flow.step(
        pairs="SELECT b.code, b.ts, m.index_code, b.volume AS sv, b.amount AS sa, i.volume AS iv, i.amount AS ia FROM bars b JOIN master m ON b.code = m.code JOIN index_bars i ON i.index_code = m.index_code AND i.ts = b.ts",
        moves=f"""SELECT * FROM (SELECT code, index_code, ts, round(sv - {lag('sv')}, 4) AS sx, round(sa - {lag('sa')}, 4) AS sy,
            round(iv - {lag('iv')}, 4) AS mx, round(ia - {lag('ia')}, 4) AS my FROM pairs) x WHERE sx IS NOT NULL""",
        movement="""SELECT *, CASE WHEN mx * mx + my * my > 1e-12 THEN (sx * mx + sy * my) / (mx * mx + my * my) ELSE 0.0 END AS beta,
            sqrt(sx * sx + sy * sy) AS s_mag, sqrt(mx * mx + my * my) AS m_mag FROM moves""",
        damped="""SELECT *, m_mag / (m_mag + anchor) AS q, m_mag / (m_mag + anchor) * beta * mx AS px, m_mag / (m_mag + anchor) * beta * my AS py FROM (
            SELECT *, CASE WHEN median(m_mag) OVER (PARTITION BY code) > 0 THEN median(m_mag) OVER (PARTITION BY code) ELSE 1e-12 END AS anchor FROM movement) v""",
        dynamics=f"""SELECT *, CASE WHEN s_mag * m_mag > 1e-12 THEN acos({clip('(sx * mx + sy * my) / (s_mag * m_mag)', '-1.0D', '1.0D')}) END AS theta,
            0.5 * (px * px + py * py) AS e_market, 0.5 * ((sx - px) * (sx - px) + (sy - py) * (sy - py)) AS e_self, 0.5 * s_mag * s_mag AS e_total,
            CASE WHEN s_mag * s_mag > 1e-12 THEN ((sx - px) * (sx - px) + (sy - py) * (sy - py)) / (s_mag * s_mag) ELSE 0.0 END AS r FROM damped""".replace("1.0D", "1.0"),
        sloped=f"SELECT *, (r - {lag('r', 2)}) / 2 AS r_slope, (e_self - {lag('e_self', 2)}) / 2 AS e_slope FROM dynamics",
        states="""SELECT code, ts, r, theta, e_self, CASE WHEN theta IS NULL OR r IS NULL THEN 'none' WHEN theta >= pi() / 2 THEN 'against' WHEN r >= 0.5 AND theta < pi() / 6 THEN 'resonance'
            WHEN r_slope > 0 AND e_slope > 0 THEN 'accelerating' WHEN r_slope < 0 AND e_slope < 0 THEN 'returning' WHEN r >= 0.5 THEN 'independent'
            WHEN r >= 0.1 THEN 'weak_div' WHEN theta < pi() / 6 THEN 'follow' ELSE 'none' END AS state FROM sloped""",
        kinematics=f"""SELECT *, {lead('sx')} - sx AS ax, {lead('sy')} - sy AS ay, {lead('mx')} - mx AS bx, {lead('my')} - my AS by_, sx - beta * mx AS ux, sy - beta * my AS uy FROM movement""",
        displaced=f"""SELECT *, coalesce(sum(ux) OVER ({ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dx,
            coalesce(sum(uy) OVER ({ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dy FROM kinematics""",
        stacked="""SELECT code, index_code, ts, (ax - beta * bx) / 1e3 AS y, -dx / 1e3 AS x1, -ux / 1e3 AS x2 FROM displaced WHERE ax IS NOT NULL AND bx IS NOT NULL
            UNION ALL SELECT code, index_code, ts, (ay - beta * by_) / 1e3, -dy / 1e3, -uy / 1e3 FROM displaced WHERE ay IS NOT NULL AND by_ IS NOT NULL""",
        gram="""SELECT code, index_code, count(*) AS n, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS d, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(y * y) AS yy, sum(y) AS sy, sum(x1) AS s1, sum(x2) AS s2
            FROM stacked GROUP BY code, index_code""",
        solved="""SELECT *, a * d - b * b AS det, (p * d - q * b) / nullif(a * d - b * b, 0) AS k, (a * q - b * p) / nullif(a * d - b * b, 0) AS c,
            (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS top FROM gram WHERE n >= 6""",
        fitted="""SELECT code, index_code, cast(n / 2 AS int) AS n_valid, k, c, yy - 2 * (k * p + c * q) + k * k * a + 2 * k * c * b + c * c * d AS ss_res, yy - sy * sy / n AS ss_tot,
            CASE WHEN det > 1e-12 * top * top THEN sqrt(top / (det / top)) END AS cond, (b - s1 * s2 / n) / nullif(sqrt((a - s1 * s1 / n) * (d - s2 * s2 / n)), 0) AS corr_x, n FROM solved""",
        kc="""SELECT code, index_code, n_valid, k, c, ss_res / n AS loss, 1 - ss_res / nullif(ss_tot, 0) AS r2, cond, corr_x,
            CASE WHEN k IS NULL OR cond IS NULL THEN 'singular' WHEN cond >= 1e5 THEN 'unidentifiable' WHEN cond >= 1e3 THEN 'ill_conditioned' ELSE 'well_conditioned' END AS identification,
            CASE WHEN ss_tot <= 1e-12 THEN 'uninformative' WHEN 1 - ss_res / ss_tot < 0.01 THEN 'poor' WHEN 1 - ss_res / ss_tot < 0.1 THEN 'weak' ELSE 'good' END AS quality,
            CASE WHEN k IS NULL THEN 'solve_failed' WHEN abs(k) > 100 OR abs(c) > 100 THEN 'extreme' ELSE concat('ok (', CASE WHEN k >= 0 THEN 'restoring' ELSE 'anti-restoring' END, ', ', CASE WHEN c >= 0 THEN 'damping' ELSE 'anti-damping' END, ')') END AS status FROM fitted""",
    )
    e = classify("k", "c")
    flow.step(
        eigen=f"SELECT code, index_code, k, c, {e['disc']} AS disc, {e['radius']} AS rho, {e['wedge']} AS in_wedge, {e['class']} AS class, {e['stability']} AS stability, {e['mode']} AS mode, {e['response']} AS response, {e['distance']} AS distance FROM kc WHERE status LIKE 'ok%'",
        sector_si=f"""SELECT m.industry, count(*) AS n, median(rho) AS rho, median(k) AS k, median(c) AS c, avg(CASE WHEN in_wedge THEN 1e0 ELSE 0e0 END) AS wedge, avg(CASE WHEN stability = 'schur_stable' THEN 1e0 ELSE 0e0 END) AS stable,
            percentile(rho, 0.25) AS rho_25, percentile(rho, 0.75) AS rho_75, median(distance) AS distance FROM eigen e JOIN master m ON e.code = m.code GROUP BY m.industry""",
        rolled="SELECT *, " + ", ".join(f"sum({x}) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) AS {y}" for y, x in {
            "a": "dx * dx + dy * dy", "b": "dx * ux + dy * uy", "d": "ux * ux + uy * uy", "p": "-dx * (ax - beta * bx) - dy * (ay - beta * by_)", "q": "-ux * (ax - beta * bx) - uy * (ay - beta * by_)"}.items())
        + ", count(*) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) AS n FROM displaced WHERE ax IS NOT NULL",
        kc_time="""SELECT code, ts AS asof_date, n, (p * d - q * b) / nullif(a * d - b * b, 0) AS k, (a * q - b * p) / nullif(a * d - b * b, 0) AS c FROM rolled r
            WHERE n >= 60 AND ts IN (SELECT max(ts) FROM bars GROUP BY date_trunc('month', ts))""",
        si_time=f"""SELECT asof_date, industry, count(*) AS n, 0.5 * {clip('1 - median(rho) / 2')} + 0.2 * {clip('1 - abs(median(c) - 1) / 2')} + 0.3 * {clip('avg(w)')} AS si FROM (
            SELECT t.asof_date, m.industry, t.c, {e['radius']} AS rho, CASE WHEN {e['wedge']} THEN 1e0 ELSE 0e0 END AS w FROM kc_time t JOIN master m ON t.code = m.code WHERE k IS NOT NULL) x GROUP BY asof_date, industry""",
    )
    flow.query(
        state_distribution="SELECT code, state, n, round(n / cast(sum(n) OVER (PARTITION BY code) AS double), 8) AS share FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) s",
        state_counts="SELECT code, " + ", ".join(f"count_if(state = '{s}') AS {s}" for s in STATES) + " FROM states GROUP BY code",
        dominant_state=f"""SELECT code, {FIRST_OF_MOST} AS dominant, max(n) AS n FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) x GROUP BY code""",
        top_states="SELECT code, state, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, state) AS nth FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) a) b WHERE nth <= 3",
        state_series="SELECT code, ts, state FROM states",
        stock_index_pairs="SELECT code, ts, index_code, sv, sa, iv, ia FROM pairs",
        vector_norms="SELECT code, ts, round(coalesce((sv - v0) / nullif(v1 - v0, 0), 0), 8) AS v_norm, round(coalesce((sa - a0) / nullif(a1 - a0, 0), 0), 8) AS a_norm FROM (SELECT code, ts, sv, sa, min(sv) OVER (PARTITION BY code) AS v0, max(sv) OVER (PARTITION BY code) AS v1, min(sa) OVER (PARTITION BY code) AS a0, max(sa) OVER (PARTITION BY code) AS a1 FROM pairs) x",
        state_projection="""SELECT code, ts, round(b, 8) AS beta, round(sv - b * iv, 4) + 0e0 AS resid_v, round(sa - b * ia, 4) + 0e0 AS resid_a, round(sqrt(sv * sv + sa * sa) / nullif(sqrt(iv * iv + ia * ia), 0), 8) AS relative FROM (SELECT *, coalesce((sv * iv + sa * ia) / nullif(iv * iv + ia * ia, 0), 0) AS b FROM pairs) x""",
        movement_projection="SELECT code, index_code, ts, sx, sy, mx, my, round(beta, 8) AS beta, round(sx - beta * mx, 4) + 0e0 AS resid_v, round(sy - beta * my, 4) + 0e0 AS resid_a, round(coalesce(s_mag / nullif(m_mag, 0), 0), 8) AS relative_move FROM movement",
        dynamics_series="SELECT code, ts, round(q, 8) AS q, round(theta, 6) AS theta, round(r, 6) AS r, round(sqrt(e_market), 4) AS root_e_market, round(sqrt(e_self), 4) AS root_e_self, round(sqrt(e_total), 4) AS root_e_total FROM dynamics",
        forces=f"""SELECT code, ts, round(sqrt(beta * bx * beta * bx + beta * by_ * beta * by_), 4) AS f_market, round(0.1 * sqrt(dx * dx + dy * dy), 2) AS f_restore, round(0.2 * sqrt(ux * ux + uy * uy), 4) AS f_damp,
            round(sqrt((ax - beta * bx + 0.1 * dx + 0.2 * ux) * (ax - beta * bx + 0.1 * dx + 0.2 * ux) + (ay - beta * by_ + 0.1 * dy + 0.2 * uy) * (ay - beta * by_ + 0.1 * dy + 0.2 * uy)), 2) AS f_self FROM displaced""",
        next_state=f"""SELECT code, ts, round(sx + beta * bx - 0.1 * dx - 0.2 * ux, 2) + 0e0 AS vx_pred, round(sy + beta * by_ - 0.1 * dy - 0.2 * uy, 2) + 0e0 AS vy_pred, round(dx + ux, 2) + 0e0 AS dx_pred, round(dy + uy, 2) + 0e0 AS dy_pred FROM displaced WHERE ax IS NOT NULL""",
        one_step_oos=f"""SELECT code, count(*) AS n, round(avg(CASE WHEN (vx - sx) * (nx - sx) + (vy - sy) * (ny - sy) > 0 THEN 1e0 ELSE 0e0 END), 8) AS hit_rate, round(sqrt(avg((vx - nx) * (vx - nx) + (vy - ny) * (vy - ny))), 1) AS rmse FROM (
            SELECT code, sx, sy, sx + beta * bx - 0.1 * dx - 0.2 * ux AS vx, sy + beta * by_ - 0.1 * dy - 0.2 * uy AS vy, sx + ax AS nx, sy + ay AS ny FROM displaced WHERE ax IS NOT NULL) x GROUP BY code""",
        kc_estimates="SELECT code, index_code, n_valid, round(k, 6) AS k_hat, round(c, 6) AS c_hat, round(r2, 6) AS r2, round(cond, 3) AS cond, round(corr_x, 5) AS regressor_corr, identification, quality, status FROM kc",
        identifiability_audit="SELECT identification, quality, count(*) AS n, round(median(r2), 6) AS r2_median, round(median(cond), 3) AS cond_median FROM kc GROUP BY identification, quality",
        kc_month_end="SELECT code, asof_date, n, round(k, 6) AS k_hat, round(c, 6) AS c_hat FROM kc_time",
        kc_evolution="SELECT code, asof_date, round(k - lag(k) OVER (PARTITION BY code ORDER BY asof_date), 6) AS dk, round(c - lag(c) OVER (PARTITION BY code ORDER BY asof_date), 6) AS dc FROM kc_time",
        state_kc=f"SELECT d.dominant, count(*) AS n, round(median(k), 6) AS k_median, round(median(c), 6) AS c_median, round(avg(c), 6) AS c_mean FROM kc JOIN (SELECT code, {FIRST_OF_MOST} AS dominant FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) x GROUP BY code) d ON kc.code = d.code GROUP BY d.dominant",
        eigen_summary="SELECT code, round(k, 6) AS k, round(c, 6) AS c, round(disc, 6) AS disc, round(rho, 6) AS rho, in_wedge, class, stability, mode, response, round(distance, 6) AS distance FROM eigen",
        eigen_population="SELECT class, stability, count(*) AS n, count_if(in_wedge) AS in_wedge, count_if(abs(distance) < 0.05) AS near_boundary FROM eigen GROUP BY class, stability",
        industry_stability="SELECT industry, n, round(rho, 6) AS rho, round(rho_25, 6) AS rho_25, round(rho_75, 6) AS rho_75, round(k, 6) AS k, round(c, 6) AS c, round(wedge, 6) AS wedge, round(stable, 6) AS stable, round(distance, 6) AS distance FROM sector_si",
        exchange_stability="SELECT m.exchange, count(*) AS n, round(median(rho), 6) AS rho, round(median(k), 6) AS k, round(median(c), 6) AS c FROM eigen e JOIN master m ON e.code = m.code GROUP BY m.exchange",
        sector_stability_index=f"SELECT industry, n, round(0.5 * {clip('1 - rho / 2')} + 0.2 * {clip('1 - abs(c - 1) / 2')} + 0.3 * {clip('wedge')}, 6) AS si FROM sector_si",
        si_series="SELECT asof_date, industry, n, round(si, 6) AS si FROM si_time",
        si_drift="""SELECT asof_date, industry, round(z, 4) AS z FROM (SELECT asof_date, industry, (si - m) / greatest(s, 0.01) AS z, n FROM (SELECT asof_date, industry, si, avg(si) OVER w AS m, stddev_samp(si) OVER w AS s, count(*) OVER w AS n FROM si_time
            WINDOW w AS (PARTITION BY industry ORDER BY asof_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) a WHERE n >= 2) b WHERE z < -2""",
        si_asof="""SELECT g.ts, g.industry, round(last_value(si) ignore nulls OVER (PARTITION BY g.industry ORDER BY g.ts, g.kind ROWS UNBOUNDED PRECEDING), 6) AS si, g.kind FROM (
            SELECT asof_date AS ts, industry, si, 0 AS kind FROM si_time UNION ALL SELECT t.ts, i.industry, NULL, 1 FROM (SELECT DISTINCT ts FROM bars) t CROSS JOIN (SELECT DISTINCT industry FROM si_time) i) g""",
        frequency_response="""SELECT w, k, c, round(1 / sqrt(re * re + im * im), 6) AS gain, round(-atan2(im, re), 6) AS phase FROM (SELECT w, k, c, cos(2 * w) - 2 * cos(w) + 1 + c * (cos(w) - 1) + k AS re, sin(2 * w) - 2 * sin(w) + c * sin(w) AS im FROM (
            SELECT cast(i AS double) * pi() / 200 AS w FROM (SELECT explode(sequence(1, 200)) AS i) s) f CROSS JOIN (VALUES (0.1, 0.5), (0.3, 0.9), (0.5, 1.2)) AS p(k, c)) x""",
        natural_frequency="SELECT code, CASE WHEN c * c < 4 * k AND k > 0 THEN round(atan2(sqrt(4 * k - c * c) / 2, 1 - c / 2), 6) END AS omega FROM kc WHERE status LIKE 'ok%'",
        stability_grid=f"SELECT round(k, 6) AS k, round(c, 6) AS c, round({e['radius']}, 6) AS rho, {e['class']} AS class FROM (SELECT -0.5 + i * 0.075 AS k FROM (SELECT explode(sequence(0, 59)) AS i) a) p CROSS JOIN (SELECT -0.5 + j * 0.0813 AS c FROM (SELECT explode(sequence(0, 59)) AS j) b) q".replace("-0.5 + i * 0.075", "cast(-0.5 + i * 0.075 AS double)").replace("-0.5 + j * 0.0813", "cast(-0.5 + j * 0.0813 AS double)"),
        wedge_boundary="SELECT i, round(cast(i AS double) / 10, 6) AS k, round(2 * sqrt(cast(i AS double) / 10 + 1), 6) AS c FROM (SELECT explode(sequence(0, 40)) AS i) x",
    )
