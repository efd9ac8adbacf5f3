"""Stability of fitted pairs: eigen tables, sector indices, rolling fits, driver comparison.

Every query here has a DuckDB statement of its own, built on other constructs than the
Spark one (filters and lists for windows and joins, ``QUALIFY`` for ranks).
"""

from __future__ import annotations

from tidemill.functions.exprs import clip
from tidemill.operators.dynamics import FIRST_OF_MOST, STATES, classify
from tidemill.plans.flow import Flow

#: Codes that an industry holds at least, and at least in the second attempt; industries that satisfy.
STRONG, WEAK, ENOUGH = 50, 30, 5
#: Rows of the rolling fits, from the last one back; k or c beyond which a fit is extreme.
WINDOWS = (60, 120, 240)
EXTREME = 10


def angle(k: str, c: str) -> str:
    """Angle of the root of the largest size: pi for a negative real one."""
    disc = f"({c} * {c} - 4 * {k})"
    return f"(CASE WHEN {disc} < -1e-8 THEN atan2(sqrt(greatest(-{disc}, 0)) / 2, 1 - {c} / 2) WHEN 2 - {c} >= 0 THEN 0e0 ELSE pi() END)"


#: The four regimes of a class name and its radius.
REGIME = """(CASE WHEN class LIKE '%stable%' THEN CASE WHEN rho < 0.95 THEN 'overdamped' ELSE 'critical' END
    WHEN class LIKE '%divergent%' OR class LIKE '%periodic%' THEN 'underdamped' WHEN class LIKE '%anti%' THEN 'anti_damped' ELSE 'critical' END)"""


def enough(flow: Flow, name: str, table: str, strong: int, weak: int, groups: int) -> None:
    """A step of the rows of ``table`` with n of ``strong`` or more; ``weak`` if too few, all if still too few."""
    flow.step(**{name: f"""SELECT * FROM (SELECT *, count(CASE WHEN n >= {strong} THEN 1 END) OVER (PARTITION BY 0) AS n_strong, count(CASE WHEN n >= {weak} THEN 1 END) OVER (PARTITION BY 0) AS n_weak FROM {table}) x
        WHERE n >= CASE WHEN n_strong >= {groups} THEN {strong} WHEN n_weak >= {groups} THEN {weak} ELSE 0 END"""})


def _solved(prefix: str = "") -> str:
    return f"({prefix}p * {prefix}d - {prefix}q * {prefix}b) / nullif({prefix}a * {prefix}d - {prefix}b * {prefix}b, 0) AS k, ({prefix}a * {prefix}q - {prefix}b * {prefix}p) / nullif({prefix}a * {prefix}d - {prefix}b * {prefix}b, 0) AS c"


def _status(k: str, c: str) -> str:
    return f"CASE WHEN n_valid < 3 THEN concat('too_few_days (', cast(n_valid AS string), ')') WHEN {k} IS NULL THEN 'singular' WHEN abs({k}) > {EXTREME} OR abs({c}) > {EXTREME} THEN 'extreme' ELSE 'ok' END"


def _two_places(x: str) -> str:
    """``x`` with two places as text; what is rounded to zero keeps its sign, as DuckDB's ``round`` has it."""
    return f"CASE WHEN round({x}, 2) = 0 AND cast({x} AS string) LIKE '-%' THEN '-0.0' ELSE cast(round({x}, 2) AS string) END"


def add(flow: Flow) -> None:
    e = classify("k", "c")
    flow.step(
        angled=f"SELECT *, {angle('k', 'c')} AS theta, {REGIME} AS regime FROM eigen",
        si_all=f"""SELECT industry, n, rho, c, {clip('1 - rho / 2')} AS rho_health, {clip('1 - abs(c - 1) / 2')} AS damping_health, {clip('wedge')} AS wedge_health,
            0.5 * {clip('1 - rho / 2')} + 0.2 * {clip('1 - abs(c - 1) / 2')} + 0.3 * {clip('wedge')} AS si FROM sector_si""",
        kc_by_date=f"""SELECT t.asof_date, m.industry, count(*) AS n, median(t.k) AS k, median(t.c) AS c, median({classify('t.k', 't.c')['radius']}) AS rho, avg(CASE WHEN {classify('t.k', 't.c')['wedge']} THEN 1e0 ELSE 0e0 END) AS wedge
            FROM kc_time t JOIN master m ON t.code = m.code WHERE t.k IS NOT NULL GROUP BY t.asof_date, m.industry""",
        evolved=f"""SELECT code, asof_date, k - lag(k) OVER w AS dk, c - lag(c) OVER w AS dc, rho - lag(rho) OVER w AS drho, theta - lag(theta) OVER w AS dtheta FROM (
            SELECT code, asof_date, k, c, {e['radius']} AS rho, {angle('k', 'c')} AS theta FROM kc_time) x WINDOW w AS (PARTITION BY code ORDER BY asof_date)""",
        from_last=f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY code) AS total FROM displaced",
        windowed="SELECT code, w.w, min(ts) AS window_start, max(ts) AS window_end, count(ax) AS n_valid, "
        + ", ".join(f"coalesce(sum(CASE WHEN ax IS NOT NULL THEN {x} END), 0) AS {y}" for y, x in {
            "a": "(dx * dx + dy * dy) / 1e6", "b": "(dx * ux + dy * uy) / 1e6", "d": "(ux * ux + uy * uy) / 1e6",
            "p": "(-dx * (ax - beta * bx) - dy * (ay - beta * by_)) / 1e6", "q": "(-ux * (ax - beta * bx) - uy * (ay - beta * by_)) / 1e6",
            "yy": "((ax - beta * bx) * (ax - beta * bx) + (ay - beta * by_) * (ay - beta * by_)) / 1e6", "sy": "(ax - beta * bx + ay - beta * by_) / 1e3"}.items())
        + f" FROM from_last CROSS JOIN (VALUES {', '.join(f'({w})' for w in WINDOWS)}) AS w(w) WHERE back <= w.w GROUP BY code, w.w",
        window_fits=f"""SELECT code, w, window_start, window_end, n_valid, k, c, (k * p + c * q - sy * sy / (2 * n_valid)) / nullif(yy - sy * sy / (2 * n_valid), 0) AS r2, {_status('k', 'c')} AS status FROM (
            SELECT code, w, window_start, window_end, n_valid, p, q, yy, sy, CASE WHEN n_valid >= 3 THEN k END AS k, CASE WHEN n_valid >= 3 THEN c END AS c FROM (SELECT *, {_solved()} FROM windowed) y) x""",
        industry_pairs_of="SELECT m.code, b.ts, b.volume AS sv, b.amount AS sa, i.volume AS iv, i.amount AS ia FROM bars b JOIN master m ON b.code = m.code JOIN industry_bars i ON i.industry = m.industry AND i.ts = b.ts",
        driven="SELECT 'market' AS driver, code, ts, sv, sa, iv, ia FROM pairs UNION ALL SELECT 'industry', code, ts, sv, sa, iv, ia FROM industry_pairs_of",
        driven_moves="SELECT * FROM (SELECT driver, code, ts, " + ", ".join(f"{x} - lag({x}) OVER (PARTITION BY driver, code ORDER BY ts) AS {y}" for x, y in (("sv", "sx"), ("sa", "sy"), ("iv", "mx"), ("ia", "my"))) + " FROM driven) x WHERE sx IS NOT NULL",
        driven_free="""SELECT *, sx - beta * mx AS ux, sy - beta * my AS uy, (lead(sx) OVER w) - sx - beta * ((lead(mx) OVER w) - mx) AS fx, (lead(sy) OVER w) - sy - beta * ((lead(my) OVER w) - my) AS fy FROM (
            SELECT *, CASE WHEN mx * mx + my * my > 1e-12 THEN (sx * mx + sy * my) / (mx * mx + my * my) ELSE 0e0 END AS beta FROM driven_moves) x WINDOW w AS (PARTITION BY driver, code ORDER BY ts)""",
        driven_far="""SELECT *, coalesce(sum(ux) OVER w, 0) AS dx, coalesce(sum(uy) OVER w, 0) AS dy FROM driven_free WINDOW w AS (PARTITION BY driver, code ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        driven_sums="""SELECT driver, code, count(*) AS n, avg(beta) AS beta, sum((dx * dx + dy * dy) / 1e6) AS a, sum((dx * ux + dy * uy) / 1e6) AS b, sum((ux * ux + uy * uy) / 1e6) AS d,
            sum((-dx * fx - dy * fy) / 1e6) AS p, sum((-ux * fx - uy * fy) / 1e6) AS q, sum((fx * fx + fy * fy) / 1e6) AS yy FROM driven_far WHERE fx IS NOT NULL GROUP BY driver, code""",
        driven_fits=f"SELECT driver, code, n, beta, k, c, (k * p + c * q) / nullif(yy, 0) AS fit FROM (SELECT *, {_solved()} FROM driven_sums WHERE n >= 3) x",
        swapped="""SELECT m.code, m.n, m.k AS k_market, i.k AS k_industry, m.c AS c_market, i.c AS c_industry, m.beta AS beta_market, i.beta AS beta_industry, m.fit AS fit_market, i.fit AS fit_industry
            FROM driven_fits m JOIN driven_fits i ON m.code = i.code WHERE m.driver = 'market' AND i.driver = 'industry'""",
    )
    enough(flow, "si_kept", "si_all", STRONG, WEAK, ENOUGH)
    enough(flow, "si_kept_small", "si_all", 4, 3, ENOUGH)
    enough(flow, "industries_kept", "sector_si", STRONG, WEAK, ENOUGH)
    enough(flow, "industries_kept_small", "sector_si", 4, 3, ENOUGH)

    def industries(kept: str) -> str:
        return f"""SELECT industry, n, nth, round(rho, 6) AS rho, round(rho_25, 6) AS rho_25, round(rho_75, 6) AS rho_75, round(k, 6) AS k, round(c, 6) AS c, round(stable, 6) AS stable, round(wedge, 6) AS wedge, round(distance, 6) AS distance
            FROM (SELECT *, row_number() OVER (ORDER BY round(rho, 8) DESC, industry) AS nth FROM {kept}) x WHERE nth <= 10"""

    def industries_other(strong: int, weak: int) -> str:
        return f"""SELECT industry, n, row_number() OVER (ORDER BY round(r, 8) DESC, industry) AS nth, round(r, 6) AS rho, round(r25, 6) AS rho_25, round(r75, 6) AS rho_75, round(k, 6) AS k, round(c, 6) AS c, round(stable, 6) AS stable, round(wedge, 6) AS wedge, round(distance, 6) AS distance FROM (
              SELECT m.industry, count(*) AS n, quantile_cont(rho, 0.5) AS r, quantile_cont(rho, 0.25) AS r25, quantile_cont(rho, 0.75) AS r75, quantile_cont(k, 0.5) AS k, quantile_cont(c, 0.5) AS c,
                count(*) FILTER (WHERE rho < 1 - 1e-8)::DOUBLE / count(*) AS stable, count(*) FILTER (WHERE k > 1e-8 AND c > k + 1e-8 AND c < 2 + k / 2 - 1e-8)::DOUBLE / count(*) AS wedge, quantile_cont(list_min([k, c - k, 2 + k / 2 - c]), 0.5) AS distance
              FROM eigen JOIN master m USING (code) GROUP BY ALL) g, (SELECT len(list_filter(l, lambda z: z >= {strong})) AS s, len(list_filter(l, lambda z: z >= {weak})) AS w FROM (SELECT list(n) AS l FROM (SELECT count(*) AS n FROM eigen JOIN master m USING (code) GROUP BY m.industry))) t
            WHERE n >= CASE WHEN s >= {ENOUGH} THEN {strong} WHEN w >= {ENOUGH} THEN {weak} ELSE 0 END QUALIFY nth <= 10"""

    def stability_index(kept: str) -> str:
        return f"SELECT industry, n, round(rho_health, 6) AS rho_health, round(damping_health, 6) AS damping_health, round(wedge_health, 6) AS wedge_health, round(si, 6) AS si, round(rho, 6) AS rho_median, round(c, 6) AS c_median, row_number() OVER (ORDER BY round(si, 8) DESC, industry) AS nth FROM {kept}"

    def stability_index_other(strong: int, weak: int) -> str:
        return f"""WITH g AS (SELECT m.industry, count(*) AS n, quantile_cont(rho, 0.5) AS r, quantile_cont(c, 0.5) AS c, avg(CASE WHEN k > 1e-8 AND c > k + 1e-8 AND c < 2 + k / 2 - 1e-8 THEN 1 ELSE 0 END) AS w FROM eigen JOIN master m USING (code) GROUP BY ALL),
            h AS (SELECT *, list_max([0, list_min([1, 1 - r / 2])]) AS rh, list_max([0, list_min([1, 1 - abs(c - 1) / 2])]) AS dh FROM g WHERE n >= (SELECT CASE WHEN count(*) FILTER (WHERE n >= {strong}) >= {ENOUGH} THEN {strong} WHEN count(*) FILTER (WHERE n >= {weak}) >= {ENOUGH} THEN {weak} ELSE 0 END FROM g))
            SELECT industry, n, round(rh, 6) AS rho_health, round(dh, 6) AS damping_health, round(w, 6) AS wedge_health, round(0.5 * rh + 0.2 * dh + 0.3 * w, 6) AS si, round(r, 6) AS rho_median, round(c, 6) AS c_median, row_number() OVER (ORDER BY round(0.5 * rh + 0.2 * dh + 0.3 * w, 8) DESC, industry) AS nth FROM h"""

    roots = """SELECT code, index_code, k, c, 2 - c AS tr, 1 - c + k AS det FROM eigen"""
    flow.pair(
        eigen_factors=(
            "SELECT code, round(rho, 6) AS rho, round(theta, 6) AS theta, round(1 - rho, 6) AS dist_to_unit, regime FROM angled",
            f"""SELECT code, round(r, 6) AS rho, round(t, 6) AS theta, round(1 - r, 6) AS dist_to_unit,
                CASE WHEN class IN ('stable_oscillatory', 'stable_overdamped', 'stable_critical_damping') THEN if(r < 0.95, 'overdamped', 'critical') WHEN class IN ('oscillatory_divergent', 'monotonic_divergent', 'critical_periodic') THEN 'underdamped' WHEN class = 'anti_restoring' THEN 'anti_damped' ELSE 'critical' END AS regime
              FROM (SELECT x.code, e.class, CASE WHEN tr * tr - 4 * det < -1e-8 THEN sqrt(det) ELSE list_max([abs(tr + sqrt(greatest(tr * tr - 4 * det, 0))), abs(tr - sqrt(greatest(tr * tr - 4 * det, 0)))]) / 2 END AS r,
                CASE WHEN tr * tr - 4 * det < -1e-8 THEN acos(tr / 2 / sqrt(det)) WHEN tr < 0 THEN pi() ELSE 0 END AS t FROM ({roots}) x JOIN eigen e USING (code)) z""",
        ),
        eigen_table=(
            """SELECT code, index_code, round(k, 6) AS k_hat, round(c, 6) AS c_hat, round(2 - c, 6) AS trace, round(1 - c + k, 6) AS det, round(disc, 6) AS disc,
                round(1 - c / 2 + sqrt(greatest(disc, 0)) / 2, 6) AS root_1, round(1 - c / 2 - sqrt(greatest(disc, 0)) / 2, 6) AS root_2, round(CASE WHEN disc < -1e-8 THEN sqrt(-disc) / 2 ELSE 0e0 END, 6) AS root_im, round(rho, 6) AS rho, round(theta, 6) AS theta,
                class, stability, mode, response, in_wedge, round(c - k, 6) AS above_lower, round(2 + k / 2 - c, 6) AS below_upper, round(distance, 6) AS distance, regime FROM angled""",
            """SELECT e.code, e.index_code, round(e.k, 6) AS k_hat, round(e.c, 6) AS c_hat, round(x.tr, 6) AS trace, round(x.det, 6) AS det, round(x.tr ** 2 - 4 * x.det, 6) AS disc,
                round((x.tr + sqrt(greatest(x.tr ** 2 - 4 * x.det, 0))) / 2, 6) AS root_1, round((x.tr - sqrt(greatest(x.tr ** 2 - 4 * x.det, 0))) / 2, 6) AS root_2, round(CASE WHEN x.tr ** 2 - 4 * x.det < -1e-8 THEN sqrt(4 * x.det - x.tr ** 2) / 2 ELSE 0 END, 6) AS root_im,
                round(e.rho, 6) AS rho, round(CASE WHEN x.tr ** 2 - 4 * x.det < -1e-8 THEN acos(x.tr / 2 / sqrt(x.det)) WHEN x.tr < 0 THEN pi() ELSE 0 END, 6) AS theta, e.class, e.stability, e.mode, e.response,
                (e.k > 1e-8 AND e.c - e.k > 1e-8 AND 2 + e.k / 2 - e.c > 1e-8) AS in_wedge, round(e.c - e.k, 6) AS above_lower, round(2 + e.k / 2 - e.c, 6) AS below_upper, round(list_min([e.k, e.c - e.k, 2 + e.k / 2 - e.c]), 6) AS distance,
                CASE WHEN starts_with(e.class, 'stable') THEN if(e.rho < 0.95, 'overdamped', 'critical') WHEN regexp_matches(e.class, 'divergent|periodic') THEN 'underdamped' WHEN starts_with(e.class, 'anti') THEN 'anti_damped' ELSE 'critical' END AS regime
              FROM eigen e JOIN (SELECT code, 2 - c AS tr, 1 - c + k AS det FROM eigen) x USING (code)""",
        ),
        kc_evolution_full=(
            "SELECT code, asof_date, round(dk, 6) + 0e0 AS delta_k, round(dc, 6) + 0e0 AS delta_c, round(drho, 6) + 0e0 AS delta_rho, round(dtheta, 5) + 0e0 AS delta_theta FROM evolved",
            """WITH z AS (SELECT code, asof_date, k, c, CASE WHEN c * c < 4 * k - 1e-8 THEN sqrt(1 - c + k) ELSE list_max([abs(2 - c + sqrt(greatest(c * c - 4 * k, 0))), abs(2 - c - sqrt(greatest(c * c - 4 * k, 0)))]) / 2 END AS r,
                CASE WHEN c * c < 4 * k - 1e-8 THEN acos((1 - c / 2) / sqrt(1 - c + k)) WHEN c > 2 THEN pi() ELSE 0 END AS t, row_number() OVER (PARTITION BY code ORDER BY asof_date) AS i FROM kc_time)
              SELECT a.code, a.asof_date, round(a.k - b.k, 6) + 0 AS delta_k, round(a.c - b.c, 6) + 0 AS delta_c, round(a.r - b.r, 6) + 0 AS delta_rho, round(a.t - b.t, 5) + 0 AS delta_theta FROM z a LEFT JOIN z b ON a.code = b.code AND a.i = b.i + 1""",
        ),
        industry_top_stability=(industries("industries_kept"), industries_other(STRONG, WEAK)),
        industry_top_stability_small=(industries("industries_kept_small"), industries_other(4, 3)),
        stability_index_table=(stability_index("si_kept"), stability_index_other(STRONG, WEAK)),
        stability_index_table_small=(stability_index("si_kept_small"), stability_index_other(4, 3)),
        stability_by_date=(
            "SELECT asof_date, industry, n, round(k, 6) AS k, round(c, 6) AS c, round(rho, 6) AS rho, round(wedge, 6) AS wedge FROM kc_by_date",
            """SELECT asof_date, industry, count(*) AS n, round(quantile_cont(k, 0.5), 6) AS k, round(quantile_cont(c, 0.5), 6) AS c,
                round(quantile_cont(CASE WHEN c * c < 4 * k - 1e-8 THEN sqrt(1 - c + k) ELSE list_max([abs(2 - c + sqrt(greatest(c * c - 4 * k, 0))), abs(2 - c - sqrt(greatest(c * c - 4 * k, 0)))]) / 2 END, 0.5), 6) AS rho,
                round(count(*) FILTER (WHERE k > 1e-8 AND c - k > 1e-8 AND 2 + k / 2 - c > 1e-8)::DOUBLE / count(*), 6) AS wedge FROM kc_time JOIN master USING (code) WHERE k IS NOT NULL GROUP BY ALL""",
        ),
        regimes_by_date=(
            """SELECT asof_date, industry, nth, n, concat(lower(industry), ' (', industry, ')') AS label, round(k, 6) AS k, round(c, 6) AS c, round(CASE WHEN c * c < 4 * k AND k > 0 THEN atan2(sqrt(4 * k - c * c) / 2, 1 - c / 2) END, 6) AS omega,
                CASE WHEN c * c > 4 * k THEN 'overdamped' WHEN abs(c * c - 4 * k) < 1e-6 THEN 'critical' ELSE 'underdamped' END AS regime FROM (
              SELECT *, row_number() OVER (PARTITION BY asof_date ORDER BY n DESC, industry) AS nth FROM kc_by_date) x WHERE nth <= 6""",
            """SELECT asof_date, industry, row_number() OVER (PARTITION BY asof_date ORDER BY n DESC, industry) AS nth, n, lower(industry) || ' (' || industry || ')' AS label, round(k, 6) AS k, round(c, 6) AS c,
                round(CASE WHEN c * c < 4 * k THEN acos((1 - c / 2) / sqrt(1 - c + k)) END, 6) AS omega, ['underdamped', 'critical', 'overdamped'][CASE WHEN c ** 2 > 4 * k THEN 3 WHEN abs(c ** 2 - 4 * k) < 1e-6 THEN 2 ELSE 1 END] AS regime
              FROM (SELECT asof_date, industry, count(*) AS n, quantile_cont(k, 0.5) AS k, quantile_cont(c, 0.5) AS c FROM kc_time JOIN master USING (code) WHERE k IS NOT NULL GROUP BY ALL) QUALIFY nth <= 6""",
        ),
        industry_pairs_by_key=(
            """SELECT by_key, industry, nth FROM (SELECT s.by_key, industry, row_number() OVER (PARTITION BY s.by_key ORDER BY CASE s.by_key WHEN 'n_stocks' THEN cast(n AS double) WHEN 'c_over_k' THEN round(c / nullif(k, 0), 8) ELSE round(k / nullif(c, 0), 8) END DESC NULLS LAST, industry) AS nth
                FROM sector_si CROSS JOIN (VALUES ('n_stocks'), ('c_over_k'), ('k_over_c')) AS s(by_key)) x WHERE nth <= 6""",
            """SELECT 'n_stocks' AS by_key, industry, row_number() OVER (ORDER BY n DESC, industry) AS nth FROM sector_si QUALIFY nth <= 6
               UNION ALL SELECT 'c_over_k', industry, row_number() OVER (ORDER BY CASE WHEN k <> 0 THEN round(c / k, 8) END DESC NULLS LAST, industry) AS nth FROM sector_si QUALIFY nth <= 6
               UNION ALL SELECT 'k_over_c', industry, row_number() OVER (ORDER BY CASE WHEN c <> 0 THEN round(k / c, 8) END DESC NULLS LAST, industry) AS nth FROM sector_si QUALIFY nth <= 6""",
        ),
        stability_extremes=(
            """SELECT side, industry, round(si, 6) AS si, nth FROM (SELECT 'top' AS side, industry, si, row_number() OVER (ORDER BY round(si, 8) DESC, industry) AS nth FROM si_all
                UNION ALL SELECT 'bottom', industry, si, row_number() OVER (ORDER BY round(si, 8), industry) FROM si_all) x WHERE nth <= 12""",
            """WITH l AS (SELECT list({'s': round(si, 8), 'v': si, 'i': industry} ORDER BY round(si, 8) DESC, industry)[1:12] AS t, list({'s': round(si, 8), 'v': si, 'i': industry} ORDER BY round(si, 8), industry)[1:12] AS b FROM si_all)
              SELECT 'top' AS side, t[p].i AS industry, round(t[p].v, 6) AS si, p AS nth FROM l, range(1, 13) r(p) WHERE p <= len(t) UNION ALL SELECT 'bottom', b[p].i, round(b[p].v, 6), p FROM l, range(1, 13) r(p) WHERE p <= len(b)""",
        ),
        drift_by_industry=(
            """SELECT industry, events, nth FROM (SELECT *, row_number() OVER (ORDER BY events DESC, industry) AS nth FROM (SELECT industry, count_if(n >= 2 AND (si - m) / greatest(s, 0.01) < -2) AS events FROM (
                SELECT industry, si, avg(si) OVER w AS m, stddev_samp(si) OVER w AS s, count(*) OVER w AS n FROM si_time WINDOW w AS (PARTITION BY industry ORDER BY asof_date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) a GROUP BY industry) b) c WHERE nth <= 10""",
            """WITH o AS (SELECT industry, si, row_number() OVER (PARTITION BY industry ORDER BY asof_date) AS i FROM si_time), z AS (SELECT a.industry, a.i, any_value(a.si) AS si, avg(b.si) AS m, stddev_samp(b.si) AS s, count(b.si) AS n FROM o a LEFT JOIN o b ON a.industry = b.industry AND b.i BETWEEN a.i - 6 AND a.i - 1 GROUP BY a.industry, a.i)
              SELECT industry, count(*) FILTER (WHERE n >= 2 AND (si - m) / greatest(s, 0.01) < -2) AS events, row_number() OVER (ORDER BY events DESC, industry) AS nth FROM z GROUP BY industry QUALIFY nth <= 10""",
        ),
        ramp_up=(
            "SELECT code, n_valid, round(k, 6) AS k_hat, round(c, 6) AS c_hat FROM kc WHERE status LIKE 'ok%' AND n_valid >= 192",
            "SELECT code, n_valid, round(k, 6) AS k_hat, round(c, 6) AS c_hat FROM kc WHERE starts_with(status, 'ok') AND NOT n_valid < 192",
        ),
        rolling_fits=(
            "SELECT code, w AS window_rows, window_start, window_end, n_valid, round(k, 6) AS k_hat, round(c, 6) AS c_hat, round(r2, 6) AS r2, status FROM window_fits",
            f"""WITH l AS (SELECT code, list({{'t': ts, 'v': ax IS NOT NULL, 'd': [dx, dy], 'u': [ux, uy], 'y': [ax - beta * bx, ay - beta * by_]}} ORDER BY ts) AS l FROM displaced GROUP BY code),
                s AS (SELECT code, w, list_slice(l, greatest(1, len(l) - w + 1), len(l)) AS r FROM l, (VALUES (60), (120), (240)) v(w)),
                g AS (SELECT code, w, r[1].t AS window_start, r[-1].t AS window_end, list_filter(r, lambda z: z.v) AS r FROM s),
                m AS (SELECT code, w, window_start, window_end, len(r) AS n, flatten([z.d FOR z IN r]) AS d, flatten([z.u FOR z IN r]) AS u, flatten([z.y FOR z IN r]) AS y FROM g),
                o AS (SELECT *, list_dot_product(d, d) / 1e6 AS dd, list_dot_product(d, u) / 1e6 AS du, list_dot_product(u, u) / 1e6 AS uu, -list_dot_product(d, y) / 1e6 AS dy, -list_dot_product(u, y) / 1e6 AS uy, list_dot_product(y, y) / 1e6 - list_sum(y) ** 2 / 1e6 / len(y) AS ss FROM m),
                f AS (SELECT *, CASE WHEN n >= 3 AND dd * uu - du * du <> 0 THEN (dy * uu - uy * du) / (dd * uu - du * du) END AS k, CASE WHEN n >= 3 AND dd * uu - du * du <> 0 THEN (uy * dd - dy * du) / (dd * uu - du * du) END AS c FROM o)
              SELECT code, w AS window_rows, window_start, window_end, n AS n_valid, round(k, 6) AS k_hat, round(c, 6) AS c_hat, round((k * dy + c * uy - list_sum(y) ** 2 / 1e6 / len(y)) / nullif(ss, 0), 6) AS r2,
                CASE WHEN n < 3 THEN 'too_few_days (' || n || ')' WHEN k IS NULL THEN 'singular' WHEN greatest(abs(k), abs(c)) > {EXTREME} THEN 'extreme' ELSE 'ok' END AS status FROM f""",
        ),
        rolling_fit_summary=(
            "SELECT code, " + ", ".join(f"round(max(CASE WHEN w = {w} THEN {x} END), 6) AS {x}_{w}" for x in ("k", "c") for w in WINDOWS) + ", count_if(status = 'ok') AS n_ok FROM window_fits GROUP BY code",
            "SELECT code, " + ", ".join(f"round(any_value({x}) FILTER (WHERE w = {w}), 6) AS {x}_{w}" for x in ("k", "c") for w in WINDOWS) + ", count(*) FILTER (WHERE status = 'ok') AS n_ok FROM window_fits GROUP BY code",
        ),
        rolling_fit_medians=(
            "SELECT w AS window_rows, count(*) AS n, count(k) AS fitted, round(median(k), 6) AS k_median, round(median(c), 6) AS c_median, round(median(r2), 6) AS r2_median, count_if(status <> 'ok') AS not_ok FROM window_fits GROUP BY w",
            "SELECT w AS window_rows, count(*) AS n, count(k) AS fitted, round(quantile_cont(k, 0.5), 6) AS k_median, round(quantile_cont(c, 0.5), 6) AS c_median, round(quantile_cont(r2, 0.5), 6) AS r2_median, count(*) FILTER (WHERE status <> 'ok') AS not_ok FROM window_fits GROUP BY w",
        ),
        industry_lookup=(
            """SELECT code, CASE WHEN sector_code IN ('-', 'nan', 'None') THEN '' ELSE substring(sector_code, 1, 5) END AS industry_l1, concat(sector_name, ' (', sector_code, ')') AS label FROM (
                SELECT member_code AS code, CASE WHEN member_code % 13 = 0 THEN '-' ELSE sector_code END AS sector_code, sector_name, row_number() OVER (PARTITION BY member_code ORDER BY ord, sector_code) AS nth FROM membership) x WHERE nth = 1""",
            """SELECT member_code AS code, CASE WHEN member_code % 13 = 0 THEN '' ELSE left(arg_min(sector_code, (ord, sector_code)), 5) END AS industry_l1,
                arg_min(sector_name, (ord, sector_code)) || ' (' || CASE WHEN member_code % 13 = 0 THEN '-' ELSE arg_min(sector_code, (ord, sector_code)) END || ')' AS label FROM membership GROUP BY member_code""",
        ),
        overlay_pairs=(
            rf"""SELECT nth, cast(part[0] AS double) AS k, cast(part[1] AS double) AS c, trim(part[2]) AS label FROM (SELECT nth, split(trim(piece), ',', 3) AS part FROM (SELECT posexplode(split(text, ';')) AS (nth, piece) FROM (
                SELECT array_join(array_sort(collect_list(concat({_two_places('k')}, ',', {_two_places('c')}, ', ', industry, ', n=', cast(n AS string)))), '; ') AS text FROM sector_si WHERE k IS NOT NULL) a) b) d""",
            r"""SELECT (row_number() OVER (ORDER BY s) - 1)::INT AS nth, regexp_extract(s, '^([^,]*),([^,]*),(.*)$', 1)::DOUBLE AS k, regexp_extract(s, '^([^,]*),([^,]*),(.*)$', 2)::DOUBLE AS c, trim(regexp_extract(s, '^([^,]*),([^,]*),(.*)$', 3)) AS label
                FROM (SELECT round(k, 2) || ',' || round(c, 2) || ', ' || industry || ', n=' || n AS s FROM sector_si WHERE k IS NOT NULL)""",
        ),
        frequency_summary=(
            """SELECT industry, n, point, round(1 / sqrt(re * re + im * im), 5) AS gain FROM (SELECT industry, n, point, cos(2 * w) - 2 * cos(w) + 1 + c * (cos(w) - 1) + k AS re, sin(2 * w) - 2 * sin(w) + c * sin(w) AS im FROM (
                SELECT industry, n, k, c, p.point, CASE p.point WHEN 'dc' THEN 0.001 WHEN 'pi' THEN pi() ELSE CASE WHEN c * c < 4 * k AND k > 0 THEN atan2(sqrt(4 * k - c * c) / 2, 1 - c / 2) END END AS w FROM sector_si CROSS JOIN (VALUES ('dc'), ('natural'), ('pi')) AS p(point)) x) y WHERE re * re + im * im > 1e-12""",
            """WITH p AS (SELECT industry, n, k, c, unnest(['dc', 'natural', 'pi']) AS point, unnest([0.001, CASE WHEN c * c < 4 * k THEN acos((1 - c / 2) / sqrt(1 - c + k)) END, pi()]) AS w FROM sector_si)
              SELECT industry, n, point, round(z ** -0.5, 5) AS gain FROM (SELECT *, (cos(2 * w) + (c - 2) * cos(w) + 1 - c + k) ** 2 + (sin(2 * w) + (c - 2) * sin(w)) ** 2 AS z FROM p) WHERE z > 1e-12""",
        ),
        driver_swap=(
            """SELECT code, n, round(k_market, 5) AS k_market, round(k_industry, 5) AS k_industry, round(c_market, 5) AS c_market, round(c_industry, 5) AS c_industry, round(beta_market, 6) AS beta_market, round(beta_industry, 6) AS beta_industry,
                k_market * k_industry < 0 AS sign_flipped, abs(k_market) < 0.5 * abs(k_industry) AS attenuated, abs(k_market) > 1.5 * abs(k_industry) AS amplified, round(fit_market, 6) > round(fit_industry, 6) AS improved, round(fit_market, 6) < round(fit_industry, 6) AS worsened FROM swapped""",
            """WITH p AS (SELECT code, max(n) FILTER (WHERE driver = 'market') AS n, max(k) FILTER (WHERE driver = 'market') AS km, max(k) FILTER (WHERE driver = 'industry') AS ki, max(c) FILTER (WHERE driver = 'market') AS cm, max(c) FILTER (WHERE driver = 'industry') AS ci,
          max(beta) FILTER (WHERE driver = 'market') AS bm, max(beta) FILTER (WHERE driver = 'industry') AS bi, max(fit) FILTER (WHERE driver = 'market') AS fm, max(fit) FILTER (WHERE driver = 'industry') AS fi FROM driven_fits GROUP BY code HAVING count(*) = 2)
        SELECT code, n, round(km, 5) AS k_market, round(ki, 5) AS k_industry, round(cm, 5) AS c_market, round(ci, 5) AS c_industry, round(bm, 6) AS beta_market, round(bi, 6) AS beta_industry, sign(km) * sign(ki) = -1 AS sign_flipped, 2 * abs(km) < abs(ki) AS attenuated, abs(km) > 1.5 * abs(ki) AS amplified,
          round(fm, 6) > round(fi, 6) AS improved, round(fm, 6) < round(fi, 6) AS worsened FROM p""",
        ),
        driver_swap_gate=(
            """SELECT count(*) AS n, count_if(k_market * k_industry < 0) AS flipped, count_if(abs(k_market) < 0.5 * abs(k_industry)) AS attenuated, count_if(abs(k_market) > 1.5 * abs(k_industry)) AS amplified,
                count_if(round(fit_market, 6) > round(fit_industry, 6)) AS improved, count_if(round(fit_market, 6) < round(fit_industry, 6)) AS worsened, round(avg(CASE WHEN round(fit_market, 6) > round(fit_industry, 6) THEN 1e0 ELSE 0e0 END), 6) AS improved_share,
                round(median(abs(k_market - k_industry)), 5) AS k_gap_median FROM swapped""",
            """WITH p AS (SELECT code, max(k) FILTER (WHERE driver = 'market') AS km, max(k) FILTER (WHERE driver = 'industry') AS ki, max(fit) FILTER (WHERE driver = 'market') AS fm, max(fit) FILTER (WHERE driver = 'industry') AS fi, count(*) AS n FROM driven_fits GROUP BY code HAVING count(*) = 2)
              SELECT count(*) AS n, count(*) FILTER (WHERE sign(km) * sign(ki) = -1) AS flipped, count(*) FILTER (WHERE 2 * abs(km) < abs(ki)) AS attenuated, count(*) FILTER (WHERE abs(km) > 1.5 * abs(ki)) AS amplified, count(*) FILTER (WHERE round(fm, 6) > round(fi, 6)) AS improved,
                count(*) FILTER (WHERE round(fm, 6) < round(fi, 6)) AS worsened, round((count(*) FILTER (WHERE round(fm, 6) > round(fi, 6)))::DOUBLE / count(*), 6) AS improved_share, round(quantile_cont(abs(km - ki), 0.5), 5) AS k_gap_median FROM p""",
        ),
        factor_panel_full=(
            f"""SELECT code, factor_name, round(value_num, 5) AS value_num, value_str, asof_date, 'loaded' AS status FROM (
                SELECT code, factor_name, value_num, cast(NULL AS string) AS value_str, cast(NULL AS date) AS asof_date FROM (SELECT code, stack(7, 'k', k, 'c', c, 'c_over_k', CASE WHEN abs(k) > 1e-12 THEN c / k END, 'log_c_over_k', CASE WHEN abs(k) > 1e-12 THEN log10(abs(c / k) + 1e-12) END,
                  'rho', rho, 'theta', theta, 'dist_to_unit', 1 - rho) AS (factor_name, value_num) FROM angled) a
                UNION ALL SELECT code, 'regime', NULL, regime, NULL FROM angled
                UNION ALL SELECT code, concat('state_p_', state), n / total, NULL, NULL FROM (SELECT code, state, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY code) AS double) AS total FROM states GROUP BY code, state) s
                UNION ALL SELECT code, 'state_dominant', NULL, {FIRST_OF_MOST}, NULL FROM (SELECT code, state, count(*) AS n FROM states GROUP BY code, state) s GROUP BY code
                UNION ALL SELECT code, factor_name, value_num, NULL, asof_date FROM (SELECT code, asof_date, stack(4, 'delta_k', dk, 'delta_c', dc, 'delta_rho', drho, 'delta_theta', dtheta) AS (factor_name, value_num) FROM evolved) d WHERE value_num IS NOT NULL) x""",
            f"""SELECT code, factor_name, round(value_num, 5) AS value_num, value_str, asof_date, 'loaded' AS status FROM (
                SELECT code, unnest(['k', 'c', 'c_over_k', 'log_c_over_k', 'rho', 'theta', 'dist_to_unit']) AS factor_name, unnest([k, c, if(abs(k) > 1e-12, c / k, NULL), if(abs(k) > 1e-12, log10(abs(c / k) + 1e-12), NULL), rho, theta, 1 - rho]) AS value_num, NULL AS value_str, NULL::DATE AS asof_date FROM angled
                UNION ALL SELECT code, 'regime', NULL, regime, NULL FROM angled
                UNION ALL SELECT s.code, 'state_p_' || s.state, count(*)::DOUBLE / any_value(t.total), NULL, NULL FROM states s JOIN (SELECT code, count(*) AS total FROM states GROUP BY code) t USING (code) GROUP BY s.code, s.state
                UNION ALL SELECT code, 'state_dominant', NULL, arg_max(state, (n, -list_position({list(STATES)}, state))), NULL FROM (SELECT code, state, count(*) AS n FROM states GROUP BY ALL) GROUP BY code
                UNION ALL SELECT code, factor_name, value_num, NULL, asof_date FROM (SELECT code, asof_date, unnest(['delta_k', 'delta_c', 'delta_rho', 'delta_theta']) AS factor_name, unnest([dk, dc, drho, dtheta]) AS value_num FROM evolved) WHERE value_num IS NOT NULL)""",
        ),
        batch_manifest=(
            "SELECT code, sum(n) AS n, 'ok' AS status, round(sum(sum_r) / sum(n), 6) AS mean_r, round(sqrt(max(max_e)), 4) AS max_root_e, array_join(array_sort(collect_list(concat(state, ':', cast(n AS string)))), ' ') AS state_dist FROM (SELECT code, state, count(*) AS n, sum(r) AS sum_r, max(e_self) AS max_e FROM states GROUP BY code, state) x GROUP BY code",
            "SELECT code, count(*) AS n, 'ok' AS status, round(avg(r), 6) AS mean_r, round(sqrt(max(e_self)), 4) AS max_root_e, (SELECT string_agg(s || ':' || c, ' ' ORDER BY s || ':' || c) FROM (SELECT unnest(map_keys(h)) AS s, unnest(map_values(h)) AS c)) AS state_dist FROM (SELECT code, r, e_self, histogram(state) OVER (PARTITION BY code) AS h FROM states) GROUP BY code, h",
        ),
        state_series_forces=(
            f"""SELECT s.code, s.ts, s.state, round(s.r, 6) AS r, round(f.f_market, 4) AS f_market, round(f.f_self, 2) AS f_self FROM states s JOIN (SELECT code, ts, sqrt(beta * bx * beta * bx + beta * by_ * beta * by_) AS f_market,
                sqrt(pow(ax - beta * bx + 0.1 * dx + 0.2 * ux, 2) + pow(ay - beta * by_ + 0.1 * dy + 0.2 * uy, 2)) AS f_self FROM displaced) f ON s.code = f.code AND s.ts = f.ts""",
            """SELECT s.code, s.ts, s.state, round(s.r, 6) AS r, round(abs(d.beta) * sqrt(d.bx ** 2 + d.by_ ** 2), 4) AS f_market, round(sqrt((d.ax - d.beta * d.bx + 0.1 * d.dx + 0.2 * d.ux) ** 2 + (d.ay - d.beta * d.by_ + 0.1 * d.dy + 0.2 * d.uy) ** 2), 2) AS f_self FROM states s JOIN displaced d USING (code, ts)""",
        ),
    )
