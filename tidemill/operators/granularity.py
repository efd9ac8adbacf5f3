"""One market at several granularities: bars of weeks and months in one pass, fits of each, and what differs.

Days nest in weeks and in months, so trades are summed to days once and days are dealt to
every period; the fit of a pair at a period is a closed form over one row of sums.
"""

from __future__ import annotations

from tidemill.functions.exprs import average_rank, correlation
from tidemill.plans.flow import Flow

PERIODS = ("week", "month")
#: Bars ahead and bars back of the factor, and codes that a date holds at least.
HORIZONS, BACK, LEAST = (1, 5), 5, 20


def add(flow: Flow) -> None:
    periods = ", ".join(f"('{p}')" for p in PERIODS)
    whole = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w > 1e-12 THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0e0 END AS {x}"
    step = lambda x: f"lead({x}) OVER (PARTITION BY code, period ORDER BY ts) - {x} AS d_{x}"
    both = lambda a, b: f"sum({a.format('v')} * {b.format('v')} + {a.format('a')} * {b.format('a')})"
    s, m, ds, dm = "s{}", "m{}", "d_s{}", "d_m{}"
    flow.step(
        day_bars=f"SELECT code, l_shipdate AS day, min_by(px, place) AS open, max(px) AS high, min(px) AS low, max_by(px, place) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lines GROUP BY code, l_shipdate",
        period_bars=f"""SELECT code, p.p AS period, cast(date_trunc(p.p, day) AS date) AS ts, min_by(open, day) AS open, max(high) AS high, min(low) AS low, max_by(close, day) AS close, sum(volume) AS volume, round(sum(amount), 2) AS amount, count(*) AS n_days
          FROM day_bars CROSS JOIN (VALUES {periods}) AS p(p) GROUP BY code, p.p, cast(date_trunc(p.p, day) AS date)""",
        period_index="SELECT m.index_code, period, ts, sum(volume) AS volume, round(sum(amount), 2) AS amount FROM period_bars b JOIN master m ON m.code = b.code GROUP BY m.index_code, period, ts",
        period_pairs="SELECT b.code, b.period, b.ts, b.volume AS sv, b.amount AS sa, i.volume AS mv, i.amount AS ma FROM period_bars b JOIN master m ON m.code = b.code JOIN period_index i ON i.index_code = m.index_code AND i.period = b.period AND i.ts = b.ts",
        period_states=f"SELECT code, period, ts, {', '.join(whole(x) for x in ('sv', 'sa', 'mv', 'ma'))} FROM period_pairs WINDOW w AS (PARTITION BY code, period)",
        period_steps=f"SELECT code, period, ts, sv, sa, mv, ma, {', '.join(step(x) for x in ('sv', 'sa', 'mv', 'ma'))} FROM period_states",
        period_sums=f"""SELECT code, period, count(*) AS n, {both(ds, dm)} AS ab, {both(dm, dm)} AS bb, {both(ds, ds)} AS aa, {both(s, s)} AS g11, {both(s, m)} AS g12, {both(m, m)} AS g22, {both(s, ds)} AS sa_, {both(s, dm)} AS sb_, {both(m, ds)} AS ma_, {both(m, dm)} AS mb_
          FROM period_steps WHERE d_sv IS NOT NULL GROUP BY code, period""",
        period_targets="SELECT *, beta * sb_ - sa_ AS p1, beta * mb_ - ma_ AS p2, aa - 2 * beta * ab + beta * beta * bb AS yy, g11 * g22 - g12 * g12 AS det FROM (SELECT *, CASE WHEN bb > 1e-12 THEN ab / bb ELSE 1e0 END AS beta FROM period_sums) x",
        period_fits="""SELECT code, period, n, beta, k, c, (yy - k * p1 - c * p2) / (2 * n) AS f2, sqrt(greatest(k * k - c * c, 0)) AS omega FROM (
            SELECT *, CASE WHEN det > 1e-10 * g11 * g22 THEN (p1 * g22 - p2 * g12) / det END AS k, CASE WHEN det > 1e-10 * g11 * g22 THEN (g11 * p2 - g12 * p1) / det END AS c FROM period_targets) x""",
        period_returns=f"SELECT code, period, ts, close / nullif(lag(close, {BACK}) OVER w, 0) - 1 AS momentum, close / nullif(avg(close) OVER (PARTITION BY code, period ORDER BY ts ROWS BETWEEN {BACK - 1} PRECEDING AND CURRENT ROW), 0) - 1 AS gap, {', '.join(f'lead(close, {h}) OVER w / nullif(close, 0) - 1 AS y{h}' for h in HORIZONS)} FROM period_bars WINDOW w AS (PARTITION BY code, period ORDER BY ts)",
        # each factor and each horizon is ranked once a date; only ranks are multiplied
        period_observed=f"SELECT code, period, ts, f.f AS factor, h.h, CASE f.f WHEN 'momentum' THEN momentum ELSE gap END AS x, CASE h.h {' '.join(f'WHEN {h} THEN y{h}' for h in HORIZONS)} END AS y FROM period_returns CROSS JOIN (VALUES ('momentum'), ('gap')) AS f(f) CROSS JOIN (VALUES {', '.join(f'({h})' for h in HORIZONS)}) AS h(h)",
        period_ic=f"SELECT period, factor, h, ts, {correlation('a', 'b')} AS ic FROM (SELECT period, factor, h, ts, {average_rank('round(x, 10)', 'period, factor, h, ts')} AS a, {average_rank('round(y, 10)', 'period, factor, h, ts')} AS b FROM period_observed WHERE x IS NOT NULL AND y IS NOT NULL) r GROUP BY period, factor, h, ts HAVING count(*) >= {LEAST}",
        period_metrics="SELECT period, factor, h, count(ic) AS n_dates, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir FROM period_ic GROUP BY period, factor, h",
    )
    flow.store("day_bars", "period_bars")
    unit = lambda x: f"if(max({x}) OVER w - min({x}) OVER w > 1e-12, ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w), 0) AS {x}"
    bars = """d AS (SELECT code, l_shipdate, px, l_quantity, l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o FROM lines),
        pb AS (SELECT code, period, date_trunc(period, l_shipdate)::DATE AS ts, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount, count(DISTINCT l_shipdate) AS n_days FROM d, (SELECT unnest(['week', 'month']) AS period) GROUP BY ALL)"""
    fits = f"""{bars}, pi AS (SELECT index_code, period, ts, sum(volume) AS volume, round(sum(amount), 2) AS amount FROM pb JOIN master USING (code) GROUP BY ALL),
        u AS (SELECT code, period, ts, {", ".join(unit(x) for x in ("sv", "sa", "mv", "ma"))} FROM (SELECT pb.code, pb.period, pb.ts, pb.volume AS sv, pb.amount AS sa, pi.volume AS mv, pi.amount AS ma FROM pb JOIN master USING (code) JOIN pi USING (index_code, period, ts)) WINDOW w AS (PARTITION BY code, period)),
        e AS (SELECT code, period, s, m, lead(s) OVER w - s AS a, lead(m) OVER w - m AS b FROM (SELECT code, period, ts, 'v' AS part, sv AS s, mv AS m FROM u UNION ALL SELECT code, period, ts, 'a', sa, ma FROM u) WINDOW w AS (PARTITION BY code, period, part ORDER BY ts) QUALIFY a IS NOT NULL),
        bt AS (SELECT code, period, if(sum(b * b) > 1e-12, sum(a * b) / sum(b * b), 1) AS beta FROM e GROUP BY ALL), y AS (SELECT e.*, beta, a - beta * b AS y FROM e JOIN bt USING (code, period)),
        th AS (SELECT code, period, count(*) / 2 AS n, any_value(beta) AS beta, if(sum(s * s) * sum(m * m) - sum(s * m) ** 2 > 1e-10 * sum(s * s) * sum(m * m), sum(s * s) * sum(m * m) - sum(s * m) ** 2, NULL) AS det, (sum(m * y) * sum(s * m) - sum(s * y) * sum(m * m)) / det AS k, (sum(s * y) * sum(s * m) - sum(m * y) * sum(s * s)) / det AS c FROM y GROUP BY ALL),
        ft AS (SELECT th.code, th.period, any_value(n)::BIGINT AS n, any_value(th.beta) AS beta, any_value(k) AS k, any_value(c) AS c, avg((y + k * s + c * m) ** 2) AS f2, sqrt(greatest(any_value(k) ** 2 - any_value(c) ** 2, 0)) AS omega FROM th JOIN y USING (code, period) GROUP BY ALL)"""
    fit = "round(beta, 6) + 0e0 AS beta, round(k, 6) + 0e0 AS k, round(c, 6) + 0e0 AS c, round(f2, 8) + 0e0 AS f2, round(CASE WHEN omega > 1e-6 THEN omega ELSE 0 END, 5) AS omega"
    two = lambda t: f"""SELECT coalesce(w.code, m.code) AS code, round(w.k, 6) + 0e0 AS k_week, round(m.k, 6) + 0e0 AS k_month, round(w.c, 6) + 0e0 AS c_week, round(m.c, 6) + 0e0 AS c_month, round(w.f2 / nullif(m.f2, 0), 5) AS f2_ratio, CASE WHEN w.code IS NULL THEN 'month' WHEN m.code IS NULL THEN 'week' ELSE 'both' END AS found
        FROM (SELECT * FROM {t} WHERE period = 'week' AND n >= 20) w FULL OUTER JOIN (SELECT * FROM {t} WHERE period = 'month' AND n >= 20) m ON w.code = m.code"""  # noqa: E731
    compare = lambda t: f"SELECT w.factor, w.h AS horizon, w.n_dates AS n_week, m.n_dates AS n_month, round(w.ic_mean, 6) AS ic_week, round(m.ic_mean, 6) AS ic_month, round(m.ic_mean - w.ic_mean, 6) AS delta_ic, round(m.ic_ir - w.ic_ir, 5) AS delta_ic_ir FROM {t} w JOIN {t} m ON w.factor = m.factor AND w.h = m.h WHERE w.period = 'week' AND m.period = 'month'"
    flow.pair(
        period_bars_all=(
            "SELECT code, period, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount, n_days FROM period_bars",
            f"WITH {bars} SELECT code, period, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount, n_days FROM pb WHERE code IN (SELECT code FROM lines)",
        ),
        granularity_fits=(f"SELECT code, period, n, {fit} FROM period_fits", f"WITH {fits} SELECT code, period, n, {fit} FROM ft WHERE code IN (SELECT code FROM master JOIN lines USING (code))"),
        granularity_topology=(two("period_fits"), f"WITH {fits} SELECT * FROM ({two('ft')}) WHERE code IN (SELECT code FROM master JOIN lines USING (code))"),
        granularity_metrics=(
            compare("period_metrics"),
            f"""WITH {bars}, q AS (SELECT code, period, list({{'t': ts, 'c': close}} ORDER BY ts) AS l FROM pb GROUP BY ALL), r AS (SELECT code, period, i, l[i].t AS ts, l, l[i].c AS c FROM (SELECT code, period, l, unnest(range(1, len(l) + 1)) AS i FROM q)),
                o AS (SELECT period, ts, code, factor, h, if(factor = 'momentum', if(i > {BACK}, c / l[i - {BACK}].c - 1, NULL), c / list_avg([z.c FOR z IN l[greatest(1, i - {BACK - 1}):i]]) - 1) AS x, l[i + h].c / c - 1 AS y FROM r, (SELECT unnest(['momentum', 'gap']) AS factor), (SELECT unnest({list(HORIZONS)}) AS h)),
                k AS (SELECT period, factor, h, ts, rank() OVER (PARTITION BY period, factor, h, ts ORDER BY round(x, 10)) + (count(*) OVER (PARTITION BY period, factor, h, ts, round(x, 10)) - 1) / 2 AS a, rank() OVER (PARTITION BY period, factor, h, ts ORDER BY round(y, 10)) + (count(*) OVER (PARTITION BY period, factor, h, ts, round(y, 10)) - 1) / 2 AS b FROM o WHERE x IS NOT NULL AND y IS NOT NULL),
                me AS (SELECT period, factor, h, count(ic) AS n_dates, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir FROM (SELECT period, factor, h, ts, if(isnan(corr(a, b)), NULL, corr(a, b)) AS ic FROM k GROUP BY ALL HAVING count(*) >= {LEAST}) GROUP BY ALL)
              SELECT * FROM ({compare('me')}) WHERE EXISTS (SELECT 1 FROM lines)""",
        ),
    )
