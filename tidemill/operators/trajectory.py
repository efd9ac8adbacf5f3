"""Motion of a pair forward in time: forecasts of its drivers, simulation, one-step predictions.

A simulation is a fold over its few steps, in the JVM. Energies split a move along the
benchmark's and across it, so they add up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import ROWS
from tidemill.plans.flow import Flow

STEPS, WINDOW, LEAST = 5, 10, 10
#: Unit of the figures of a simulation: moves are of some millions.
UNIT = 1e3


def add(flow: Flow) -> None:
    flow.step(
        own_force=f"SELECT code, ts, sx, sy, mx, my, beta, dx, dy, ux, uy, (ax - beta * bx + 0.1 * dx + 0.2 * ux) / {UNIT} AS fx, (ay - beta * by_ + 0.1 * dy + 0.2 * uy) / {UNIT} AS fy, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back FROM displaced",
        own_valid="SELECT code, ts, fx, fy, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS nth, count(*) OVER (PARTITION BY code) AS n, avg(fx) OVER (PARTITION BY code) AS mx, avg(fy) OVER (PARTITION BY code) AS my FROM own_force WHERE fx IS NOT NULL AND fy IS NOT NULL",
        own_pairs=f"""SELECT code, fx - mx AS x, fy - my AS y, lag(fx - mx) OVER ({ROWS}) AS px, lag(fy - my) OVER ({ROWS}) AS py FROM own_valid""",
        own_rho="""SELECT code, greatest(-1.0, least(1.0, coalesce(sum(x * px) / nullif(sum(px * px), 0), 0))) AS rho_x, greatest(-1.0, least(1.0, coalesce(sum(y * py) / nullif(sum(py * py), 0), 0))) AS rho_y FROM own_pairs WHERE px IS NOT NULL GROUP BY code""",
        predictors=f"""SELECT v.code, count(*) AS n, avg(CASE WHEN nth <= {WINDOW} THEN fx END) AS roll_x, avg(CASE WHEN nth <= {WINDOW} THEN fy END) AS roll_y, max(CASE WHEN nth = 1 THEN fx END) AS last_x, max(CASE WHEN nth = 1 THEN fy END) AS last_y, max(mx) AS mean_x, max(my) AS mean_y,
            max(CASE WHEN v.n < {LEAST} THEN 0e0 ELSE coalesce(r.rho_x, 0e0) END) AS rho_x, max(CASE WHEN v.n < {LEAST} THEN 0e0 ELSE coalesce(r.rho_y, 0e0) END) AS rho_y FROM own_valid v LEFT JOIN own_rho r ON r.code = v.code GROUP BY v.code""",
        starts="SELECT f.code, f.ts, k, c, sx / 1e3 AS sx, sy / 1e3 AS sy, mx / 1e3 AS mx, my / 1e3 AS my, beta, dx / 1e3 AS dx, dy / 1e3 AS dy FROM own_force f JOIN kc ON kc.code = f.code WHERE back = 1 AND status LIKE 'ok%'",
        driven_starts=f"""SELECT s.*, p.roll_x AS fx, p.roll_y AS fy FROM starts s JOIN predictors p ON p.code = s.code""",
        one_step=f"""SELECT d.code, d.ts, d.sx / 1e3 AS sx, d.sy / 1e3 AS sy, (d.sx + d.ax) / 1e3 AS nx, (d.sy + d.ay) / 1e3 AS ny, (d.beta * d.bx - k.k * d.dx - k.c * d.ux) / 1e3 AS gx, (d.beta * d.by_ - k.k * d.dy - k.c * d.uy) / 1e3 AS gy FROM displaced d JOIN kc k ON k.code = d.code WHERE d.ax IS NOT NULL AND k.k IS NOT NULL""",
        aligned=f"""SELECT code, ts, nx, ny, q, state, next_state, CASE WHEN ord > {WINDOW} THEN hx ELSE 0e0 END AS hx, CASE WHEN ord > {WINDOW} THEN hy ELSE 0e0 END AS hy, gx, gy, ord FROM (
            SELECT o.code, o.ts, o.nx, o.ny, d.q, s.state, lead(s.state) OVER (PARTITION BY o.code ORDER BY o.ts) AS next_state, o.gx, o.gy, avg(o.sx) OVER w AS hx, avg(o.sy) OVER w AS hy, row_number() OVER (PARTITION BY o.code ORDER BY o.ts) AS ord
            FROM one_step o JOIN damped d ON d.code = o.code AND d.ts = o.ts JOIN states s ON s.code = o.code AND s.ts = o.ts WINDOW w AS (PARTITION BY o.code ORDER BY o.ts ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)) x""",
    )
    label = lambda m: f"CASE WHEN {m} < 0.005 THEN 'none' WHEN {m} < 0.05 THEN 'follow' ELSE 'accelerating' END"
    flow.pair(
        self_force_predictors=(
            "SELECT code, n, round(roll_x, 5) AS rolling_x, round(roll_y, 4) AS rolling_y, round(last_x, 5) AS constant_x, round(last_y, 4) AS constant_y, round(mean_x, 5) AS mean_x, round(mean_y, 4) AS mean_y, round(rho_x, 6) AS rho_x, round(rho_y, 6) AS rho_y FROM predictors",
            f"""WITH l AS (SELECT code, list({{'x': fx, 'y': fy}} ORDER BY ts) AS l FROM own_force WHERE fx IS NOT NULL AND fy IS NOT NULL GROUP BY code), c AS (SELECT code, l, [z.x - list_avg([w.x FOR w IN l]) FOR z IN l] AS x, [z.y - list_avg([w.y FOR w IN l]) FOR z IN l] AS y FROM l)
              SELECT code, len(l) AS n, round(list_avg([z.x FOR z IN l[-{WINDOW}:]]), 5) AS rolling_x, round(list_avg([z.y FOR z IN l[-{WINDOW}:]]), 4) AS rolling_y, round(l[-1].x, 5) AS constant_x, round(l[-1].y, 4) AS constant_y, round(list_avg([z.x FOR z IN l]), 5) AS mean_x, round(list_avg([z.y FOR z IN l]), 4) AS mean_y,
                round(if(len(l) < {LEAST}, 0, greatest(-1, least(1, coalesce(list_dot_product(x[:-2], x[2:]) / nullif(list_dot_product(x[:-2], x[:-2]), 0), 0)))), 6) AS rho_x, round(if(len(l) < {LEAST}, 0, greatest(-1, least(1, coalesce(list_dot_product(y[:-2], y[2:]) / nullif(list_dot_product(y[:-2], y[:-2]), 0), 0)))), 6) AS rho_y FROM c""",
        ),
        self_force_ar1=(
            f"SELECT code, t.t AS step, round(mean_x + pow(rho_x, t.t) * (last_x - mean_x), 5) + 0e0 AS fx, round(mean_y + pow(rho_y, t.t) * (last_y - mean_y), 4) + 0e0 AS fy FROM predictors CROSS JOIN (SELECT explode(sequence(0, {STEPS})) AS t) t",
            f"""WITH RECURSIVE r AS (SELECT code, 0 AS step, last_x AS fx, last_y AS fy, mean_x, mean_y, rho_x, rho_y FROM predictors UNION ALL SELECT code, step + 1, mean_x + rho_x * (fx - mean_x), mean_y + rho_y * (fy - mean_y), mean_x, mean_y, rho_x, rho_y FROM r WHERE step < {STEPS})
              SELECT code, step, round(fx, 5) + 0 AS fx, round(fy, 4) + 0 AS fy FROM r""",
        ),
        driver_forecasts=(
            f"""SELECT code, t.t AS step, round(mx, 6) AS m_last_x, round(my, 6) AS m_last_y, round(beta, 6) AS beta_last, round(beta_10, 6) AS beta_mean, CASE WHEN t.t < {STEPS} THEN round(q, 6) END AS q_last FROM (
                SELECT f.code, f.mx / 1e3 AS mx, f.my / 1e3 AS my, f.beta, d.q, f.back, avg(f.beta) OVER (PARTITION BY f.code ORDER BY f.ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS beta_10 FROM own_force f JOIN damped d ON d.code = f.code AND d.ts = f.ts) x CROSS JOIN (SELECT explode(sequence(0, {STEPS})) AS t) t WHERE back = 1""",
            f"""WITH l AS (SELECT f.code, arg_max(f.mx, f.ts) / 1e3 AS mx, arg_max(f.my, f.ts) / 1e3 AS my, arg_max(f.beta, f.ts) AS b, list_avg(list(f.beta ORDER BY f.ts)[-10:]) AS m, arg_max(d.q, d.ts) AS q FROM own_force f JOIN damped d USING (code, ts) GROUP BY f.code)
              SELECT code, unnest(range(0, {STEPS + 1})) AS step, round(mx, 6) AS m_last_x, round(my, 6) AS m_last_y, round(b, 6) AS beta_last, round(m, 6) AS beta_mean, if(step < {STEPS}, round(q, 6), NULL) AS q_last FROM l""",
        ),
        ode_prediction=(
            """SELECT code, ts, round(sx + gx, 4) + 0e0 AS pred_x, round(sy + gy, 3) + 0e0 AS pred_y, round(nx, 6) + 0e0 AS actual_x, round(ny, 6) + 0e0 AS actual_y, round(cosine, 6) + 0e0 AS cosine, CASE WHEN cosine > 0 THEN 1 ELSE 0 END AS dir_match, round(err, 3) AS err FROM (
                SELECT *, ((sx + gx) * nx + (sy + gy) * ny) / (sqrt((sx + gx) * (sx + gx) + (sy + gy) * (sy + gy)) * sqrt(nx * nx + ny * ny) + 1e-30) AS cosine, sqrt((sx + gx - nx) * (sx + gx - nx) + (sy + gy - ny) * (sy + gy - ny)) AS err FROM one_step) x""",
            """SELECT code, ts, round(p[1], 4) + 0 AS pred_x, round(p[2], 3) + 0 AS pred_y, round(a[1], 6) + 0 AS actual_x, round(a[2], 6) + 0 AS actual_y, round(list_dot_product(p, a) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(a, a)) + 1e-30), 6) + 0 AS cosine, (list_dot_product(p, a) > 0)::INT AS dir_match,
                round(list_distance(p, a), 3) AS err FROM (SELECT code, ts, [sx + gx, sy + gy] AS p, [nx, ny] AS a FROM one_step)""",
        ),
        ode_prediction_summary=(
            """SELECT code, count(*) AS n_valid, round(avg(CASE WHEN (sx + gx) * nx + (sy + gy) * ny > 0 THEN 1e0 ELSE 0e0 END), 6) AS dir_hit_rate, round(sqrt(avg(pow(sx + gx - nx, 2) + pow(sy + gy - ny, 2))), 3) AS rmse, round(avg(sqrt(pow(sx + gx - nx, 2) + pow(sy + gy - ny, 2))), 3) AS mean_err FROM one_step GROUP BY code""",
            """WITH z AS (SELECT code, list_distance([sx + gx, sy + gy], [nx, ny]) AS e, list_dot_product([sx + gx, sy + gy], [nx, ny]) AS d FROM one_step) SELECT code, count(*) AS n_valid, round(count(*) FILTER (WHERE d > 0)::DOUBLE / count(*), 6) AS dir_hit_rate, round(sqrt(sum(e * e) / count(*)), 3) AS rmse, round(avg(e), 3) AS mean_err FROM z GROUP BY code""",
        ),
        oos_alignment=(
            f"""SELECT code, ts, {label('sqrt(ax * ax + ay * ay)')} AS state_pred, next_state AS state_actual, round(ax, 4) + 0e0 AS a_pred_x, round(ay, 3) + 0e0 AS a_pred_y FROM (SELECT *, gx + hx AS ax, gy + hy AS ay FROM aligned) x WHERE next_state IS NOT NULL""",
            f"""WITH o AS (SELECT code, ts, sx, sy, gx, gy, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM one_step), h AS (SELECT a.code, a.ts, any_value(a.gx) + if(any_value(a.i) > {WINDOW}, avg(b.sx), 0) AS ax, any_value(a.gy) + if(any_value(a.i) > {WINDOW}, avg(b.sy), 0) AS ay FROM o a LEFT JOIN o b ON a.code = b.code AND b.i BETWEEN a.i - {WINDOW} AND a.i - 1 GROUP BY a.code, a.ts),
                n AS (SELECT a.code, a.ts, b.state FROM (SELECT code, ts, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM one_step) a JOIN (SELECT o.code, s.state, row_number() OVER (PARTITION BY o.code ORDER BY o.ts) AS i FROM one_step o JOIN states s USING (code, ts)) b ON a.code = b.code AND b.i = a.i + 1)
              SELECT code, ts, ['none', 'follow', 'accelerating'][1 + (norm >= 0.005)::INT + (norm >= 0.05)::INT] AS state_pred, state AS state_actual, round(ax, 4) + 0e0 AS a_pred_x, round(ay, 3) + 0e0 AS a_pred_y FROM (SELECT *, sqrt(ax ** 2 + ay ** 2) AS norm FROM h) JOIN n USING (code, ts)""",
        ),
        oos_metrics=(
            f"""SELECT code, count(*) AS n_oos, round(avg(CASE WHEN {label('p')} = next_state THEN 1e0 ELSE 0e0 END), 6) AS hit_rate, round(sqrt(avg((p - a) * (p - a))), 3) AS rmse, round(avg(abs(p - a)), 3) AS mae, round(avg(CASE WHEN signum(p) = signum(a) THEN 1e0 ELSE 0e0 END), 6) AS direction_accuracy FROM (
                SELECT code, next_state, sqrt(pow(gx + hx, 2) + pow(gy + hy, 2)) AS p, sqrt(nx * nx + ny * ny) AS a FROM aligned WHERE next_state IS NOT NULL) x GROUP BY code""",
            f"""WITH z AS (SELECT code, next_state, list_distance([gx + hx, gy + hy], [0, 0]) AS p, list_distance([nx, ny], [0, 0]) AS a FROM aligned WHERE next_state IS NOT NULL)
              SELECT code, count(*) AS n_oos, round(count(*) FILTER (WHERE next_state = ['none', 'follow', 'accelerating'][1 + (p >= 0.005)::INT + (p >= 0.05)::INT])::DOUBLE / count(*), 6) AS hit_rate, round(sqrt(sum((p - a) ** 2) / count(*)), 3) AS rmse, round(avg(abs(p - a)), 3) AS mae, round(count(*) FILTER (WHERE (p > 0) = (a > 0))::DOUBLE / count(*), 6) AS direction_accuracy FROM z GROUP BY code""",
        ),
        one_step_self_force=(
            f"""SELECT code, count(*) AS n, round(sqrt(avg(pow(sx + gx + coalesce(rx, 0) - nx, 2) + pow(sy + gy + coalesce(ry, 0) - ny, 2))), 3) AS rmse, round(avg(CASE WHEN (gx + coalesce(rx, 0)) * (nx - sx) + (gy + coalesce(ry, 0)) * (ny - sy) > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM (
                SELECT *, avg(nx - sx - gx) OVER w AS rx, avg(ny - sy - gy) OVER w AS ry FROM one_step WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)) x GROUP BY code""",
            f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS i FROM one_step), r AS (SELECT a.code, a.i, any_value(a.gx) AS gx, any_value(a.gy) AS gy, any_value(a.sx) AS sx, any_value(a.sy) AS sy, any_value(a.nx) AS nx, any_value(a.ny) AS ny, coalesce(avg(b.nx - b.sx - b.gx), 0) AS rx, coalesce(avg(b.ny - b.sy - b.gy), 0) AS ry
                FROM o a LEFT JOIN o b ON a.code = b.code AND b.i BETWEEN a.i - {WINDOW} AND a.i - 1 GROUP BY a.code, a.i)
              SELECT code, count(*) AS n, round(sqrt(avg((sx + gx + rx - nx) ** 2 + (sy + gy + ry - ny) ** 2)), 3) AS rmse, round(count(*) FILTER (WHERE (gx + rx) * (nx - sx) + (gy + ry) * (ny - sy) > 0)::DOUBLE / count(*), 6) AS hit_rate FROM r GROUP BY code""",
        ),
    )


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def trajectory(flow: Flow, steps: int = STEPS) -> Callable[[SparkSession, str], DataFrame]:
    """Motion of each fitted pair from its last bar: the benchmark's move and beta stay, the own force is its mean.

    One row a code and step, the start included: move, displacement, slip, energies along
    and across the benchmark's move, their error, residual share, angle, force sizes, state.
    """
    start = flow.run("SELECT * FROM driven_starts")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = F.col
        names = ("step", "vx", "vy", "dx", "dy", "ux", "uy")
        first = F.struct(F.lit(0).alias("step"), c("sx").alias("vx"), c("sy").alias("vy"), c("dx"), c("dy"), (c("sx") - c("beta") * c("mx")).alias("ux"), (c("sy") - c("beta") * c("my")).alias("uy"))

        def step(done: Column, t: Column) -> Column:
            now = F.element_at(done, -1)
            vx = now["vx"] - c("k") * now["dx"] - c("c") * now["ux"] + c("fx")
            vy = now["vy"] - c("k") * now["dy"] - c("c") * now["uy"] + c("fy")
            made = (t, vx, vy, now["dx"] + now["ux"], now["dy"] + now["uy"], vx - c("beta") * c("mx"), vy - c("beta") * c("my"))
            return F.concat(done, F.array(F.struct(*(x.alias(n) for n, x in zip(names, made, strict=True)))))

        rows = start(spark, sf_dir)
        moved = rows.select("code", "k", "c", "mx", "my", "fx", "fy", F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(first), step)))
        market = _square(c("mx"), c("my"))
        along = (c("vx") * c("mx") + c("vy") * c("my")) / F.nullif(market, F.lit(0.0))
        total = 0.5 * _square(c("vx"), c("vy"))
        energy = moved.withColumn("e_total", total).withColumn("e_market", 0.5 * along * along * market)
        energy = energy.withColumn("e_self", 0.5 * _square(c("vx") - along * c("mx"), c("vy") - along * c("my")))
        cosine = (c("vx") * c("mx") + c("vy") * c("my")) / F.nullif(F.sqrt(2 * c("e_total")) * F.sqrt(market), F.lit(0.0))
        energy = energy.withColumn("r", F.coalesce(c("e_self") / F.nullif(c("e_total"), F.lit(0.0)), F.lit(0.0))).withColumn("theta", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
        state = F.when(c("theta").isNull(), "none").when(c("theta") >= F.pi() / 2, "against").when((c("r") >= 0.5) & (c("theta") < F.pi() / 6), "resonance").when(c("r") >= 0.5, "independent").when(c("r") >= 0.1, "weak_div").when(c("theta") < F.pi() / 6, "follow").otherwise("none")
        balanced = F.abs(c("e_total") - c("e_market") - c("e_self")) <= 1e-9 * F.greatest(c("e_total"), F.lit(1e-12))
        return energy.select(
            "code", "step", (F.round("vx", 3) + 0.0).alias("vx"), (F.round("vy", 2) + 0.0).alias("vy"), (F.round("dx", 3) + 0.0).alias("dx"), (F.round("dy", 2) + 0.0).alias("dy"), F.round(F.sqrt(2 * c("e_total")), 2).alias("speed"), F.round(F.sqrt(2 * c("e_market")), 2).alias("along"), F.round(F.sqrt(2 * c("e_self")), 2).alias("across"),
            F.round("r", 6).alias("r"), F.round("theta", 5).alias("theta"), F.round(F.abs(c("k")) * F.sqrt(_square(c("dx"), c("dy"))), 2).alias("f_restore"), F.round(F.abs(c("c")) * F.sqrt(_square(c("ux"), c("uy"))), 2).alias("f_damp"), F.round(F.sqrt(_square(c("fx"), c("fy"))), 3).alias("f_self"), balanced.alias("balanced"), state.alias("state"),
        )

    return query


TRAJECTORY_SQL = f"""
, m AS (SELECT code, k, c, mx, my, beta, fx, fy, 0 AS step, sx AS vx, sy AS vy, dx, dy FROM driven_starts
  UNION ALL SELECT code, k, c, mx, my, beta, fx, fy, step + 1, vx - k * dx - c * (vx - beta * mx) + fx, vy - k * dy - c * (vy - beta * my) + fy, dx + vx - beta * mx, dy + vy - beta * my FROM m WHERE step < {STEPS}),
w AS (SELECT *, sqrt(vx ** 2 + vy ** 2) AS v, abs(vx * mx + vy * my) / nullif(sqrt(mx ** 2 + my ** 2), 0) AS g, abs(vx * my - vy * mx) / nullif(sqrt(mx ** 2 + my ** 2), 0) AS x FROM m),
s AS (SELECT *, coalesce(x ** 2 / nullif(v ** 2, 0), 0) AS r, acos(greatest(-1, least(1, (vx * mx + vy * my) / nullif(v * sqrt(mx ** 2 + my ** 2), 0)))) AS t FROM w)
SELECT code, step, round(vx, 3) + 0 AS vx, round(vy, 2) + 0 AS vy, round(dx, 3) + 0 AS dx, round(dy, 2) + 0 AS dy, round(v, 2) AS speed, round(g, 2) AS along, round(x, 2) AS across, round(r, 6) AS r, round(t, 5) AS theta, round(abs(k) * sqrt(dx ** 2 + dy ** 2), 2) AS f_restore,
  round(abs(c) * sqrt((vx - beta * mx) ** 2 + (vy - beta * my) ** 2), 2) AS f_damp, round(sqrt(fx ** 2 + fy ** 2), 3) AS f_self, true AS balanced,
  CASE WHEN t IS NULL THEN 'none' WHEN t >= pi() / 2 THEN 'against' WHEN r >= 0.5 AND t < pi() / 6 THEN 'resonance' WHEN r >= 0.5 THEN 'independent' WHEN r >= 0.1 THEN 'weak_div' WHEN t < pi() / 6 THEN 'follow' ELSE 'none' END AS state FROM s
"""


def random_walk(flow: Flow, steps: int = STEPS, seed: int = 42) -> Callable[[SparkSession, str], DataFrame]:
    """The benchmark's move of each pair, carried on by a random walk of its own changes' spread.

    Every code draws from a generator of its own, seeded by ``seed`` and the code, so
    results do not depend on partitioning.
    """
    last = flow.run("SELECT code, max(CASE WHEN back = 1 THEN mx END) AS mx, max(CASE WHEN back = 1 THEN my END) AS my, stddev_pop(gx) AS wx, stddev_pop(gy) AS wy FROM (SELECT code, back, mx, my, mx - lag(mx) OVER (PARTITION BY code ORDER BY ts) AS gx, my - lag(my) OVER (PARTITION BY code ORDER BY ts) AS gy FROM own_force) x GROUP BY code")

    def walk(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                noise = np.random.default_rng([seed, int(r.code)]).normal(size=(steps, 2)) * np.nan_to_num([r.wx, r.wy])
                path = np.vstack([[r.mx, r.my], [r.mx, r.my] + np.cumsum(noise, axis=0)])
                out.append(pd.DataFrame({"code": r.code, "step": np.arange(steps + 1, dtype=np.int32), "mx": path[:, 0], "my": path[:, 1]}))
            yield pd.concat(out) if out else pd.DataFrame({"code": [], "step": [], "mx": [], "my": []})

    return lambda spark, sf_dir: last(spark, sf_dir).mapInPandas(walk, "code long, step int, mx double, my double")


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    head = flow.duckdb("SELECT 1 FROM driven_starts")
    head = head[: head.rindex(" SELECT 1 FROM")].replace("WITH ", "WITH RECURSIVE ", 1)
    return {"trajectory": trajectory(flow), "random_walk": random_walk(flow)}, {"trajectory": head + TRAJECTORY_SQL}
