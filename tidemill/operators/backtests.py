"""Back-tests of signals: probabilities to positions, trades with lots and fees, baskets, pools.

A position is the last signal that is not null (1 enters, 0 leaves), so trades come from
windows, without a loop over bars. Signals act on the next bar's open.
"""

from __future__ import annotations

from tidemill.functions.exprs import ROWS
from tidemill.operators.selection import fee
from tidemill.plans.flow import Flow

#: Money of an account, the part of it that a position takes, shares of a lot.
CASH, SHARE, LOT = 1_000_000, 0.95, 100
#: Strategies: name, probability to enter above and to leave below, whether the close must be above its average too.
STRATEGIES = (("p50", 0.50, 0.50, False), ("p55", 0.55, 0.50, False), ("p60", 0.60, 0.50, False), ("p55_ma5", 0.55, 0.50, True))
HOLD, TOP = 5, 5
#: Bars of a year, for figures by week.
YEAR = 52


def _trades(signals: str, keys: str) -> str:
    """Trades of ``signals`` (keys, code, ts, open, sig): changes of the last signal that is not null."""
    return f"""SELECT {keys}, code, ts AS entry_ts, open AS entry_price, exit_ts, exit_price, floor({CASH} * {SHARE} / open / {LOT}) * {LOT} AS size FROM (
        SELECT {keys}, code, ts, open, sig, lead(ts) OVER (PARTITION BY {keys}, code ORDER BY ts) AS exit_ts, lead(open) OVER (PARTITION BY {keys}, code ORDER BY ts) AS exit_price FROM (
          SELECT *, lag(sig) OVER (PARTITION BY {keys}, code ORDER BY ts) AS before FROM {signals} WHERE sig IS NOT NULL) a WHERE sig IS DISTINCT FROM before) b WHERE sig = 1 AND exit_ts IS NOT NULL AND open > 0"""


def _trades_duckdb(signals: str, keys: str) -> str:
    """The same trades: of the entries since an exit the first, with the next exit after it."""
    return f"""x AS (SELECT {keys}, code, ts, open FROM {signals} WHERE sig = 0),
        g AS (SELECT e.*, x.ts AS since FROM (SELECT * FROM {signals} WHERE sig = 1) e ASOF LEFT JOIN x ON {' AND '.join(f'e.{k.strip()} = x.{k.strip()}' for k in (keys + ', code').split(','))} AND e.ts >= x.ts),
        f AS (SELECT {keys}, code, min(ts) AS ts, arg_min(open, ts) AS open FROM g GROUP BY {keys}, code, since),
        t AS (SELECT {', '.join(f'f.{k.strip()}' for k in keys.split(','))}, f.code, f.ts AS entry_ts, f.open AS entry_price, x.ts AS exit_ts, x.open AS exit_price, trunc({CASH} * {SHARE} / f.open / {LOT}) * {LOT} AS size FROM f ASOF JOIN x ON {' AND '.join(f'f.{k.strip()} = x.{k.strip()}' for k in (keys + ', code').split(','))} AND f.ts < x.ts WHERE f.open > 0)"""


def _settled(trades: str) -> str:
    return f"""SELECT t.*, m.exchange, m.industry, (exit_price - entry_price) * size AS gross, {fee('entry_price * size', 'm.exchange', False)} + {fee('exit_price * size', 'm.exchange', True)} AS fees FROM {trades} t JOIN master m ON t.code = m.code WHERE size > 0"""


def add(flow: Flow) -> None:
    grid = ", ".join(f"('{n}', {a}, {b}, {str(c).lower()})" for n, a, b, c in STRATEGIES)
    flow.step(
        # a probability is known where its averages are: elsewhere the calendar of bars has a null
        proba=f"SELECT code, ts, 1 / (1 + exp(-10 * (close / nullif(ma_20, 0) - 1))) AS p_basic, 1 / (1 + exp(-6 * (close / nullif(ma_20, 0) - 1) - 4 * (close / nullif(ma_5, 0) - 1))) AS p_ma, close > ma_5 AS above FROM (SELECT *, row_number() OVER ({ROWS}) AS nth FROM averaged) x WHERE nth >= 20",
        proba_bars=f"SELECT b.code, b.ts, b.open, lag(p.p_basic) OVER (PARTITION BY b.code ORDER BY b.ts) AS p_basic, lag(p.p_ma) OVER (PARTITION BY b.code ORDER BY b.ts) AS p_ma, lag(p.above) OVER (PARTITION BY b.code ORDER BY b.ts) AS above FROM bars b LEFT JOIN proba p ON p.code = b.code AND p.ts = b.ts",
        grid_signals=f"""SELECT strategy, channel, code, ts, open, CASE WHEN p < exit_below THEN 0 WHEN p > entry_above AND (above OR NOT confirm) THEN 1 END AS sig FROM (
            SELECT s.strategy, c.channel, s.entry_above, s.exit_below, s.confirm, b.code, b.ts, b.open, b.above, CASE WHEN c.channel = 'ma' THEN b.p_ma ELSE b.p_basic END AS p FROM proba_bars b CROSS JOIN (VALUES {grid}) AS s(strategy, entry_above, exit_below, confirm) CROSS JOIN (VALUES ('basic'), ('ma')) AS c(channel)) x""",
        grid_trades=_trades("grid_signals", "strategy, channel"),
        grid_settled=_settled("grid_trades"),
        hold_signals=f"SELECT 'hold' AS rule, code, ts, open, CASE WHEN lag(entry, {HOLD}) OVER ({ROWS}) THEN 0 WHEN entry THEN 1 END AS sig FROM crossed",
        hold_trades=_trades("hold_signals", "rule"),
        hold_settled=_settled("hold_trades"),
        led=f"""SELECT code, ts, (coalesce(CASE WHEN n >= 20 THEN cov / nullif(sd_r * sd_i, 0) END, 0) + 1) / 2 * 0.4 + 0.6 / (1 + exp(-coalesce(CASE WHEN m >= 20 THEN (spread - spread_mean) / nullif(spread_sd, 0) END, 0))) AS raw FROM (
            SELECT code, ts, spread, count(r) OVER w AS n, covar_pop(r, ri) OVER w AS cov, stddev_pop(r) OVER w AS sd_r, stddev_pop(ri) OVER w AS sd_i, count(spread) OVER w AS m, avg(spread) OVER w AS spread_mean, stddev_samp(spread) OVER w AS spread_sd FROM (
              SELECT code, ts, close / nullif(lag(close, 5) OVER w, 0) - 1 AS r, ic / nullif(lag(ic, 5) OVER w, 0) - 1 AS ri, close / nullif(lag(close) OVER w, 0) - ic / nullif(lag(ic) OVER w, 0) AS spread FROM (
                SELECT b.code, b.ts, b.close, i.close AS ic FROM bars b JOIN master m ON b.code = m.code JOIN index_bars i ON i.index_code = m.index_code AND i.ts = b.ts) a WINDOW w AS (PARTITION BY code ORDER BY ts)) b
            WINDOW w AS (PARTITION BY code ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) c""",
        led_known=f"SELECT code, ts, coalesce(lag(raw) OVER ({ROWS}), 0.5) AS raw FROM led",
        led_ends="SELECT code, percentile(raw, 0.2) AS p20, percentile(raw, 0.8) AS p80 FROM led_known GROUP BY code",
        led_proba="SELECT k.code, k.ts, greatest(0.0, least(1.0, 0.3 + 0.5 * (k.raw - e.p20) / CASE WHEN e.p80 > e.p20 THEN e.p80 - e.p20 ELSE 1e-6 END)) AS p FROM led_known k JOIN led_ends e ON e.code = k.code",
        # codes that were in the best industry on some day of the rebalancing grid
        led_codes="""SELECT DISTINCT m.code FROM (SELECT ts, industry FROM (SELECT r.*, row_number() OVER (PARTITION BY r.ts ORDER BY round(ret, 10) DESC, industry) AS nth FROM industry_return_20 r JOIN rebalances d ON d.ts = r.ts AND d.day WHERE n >= 2) x WHERE nth = 1) t JOIN master m ON m.industry = t.industry""",
        led_signals=f"SELECT 'led' AS rule, code, ts, open, CASE WHEN p < 0.5 THEN 0 WHEN p > 0.55 THEN 1 END AS sig FROM (SELECT b.code, b.ts, b.open, lag(p.p) OVER (PARTITION BY b.code ORDER BY b.ts) AS p FROM bars b JOIN led_codes c ON c.code = b.code LEFT JOIN led_proba p ON p.code = b.code AND p.ts = b.ts) x",
        led_trades=_trades("led_signals", "rule"),
        led_settled=_settled("led_trades"),
        # picks of a rebalancing day act on the bar after it
        pool_next=f"SELECT code, ts, lead(open) OVER ({ROWS}) AS buy, lead(open, 6) OVER ({ROWS}) AS sell FROM bars",
        pool_returns=f"SELECT p.pool, p.ts, p.code, n.sell / nullif(n.buy, 0) - 1 - (2 * 0.000085 + 0.0005) AS net FROM pool_picks p JOIN pool_next n ON n.code = p.code AND n.ts = p.ts WHERE p.nth <= {TOP} AND n.sell IS NOT NULL AND n.buy > 0",
        weekly_weights="SELECT b.code, b.ts, b.close, CASE WHEN k.code IS NOT NULL THEN 0.1 ELSE 0.0 END AS weight FROM bars b JOIN month_order_of o ON o.month = cast(date_trunc('month', b.ts) AS date) LEFT JOIN picks k ON k.code = b.code AND k.month = o.before",
        month_order_of="SELECT month, lag(month) OVER (ORDER BY month) AS before FROM (SELECT DISTINCT month FROM picks) x",
        weekly_returns=f"SELECT ts, sum(r * weight) AS ret FROM (SELECT ts, weight, coalesce(close / nullif(lag(close) OVER ({ROWS}), 0) - 1, 0) AS r FROM weekly_weights) x GROUP BY ts",
        weekly_nav="SELECT ts, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS nav FROM weekly_returns WHERE ret > -1",
        state_baskets=f"SELECT state, ts, avg(r) AS ret, count(*) AS n FROM (SELECT s.state, b.ts, b.r FROM (SELECT code, ts, lead(close) OVER ({ROWS}) / nullif(close, 0) - 1 AS r FROM bars) b JOIN states s ON s.code = b.code AND s.ts = b.ts WHERE b.r IS NOT NULL) x GROUP BY state, ts",
        state_nav="SELECT state, ts, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY state ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS nav FROM state_baskets WHERE ret > -1",
        state_down="SELECT state, ret, nav, nav / max(nav) OVER (PARTITION BY state ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS down FROM state_nav",
    )
    columns = "code, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, cast(size AS bigint) AS size"
    summary = f"count(*) AS n, round(sum(gross), 2) AS gross, round(sum(fees), 2) AS fees, round(sum(gross - fees), 2) AS net, round(avg(CASE WHEN gross - fees > 0 THEN 1e0 ELSE 0e0 END), 8) AS win_rate, round(100 * sum(gross - fees) / {CASH}, 5) AS return_pct"
    paid = "(exit_price - entry_price) * size AS gross, size * (entry_price + exit_price) * (0.000085 + if(m.exchange = 'SH', 0.00001, 0)) + size * exit_price * 0.0005 AS fees"
    other = lambda keys: f"SELECT {keys}, count(*) AS n, round(sum(gross), 2) AS gross, round(sum(fees), 2) AS fees, round(sum(gross) - sum(fees), 2) AS net, round(count(*) FILTER (WHERE gross > fees)::DOUBLE / count(*), 8) AS win_rate, round(100 * (sum(gross) - sum(fees)) / {CASH}, 5) AS return_pct"
    flow.pair(
        signal_grid=(
            "SELECT strategy, channel, code, count_if(sig = 1) AS entries, count_if(sig = 0) AS exits FROM grid_signals GROUP BY strategy, channel, code",
            "WITH q AS (SELECT b.code, b.ts, p.p_basic, p.p_ma, p.above, row_number() OVER (PARTITION BY b.code ORDER BY b.ts) AS i FROM bars b LEFT JOIN proba p USING (code, ts)), s AS (SELECT a.code, unnest(['basic', 'ma']) AS channel, unnest([b.p_basic, b.p_ma]) AS p, b.above FROM q a LEFT JOIN q b ON a.code = b.code AND a.i = b.i + 1) "
            + " UNION ALL ".join(f"SELECT '{n}' AS strategy, channel, code, count(*) FILTER (WHERE p > {a} AND NOT p < {b}{' AND above' if c else ''}) AS entries, count(*) FILTER (WHERE p < {b}) AS exits FROM s GROUP BY ALL" for n, a, b, c in STRATEGIES),
        ),
        signal_trades=(f"SELECT strategy, channel, {columns} FROM grid_trades", f"WITH {_trades_duckdb('grid_signals', 'strategy, channel')} SELECT strategy, channel, code, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, size::BIGINT AS size FROM t"),
        signal_backtest=(
            f"SELECT strategy, channel, code, {summary} FROM grid_settled GROUP BY strategy, channel, code",
            f"WITH {_trades_duckdb('grid_signals', 'strategy, channel')}, y AS (SELECT t.*, {paid} FROM t JOIN master m USING (code) WHERE size > 0) {other('strategy, channel, code')} FROM y GROUP BY ALL",
        ),
        sector_sweep=(
            f"SELECT industry, strategy, channel, count(DISTINCT code) AS n_codes, {summary} FROM grid_settled GROUP BY industry, strategy, channel",
            f"WITH {_trades_duckdb('grid_signals', 'strategy, channel')}, y AS (SELECT t.*, m.industry, {paid} FROM t JOIN master m USING (code) WHERE size > 0) {other('industry, strategy, channel, count(DISTINCT code) AS n_codes')} FROM y GROUP BY industry, strategy, channel",
        ),
        ma_channel_gain=(
            f"""SELECT strategy, count(*) AS n, round(avg(CASE WHEN ma > basic THEN 1e0 ELSE 0e0 END), 6) AS wins_share, round(avg(ma - basic), 5) AS mean_pp, round(median(ma - basic), 5) AS median_pp FROM (SELECT strategy, code, sum(CASE WHEN channel = 'ma' THEN 100 * (gross - fees) / {CASH} ELSE 0 END) AS ma,
                sum(CASE WHEN channel = 'basic' THEN 100 * (gross - fees) / {CASH} ELSE 0 END) AS basic FROM grid_settled GROUP BY strategy, code) x GROUP BY strategy""",
            f"""WITH r AS (SELECT strategy, channel, code, 100 * sum(gross - fees) / {CASH} AS v FROM grid_settled GROUP BY ALL), p AS (SELECT strategy, code, coalesce(a.v, 0) AS ma, coalesce(b.v, 0) AS basic FROM (SELECT * FROM r WHERE channel = 'ma') a FULL JOIN (SELECT * FROM r WHERE channel = 'basic') b USING (strategy, code))
              SELECT strategy, count(*) AS n, round(count(*) FILTER (WHERE ma > basic)::DOUBLE / count(*), 6) AS wins_share, round(avg(ma - basic), 5) AS mean_pp, round(quantile_cont(ma - basic, 0.5), 5) AS median_pp FROM p GROUP BY ALL""",
        ),
        hold_backtest=(
            f"SELECT code, {summary} FROM hold_settled GROUP BY code",
            f"WITH {_trades_duckdb('hold_signals', 'rule')}, y AS (SELECT t.*, {paid} FROM t JOIN master m USING (code) WHERE size > 0) {other('code')} FROM y GROUP BY ALL",
        ),
        lead_lag_probability=(
            "SELECT code, ts, round(p, 6) AS p FROM led_proba",
            """WITH k AS (SELECT l.code, l.ts, coalesce(lag(raw) OVER (PARTITION BY l.code ORDER BY l.ts), 0.5) AS raw FROM led l), q AS (SELECT code, quantile_cont(raw, [0.2, 0.8]) AS e FROM k GROUP BY code)
              SELECT code, ts, round(list_max([0, list_min([1, 0.3 + 0.5 * (raw - e[1]) / greatest(e[2] - e[1], CASE WHEN e[2] > e[1] THEN 0 ELSE 1e-6 END)])]), 6) AS p FROM k JOIN q USING (code)""",
        ),
        lead_lag_backtest=(
            f"SELECT code, {summary} FROM led_settled GROUP BY code",
            f"WITH {_trades_duckdb('led_signals', 'rule')}, y AS (SELECT t.*, {paid} FROM t JOIN master m USING (code) WHERE size > 0) {other('code')} FROM y GROUP BY ALL",
        ),
        pool_rebalancing=(
            "SELECT pool, count(*) AS n, round(avg(net), 7) AS mean_net, round(median(net), 7) AS median_net, round(avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, count(DISTINCT ts) AS n_dates FROM pool_returns GROUP BY pool",
            f"""WITH l AS (SELECT code, list({{'t': ts, 'o': open}} ORDER BY ts) AS l FROM bars GROUP BY code), n AS (SELECT code, l[i].t AS ts, l[i + 1].o AS buy, l[i + 6].o AS sell FROM (SELECT code, l, unnest(range(1, len(l) + 1)) AS i FROM l)), r AS (SELECT p.pool, p.ts, n.sell / n.buy - 1.00067 AS net FROM pool_picks p JOIN n USING (code, ts) WHERE p.nth <= {TOP} AND n.sell IS NOT NULL AND n.buy > 0)
              SELECT pool, count(*) AS n, round(avg(net), 7) AS mean_net, round(quantile_cont(net, 0.5), 7) AS median_net, round(count(*) FILTER (WHERE net > 0)::DOUBLE / count(*), 6) AS win_rate, count(DISTINCT ts) AS n_dates FROM r GROUP BY ALL""",
        ),
        pool_audit=(
            "SELECT pool, code, n, round(mom, 6) AS mean_mom, CASE WHEN n >= 100 THEN 'core' WHEN n >= 30 THEN 'part' ELSE 'rare' END AS role FROM (SELECT pool, code, count(*) AS n, avg(mom) AS mom FROM pooled WHERE mom IS NOT NULL GROUP BY pool, code) x",
            "SELECT pool, code, count(*) AS n, round(sum(mom) / count(mom), 6) AS mean_mom, ['rare', 'part', 'core'][1 + (count(*) >= 30)::INT + (count(*) >= 100)::INT] AS role FROM pooled WHERE mom IS NOT NULL GROUP BY ALL",
        ),
        weight_changes=(
            """SELECT month, code, CASE WHEN weight > 0 AND coalesce(before, 0) = 0 THEN 'entry' WHEN weight = 0 AND before > 0 THEN 'exit' ELSE 'hold' END AS act FROM (SELECT month, code, weight, lag(weight) OVER (PARTITION BY code ORDER BY month) AS before FROM (
                SELECT o.month, c.code, CASE WHEN k.code IS NOT NULL THEN 0.1 ELSE 0.0 END AS weight FROM (SELECT DISTINCT month FROM picks) o CROSS JOIN (SELECT DISTINCT code FROM picks) c LEFT JOIN picks k ON k.code = c.code AND k.month = o.month) x) y WHERE weight > 0 OR before > 0""",
            """WITH o AS (SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM picks)), k AS (SELECT p.code, o.i FROM picks p JOIN o USING (month))
              SELECT o.month, u.code, CASE WHEN a.i IS NULL THEN 'exit' WHEN b.i IS NULL THEN 'entry' ELSE 'hold' END AS act FROM (SELECT code, i FROM k UNION SELECT code, i + 1 FROM k) u JOIN o ON o.i = u.i LEFT JOIN k a ON a.code = u.code AND a.i = u.i LEFT JOIN k b ON b.code = u.code AND b.i = u.i - 1""",
        ),
        weighted_nav=(
            f"SELECT ts, round(ret, 8) AS ret, round(nav, 6) AS nav, round(nav / max(nav) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM weekly_nav",
            """WITH l AS (SELECT list({'t': ts, 'r': ret} ORDER BY ts) AS l FROM weekly_returns WHERE ret > -1), n AS (SELECT l[i].t AS ts, l[i].r AS ret, list_product([1 + z.r FOR z IN l[1:i]]) AS nav FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM l))
              SELECT a.ts, round(any_value(a.ret), 8) AS ret, round(any_value(a.nav), 6) AS nav, round(any_value(a.nav) / max(b.nav) - 1, 6) AS drawdown FROM n a JOIN n b ON b.ts <= a.ts GROUP BY a.ts""",
        ),
        weighted_metrics=(
            f"""SELECT count(*) AS n, round(max_by(nav, ts) - 1, 6) AS total, round(pow(max_by(nav, ts), {YEAR}.0 / count(*)) - 1, 6) AS ann, round(stddev_samp(ret) * sqrt({YEAR}), 6) AS vol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({YEAR}), 5) AS sharpe, round(min(down), 6) AS max_drawdown FROM (
                SELECT ts, ret, nav, nav / max(nav) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS down FROM weekly_nav) x""",
            f"""WITH d AS (SELECT a.nav / max(b.nav) - 1 AS down FROM weekly_nav a JOIN weekly_nav b ON b.ts <= a.ts GROUP BY a.ts, a.nav) SELECT count(*) AS n, round(product(1 + ret) - 1, 6) AS total, round(product(1 + ret) ** ({YEAR}.0 / count(*)) - 1, 6) AS ann, round(sqrt(var_samp(ret) * {YEAR}), 6) AS vol,
                round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({YEAR}), 5) AS sharpe, (SELECT round(min(down), 6) FROM d) AS max_drawdown FROM weekly_returns WHERE ret > -1""",
        ),
        weighted_by_year=(
            "SELECT year(ts) AS y, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total FROM weekly_returns WHERE ret > -1 GROUP BY year(ts)",
            "SELECT date_part('year', ts) AS y, count(*) AS n, round(product(1 + ret) - 1, 6) AS total FROM weekly_returns WHERE ret > -1 GROUP BY ALL",
        ),
        equal_weight_states=(
            f"SELECT state, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({YEAR}), 5) AS sharpe, round(min(down), 6) AS max_drawdown FROM state_down GROUP BY state",
            f"""WITH d AS (SELECT a.state, a.nav / max(b.nav) - 1 AS down FROM state_nav a JOIN state_nav b ON a.state = b.state AND b.ts <= a.ts GROUP BY a.state, a.ts, a.nav), m AS (SELECT state, min(down) AS down FROM d GROUP BY ALL)
              SELECT s.state, count(*) AS n, round(product(1 + ret) - 1, 6) AS total, round(avg(ret) / nullif(sqrt(var_samp(ret)), 0) * sqrt({YEAR}), 5) AS sharpe, round(any_value(m.down), 6) AS max_drawdown FROM state_baskets s JOIN m USING (state) WHERE ret > -1 GROUP BY ALL""",
        ),
        equity_metrics=(
            """SELECT count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(pow(exp(sum(ln(1 + ret))), 12.0 / count(*)) - 1, 6) AS ann, round(stddev_samp(ret) * sqrt(12), 6) AS vol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 5) AS sharpe, round(min(down), 6) AS max_drawdown FROM (
                SELECT ret, nav / max(nav) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS down FROM nav) x""",
            """WITH d AS (SELECT a.nav / max(b.nav) - 1 AS down FROM nav a JOIN nav b ON b.month <= a.month GROUP BY a.month, a.nav) SELECT count(*) AS n, round(product(1 + ret) - 1, 6) AS total, round(product(1 + ret) ** (12.0 / count(*)) - 1, 6) AS ann, round(sqrt(12 * var_samp(ret)), 6) AS vol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12), 5) AS sharpe, (SELECT round(min(down), 6) FROM d) AS max_drawdown FROM portfolio WHERE ret > -1""",
        ),
        two_layer_ranking=(
            """SELECT code, nth, round(ret, 6) AS ret, round(alpha_index, 6) AS alpha_index, round(alpha_sector, 6) AS alpha_sector, row_number() OVER (ORDER BY round(alpha_sector, 8) DESC, code) AS nth_sector FROM (SELECT *, ret - sector AS alpha_sector, row_number() OVER (ORDER BY round(alpha_index, 8) DESC, code) AS nth FROM (SELECT r.code, r.ret, r.ret - x.ri AS alpha_index, s.sector FROM (
                SELECT code, max(CASE WHEN nth = 1 THEN close END) / max(CASE WHEN nth = 21 THEN close END) - 1 AS ret FROM (SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS nth FROM bars) a WHERE nth IN (1, 21) GROUP BY code) r JOIN master m ON m.code = r.code
              JOIN (SELECT index_code, max(CASE WHEN nth = 1 THEN close END) / max(CASE WHEN nth = 21 THEN close END) - 1 AS ri FROM (SELECT index_code, close, row_number() OVER (PARTITION BY index_code ORDER BY ts DESC) AS nth FROM index_bars) b WHERE nth IN (1, 21) GROUP BY index_code) x ON x.index_code = m.index_code
              CROSS JOIN (SELECT max(CASE WHEN nth = 1 THEN med END) / max(CASE WHEN nth = 21 THEN med END) - 1 AS sector FROM (SELECT med, row_number() OVER (ORDER BY ts DESC) AS nth FROM (SELECT ts, median(close) AS med FROM bars GROUP BY ts) c) d WHERE nth IN (1, 21)) s WHERE r.ret IS NOT NULL ORDER BY round(r.ret - x.ri, 8) DESC, r.code LIMIT 20) e) f""",
            """WITH l AS (SELECT code, list(close ORDER BY ts DESC) AS l FROM bars GROUP BY code HAVING count(*) > 20), i AS (SELECT index_code, list(close ORDER BY ts DESC) AS l FROM index_bars GROUP BY ALL), s AS (SELECT list(v ORDER BY ts DESC) AS l FROM (SELECT ts, quantile_cont(close, 0.5) AS v FROM bars GROUP BY ts)),
                t AS (SELECT l.code, l.l[1] / l.l[21] - 1 AS ret, l.l[1] / l.l[21] - i.l[1] / i.l[21] AS a, l.l[1] / l.l[21] - s.l[1] / s.l[21] AS b FROM l JOIN master m USING (code) JOIN i USING (index_code), s), u AS (SELECT *, row_number() OVER (ORDER BY round(a, 8) DESC, code) AS nth FROM t QUALIFY nth <= 20)
              SELECT code, nth, round(ret, 6) AS ret, round(a, 6) AS alpha_index, round(b, 6) AS alpha_sector, row_number() OVER (ORDER BY round(b, 8) DESC, code) AS nth_sector FROM u""",
        ),
        industry_members_ranked=(
            """SELECT ts, industry, code, nth_industry, nth, round(ret, 7) AS ret, round(ret - industry_ret, 7) AS alpha_industry, round(ret - ri, 7) AS alpha_index FROM (SELECT r.ts, r.industry, r.code, r.ret, t.ret AS industry_ret, t.nth AS nth_industry, x.ri, row_number() OVER (PARTITION BY r.ts, r.industry ORDER BY round(r.ret, 10) DESC, r.code) AS nth FROM member_returns r
                JOIN (SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.ts ORDER BY round(ret, 10) DESC, industry) AS nth FROM industry_return_20 i JOIN rebalances d ON d.ts = i.ts AND d.day WHERE n >= 2) a WHERE nth <= 3) t ON t.ts = r.ts AND t.industry = r.industry JOIN index_returns x ON x.index_code = r.index_code AND x.ts = r.ts) z WHERE nth <= 3""",
            """WITH t AS (SELECT ts, industry, ret, row_number() OVER (PARTITION BY ts ORDER BY round(ret, 10) DESC, industry) AS k FROM industry_return_20 SEMI JOIN (SELECT ts FROM rebalances WHERE day) USING (ts) WHERE n >= 2 QUALIFY k <= 3)
              SELECT r.ts, r.industry, r.code, t.k AS nth_industry, row_number() OVER (PARTITION BY r.ts, r.industry ORDER BY round(r.ret, 10) DESC, r.code) AS nth, round(r.ret, 7) AS ret, round(r.ret - t.ret, 7) AS alpha_industry, round(r.ret - x.ri, 7) AS alpha_index FROM member_returns r JOIN t USING (ts, industry) JOIN index_returns x USING (index_code, ts) QUALIFY nth <= 3""",
        ),
        double_outperformers_named=(
            """SELECT r.ts, r.code, r.industry, round(r.ret, 7) AS ret FROM member_returns r JOIN (SELECT ts, max_by(industry, struct(round(ret, 10), industry)) AS industry, max_by(ret, struct(round(ret, 10), industry)) AS top_ret FROM industry_return_20 WHERE n >= 2 GROUP BY ts) t ON t.ts = r.ts AND t.industry = r.industry
                JOIN index_returns x ON x.index_code = r.index_code AND x.ts = r.ts WHERE r.ret > t.top_ret + 1e-9 AND r.ret > x.ri + 1e-9""",
            """WITH t AS (SELECT ts, industry, ret FROM industry_return_20 WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY ts ORDER BY round(ret, 10) DESC, industry DESC) = 1)
              SELECT r.ts, r.code, r.industry, round(r.ret, 7) AS ret FROM member_returns r JOIN t USING (ts, industry) JOIN index_returns x USING (index_code, ts) WHERE r.ret - 1e-9 > greatest(t.ret, x.ri)""",
        ),
    )
    flow.step(
        member_returns="SELECT * FROM (SELECT m.industry, m.index_code, b.code, b.ts, b.close / nullif(lag(b.close, 20) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS ret FROM bars b JOIN master m ON b.code = m.code) x WHERE ret IS NOT NULL",
        index_returns="SELECT * FROM (SELECT index_code, ts, close / lag(close, 20) OVER (PARTITION BY index_code ORDER BY ts) - 1 AS ri FROM index_bars) x WHERE ri IS NOT NULL",
    )
