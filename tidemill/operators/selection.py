"""Selection, rotation, fees and trades."""

from __future__ import annotations

from tidemill.functions.exprs import ROWS
from tidemill.plans.flow import Flow

#: Commission and transfer fee a side, stamp duty on sales.
COMMISSION, TRANSFER, STAMP = 8.5e-5, 1e-5, 5e-4


def fee(amount: str, exchange: str, sale: bool) -> str:
    """Fees of one side of a trade; the transfer fee is for one exchange only."""
    stamp = f" + {amount} * {STAMP:.5f}" if sale else ""
    return f"({amount} * {COMMISSION:.6f} + CASE WHEN {exchange} = 'SH' THEN {amount} * {TRANSFER:.6f} ELSE 0 END{stamp})"


def add(flow: Flow) -> None:
    flow.step(
        month_close="SELECT code, month, max(ts) AS ts, max_by(close, ts) AS close, max_by(f, ts) AS f FROM (SELECT code, ts, close, f, cast(date_trunc('month', ts) AS date) AS month FROM factors WHERE f IS NOT NULL) x GROUP BY code, month",
        month_dates="SELECT cast(date_trunc('month', ts) AS date) AS month, max(ts) AS ts FROM factors GROUP BY cast(date_trunc('month', ts) AS date)",
        # a code without a value on the month's last date is no candidate
        picks="SELECT month, code, close, 1.0 / 10 AS weight, nth FROM (SELECT c.*, row_number() OVER (PARTITION BY c.month ORDER BY c.f DESC, c.code) AS nth, count(*) OVER (PARTITION BY c.month) AS n FROM month_close c JOIN month_dates d ON d.month = c.month AND d.ts = c.ts) x WHERE nth <= 10 AND n >= 10",
        next_month="SELECT code, month, lead(close) OVER (PARTITION BY code ORDER BY month) / close - 1 AS ret FROM month_close",
        portfolio="SELECT p.month, sum(p.weight * coalesce(n.ret, 0)) AS ret FROM picks p JOIN next_month n ON p.code = n.code AND p.month = n.month GROUP BY p.month",
        nav="SELECT month, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)) AS nav FROM portfolio WHERE ret > -1",
        crossed=f"SELECT code, ts, open, close, coalesce(lag(close > ma_5 AND NOT before) OVER ({ROWS}), false) AS entry, coalesce(lag(close <= ma_5 AND before) OVER ({ROWS}), false) AS exit_ FROM (SELECT *, lag(close > ma_5) OVER ({ROWS}) AS before FROM averaged) x",
        acts=f"SELECT *, lag(act) OVER ({ROWS}) AS before_act FROM (SELECT code, ts, open, CASE WHEN exit_ THEN 'exit' WHEN entry THEN 'entry' END AS act FROM crossed) x WHERE act IS NOT NULL",
        trades=f"""SELECT code, ts AS entry_ts, open AS entry_price, exit_ts, exit_price, floor(100000 * 0.95 / open / 100) * 100 AS size FROM (SELECT code, ts, open, act, lead(ts) OVER ({ROWS}) AS exit_ts, lead(open) OVER ({ROWS}) AS exit_price
            FROM acts WHERE act IS DISTINCT FROM before_act) x WHERE act = 'entry' AND exit_ts IS NOT NULL""",
        settled=f"""SELECT t.*, m.exchange, (exit_price - entry_price) * size AS gross, {fee('entry_price * size', 'm.exchange', False)} + {fee('exit_price * size', 'm.exchange', True)} AS fees FROM trades t JOIN master m ON t.code = m.code WHERE size > 0""",
        industry_return_20=f"SELECT industry, ts, avg(ret) AS ret, count(*) AS n FROM (SELECT m.industry, b.code, b.ts, b.close / nullif(lag(b.close, 20) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS ret FROM bars b JOIN master m ON b.code = m.code) x WHERE ret IS NOT NULL GROUP BY industry, ts",
    )
    flow.query(
        monthly_top_n="SELECT month, code, nth, round(weight, 6) AS weight FROM picks",
        portfolio_nav="SELECT month, round(ret, 8) AS ret, round(nav, 6) AS nav, round(nav / max(nav) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM nav",
        top_industries="SELECT ts, industry, nth, round(ret, 8) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY round(ret, 10) DESC, industry) AS nth FROM industry_return_20 WHERE n >= 2) x WHERE nth <= 3",
        top_industry_members="""SELECT ts, industry, code, nth, round(ret, 8) AS ret FROM (SELECT r.ts, r.industry, r.code, r.ret, row_number() OVER (PARTITION BY r.ts, r.industry ORDER BY r.ret DESC, r.code) AS nth FROM (SELECT m.industry, b.code, b.ts, b.close / nullif(lag(b.close, 20) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS ret
            FROM bars b JOIN master m ON b.code = m.code) r JOIN (SELECT ts, max_by(industry, struct(round(ret, 10), industry)) AS industry FROM industry_return_20 WHERE n >= 2 GROUP BY ts) t ON r.ts = t.ts AND r.industry = t.industry WHERE r.ret IS NOT NULL) x WHERE nth <= 3""",
        double_outperformers="""SELECT b.ts, count(*) AS n FROM (SELECT m.industry, m.index_code, b.code, b.ts, b.close / nullif(lag(b.close, 20) OVER (PARTITION BY b.code ORDER BY b.ts), 0) - 1 AS ret FROM bars b JOIN master m ON b.code = m.code) b JOIN industry_return_20 i ON i.industry = b.industry AND i.ts = b.ts
            JOIN (SELECT index_code, ts, close / lag(close, 20) OVER (PARTITION BY index_code ORDER BY ts) - 1 AS ri FROM index_bars) x ON x.index_code = b.index_code AND x.ts = b.ts WHERE b.ret > i.ret + 1e-9 AND b.ret > ri + 1e-9 GROUP BY b.ts""",
        signals_ma5="SELECT code, count_if(entry) AS entries, count_if(exit_) AS exits FROM crossed GROUP BY code",
        trades_ma5="SELECT code, entry_ts, exit_ts, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, cast(size AS bigint) AS size FROM trades",
        trade_fees="SELECT code, entry_ts, round(gross, 3) AS gross, round(fees, 3) AS fees, round(gross - fees, 3) AS net_pnl_full FROM settled",
        backtest_summary="SELECT code, count(*) AS n, round(sum(gross), 2) AS gross, round(sum(fees), 2) AS fees, round(sum(gross - fees), 2) AS net, round(avg(CASE WHEN gross - fees > 0 THEN 1e0 ELSE 0e0 END), 8) AS win_rate FROM settled GROUP BY code",
        lot_sizes="SELECT code, ts, cast(CASE WHEN open > 0 THEN floor(100000 * 0.95 / open / 100) * 100 ELSE 0 END AS bigint) AS lots FROM bars",
        hold_exits=f"SELECT code, ts, coalesce(lag(entry, 5) OVER ({ROWS}), false) AS exit_after_5 FROM crossed",
        quote_alerts="""SELECT user_id, min(ts) AS first_ts, min_by(round(rise, 2), struct(ts, event_id)) AS rise FROM (SELECT user_id, event_id, ts, (value - p) / CASE WHEN p > 0 THEN p ELSE value - 0.01 END * 100 AS rise FROM (
            SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {events} WHERE value > 0) a WHERE p IS NOT NULL) b WHERE rise > 5 GROUP BY user_id""",
        tick_bars="""SELECT event_type, cast(date_trunc('hour', ts) AS timestamp) AS ts, min_by(value, struct(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, struct(ts, event_id)) AS close, count(*) AS n FROM {events} GROUP BY event_type, date_trunc('hour', ts)""".replace("cast(date_trunc('hour', ts) AS timestamp) AS ts", "cast(date_trunc('hour', ts) AS string) AS hour"),
        tick_json="SELECT event_type, sum(cast(get_json_object(props, '$.k') AS bigint)) AS k, count(*) AS n FROM {events} GROUP BY event_type",
        strategy_grid=f"""SELECT s.entry_p, b.code, count_if(coalesce(lag_p > s.entry_p, false)) AS entries FROM (SELECT code, ts, lag(p) OVER ({ROWS}) AS lag_p FROM (SELECT code, ts, 1 / (1 + exp(-10 * (close / nullif(ma_20, 0) - 1))) AS p FROM averaged) a) b
            CROSS JOIN (VALUES (0.50), (0.55), (0.60)) AS s(entry_p) GROUP BY s.entry_p, b.code""",
    )
