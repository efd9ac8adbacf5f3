"""Bars, benchmarks, security master and membership from the order tables.

A security is a supplier; its bar holds the first and last price, the extremes, volume
and amount of its lines in a week (or month). Its benchmark is the sum over its exchange.
"""

from __future__ import annotations

from tidemill.plans.flow import Flow

#: Place of a line in time as one number (day, order, line): a first and a last by it are hash aggregates.
_ORDER = "((year(l_shipdate) - 1900) * 366 + dayofyear(l_shipdate)) * 8796093022208 * 4 + l_orderkey * 8 + l_linenumber"


def _bars(unit: str) -> str:
    return f"""
    SELECT code, cast(date_trunc('{unit}', l_shipdate) AS date) AS ts,
      min_by(px, place) AS open, max(px) AS high, min(px) AS low, max_by(px, place) AS close,
      sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
    FROM lines GROUP BY code, cast(date_trunc('{unit}', l_shipdate) AS date)"""


def add(flow: Flow) -> None:
    flow.step(
        lines=f"""SELECT l_suppkey AS code, l_extendedprice / l_quantity AS px, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, {_ORDER} AS place
          FROM {{lineitem}} WHERE l_quantity > 0 AND l_extendedprice > 0""",
        bars=_bars("week"),
        bars_m=_bars("month"),
        named="""SELECT s_suppkey AS code, n_nationkey, n_name AS industry, n_regionkey AS region_id, s_acctbal,
            CASE WHEN s_suppkey % 37 = 0 THEN NULL WHEN s_suppkey % 34 = 0 THEN concat('ST', s_name) WHEN s_suppkey % 17 = 0 THEN concat('*ST ', s_name) WHEN s_suppkey % 23 = 0 THEN concat(s_name, '退') WHEN s_suppkey % 29 = 0 THEN '' ELSE s_name END AS name,
            CASE WHEN n_regionkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange,
            CASE WHEN s_suppkey % 31 = 0 THEN 'BJ' WHEN n_regionkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS market
          FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
        master="""SELECT *, CASE WHEN market = 'BJ' THEN 'bj' WHEN name LIKE '%退%' THEN 'delisted' WHEN upper(name) LIKE '%ST%' THEN 'st'
            WHEN coalesce(name, '') = '' THEN 'unknown' ELSE 'active' END AS status,
            CASE WHEN exchange = 'SH' THEN '000001.SH' ELSE '399001.SZ' END AS index_code FROM named""",
        membership="""SELECT concat('88', lpad(cast(n_nationkey AS string), 4, '0')) AS sector_code, industry AS sector_name, code AS member_code, n_nationkey AS ord FROM named
          UNION ALL SELECT concat('99', lpad(cast(region_id AS string), 4, '0')), concat('region ', cast(region_id AS string)), code, 100 + region_id FROM named""",
        index_bars="""SELECT index_code, ts, sum(volume) AS volume, round(sum(amount), 2) AS amount, round(sum(amount) / sum(volume), 6) AS close
          FROM bars JOIN master USING (code) GROUP BY index_code, ts""",
        manifest="""SELECT code, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, CASE WHEN max(ts) = (SELECT max(ts) FROM bars) THEN 'ok' ELSE 'stale' END AS state FROM bars GROUP BY code""",
    )
    flow.query(
        bars_weekly="SELECT code, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount FROM bars",
        bars_monthly="SELECT code, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, amount FROM bars_m",
        index_bars_weekly="SELECT index_code, ts, volume, amount, close FROM index_bars",
        security_master="SELECT code, name, market, exchange, industry, status, index_code FROM master",
        status_counts="SELECT status, market, count(*) AS n FROM master GROUP BY status, market",
        stock_universe="SELECT DISTINCT member_code AS code, m.name FROM membership JOIN master m ON m.code = member_code WHERE m.status = 'active' AND m.market <> 'BJ'",
        not_st_or_delisted="SELECT code, name FROM master WHERE upper(coalesce(name, '')) NOT LIKE '%ST%' AND coalesce(name, '') NOT LIKE '%退%'",
        first_membership="""SELECT member_code, sector_code, sector_name FROM (SELECT *, row_number() OVER (PARTITION BY member_code ORDER BY ord, sector_code) AS nth FROM membership) x WHERE nth = 1""",
        sector_universe="SELECT sector_code, sector_name, count(DISTINCT member_code) AS n_members FROM membership GROUP BY sector_code, sector_name",
        name_lookup="SELECT b.code, coalesce(nullif(m.name, ''), 'unknown') AS name, coalesce(m.market, '') AS market, count(*) AS n FROM bars b LEFT JOIN master m ON b.code = m.code GROUP BY 1, 2, 3",
        manifest_record="SELECT code, n_rows, first_ts, last_ts, state FROM manifest",
        fetch_todo="SELECT m.code FROM master m WHERE NOT EXISTS (SELECT 1 FROM manifest d WHERE m.code = d.code AND d.state = 'ok')",
        fetch_triage="""SELECT m.code, CASE WHEN d.code IS NULL THEN 'missing' WHEN d.n_rows < 280 THEN 'short' ELSE 'ok' END AS reason FROM master m LEFT JOIN manifest d ON m.code = d.code""",
        fetch_chunks="SELECT code, cast(floor((row_number() OVER (ORDER BY code) - 1) / 25) AS int) AS chunk FROM master",
        has_bars="SELECT m.code FROM master m WHERE EXISTS (SELECT 1 FROM bars b WHERE m.code = b.code)",
        tail_bars="SELECT code, ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS nth FROM bars) x WHERE nth <= 10",
        calendar_days="SELECT id AS n, cast(floor(id / 0.67 * 1.05) AS int) AS days FROM (SELECT explode(sequence(1, 500)) AS id) x",
        month_ends="SELECT max(ts) AS ts FROM bars GROUP BY date_trunc('month', ts)",
        trading_grid="SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS ord FROM (SELECT DISTINCT ts FROM bars) d) x WHERE (ord - 1) % 5 = 0",
        common_dates="SELECT ts, count(DISTINCT code) AS n FROM bars GROUP BY ts HAVING count(DISTINCT code) >= 0.8 * (SELECT count(DISTINCT code) FROM bars)",
        price_floor="SELECT code, ts, round(close, 6) AS close FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM bars) x WHERE n >= 60 AND close >= 1000 AND volume IS NOT NULL AND volume > 0",
        date_slice="SELECT code, count(*) AS n, round(avg(close), 6) AS mean_close FROM bars WHERE ts BETWEEN date '1994-01-01' AND date '1995-12-31' GROUP BY code",
        exchange_subset="SELECT code, market, name FROM master WHERE market = 'SH'",
        code_tags="""SELECT code, replace(full_code, '.', '_') AS file_tag, split_part(full_code, '.', 1) AS tag, upper(split_part(full_code, '.', 2)) AS suffix,
            CASE WHEN substring(full_code, 1, 1) IN ('6', '9', '5') THEN 'SH' ELSE 'SZ' END AS guess
          FROM (SELECT code, concat(lpad(cast(code * 7919 % 1000000 AS string), 6, '0'), '.', market) AS full_code FROM master) x""",
        panel_stats="SELECT count(*) AS n_rows, count(DISTINCT code) AS n_codes, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS n_dates FROM bars",
        kind_priority="""SELECT key, min_by(kind, ord) AS kind, min_by(n, ord) AS n FROM (
            SELECT cast(code AS string) AS key, 'stocks' AS kind, 1 AS ord, count(*) AS n FROM bars GROUP BY code
            UNION ALL SELECT index_code, 'indices', 3, count(*) FROM index_bars GROUP BY index_code
            UNION ALL SELECT cast(member_code AS string), 'sectors', 2, count(*) FROM membership GROUP BY member_code) x GROUP BY key""",
    )
