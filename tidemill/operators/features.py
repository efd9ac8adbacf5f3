"""Time-series features: everything here is partitioned by code, one shuffle for all."""

from __future__ import annotations

from tidemill.functions.exprs import ROWS, average_rank, correlation, lag, last, lead, ratio, rolling
from tidemill.plans.flow import Flow


def add(flow: Flow) -> None:
    ma = {n: rolling("avg(close)", n) for n in (5, 10, 20, 60)}
    flow.step(
        changed=f"SELECT *, close - {lag('close')} AS delta_1, {ratio('close', lag('close'))} - 1 AS ret_1, {lag('close')} AS prev_close, (high + low + close) / 3 AS typical FROM bars",
        averaged="SELECT *, " + ", ".join(f"{x} AS ma_{n}" for n, x in ma.items()) + ", " + ", ".join(f"{rolling('stddev_samp(close)', n, 2)} AS std_{n}" for n in (5, 10, 20, 60)) + " FROM bars",
        flows=f"""SELECT *, CASE WHEN typical > {lag('typical')} THEN typical * volume ELSE 0.0 END AS up_flow,
            CASE WHEN typical < {lag('typical')} THEN typical * volume ELSE 0.0 END AS down_flow, coalesce(signum(delta_1), 0) * volume AS signed_volume FROM changed""",
        obv=f"SELECT code, ts, sum(signed_volume) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS obv FROM flows",
    )
    flow.query(
        moving_averages="SELECT code, ts, " + ", ".join(f"round(ma_{n}, 6) AS ma_{n}, round(std_{n}, 4) AS std_{n}" for n in (5, 10, 20, 60)) + " FROM averaged",
        rolling_extremes="SELECT code, ts, " + ", ".join(f"round({rolling('min(low)', n)}, 6) AS low_{n}, round({rolling('max(high)', n)}, 6) AS high_{n}" for n in (5, 10, 20, 60)) + " FROM bars",
        strict_rolling=f"SELECT code, ts, round({rolling('avg(close)', 20, 20)}, 6) AS ma, round({rolling('stddev_samp(close)', 20, 20)}, 4) AS sd FROM bars",
        deltas_and_delays="SELECT code, ts, " + ", ".join(f"round(close - {lag('close', n)}, 8) AS delta_{n}, round({ratio('close', lag('close', n))} - 1, 8) AS ret_{n}, round({lag('close', n)}, 8) AS delay_{n}, {lag('volume', n)} AS delay_v_{n}" for n in (1, 5, 10, 20)) + " FROM bars",
        ma_ratios="SELECT code, ts, round(ma_5 / (ma_20 + 1e-12), 8) AS ma_5_20, round(ma_10 / (ma_60 + 1e-12), 8) AS ma_10_60 FROM averaged",
        stochastic_k=f"""SELECT code, ts, round(coalesce(100 * (close - lo) / nullif(hi - lo, 0), 50), 6) AS stoch_k FROM (SELECT code, ts, close,
            {rolling('min(low)', 14, 14)} AS lo, {rolling('max(high)', 14, 14)} AS hi FROM bars) x""",
        true_range=f"SELECT code, ts, round(greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})), 6) AS tr FROM bars",
        # what is not known holds on: amounts, prices, deviations
        vwap_deviation=f"""SELECT code, ts, round(last_value(dev) ignore nulls OVER ({ROWS} ROWS UNBOUNDED PRECEDING), 8) AS vwap_dev FROM (SELECT code, ts, (close - vwap) / nullif(vwap, 0) AS dev FROM (
            SELECT code, ts, close, last_value(price) ignore nulls OVER ({ROWS} ROWS UNBOUNDED PRECEDING) AS vwap FROM (SELECT code, ts, close, last_value(paid) ignore nulls OVER ({ROWS} ROWS UNBOUNDED PRECEDING) / nullif(volume, 0) AS price FROM (
              SELECT code, ts, close, volume, coalesce(amount, close * volume) AS paid FROM bars) a) b) c) d""",
        volume_features=f"""SELECT code, ts, round({rolling('avg(volume)', 5)}, 6) AS v_ma_5, round({rolling('avg(volume)', 20)}, 6) AS v_ma_20,
            round(volume / ({rolling('avg(volume)', 5)} + 1e-12), 8) AS v_ratio_5, round(volume / ({rolling('avg(volume)', 20)} + 1e-12), 8) AS v_ratio_20, round(close * volume, 6) AS vwap_proxy FROM bars""",
        shape_features=f"SELECT code, ts, round({ratio('close', lag('close', 20))} - 1, 8) AS mom_20, round({ratio('high - low', 'close')}, 8) AS hl_ratio, round({ratio('close - open', 'open')}, 8) AS oc_ratio FROM bars",
        forward_returns="SELECT code, ts, " + ", ".join(f"round({ratio(lead('close', h), 'close')} - 1, 8) AS fwd_{h}" for h in (1, 5, 10, 20)) + " FROM bars",
        size_proxy=f"SELECT code, ts, round(ln(1 + {rolling('avg(amount)', 20, 5, 'amount')}), 8) AS log_size FROM bars",
        recent_return="""SELECT code, round(max(CASE WHEN nth = 1 THEN close END) / max(CASE WHEN nth = 21 THEN close END) - 1, 8) AS ret_20 FROM (
            SELECT code, close, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS nth FROM bars) x WHERE nth IN (1, 21) GROUP BY code""",
        whole_return="SELECT code, round(max_by(close, ts) / min_by(close, ts) - 1, 8) AS ret FROM bars GROUP BY code",
        up_streak=f"""SELECT code, ts, ord - coalesce(max(CASE WHEN NOT up THEN ord END) OVER ({ROWS} ROWS UNBOUNDED PRECEDING), 0) AS streak FROM (
            SELECT code, ts, row_number() OVER ({ROWS}) AS ord, coalesce(delta_1 > 0, false) AS up FROM changed) x""",
        ma_cross=f"""SELECT code, ts, coalesce(above AND NOT before, false) AS cross_up, coalesce(NOT above AND before, false) AS cross_down FROM (
            SELECT code, ts, close > ma_5 AS above, lag(close > ma_5) OVER ({ROWS}) AS before FROM averaged) x""",
        relative_ma5=f"""SELECT code, ts, round(close / first_value(strict) ignore nulls OVER ({ROWS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1, 8) AS rel_ma5 FROM (
            SELECT code, ts, close, {rolling('avg(close)', 5, 5)} AS strict FROM bars) x""",
        drawdown=f"SELECT code, ts, round(close / max(close) OVER ({ROWS} ROWS UNBOUNDED PRECEDING) - 1, 8) AS drawdown FROM bars",
        zscore="SELECT code, ts, round(CASE WHEN s > 0 THEN (close - m) / s ELSE 0 END, 6) AS z FROM (SELECT code, ts, close, avg(close) OVER (PARTITION BY code) AS m, stddev_samp(close) OVER (PARTITION BY code) AS s FROM bars) x",
        minmax="SELECT code, ts, round(coalesce((volume - lo) / nullif(hi - lo, 0), 0), 8) AS v_norm FROM (SELECT code, ts, volume, min(volume) OVER (PARTITION BY code) AS lo, max(volume) OVER (PARTITION BY code) AS hi FROM bars) x",
        limit_move_mask="SELECT code, ts, round(CASE WHEN ret_1 IS NULL OR abs(ret_1) < 0.095 THEN typical END, 6) AS masked FROM changed",
        thinned="SELECT code, ts, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) AS nth FROM bars) x WHERE (nth - 1) % 5 = 0",
        purged_split="""SELECT code, ts, CASE WHEN nth <= floor(0.7 * n) - 14 THEN 'train' WHEN nth > floor(0.7 * n) + 14 THEN 'test' ELSE 'gap' END AS part FROM (
            SELECT code, ts, row_number() OVER (PARTITION BY code ORDER BY ts) AS nth, count(*) OVER (PARTITION BY code) AS n FROM bars) x""",
        beta_volatility=f"""SELECT code, round(covar_samp(r, ri) / nullif(var_samp(ri), 0), 5) AS beta, round(stddev_samp(r), 6) AS volatility, round(median(amount), 3) AS liquidity, count(*) AS n FROM (
            SELECT s.code, s.ts, s.ret_1 AS r, i.ri, s.amount, row_number() OVER (PARTITION BY s.code ORDER BY s.ts DESC) AS nth FROM changed s JOIN master m ON s.code = m.code
            JOIN (SELECT index_code, ts, close / lag(close) OVER (PARTITION BY index_code ORDER BY ts) - 1 AS ri FROM index_bars) i ON i.index_code = m.index_code AND i.ts = s.ts) x
            WHERE nth <= 168 AND r IS NOT NULL AND ri IS NOT NULL GROUP BY code HAVING count(*) >= 50""",
        window_statistics="SELECT code, ts, " + ", ".join(f"round(CASE WHEN n = 30 THEN {e} END, 6) AS {k}" for k, e in {
            "mean": "m", "variance": "v / 1e3", "minimum": "lo", "maximum": "hi", "sum_changes": "ch", "energy": "sq / 1e6"}.items())
        + f""" FROM (SELECT code, ts, count(close) OVER {last(30)} AS n, avg(close) OVER {last(30)} AS m, var_pop(close) OVER {last(30)} AS v, min(close) OVER {last(30)} AS lo, max(close) OVER {last(30)} AS hi,
            sum(abs(delta_1)) OVER {last(29)} AS ch, sum(close * close) OVER {last(30)} AS sq FROM changed) x""",
        labels_relative=f"""SELECT code, ts, CASE WHEN f IS NULL OR fi IS NULL THEN NULL WHEN round(f - fi, 6) > 0 THEN 1 ELSE 0 END AS label FROM (SELECT b.code, b.ts, {ratio('lead(b.close, 5) OVER (PARTITION BY b.code ORDER BY b.ts)', 'b.close')} - 1 AS f,
            {ratio('lead(i.close, 5) OVER (PARTITION BY b.code ORDER BY b.ts)', 'i.close')} - 1 AS fi FROM bars b JOIN master m ON b.code = m.code JOIN index_bars i ON i.index_code = m.index_code AND i.ts = b.ts) x""",
        time_series_ic=f"""SELECT code, count(*) AS n, round({correlation('rx', 'ry')}, 6) AS ic FROM (SELECT code, {average_rank('x', 'code')} AS rx, {average_rank('y', 'code')} AS ry FROM (
            SELECT code, {ratio('close', lag('close', 5))} - 1 AS x, {ratio(lead('close', 5), 'close')} - 1 AS y FROM bars) a WHERE x IS NOT NULL AND y IS NOT NULL) b GROUP BY code HAVING count(*) >= 30""",
        candles=f"""SELECT code, count_if(doji) AS doji, count_if(hammer) AS hammer, count_if(engulfing) AS engulfing, count_if(marubozu) AS marubozu, count_if(soldiers) AS soldiers, count_if(harami) AS harami,
            count_if(hammer AND fwd > 0) AS hammer_wins, count_if(engulfing AND fwd > 0) AS engulfing_wins FROM (SELECT code,
              body < 0.1 * span AS doji, low_shadow > 2 * body AND high_shadow < body AND body > 0 AS hammer, coalesce(close > open AND p_close < p_open AND close >= p_open AND open <= p_close, false) AS engulfing,
              body > 0.95 * span AND span > 0 AS marubozu, coalesce(close > open AND p_close > p_open AND p2_close > p2_open AND close > p_close AND p_close > p2_close, false) AS soldiers,
              coalesce(greatest(open, close) <= greatest(p_open, p_close) AND least(open, close) >= least(p_open, p_close), false) AS harami, coalesce(fwd, 0) AS fwd FROM (
              SELECT code, open, close, abs(close - open) AS body, high - low AS span, least(open, close) - low AS low_shadow, high - greatest(open, close) AS high_shadow,
                {lag('open')} AS p_open, {lag('close')} AS p_close, {lag('open', 2)} AS p2_open, {lag('close', 2)} AS p2_close, {lead('close', 2)} - close AS fwd FROM bars) a) b GROUP BY code""",
    )
