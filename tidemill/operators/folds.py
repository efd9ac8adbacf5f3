"""Operators whose next value needs the last one: EWM averages, simulation.

Averages over a series are one grouped map by code, linear in its bars; folds over a few
steps run in the JVM by ``aggregate``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.flow import Flow


def ewm(values: Column, alpha: float) -> Column:
    """Array of e[0] = x[0], e[t] = alpha x[t] + (1 - alpha) e[t-1] of an array of values.

    The accumulator appends: for arrays of some 10^5 values and more, use a grouped map.
    """
    # the first value has nothing before it: trying for it gives null
    step = lambda a, x: F.concat(a, F.array(F.coalesce(F.lit(alpha) * x + F.lit(1 - alpha) * F.try_element_at(a, F.lit(-1)), x)))
    return F.aggregate(values, F.array().cast("array<double>"), step)


def smoothed(rows: DataFrame, alphas: dict[str, tuple[str, float]]) -> DataFrame:
    """``rows`` (code, ts, columns) with ewm averages: name -> (column, alpha); a code is one group, read once."""
    columns = [c for c in rows.columns if c not in ("code", "ts")]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", ignore_index=True)
        for name, (column, alpha) in alphas.items():
            frame[name] = frame[column].ewm(alpha=alpha, adjust=False).mean()
        return frame

    schema = "code long, ts date, " + ", ".join(f"{c} double" for c in [*columns, *alphas])
    return rows.select("code", F.col("ts").cast("date").alias("ts"), *(F.col(c).cast("double").alias(c) for c in columns)).groupBy("code").applyInPandas(fold, schema)


def macd(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    bars = flow.run("SELECT code, ts, close FROM bars")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = smoothed(bars(spark, sf_dir), {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)})
        s = smoothed(s.withColumn("dif", F.col("fast") - F.col("slow")), {"dea": ("dif", 2 / 10)})
        return s.select("code", "ts", F.round("dif", 4).alias("dif"), F.round("dea", 4).alias("dea"), F.round(2 * (F.col("dif") - F.col("dea")), 4).alias("bar"))

    return query


MACD_SQL = """
, o AS (SELECT code, ts, close, row_number() OVER (PARTITION BY code ORDER BY ts) AS n FROM bars),
e AS (SELECT code, ts, n, close AS fast, close AS slow, close - close AS dif, close - close AS dea FROM o WHERE n = 1
  UNION ALL SELECT o.code, o.ts, o.n, o.close * (2.0::DOUBLE / 13) + (1 - 2.0::DOUBLE / 13) * e.fast, o.close * (2.0::DOUBLE / 27) + (1 - 2.0::DOUBLE / 27) * e.slow,
    (o.close * (2.0::DOUBLE / 13) + (1 - 2.0::DOUBLE / 13) * e.fast) - (o.close * (2.0::DOUBLE / 27) + (1 - 2.0::DOUBLE / 27) * e.slow),
    ((o.close * (2.0::DOUBLE / 13) + (1 - 2.0::DOUBLE / 13) * e.fast) - (o.close * (2.0::DOUBLE / 27) + (1 - 2.0::DOUBLE / 27) * e.slow)) * 0.2::DOUBLE + 0.8::DOUBLE * e.dea
  FROM e JOIN o ON o.code = e.code AND o.n = e.n + 1)
SELECT code, ts, round(dif, 4) AS dif, round(dea, 4) AS dea, round(2 * (dif - dea), 4) AS bar FROM e
"""


def wilder(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    moves = flow.run("""SELECT code, ts, close, greatest(delta_1, 0) AS gain, greatest(-delta_1, 0) AS loss, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr
        FROM changed WHERE delta_1 IS NOT NULL""")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = smoothed(moves(spark, sf_dir), {f"{c}_14": (c, 1 / 14) for c in ("gain", "loss", "tr")})
        out = out.select("code", "ts", "close", *(F.col(f"{c}_14").alias(c) for c in ("gain", "loss", "tr")))
        rsi = F.coalesce(100 - 100 / (1 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0))), F.lit(50.0))
        return out.select("code", "ts", F.round(rsi, 4).alias("rsi"), F.round("tr", 4).alias("atr"), F.round(F.col("tr") / F.nullif(F.col("close"), F.lit(0)) * 100, 4).alias("adx_proxy"))

    return query


WILDER_SQL = """
, o AS (SELECT code, ts, close, greatest(delta_1, 0) AS gain, greatest(-delta_1, 0) AS loss, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr,
  row_number() OVER (PARTITION BY code ORDER BY ts) AS n FROM changed WHERE delta_1 IS NOT NULL),
e AS (SELECT code, ts, n, close, gain, loss, tr FROM o WHERE n = 1
  UNION ALL SELECT o.code, o.ts, o.n, o.close, o.gain * (1::DOUBLE / 14) + (1 - 1::DOUBLE / 14) * e.gain, o.loss * (1::DOUBLE / 14) + (1 - 1::DOUBLE / 14) * e.loss, o.tr * (1::DOUBLE / 14) + (1 - 1::DOUBLE / 14) * e.tr
  FROM e JOIN o ON o.code = e.code AND o.n = e.n + 1)
SELECT code, ts, round(coalesce(100 - 100 / (1 + gain / nullif(loss, 0)), 50), 4) AS rsi, round(tr, 4) AS atr, round(tr / nullif(close, 0) * 100, 4) AS adx_proxy FROM e
"""


def span_indicators(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    """RSI and true range with the span of 14 (alpha 2 / 15)."""
    moves = flow.run("""SELECT code, ts, greatest(delta_1, 0) AS gain, greatest(-delta_1, 0) AS loss, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM changed WHERE delta_1 IS NOT NULL""")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = smoothed(moves(spark, sf_dir), {f"{c}_14": (c, 2 / 15) for c in ("gain", "loss", "tr")})
        return out.select("code", "ts", F.round(100 - 100 / (1 + F.col("gain_14") / (F.col("loss_14") + 1e-12)), 4).alias("rsi"), F.round("tr_14", 4).alias("atr"))

    return query


SPAN_SQL = """
, o AS (SELECT code, ts, greatest(delta_1, 0) AS gain, greatest(-delta_1, 0) AS loss, list_max([high - low, abs(high - prev_close), abs(low - prev_close)]) AS tr, row_number() OVER (PARTITION BY code ORDER BY ts) AS n FROM changed WHERE delta_1 IS NOT NULL),
e AS (SELECT code, ts, n, gain, loss, tr FROM o WHERE n = 1
  UNION ALL SELECT o.code, o.ts, o.n, (2 * o.gain + 13 * e.gain) / 15, (2 * o.loss + 13 * e.loss) / 15, (2 * o.tr + 13 * e.tr) / 15 FROM e JOIN o ON o.code = e.code AND o.n = e.n + 1)
SELECT code, ts, round(100 * gain / (gain + loss + 1e-12), 4) AS rsi, round(tr, 4) AS atr FROM e
"""


def simulation(flow: Flow, steps: int = 8) -> Callable[[SparkSession, str], DataFrame]:
    """Free motion of each fitted pair from d = 1, u = 0: d' = d + u, u' = u - k d - c u."""
    fitted = flow.run("SELECT code, k, c FROM kc WHERE status LIKE 'ok%'")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.array(F.struct(F.lit(0).alias("step"), F.lit(1.0).alias("d"), F.lit(0.0).alias("u"))),
            lambda a, t: F.concat(a, F.array(F.struct(t.alias("step"), (F.element_at(a, -1)["d"] + F.element_at(a, -1)["u"]).alias("d"),
                (F.element_at(a, -1)["u"] - F.col("k") * F.element_at(a, -1)["d"] - F.col("c") * F.element_at(a, -1)["u"]).alias("u")))),
        )
        rows = fitted(spark, sf_dir).select("code", F.inline(state))
        return rows.select("code", "step", F.round("d", 5).alias("d"), F.round("u", 5).alias("u"))

    return query


SIMULATION_SQL = """
, s AS (SELECT code, k, c, 0 AS step, 1::DOUBLE AS d, 0::DOUBLE AS u FROM kc WHERE status LIKE 'ok%'
  UNION ALL SELECT code, k, c, step + 1, d + u, u - k * d - c * u FROM s WHERE step < 8)
SELECT code, step, round(d, 5) AS d, round(u, 5) AS u FROM s
"""


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    def recursive(base: str, rest: str) -> str:
        head = flow.duckdb(f"SELECT 1 FROM {base}")
        head = head[: head.rindex(" SELECT 1 FROM")]
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + rest

    return (
        {"macd": macd(flow), "wilder_indicators": wilder(flow), "span_indicators": span_indicators(flow), "simulation": simulation(flow)},
        {"macd": recursive("bars", MACD_SQL), "wilder_indicators": recursive("changed", WILDER_SQL), "span_indicators": recursive("changed", SPAN_SQL), "simulation": recursive("kc", SIMULATION_SQL)},
    )
