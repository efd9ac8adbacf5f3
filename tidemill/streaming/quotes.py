"""Quote streams: threshold alerts that fire once, bars from ticks, sessions.

The alert rule is that of the batch query ``quote_alerts``, save that a stream knows the
price before only from the quote itself; bars, sessions and the watermark are extensions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.flow import Flow
from tidemill.plans.scratch import scratch, stored


def quotes(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The stream of quotes in a folder of Parquet files, with timestamps that watermarks take."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def rise(now: str = "now", last_close: str = "last_close") -> Column:
    """Percent above the last close; a last close that is not positive counts as now - 0.01."""
    base = F.when(F.col(last_close) > 0, F.col(last_close)).otherwise(F.col(now) - 0.01)
    return F.round((F.col(now) - base) / F.nullif(base, F.lit(0)) * 100, 2)


def parse_quotes(raw: DataFrame) -> DataFrame:
    """code, now, last_close, volume, ts from JSON quotes in ``value``; quotes in error go."""
    fields = F.from_json("value", "Code string, ErrorId string, Now double, LastClose double, Volume double")
    parsed = raw.select(fields.alias("q"), "ts")
    return parsed.where(F.coalesce(F.col("q.ErrorId"), F.lit("0")) == "0").select(F.col("q.Code").alias("code"), F.col("q.Now").alias("now"), F.col("q.LastClose").alias("last_close"), F.col("q.Volume").alias("volume"), "ts")


def alerts(stream: DataFrame, codes: DataFrame | None = None, threshold: float = 5.0) -> DataFrame:
    """The first quote of each code whose rise is above ``threshold``, once per code for good."""
    rows = stream.where(F.col("code").isNotNull() & (F.col("now") > 0))
    if codes is not None:
        rows = rows.join(codes.select("code").distinct(), "code", "left_semi")
    risen = rows.withColumn("rise", rise()).where(F.col("rise") > threshold)
    return risen.dropDuplicates(["code"])


def debounced(stream: DataFrame, seconds: float = 10.0, late: str | None = None) -> DataFrame:
    """code, ts, rise of alerts of a code at least ``seconds`` apart; the time of the last one is kept as state.

    With ``late`` the state of a code goes once the watermark is ``seconds`` past its last
    alert, so state is bounded by the codes that rose lately; rows later than that are
    dropped. Needs the RocksDB state store. The rows of one code in one batch are sorted in
    memory. Batch twin: ``apart``.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Debounce(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.last = handle, handle.getValueState("last", "at double")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            import pandas as pd

            out = []
            last = before = self.last.get()[0] if self.last.exists() else None
            for r in pd.concat([f[["ts", "rise"]] for f in rows]).sort_values(["ts", "rise"]).itertuples():
                at = r.ts.timestamp()
                if last is None or at - last >= seconds:
                    last = at
                    out.append((key[0], r.ts, r.rise))
            if last != before:
                self.last.update((last,))
                if late:
                    self.handle.registerTimer(int((last + seconds) * 1000) + 1)
            yield pd.DataFrame(out, columns=["code", "ts", "rise"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            import pandas as pd

            if self.last.exists() and (self.last.get()[0] + seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
            yield pd.DataFrame([], columns=["code", "ts", "rise"])

        def close(self) -> None:
            pass

    rows = stream.select("code", "ts", "rise")
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy("code").transformWithStateInPandas(Debounce(), "code string, ts timestamp, rise double", "Append", "EventTime" if late else "None")


def apart(rows: DataFrame, seconds: float = 10.0) -> DataFrame:
    """The batch twin of ``debounced``: a fold over the times of a code."""
    times = rows.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("ts", "rise"))).alias("all"))
    start = F.array().cast("array<struct<ts:timestamp,rise:double>>")
    far = lambda kept, x: (F.size(kept) == 0) | (F.unix_micros(x["ts"]) - F.unix_micros(F.element_at(kept, -1)["ts"]) >= F.lit(int(seconds * 1_000_000)))
    kept = F.aggregate("all", start, lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return times.select("code", F.explode(kept).alias("x")).select("code", "x.*")


def risen(quotes_: DataFrame, universe: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Parsed quotes of the universe's codes with a price whose rise is above ``threshold``."""
    rows = quotes_.where(F.col("code").isNotNull() & (F.col("now") > 0)).join(universe.select("code").distinct(), "code", "left_semi")
    return rows.withColumn("rise", rise()).where(F.col("rise") > threshold)


def monitor(raw: DataFrame, universe: Callable[[], DataFrame], folder: str, checkpoint: str, threshold: float = 5.0, until_empty: bool = True):
    """Start a query that writes the first alert of each code, once and for good, to ``folder``.

    The universe is read anew for every batch. What has been alerted is the table itself: a
    batch leaves out codes of earlier batches and overwrites only its own partition, so a
    batch that is repeated after a failure or a restart changes nothing. No row passes the
    driver. ``until_empty`` ends the query when all that is there has been read; the next
    start goes on from ``checkpoint``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.struct("ts", "rise")
        first = risen(parse_quotes(batch), universe(), threshold).groupBy("code").agg(F.min(order).alias("first")).select("code", "first.*")
        earlier = alerted(spark, folder)
        if earlier is not None:
            first = first.join(earlier.where(F.col("batch") < number).select("code"), "code", "left_anti")
        first.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    started = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if until_empty else started).start()


def alerted(spark: SparkSession, folder: str) -> DataFrame | None:
    """The alerts in a folder of ``monitor``; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(s.isDirectory() for s in files.listStatus(path)):
        return None
    return spark.read.schema("code string, ts timestamp, rise double, batch long").parquet(folder)


def tick_bars(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of ``value`` by ``event_type`` and window; ticks later than ``late`` are dropped (extension)."""
    order = F.struct("ts", "event_id")
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    bars = rows.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select("event_type", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user's events (extension)."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("ts"), "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its rows as a table of files.

    A stream that only appends goes to the file sink, others (``complete``) write their
    last result, replacing the one before.
    """
    spark = stream.sparkSession
    folder, checkpoint = scratch(spark, "drained"), scratch(spark, "drained-progress")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


_QUOTES = """SELECT concat(lpad(cast(e.user_id AS string), 6, '0'), '.', coalesce(m.market, 'XX')) AS Code, CASE WHEN e.event_type = 'error' THEN '1' ELSE '0' END AS ErrorId, e.value AS Now, l.last_close AS LastClose, cast(e.event_id AS double) AS Volume, e.ts
    FROM {events} e LEFT JOIN master m ON m.code = e.user_id LEFT JOIN last_closes l ON l.user_id = e.user_id AND l.day = cast(e.ts AS date)"""
_RISES = """SELECT q.Code AS code, q.ts, round((Now - CASE WHEN LastClose > 0 THEN LastClose ELSE Now - 0.01 END) / nullif(CASE WHEN LastClose > 0 THEN LastClose ELSE Now - 0.01 END, 0) * 100, 2) AS rise FROM ticks q JOIN listed u ON u.code = q.Code WHERE ErrorId = '0' AND Now > 0"""


def add(flow: Flow) -> None:
    flow.step(
        last_closes="SELECT user_id, day, lag(close) OVER (PARTITION BY user_id ORDER BY day) AS last_close FROM (SELECT user_id, cast(ts AS date) AS day, max_by(value, struct(ts, event_id)) AS close FROM {events} GROUP BY user_id, cast(ts AS date)) d",
        listed="SELECT DISTINCT concat(lpad(cast(code AS string), 6, '0'), '.', market) AS code FROM master WHERE market IN ('SH', 'SZ') AND status = 'active'",
        ticks=_QUOTES,
    )


def _raw_quotes(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    """Events as JSON quotes in files, as a stream: value, ts."""
    rows = flow.run("SELECT Code, ErrorId, Now, LastClose, Volume, ts FROM ticks")

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = stored(rows(spark, sf_dir).select(F.to_json(F.struct("Code", "ErrorId", "Now", "LastClose", "Volume")).alias("value"), F.col("ts").cast("timestamp").alias("ts")), "raw-quotes")
        return spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rpartition("/")[0]) if table.inputFiles() else table

    return made


def first_rise(flow: Flow, threshold: float = 5.0) -> Callable[[SparkSession, str], DataFrame]:
    """Fire-once alerts over JSON quotes: each code's first quote above its last close of the day before."""
    raw, listed = _raw_quotes(flow), flow.run("SELECT code FROM listed")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch(spark, "alerts")
        monitor(raw(spark, sf_dir), lambda: listed(spark, sf_dir), folder, scratch(spark, "alerts-progress"), threshold).awaitTermination()
        return spark.read.schema("code string, ts timestamp, rise double").parquet(folder).select("code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "rise")

    return query


#: The debounced query's gap: quotes of a code are hours apart.
GAP = 86_400.0


def debounced_rises(flow: Flow, seconds: float = GAP, threshold: float = 5.0) -> Callable[[SparkSession, str], DataFrame]:
    """Alerts of a code at least a day apart, by keyed state with timers."""
    raw, listed = _raw_quotes(flow), flow.run("SELECT code FROM listed")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        before = spark.conf.get(key, None)
        spark.conf.set(key, store)
        try:
            rows = drained(debounced(risen(parse_quotes(raw(spark, sf_dir)), listed(spark, sf_dir), threshold), seconds, late="1 hour"))
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        return rows.select("code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "rise")

    return query


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream in complete mode: all windows, late or not."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = drained(tick_bars(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), "complete")
    return rows.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("hour"), "open", "high", "low", "close", "n")


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    rises, at = f"rises AS ({" ".join(_RISES.split())})", "strftime(ts, '%Y-%m-%d %H:%M:%S') AS at"
    head = flow.duckdb("SELECT 1 AS x FROM ticks JOIN listed")
    head = head[: head.rindex("SELECT 1 AS x")].rstrip()
    return (
        {"stream_first_rise": first_rise(flow), "stream_debounced": debounced_rises(flow), "stream_tick_bars": streamed_bars},
        {
            "stream_first_rise": f"{head}, {rises} SELECT code, {at}, rise FROM rises WHERE rise > 5 QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts, rise) = 1",
            "stream_debounced": f"""{head.replace("WITH ", "WITH RECURSIVE ", 1)}, {rises}, far AS (SELECT code, ts, rise FROM rises WHERE rise > 5), kept AS (
                SELECT code, min(row(ts, rise)) AS x FROM far GROUP BY code UNION ALL SELECT code, x FROM (SELECT k.code, min(row(f.ts, f.rise)) AS x FROM kept k JOIN far f ON f.code = k.code AND epoch_us(f.ts) - epoch_us(k.x[1]) >= {int(GAP * 1_000_000)} GROUP BY k.code))
              SELECT code, strftime(x[1], '%Y-%m-%d %H:%M:%S') AS at, x[2] AS rise FROM kept""",
            "stream_tick_bars": """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close, count(*) AS n
                FROM events GROUP BY event_type, date_trunc('hour', ts)""",
        },
    )
