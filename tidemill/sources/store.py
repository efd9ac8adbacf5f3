"""Tables of bars, panels and runs on disk: paths, atomic writes, readers, manifest.

One table holds all bars, partitioned by period and kind, so a period or a kind is a
partition filter and a write replaces whole partitions: readers see the old files or the
new ones. Queries here write to the session's shared folder and read back what they wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.plans.flow import Flow
from tidemill.plans.scratch import scratch

#: Kinds in the order in which a code is looked up, periods and their seconds.
KINDS = ("stocks", "sectors", "indices")
PERIODS = {"daily": 86400, "15m": 900, "5m": 300, "1m": 60, "weekly": 604800, "monthly": 2592000}
#: CSV of lists: quotes in a name are doubled, its line breaks and the blanks at its ends stay.
LIST = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
BARS = "code string, ts date, open double, high double, low double, close double, volume double, amount double, kind string, period string"


@dataclass(frozen=True)
class Config:
    """Parameters of a run: windows, gates, fees, forward horizon."""

    window: int = 30
    ahead: int = 5
    fit_windows: tuple[int, ...] = (60, 120, 240)
    ic_gate: float = 0.04
    icir_train: float = 0.5
    icir_test: float = 0.3
    turnover_most: float = 0.8
    correlation_most: float = 0.70
    population: int = 2000
    generations: int = 30
    sample_rows: int = 50_000
    sample_share: float = 0.3
    commission: float = 8.5e-5
    transfer: float = 1e-5
    stamp: float = 5e-4
    seed: int = 42
    names: dict[str, str] = field(default_factory=dict)


def checked(kind: str, period: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind!r}")
    if period not in PERIODS:
        raise ValueError(f"period is one of {', '.join(PERIODS)}, not {period!r}")


def path_of(root: str, kind: str | None = None, period: str = "daily") -> str:
    """Folder of a period's bars, or of one kind of them."""
    checked(kind or KINDS[0], period)
    return f"{root}/bars/period={period}" + (f"/kind={kind}" if kind else "")


def file_tag(code: str, period: str = "daily") -> str:
    """Name of one code's export: ``000001_SH_5m``."""
    checked(KINDS[0], period)
    return f"{code.replace('.', '_')}_{period}"


def parse_windows(text: str) -> tuple[int, ...]:
    """``60,120,240`` as whole numbers, each once, in order."""
    found = tuple(dict.fromkeys(int(x) for x in text.replace(" ", "").split(",") if x))
    if not found or min(found) < 1:
        raise ValueError(f"windows are positive whole numbers, not {text!r}")
    return found


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def save_bars(bars: DataFrame, root: str) -> None:
    """Write bars (columns of BARS); only the periods and kinds that are in them are replaced."""
    require_columns(bars, [f.name for f in StructType.fromDDL(BARS).fields])
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "kind").parquet(f"{root}/bars")


def load_bars(spark: SparkSession, root: str, period: str = "daily", kind: str | None = None) -> DataFrame:
    """Bars of a period; of a code that several kinds hold, those of the first kind in KINDS."""
    checked(kind or KINDS[0], period)
    rows = spark.read.schema(BARS).parquet(f"{root}/bars").where(F.col("period") == period)
    if kind:
        return rows.where(F.col("kind") == kind)
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    first = rows.groupBy("code").agg(F.min_by("kind", order).alias("kind"))
    return rows.join(first, ["code", "kind"])


def coalesced(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has their keys: the remote one first, then local copies."""
    found = sources[0]
    for other in sources[1:]:
        found = found.unionByName(other.join(found.select(*keys).distinct(), keys, "left_anti"))
    return found


def clean_bars(raw: DataFrame) -> DataFrame:
    """Text figures as numbers; what is none or not positive is null, rows without a close go."""
    number = lambda c: F.when(F.expr(f"try_cast(`{c}` AS double)") > 0, F.expr(f"try_cast(`{c}` AS double)"))
    return raw.select("code", "ts", *(number(c).alias(c) for c in ("open", "high", "low", "close")), F.expr("try_cast(volume AS double)").alias("volume")).where(F.col("close").isNotNull())


def save_manifest(entries: DataFrame, path: str) -> None:
    """Entries (code, kind, rows, start, end, fetched_at, status, period, reason) as one JSON map by code."""
    entry = F.struct(*(c for c in entries.columns if c != "code"))
    whole = entries.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", entry)))).alias("entries"), F.max("fetched_at").alias("generated_at"))
    whole.coalesce(1).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """Rows of a manifest; an absent one is empty."""
    schema = f"generated_at string, entries map<string, struct<{entry}>>"
    try:
        rows = spark.read.schema(schema).json(path)
        rows = rows.select(F.explode("entries").alias("code", "entry")).select("code", "entry.*")
        rows.limit(0).count()
        return rows
    except Exception as e:  # an absent path is the one error that means "no entries yet"
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL("code string, " + entry.replace(":", " ")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and of ``old`` those whose keys are not in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest_run(table: DataFrame, column: str = "run") -> DataFrame:
    """Rows of the newest run."""
    return table.join(F.broadcast(table.agg(F.max(column).alias(column))), column)  # one row


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of codes from CSV: ``code``, and ``name`` (null where there is none); all text, first of each code."""
    # by default Spark reads a quoted empty text as null too: what stands for null here is in no list
    rows = require_columns(spark.read.options(**LIST, nullValue="\0").csv(path), ["code"])
    name = F.col("name") if "name" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy("code").agg(F.min(name).alias("name"))


def optional(spark: SparkSession, path: str, schema: str, aliases: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """A table and ``loaded``; an absent or incomplete one is empty and ``not_loaded``."""
    want = StructType.fromDDL(schema)
    try:
        rows = spark.read.parquet(path)
        for old, new in (aliases or {}).items():
            rows = rows.withColumnRenamed(old, new) if new not in rows.columns else rows
        return require_columns(rows, want.names).select(*(F.col(f.name).cast(f.dataType) for f in want.fields)), "loaded"
    except ValueError:
        return spark.createDataFrame([], want), "not_loaded"
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], want), "not_loaded"


def aligned(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """``df`` with just these columns; missing ones and nulls are ``fill``."""
    return df.select(*(F.coalesce(F.col(c), F.lit(fill)).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))


def appended(cache: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both together, of equal keys the row that comes last in ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return cache.unionByName(new).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


ENTRY = "kind:string,n_rows:bigint,first_ts:string,last_ts:string,fetched_at:string,status:string,period:string"


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    bars = flow.run("SELECT cast(code AS string) AS code, ts, open, high, low, close, volume, amount, 'stocks' AS kind, 'weekly' AS period FROM bars")
    monthly = flow.run("SELECT cast(code AS string) AS code, ts, open, high, low, close, volume, amount, 'stocks' AS kind, 'monthly' AS period FROM bars_m")
    index = flow.run("SELECT index_code AS code, ts, close AS open, close AS high, close AS low, close, volume, amount, 'indices' AS kind, 'weekly' AS period FROM index_bars")
    manifest = flow.run("SELECT cast(code AS string) AS code, 'stocks' AS kind, n_rows, cast(first_ts AS string) AS first_ts, cast(last_ts AS string) AS last_ts, cast(last_ts AS string) AS fetched_at, state AS status, 'weekly' AS period FROM manifest")
    raw = flow.run("SELECT cast(code AS string) AS code, ts, CASE WHEN code % 5 = 0 THEN 'n/a' ELSE cast(round(open, 6) AS string) END AS open, cast(round(high, 6) AS string) AS high, cast(round(-low, 6) AS string) AS low, CASE WHEN volume > 60 THEN '' ELSE cast(round(close, 6) AS string) END AS close, cast(volume AS string) AS volume FROM bars")
    names = flow.run("SELECT cast(code AS string) AS code, name FROM master")
    fits = flow.run("SELECT code, round(k, 6) AS k_hat, round(c, 6) AS c_hat, round(r2, 6) AS dir_hit_rate FROM kc")
    features = flow.run("SELECT code, ts, f, size FROM factors WHERE f IS NOT NULL")

    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All bars written, one period replaced, another read back; a code's kind by their order."""
        root = scratch(spark, "bars")
        save_bars(bars(spark, sf_dir).unionByName(index(spark, sf_dir)).unionByName(monthly(spark, sf_dir)), root)
        save_bars(monthly(spark, sf_dir).where("volume > 10"), root)
        both = load_bars(spark, root, "weekly").unionByName(load_bars(spark, root, "monthly"))
        return both.groupBy("code", "kind", "period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))

    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A manifest written as JSON, read, upserted with what was fetched anew, written and read again."""
        path = scratch(spark, "manifest")
        save_manifest(manifest(spark, sf_dir), path)
        old = load_manifest(spark, path, ENTRY)
        anew = old.where("status <> 'ok'").withColumn("status", F.lit("retried")).withColumn("n_rows", F.col("n_rows") + 1)
        save_manifest(upserted(old, anew, ["code"]), path + "-2")
        return load_manifest(spark, path + "-2", ENTRY)

    def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clean_bars(raw(spark, sf_dir))

    def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Remote bars of the odd codes, local ones of the others."""
        both = bars(spark, sf_dir).select("code", "ts", F.round("close", 6).alias("close"))
        remote = both.where(F.col("code").cast("long") % 2 == 1).withColumn("source", F.lit("remote"))
        return coalesced([remote, both.withColumn("source", F.lit("local"))], ["code", "ts"])

    def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "list")
        names(spark, sf_dir).unionByName(names(spark, sf_dir)).write.options(**LIST).csv(path)
        return read_list(spark, path)

    def optionals(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A fit table under an old column name, one that is not there, one without a column."""
        path, out = scratch(spark, "fits"), None
        fits(spark, sf_dir).write.parquet(path)
        for name, where, schema in (("renamed", path, "code long, hit_rate double"), ("absent", path + "-none", "code long, hit_rate double"), ("incomplete", path, "code long, rmse double")):
            rows, status = optional(spark, where, schema, {"dir_hit_rate": "hit_rate"})
            part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("input"), F.lit(status).alias("status"), "n")
            out = part if out is None else out.unionByName(part)
        return out

    def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two runs of a panel as Parquet; of the newest one its columns aligned to a wanted list."""
        path = scratch(spark, "panel")
        for run, part in (("20240101_000000", "ts < date '1995-01-01'"), ("20240201_000000", "ts >= date '1995-01-01'")):
            features(spark, sf_dir).where(part).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
        newest = latest_run(spark.read.schema("code long, ts date, f double, size double, run string").parquet(path))
        return aligned(newest.select(F.col("code").cast("double").alias("code"), "f", "size"), ["code", "f", "missing"]).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f"), 6).alias("f"), F.sum("missing").alias("missing"))

    def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A cache and what was computed anew: of a code and day the newer row stays."""
        rows = features(spark, sf_dir).select("code", "ts", F.round("f", 8).alias("f"))
        return appended(rows.where("ts < date '1998-01-01'").withColumn("made", F.lit(1)), rows.where("ts >= date '1997-01-01'").withColumn("made", F.lit(2)), ["code", "ts"], "made")

    first = lambda sql: flow.duckdb("SELECT 1 FROM bars_m JOIN index_bars ON true JOIN manifest ON true JOIN kc ON true JOIN factors ON true").rsplit(" SELECT 1 FROM", 1)[0] + " " + sql
    found = {"bar_store": stored, "manifest_store": kept, "cleaned_bars": cleaned, "source_fallback": fallback, "stock_list": listed, "optional_inputs": optionals, "panel_store": panels, "feature_cache": cached}
    return found, {
        "bar_store": first("""SELECT code::VARCHAR AS code, 'stocks' AS kind, 'weekly' AS period, count(*) AS n, round(sum(volume), 2) AS volume FROM bars GROUP BY code UNION ALL SELECT index_code, 'indices', 'weekly', count(*), round(sum(volume), 2) FROM index_bars GROUP BY index_code
            UNION ALL SELECT code::VARCHAR, 'stocks', 'monthly', count(*), round(sum(volume), 2) FROM bars_m WHERE volume > 10 GROUP BY code"""),
        "manifest_store": first("SELECT code::VARCHAR AS code, 'stocks' AS kind, n_rows + (state <> 'ok')::INT AS n_rows, first_ts::DATE::VARCHAR AS first_ts, last_ts::DATE::VARCHAR AS last_ts, last_ts::DATE::VARCHAR AS fetched_at, if(state = 'ok', 'ok', 'retried') AS status, 'weekly' AS period FROM manifest"),
        "cleaned_bars": first("SELECT code::VARCHAR AS code, ts, if(code % 5 = 0, NULL, round(open, 6)) AS open, round(high, 6) AS high, NULL::DOUBLE AS low, round(close, 6) AS close, volume FROM bars WHERE volume <= 60"),
        "source_fallback": first("SELECT code::VARCHAR AS code, ts, round(close, 6) AS close, ['local', 'remote'][1 + code % 2] AS source FROM bars"),
        "stock_list": first("SELECT code::VARCHAR AS code, name FROM master"),
        "optional_inputs": first("SELECT 'renamed' AS input, 'loaded' AS status, count(*) AS n FROM kc UNION ALL VALUES ('absent', 'not_loaded', 0), ('incomplete', 'not_loaded', 0)"),
        "panel_store": first("SELECT code::DOUBLE AS code, count(*) AS n, round(sum(f), 6) AS f, 0.0 AS missing FROM factors WHERE f IS NOT NULL AND ts >= DATE '1995-01-01' GROUP BY code"),
        "feature_cache": first("SELECT code, ts, round(f, 8) AS f, if(ts >= DATE '1997-01-01', 2, 1) AS made FROM factors WHERE f IS NOT NULL"),
    }
