"""Ranks among known rows, against pandas."""

import random

import pandas as pd

from tidemill.operators import rolling_panel
from tidemill.plans import registry


def test_ranks_among_known_rows(spark):
    draw = random.Random(5)
    rows = [(t, draw.choice([0.5, 1.0, 1.5, draw.random()]), draw.choice([None, 2.0, draw.random()])) for t in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "ts int, value double, y double")
    df.createOrReplaceTempView("ranked_rows")
    got = spark.sql(f"SELECT *, {rolling_panel._known_rank('value', 'y', 'ts')} AS a, {rolling_panel._known_rank('y', 'y', 'ts')} AS b FROM ranked_rows").toPandas()
    known = got[got.y.notna()]
    assert len(known) and (known.groupby("ts").value.rank() == known.a).all() and (known.groupby("ts").y.rank() == known.b).all()


def test_dates_and_horizons_of_a_fitted_panel(spark, sf_dir):
    daily = registry._FLOW.run("SELECT factor, h, ts, n, ic FROM rolling_daily")(spark, sf_dir).toPandas()
    panel = registry._FLOW.run("SELECT * FROM rolling_panel")(spark, sf_dir).toPandas()
    assert len(daily) and (daily.n >= rolling_panel.CODES).all()
    for r in daily.itertuples():
        rows = panel[(panel.ts == r.ts) & panel[f"y{r.h}"].notna()]
        want = rows[r.factor].rank().corr(rows[f"y{r.h}"].rank())
        assert r.n == len(rows) and (pd.isna(want) and pd.isna(r.ic) or abs(want - r.ic) < 1e-9)
