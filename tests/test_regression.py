"""Fits from moments against numpy, with awkward columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import regression


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(11)
    made = {}
    for g in range(6):
        x = rng.normal(size=(60, 5)) * [1, 1e3, 1e-2, 5, 20] + [0, 50, 0, 1, 0]
        y = x @ [2, 1e-3, 30, 0, -0.1] + rng.normal(size=60)
        made[g] = x, y
    made[1][0][:, 3] = 4.0  # constant
    made[2][0][:, 4] = 2 * made[2][0][:, 1] - made[2][0][:, 0]  # depends on others
    made[3][0][:, 2] = 0.0
    made[4] = made[4][0][:3], made[4][1][:3]  # fewer rows than columns
    made[5] = made[5][0], np.full(60, 7.0)
    return made


def test_fits_are_those_of_numpy(spark, groups):
    rows = [(g, *map(float, r), float(v)) for g, (x, y) in groups.items() for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"x{i} double" for i in range(5)) + ", y double")
    sums = df.groupBy("g").agg(regression.moments([f"x{i}" for i in range(5)] + ["y"]).alias("m"))
    got = {r["g"]: r for r in regression.least_squares(sums, 5).collect()}
    for g, (x, y) in groups.items():
        r, theta = got[g], np.array(got[g]["theta"])
        units = np.sqrt((x**2).sum(axis=0))
        units[units == 0] = 1
        best, _, rank, _ = np.linalg.lstsq(x / units, y, rcond=1e-7)
        assert r["rank"] == rank and np.allclose(x @ theta, x @ (best / units), rtol=1e-5, atol=1e-5)
        loss = ((y - x @ (best / units)) ** 2).mean()
        assert r["loss"] == pytest.approx(loss, rel=1e-5, abs=1e-8)
        if rank == 5:
            assert r["condition"] == pytest.approx(np.linalg.cond(x), rel=1e-6)
        else:
            assert r["condition"] is None
        if g == 5:
            assert r["r2"] is None
        elif len(y) > 5:
            assert r["r2"] == pytest.approx(1 - loss / y.var(), abs=1e-6)
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    x, y = groups[0]
    assert np.allclose(got[0]["x_corr"], [np.corrcoef(x.T)[i, j] for i, j in pairs], atol=1e-9)
    assert [v is None for v in got[1]["x_corr"]] == [3 in p for p in pairs]
    f = y - x @ np.array(got[0]["theta"])
    assert np.allclose(got[0]["f_corr"], [np.corrcoef(f, x[:, j])[0, 1] for j in range(5)], atol=1e-7)


@pytest.mark.parametrize("p", [1, 2, 6])
def test_eigenvalues(spark, p):
    a = np.random.default_rng(p).normal(size=(p + 3, p))
    a = a.T @ a
    m = F.array(*(F.lit(float(v)) for v in a.ravel()))
    r = spark.range(1).select(regression.symmetric_eigen(m, p).alias("e")).first()["e"]
    v = np.array(r["vectors"]).reshape(p, p)
    assert np.allclose(np.sort(r["values"]), np.linalg.eigvalsh(a), rtol=1e-10) and np.allclose(v @ np.diag(r["values"]) @ v.T, a, atol=1e-10)


def test_permuted_columns_hold_the_same_values(spark):
    rows = [(g, i + 1, float(10 * g + i), float(i * i), float(-i)) for g in range(3) for i in range(20 + g)]
    df = spark.createDataFrame(rows, "g int, place long, a double, b double, y double")
    got = regression.permuted(df, ["g"], "place", ["a", "b"], "y", 42).toPandas()
    for g in range(3):
        mine = got[got.g == g].sort_values("place")
        want = [r for r in rows if r[0] == g]
        assert mine.y.tolist() == [r[4] for r in want]
        for k, c in ((2, "a"), (3, "b")):
            assert sorted(mine[c]) == sorted(r[k] for r in want) and mine[c].tolist() != [r[k] for r in want]
    again = regression.permuted(df.repartition(7), ["g"], "place", ["a", "b"], "y", 42).toPandas()
    assert got.sort_values(["g", "place"]).reset_index(drop=True).equals(again.sort_values(["g", "place"]).reset_index(drop=True))
    other = regression.permuted(df, ["g"], "place", ["a", "b"], "y", 43).toPandas()
    assert not other.sort_values(["g", "place"]).a.reset_index(drop=True).equals(got.sort_values(["g", "place"]).a.reset_index(drop=True))
