"""Least squares of each group with p columns, and its diagnostics, from one aggregate of moments.

The moments of a group are the sums of all products of (1, x_1 .. x_p, y): one ``groupBy``
with partial sums, whatever the number of groups and of their rows. The fit is an
expression over them. The eigenvalues of the Gram matrix come from Jacobi turns, folded
over an array, so rank, condition and the solution of least norm are at hand for any p.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import average_rank, correlation
from tidemill.plans.flow import Flow
from tidemill.plans.scratch import stored

#: Turns of each pair of columns; eigenvalues below this share of the largest are none.
SWEEPS, RANK = 7, 1e-14


def moments(columns: list[str]) -> Column:
    """Sums of products of (1, *columns): the upper triangle, row by row."""
    terms = ["1e0", *columns]
    return F.array(*(F.expr(f"sum(cast({a} AS double) * {b})") for i, a in enumerate(terms) for b in terms[i:]))


def _entry(m: Column, i: int, j: int, size: int) -> Column:
    i, j = min(i, j), max(i, j)
    return m[i * size - i * (i - 1) // 2 + j - i]


def symmetric_eigen(matrix: Column, p: int, sweeps: int = SWEEPS) -> Column:
    """Eigenvalues and vectors of a p x p array (by rows), as a struct of arrays; column i of ``vectors`` belongs to value i."""
    cells = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r in range(p) for k in range(p)))
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)] * sweeps

    def turn(state: Column, pair: Column) -> Column:
        i, j, a, v = pair["i"], pair["j"], state["a"], state["v"]
        off = a[i * p + j]
        gap = (a[j * p + j] - a[i * p + i]) / (F.lit(2.0) * off)
        tan = F.when(F.abs(off) <= F.lit(1e-300), F.lit(0.0)).otherwise(F.when(gap >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)) / (F.abs(gap) + F.sqrt(gap * gap + 1)))
        cosine = F.lit(1.0) / F.sqrt(tan * tan + 1)

        def turned(c: Column) -> Column:
            cos, sin = c["cos"], c["sin"]
            left = lambda at: F.when(at["r"] == i, cos * a[i * p + at["k"]] - sin * a[j * p + at["k"]]).when(at["r"] == j, sin * a[i * p + at["k"]] + cos * a[j * p + at["k"]]).otherwise(a[at["r"] * p + at["k"]])
            right = lambda m, at: F.when(at["k"] == i, cos * m[at["r"] * p + i] - sin * m[at["r"] * p + j]).when(at["k"] == j, sin * m[at["r"] * p + i] + cos * m[at["r"] * p + j]).otherwise(m[at["r"] * p + at["k"]])
            both = F.transform(F.array(F.transform(cells, left)), lambda m: F.transform(cells, lambda at: right(m, at)))[0]
            return F.struct(both.alias("a"), F.transform(cells, lambda at: right(v, at)).alias("v"))

        return F.transform(F.array(F.struct(cosine.alias("cos"), (tan * cosine).alias("sin"))), turned)[0]

    start = F.struct(matrix.alias("a"), F.array(*(F.lit(float(r == k)) for r in range(p) for k in range(p))).alias("v"))
    turns = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs)) if pairs else F.array().cast("array<struct<i:int,j:int>>")
    return F.aggregate(turns, start, turn, lambda s: F.struct(F.array(*(s["a"][i * p + i] for i in range(p))).alias("values"), s["v"].alias("vectors")))


def _total(terms) -> Column:
    return reduce(Column.__add__, terms)


def residual(m: Column, theta: Column, p: int) -> Column:
    """Sum of squares of y - x theta over the rows behind the moments ``m``."""
    size = p + 2
    cross = _total(theta[j] * _entry(m, j + 1, size - 1, size) for j in range(p))
    return _entry(m, size - 1, size - 1, size) - 2 * cross + _total(theta[i] * theta[j] * _entry(m, i + 1, j + 1, size) for i in range(p) for j in range(p))


def spread(m: Column, p: int) -> Column:
    """Sum of squares of y about its mean."""
    y = p + 1
    return _entry(m, y, y, p + 2) - _entry(m, 0, y, p + 2) * _entry(m, 0, y, p + 2) / _entry(m, 0, 0, p + 2)


def r_squared(m: Column, theta: Column, p: int, least: int = 1) -> Column:
    """1 - residual / spread of y; null for a constant y or fewer than ``least`` rows."""
    return F.when((spread(m, p) > 1e-12) & (_entry(m, 0, 0, p + 2) >= least), 1 - residual(m, theta, p) / spread(m, p))


def least_squares(sums: DataFrame, p: int, m: str = "m") -> DataFrame:
    """``sums`` (a row a group, moments in ``m``) with the fit of y on its p columns.

    theta (least norm, in units of the columns' sizes, where they depend), rank, condition (of the columns; null where
    singular), loss (mean square), r2, x_corr (the p(p-1)/2 correlations of the columns by
    pairs) and f_corr (of the residual with each column). Correlations with something
    constant are null.
    """
    size = p + 2
    col, pair = F.col(m), [(i, j) for i in range(p) for j in range(i + 1, p)]
    n = _entry(col, 0, 0, size)
    mean = lambda i: _entry(F.col(m), 0, i, size) / _entry(F.col(m), 0, 0, size)
    cov = lambda i, j: _entry(F.col(m), i, j, size) / _entry(F.col(m), 0, 0, size) - mean(i) * mean(j)
    # solved with columns of unit size, so that rank does not depend on their units
    unit = lambda i: F.when(_entry(F.col(m), i + 1, i + 1, size) > 0, F.sqrt(_entry(F.col(m), i + 1, i + 1, size))).otherwise(F.lit(1.0))
    out = sums.withColumn("_unit", F.array(*(unit(i) for i in range(p))))
    gram = lambda i, j: _entry(F.col(m), i + 1, j + 1, size)
    out = out.withColumn("_eigen", symmetric_eigen(F.array(*(gram(i, j) / (F.col("_unit")[i] * F.col("_unit")[j]) for i in range(p) for j in range(p))), p))
    out = out.withColumn("_raw", symmetric_eigen(F.array(*(gram(i, j) for i in range(p) for j in range(p))), p)["values"])
    values, vectors = F.col("_eigen.values"), F.col("_eigen.vectors")
    out = out.select("*", values.alias("_values"), vectors.alias("_vectors"))
    kept = lambda i: F.col("_values")[i] > RANK * F.array_max("_values")
    along = [F.when(kept(i), _total(F.col("_vectors")[k * p + i] * _entry(col, k + 1, size - 1, size) / F.col("_unit")[k] for k in range(p)) / F.col("_values")[i]).otherwise(F.lit(0.0)) for i in range(p)]
    out = out.withColumn("_along", F.array(*along))
    out = out.withColumn("theta", F.array(*(_total(F.col("_vectors")[r * p + i] * F.col("_along")[i] for i in range(p)) / F.col("_unit")[r] for r in range(p))))
    theta = F.col("theta")
    out = out.withColumn("rank", _total(kept(i).cast("int") for i in range(p)))
    out = out.withColumn("condition", F.when((F.col("rank") == p) & (F.array_min("_raw") > 0), F.sqrt(F.array_max("_raw") / F.array_min("_raw"))))
    out = out.withColumn("_f_mean", mean(size - 1) - _total(theta[j] * mean(j + 1) for j in range(p))).withColumn("_rss", residual(col, theta, p))
    out = out.withColumn("loss", F.col("_rss") / n).withColumn("r2", r_squared(col, theta, p))
    wide = lambda i: cov(i, i) > 1e-24
    f_var = F.col("_rss") / n - F.col("_f_mean") * F.col("_f_mean")
    f_cov = lambda j: (_entry(F.col(m), j + 1, size - 1, size) - _total(theta[k] * _entry(F.col(m), j + 1, k + 1, size) for k in range(p))) / n - F.col("_f_mean") * mean(j + 1)
    out = out.withColumn("x_corr", F.array(*(F.when(wide(i + 1) & wide(j + 1), cov(i + 1, j + 1) / F.sqrt(cov(i + 1, i + 1) * cov(j + 1, j + 1))) for i, j in pair)) if pair else F.array().cast("array<double>"))
    out = out.withColumn("f_corr", F.array(*(F.when(wide(j + 1) & (f_var > 1e-24), f_cov(j) / F.sqrt(f_var * cov(j + 1, j + 1))) for j in range(p))))
    return out.drop("_unit", "_eigen", "_raw", "_values", "_vectors", "_along", "_f_mean", "_rss")


# The diagnostic split of the four models of self-force.

#: A fit's share of rows, and its least number of rows.
TRAIN, LEAST = 0.7, 20
COLUMNS = ("x0", "x1", "x2")


def _status(rank: Column, condition: Column) -> Column:
    return F.when((rank < 2) | condition.isNull(), "singular").when(condition < 1e3, "well_conditioned").when(condition < 1e5, "ill_conditioned").otherwise("unidentifiable")


def _quality(r2: Column) -> Column:
    return F.when(r2.isNull(), "uninformative").when(r2 >= 0.1, "good").when(r2 >= 0.01, "weak").otherwise("poor")


def permuted(rows: DataFrame, keys: list[str], place: str, columns: list[str], y: str, seed: int) -> DataFrame:
    """Rows whose ``columns`` are each dealt anew over the places of their group; y stays.

    The permutation of a column is the order of digests of seed, column and place. Each
    column travels to its new place by one shuffle on the keys.
    """
    order = lambda j: f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY md5(concat('{seed}:{j}:', cast({place} AS string))))"
    placed = rows.select(*keys, F.col(place).cast("int").alias("_at"), F.col(y).cast("double").alias("_y"), *(F.struct(F.lit(j).alias("j"), F.expr(order(j)).alias("at"), F.col(c).cast("double").alias("v")).alias(f"_{j}") for j, c in enumerate(columns)))
    dealt = placed.select(*keys, F.explode(F.array(*(F.col(f"_{j}") for j in range(len(columns))), F.struct(F.lit(len(columns)).alias("j"), F.col("_at").alias("at"), F.col("_y").alias("v")))).alias("x"))
    pick = lambda j, name: F.max(F.when(F.col("x.j") == j, F.col("x.v"))).alias(name)
    return dealt.groupBy(*keys, F.col("x.at").alias(place)).agg(*(pick(j, c) for j, c in enumerate(columns)), pick(len(columns), y))


def split_fits(flow: Flow, seed: int = 42) -> Callable[[SparkSession, str], DataFrame]:
    """36 diagnostics of each code and model: fits of the first 70 % of its rows and of the rest, and how the first do on the rest.

    Models 0 and 1 have two columns, 2 and 3 three; values are in thousands, so the loss is
    in millions. Fewer than 20 rows are ``singular``. ic_null is of a fit to permuted
    columns.
    """
    source = flow.run("SELECT * FROM design_rows")
    names = flow.run("SELECT code, name, index_code, index_tag, stock_tag FROM tagged")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = ["code", "model"]
        rows = stored(source(spark, sf_dir), "design-rows")
        enough = rows.where(F.col("n") >= LEAST).withColumn("scope", F.when(F.col("place") <= F.floor(TRAIN * F.col("n")), "train").otherwise("test"))
        null = permuted(enough.where("scope = 'train'"), keys, "place", list(COLUMNS), "y", seed)
        fits = None
        for models, columns in (("model < 2", list(COLUMNS[1:])), ("model >= 2", list(COLUMNS))):
            p = len(columns)
            sums = enough.where(models).groupBy(*keys, "scope").agg(moments([*columns, "y"]).alias("m"))
            sums = sums.unionByName(null.where(models).groupBy(*keys).agg(F.lit("null").alias("scope"), moments([*columns, "y"]).alias("m")))
            fit = least_squares(sums, p)
            part = lambda scope, *names: F.max(F.when(F.col("scope") == scope, F.struct(*names))).alias(scope)
            one = fit.groupBy(*keys).agg(part("train", "m", "theta", "rank", "condition", "loss", "r2", "x_corr", "f_corr"), part("test", "m", "theta", "r2"), part("null", "theta"))
            theta = lambda scope, p=p: [F.lit(None).cast("double")] * (3 - p) + [F.col(scope)["theta"][j] for j in range(p)]
            three = lambda scope, name, p=p: [F.col(scope)[name][j] if p == 3 else F.lit(None).cast("double") for j in range(3)]
            wide = one.select(
                *keys,
                F.col("train.m")[0].cast("long").alias("n_train"), F.coalesce(F.col("test.m")[0], F.lit(0.0)).cast("long").alias("n_test"), F.col("train.rank").alias("rank"), F.col("train.condition").alias("condition_number"),
                F.array_max(F.transform("train.x_corr", F.abs)).alias("regressor_corr"), F.exists("train.x_corr", lambda v: v.isNull()).alias("flat"), F.col("train.r2").alias("train_fit_r2"), F.col("train.loss").alias("f_self_loss"), F.col("test.r2").alias("test_fit_r2"),
                r_squared(F.col("test.m"), F.col("train.theta"), p, 2).alias("oos_r2"),
                *(t.alias(f"{x}_{s}") for s in ("train", "test", "null") for x, t in zip("qkc", theta(s), strict=True)),
                *(c.alias(name) for c, name in zip(three("train", "x_corr"), ("corr_x_beta_d", "corr_x_beta_u", "corr_x_d_u"), strict=True)), *(c.alias(name) for c, name in zip(three("train", "f_corr"), ("corr_F_beta_aM", "corr_F_d", "corr_F_u"), strict=True)),
            )
            fits = wide if fits is None else fits.unionByName(wide)
        fits = stored(fits, "split-fits")
        score = lambda s: f"coalesce(q_{s}, 0) * x0 + k_{s} * x1 + c_{s} * x2"
        tested = enough.where("scope = 'test'").select(*keys, "y", *COLUMNS).join(fits.select(*keys, *(f"{x}_{s}" for s in ("train", "null") for x in "qkc")), keys)
        tested = tested.selectExpr(*keys, "round(y, 8) AS y", f"round({score('train')}, 8) AS f", f"round({score('null')}, 8) AS g")
        ranked = tested.selectExpr(*keys, *(f"{average_rank(v, 'code, model')} AS {v}" for v in "yfg"))
        ics = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.expr(correlation("y", "f")).alias("ic_real"), F.expr(correlation("y", "g")).alias("ic_null"))
        few = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        out = few.join(fits, keys, "left").join(ics, keys, "left").join(names(spark, sf_dir), "code")
        fitted, base = F.col("n_train").isNotNull(), F.when(F.col("model") < 2, F.lit(1.0))
        q = lambda s: F.when(fitted, F.coalesce(base, F.col(f"q_{s}")))
        return out.select(
            "code", "name", "index_code", "index_tag", "stock_tag", "model", F.coalesce("n_train", "rows").alias("n_train"), F.coalesce("n_test", F.lit(0)).cast("long").alias("n_test"), "condition_number",
            F.when(~F.col("flat"), F.col("regressor_corr")).alias("regressor_corr"), F.col("train_fit_r2").alias("r2"), _status(F.coalesce("rank", F.lit(0)), F.col("condition_number")).alias("identification_status"), _quality(F.col("train_fit_r2")).alias("fit_quality"),
            F.coalesce(base, F.col("q_train")).alias("q_hat"), F.col("k_train").alias("k_hat"), F.col("c_train").alias("c_hat"), "f_self_loss", *(F.when(F.col("_n") >= 3, F.col(c)).alias(c) for c in ("ic_real", "ic_null")),
            q("train").alias("q_train_fit"), F.col("k_train").alias("k_train_fit"), F.col("c_train").alias("c_train_fit"), q("test").alias("q_test_fit"), F.col("k_test").alias("k_test_fit"), F.col("c_test").alias("c_test_fit"),
            (q("test") - q("train")).alias("q_drift"), (F.col("k_test") - F.col("k_train")).alias("k_drift"), (F.col("c_test") - F.col("c_train")).alias("c_drift"), "train_fit_r2", "test_fit_r2", "oos_r2",
            *(F.when(~F.col("flat"), F.col(c)).alias(c) for c in ("corr_x_beta_d", "corr_x_beta_u", "corr_x_d_u")), "corr_F_beta_aM", "corr_F_d", "corr_F_u",
        )

    return query


#: Decimal places of the columns of ``ablation_split``.
PLACES = {c: 4 for c in ("q_hat", "k_hat", "c_hat", "q_train_fit", "k_train_fit", "c_train_fit", "q_test_fit", "k_test_fit", "c_test_fit", "q_drift", "k_drift", "c_drift", "ic_real", "ic_null")} | {c: 5 for c in ("regressor_corr", "r2", "train_fit_r2", "test_fit_r2", "oos_r2", "corr_x_beta_d", "corr_x_beta_u", "corr_x_d_u", "corr_F_beta_aM", "corr_F_d", "corr_F_u")} | {"condition_number": 2, "f_self_loss": 2}


def split_sql() -> str:
    """DuckDB: Cramer's rule, roots of the characteristic polynomial, and correlations over the rows themselves."""
    x = COLUMNS
    sums = ", ".join(f"sum({a} * {b}) AS {a}{b}" for i, a in enumerate((*x, "y")) for b in (*x, "y")[i:])
    g = lambda a, b: f"{min(a, b)}{max(a, b)}"
    det3 = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    gram = [[g(a, b) for b in x] for a in x]
    swap = lambda j: [[f"{a}y" if k == j else gram[r][k] for k in range(3)] for r, a in enumerate(x)]
    two = "(x1x1 * x2x2 - x1x2 * x1x2)"
    over = lambda call, where: f"{call} FILTER (WHERE {where})"

    def corr(a: str, b: str, where: str) -> str:
        sa, sb = over(f"stddev_pop({a})", where), over(f"stddev_pop({b})", where)
        return f"CASE WHEN {sa} > 1e-12 AND {sb} > 1e-12 THEN {over(f'covar_pop({a}, {b})', where)} / ({sa} * {sb}) END"

    pairs = (("x0", "x1"), ("x0", "x2"), ("x1", "x2"), ("f", "x0"), ("f", "x1"), ("f", "x2"))
    train = "scope = 'train'"
    return f"""
    WITH d AS (SELECT *, CASE WHEN place <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS scope FROM design_rows WHERE n >= 20),
    o AS (SELECT code, model, place, y, {", ".join(f"row_number() OVER (PARTITION BY code, model ORDER BY md5('42:{j}:' || place)) AS r{j}, {c}" for j, c in enumerate(x))} FROM d WHERE scope = 'train'),
    z AS (SELECT p.code, p.model, p.place, p.y, a.x0, b.x1, c.x2 FROM o p JOIN o a ON a.code = p.code AND a.model = p.model AND a.r0 = p.place JOIN o b ON b.code = p.code AND b.model = p.model AND b.r1 = p.place JOIN o c ON c.code = p.code AND c.model = p.model AND c.r2 = p.place),
    s AS (SELECT code, model, scope, count(*) AS m, {sums} FROM (SELECT code, model, scope, y, x0, x1, x2 FROM d UNION ALL SELECT code, model, 'null', y, x0, x1, x2 FROM z) GROUP BY ALL),
    t AS (SELECT *, CASE WHEN model >= 2 THEN {det3(swap(0))} / {det3(gram)} ELSE 0 END AS q, CASE WHEN model >= 2 THEN {det3(swap(1))} / {det3(gram)} ELSE (x1y * x2x2 - x2y * x1x2) / {two} END AS k, CASE WHEN model >= 2 THEN {det3(swap(2))} / {det3(gram)} ELSE (x1x1 * x2y - x1x2 * x1y) / {two} END AS c FROM s),
    tr AS (SELECT * FROM t WHERE scope = 'train'), te AS (SELECT * FROM t WHERE scope = 'test'), nu AS (SELECT * FROM t WHERE scope = 'null'),
    e AS (SELECT d.*, d.y - tr.q * x0 - tr.k * x1 - tr.c * x2 AS f, d.y - coalesce(te.q, 0) * x0 - te.k * x1 - te.c * x2 AS h, rank() OVER w1 + (count(*) OVER (w1 RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2 AS ry, rank() OVER w2 + (count(*) OVER (w2 RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2 AS rf, rank() OVER w3 + (count(*) OVER (w3 RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2 AS rg
      FROM (SELECT d.code, d.model, d.scope, d.y, d.x0, d.x1, d.x2 FROM d) d JOIN (SELECT code, model, q, k, c FROM tr) tr USING (code, model) JOIN (SELECT code, model, q, k, c FROM te) te USING (code, model) JOIN (SELECT code, model, q, k, c FROM nu) nu USING (code, model)
      WINDOW w1 AS (PARTITION BY d.code, d.model, d.scope ORDER BY round(d.y, 8)), w2 AS (PARTITION BY d.code, d.model, d.scope ORDER BY round(tr.q * x0 + tr.k * x1 + tr.c * x2, 8)), w3 AS (PARTITION BY d.code, d.model, d.scope ORDER BY round(nu.q * x0 + nu.k * x1 + nu.c * x2, 8))),
    v AS (SELECT code, model, avg(f * f) FILTER (WHERE scope = 'train') AS loss, 1 - sum(f * f) FILTER (WHERE scope = 'train') / nullif(var_pop(y) FILTER (WHERE scope = 'train') * count(*) FILTER (WHERE scope = 'train'), 0) AS r2, 1 - sum(h * h) FILTER (WHERE scope = 'test') / nullif(var_pop(y) FILTER (WHERE scope = 'test') * count(*) FILTER (WHERE scope = 'test'), 0) AS r2_test,
        1 - sum(f * f) FILTER (WHERE scope = 'test') / nullif(var_pop(y) FILTER (WHERE scope = 'test') * count(*) FILTER (WHERE scope = 'test'), 0) AS r2_oos, {corr('ry', 'rf', "scope = 'test'")} AS ic, {corr('ry', 'rg', "scope = 'test'")} AS ic0,
        {", ".join(f"{corr(a, b, train)} AS {a}_{b}" for a, b in pairs)} FROM e GROUP BY code, model),
    l AS (SELECT code, model, CASE WHEN model < 2 THEN sqrt(((x1x1 + x2x2) / 2 + sqrt(((x1x1 - x2x2) / 2) ** 2 + x1x2 ** 2)) ** 2 / {two}) ELSE sqrt(most * (less + sqrt(less ** 2 - 4 * det / most)) / 2 / (det / most)) END AS cond FROM (
        SELECT *, (minors - det / most) / most AS less FROM (SELECT *, mid + 2 * w * cos(acos(least(1, greatest(-1, {det3([[f"(({gram[r][k]}{' - mid' if r == k else ''}) / w)" for k in range(3)] for r in range(3)])} / 2))) / 3) AS most, {det3(gram)} AS det, x0x0 * x1x1 - x0x1 ** 2 + x0x0 * x2x2 - x0x2 ** 2 + {two} AS minors FROM (
        SELECT *, (x0x0 + x1x1 + x2x2) / 3 AS mid, sqrt((2 * (x0x1 ** 2 + x0x2 ** 2 + x1x2 ** 2) + (x0x0 - (x0x0 + x1x1 + x2x2) / 3) ** 2 + (x1x1 - (x0x0 + x1x1 + x2x2) / 3) ** 2 + (x2x2 - (x0x0 + x1x1 + x2x2) / 3) ** 2) / 6) AS w FROM tr) a) b) c),
    r AS (SELECT r.code, g.name, g.index_code, g.index_tag, g.stock_tag, r.model, coalesce(tr.m, r.rows) AS n_train, coalesce(te.m, 0) AS n_test, l.cond AS condition_number, CASE WHEN r.model < 2 THEN abs(v.x1_x2) ELSE greatest(abs(v.x0_x1), abs(v.x0_x2), abs(v.x1_x2)) END AS regressor_corr, v.r2,
        CASE WHEN l.cond IS NULL THEN 'singular' WHEN l.cond < 1000 THEN 'well_conditioned' WHEN l.cond < 100000 THEN 'ill_conditioned' ELSE 'unidentifiable' END AS identification_status, CASE WHEN v.r2 IS NULL THEN 'uninformative' WHEN v.r2 >= 0.1 THEN 'good' WHEN v.r2 >= 0.01 THEN 'weak' ELSE 'poor' END AS fit_quality,
        CASE WHEN r.model < 2 THEN 1 ELSE tr.q END AS q_hat, tr.k AS k_hat, tr.c AS c_hat, v.loss AS f_self_loss, v.ic AS ic_real, v.ic0 AS ic_null, CASE WHEN tr.m IS NULL THEN NULL WHEN r.model < 2 THEN 1 ELSE tr.q END AS q_train_fit, tr.k AS k_train_fit, tr.c AS c_train_fit, CASE WHEN tr.m IS NULL THEN NULL WHEN r.model < 2 THEN 1 ELSE te.q END AS q_test_fit, te.k AS k_test_fit, te.c AS c_test_fit,
        CASE WHEN r.model < 2 THEN 0 * tr.k ELSE te.q - tr.q END AS q_drift, te.k - tr.k AS k_drift, te.c - tr.c AS c_drift, v.r2 AS train_fit_r2, v.r2_test AS test_fit_r2, v.r2_oos AS oos_r2, CASE WHEN r.model >= 2 THEN v.x0_x1 END AS corr_x_beta_d, CASE WHEN r.model >= 2 THEN v.x0_x2 END AS corr_x_beta_u, CASE WHEN r.model >= 2 THEN v.x1_x2 END AS corr_x_d_u,
        CASE WHEN r.model >= 2 THEN v.f_x0 END AS "corr_F_beta_aM", CASE WHEN r.model >= 2 THEN v.f_x1 END AS "corr_F_d", CASE WHEN r.model >= 2 THEN v.f_x2 END AS "corr_F_u"
      FROM (SELECT code, model, count(*) AS rows FROM design_rows GROUP BY code, model) r JOIN tagged g USING (code) LEFT JOIN tr USING (code, model) LEFT JOIN te USING (code, model) LEFT JOIN v USING (code, model) LEFT JOIN l USING (code, model))
    SELECT * REPLACE ({", ".join(f'round("{c}", {n}) + 0 AS "{c}"' for c, n in PLACES.items())}) FROM r"""


#: Of the fits of a model, over codes: how good, how certain, and against the first model.
SUMMARY = """SELECT a.model, count(*) AS n, round(median(a.r2), 4) + 0e0 AS median_r2, round(percentile(a.r2, 0.25), 4) + 0e0 AS p25_r2, round(percentile(a.r2, 0.75), 4) + 0e0 AS p75_r2, round(median(a.condition_number), 1) + 0e0 AS median_cond, round(median(a.ic_real), 3) + 0e0 AS median_ic_real, round(median(a.ic_null), 3) + 0e0 AS median_ic_null,
    round(median(a.ic_real - a.ic_null), 3) + 0e0 AS median_delta_ic, round(median(a.ic_real) - median(a.ic_null), 3) + 0e0 AS diff_of_medians_delta_ic, round(CASE WHEN a.model >= 2 THEN median(abs(a.q_hat - 1)) END, 3) + 0e0 AS median_abs_q_minus_1,
    round(CASE WHEN a.model > 0 THEN median(a.r2 - z.r2) END, 4) + 0e0 AS delta_r2_vs_m0, round(CASE WHEN a.model > 0 THEN median(a.ic_real - z.ic_real) END, 3) + 0e0 AS delta_ic_vs_m0 FROM {a} a JOIN {z} z ON a.code = z.code GROUP BY a.model"""


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    flow.step(
        design_rows="""SELECT code, m.m AS model, a - CASE WHEN m.m < 2 THEN g ELSE 0 END - CASE WHEN m.m IN (1, 3) THEN b ELSE 0 END AS y, CASE WHEN m.m >= 2 THEN g ELSE 0e0 END AS x0, x1, x2,
            row_number() OVER (PARTITION BY code, m.m ORDER BY part, ts) AS place, count(*) OVER (PARTITION BY code, m.m) AS n FROM extended CROSS JOIN (VALUES (0), (1), (2), (3)) AS m(m)""",
        tagged="SELECT code, name, index_code, split_part(index_code, '.', 1) AS index_tag, lpad(cast(code * 7919 % 1000000 AS string), 6, '0') AS stock_tag FROM master",
    )
    fits = split_fits(flow)

    def split(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fits(spark, sf_dir).withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c, n in PLACES.items()})

    def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stored(fits(spark, sf_dir).select("code", "model", "r2", "condition_number", "ic_real", "ic_null", "q_hat"), "split-summary")
        return spark.sql(SUMMARY, a=rows, z=rows.where("model = 0"))

    flow.oracles["ablation_split"] = " ".join(split_sql().split())
    whole = flow.oracle("ablation_split")
    raw = whole[: whole.rindex("SELECT * REPLACE")] + ", z0 AS (SELECT * FROM r WHERE model = 0) "
    return {"ablation_split": split, "ablation_metrics": summary}, {"ablation_split": whole, "ablation_metrics": raw + SUMMARY.format(a="r", z="z0").replace("percentile(", "quantile_cont(")}
