"""Nested searches on shared statistics: ridge (M07, H14), elastic net (M08) and their out-of-fold results."""
from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import gram

from .hypervectors import encoded
from .inputs import r, table, vectors
from .registry import query


def gappy_vectors(spark, sf):
    """All vectors with gaps in the first eight positions, one empty and one constant position, and outer folds of subjects."""
    gone = lambda i: (i < 8) & (F.pmod(F.col("vec_id") * 7 + i, F.lit(17)) == 0)
    vec = F.transform("vec", lambda x, i: F.when(gone(i) | (i == 60), None).when(i == 61, 1.5).otherwise(x))
    return vectors(spark, sf).withColumn("vec", vec).withColumn("fold", (F.col("subject") % 5 + 1).cast("int"))


def _cells(search):
    return search.table.select("outer_fold", "alpha", "l1_ratio", "k", "effective_k", r("mean_error", 7).alias("mean_error"), r("sd_error", 7).alias("sd_error"), r("violation", 7).alias("violation"), "selected")


@query("m07_nested_ridge")
def m07_nested(spark, sf):
    """The published grid: 5 penalties and 4 numbers of features on 3 inner folds of 5 outer training sets."""
    return _cells(gram.nested_search(gappy_vectors(spark, sf), "vec", "target_score", "subject", "fold")).drop("l1_ratio")


@query("m07_nested_ridge_predictions")
def m07_nested_predictions(spark, sf):
    rows = gappy_vectors(spark, sf)
    search = gram.nested_search(rows, "vec", "target_score", "subject", "fold")
    return search.predict(rows, "fold").select("vec_id", "fold", "target_score", "prediction_raw", "prediction_bounded")


@query("m08_nested_elastic_net")
def m08_nested(spark, sf):
    return _cells(gram.nested_search(gappy_vectors(spark, sf), "vec", "target_score", "subject", "fold", alphas=gram.NET_ALPHAS, ratios=gram.NET_RATIOS))


@query("h14_nested_readout")
def h14_nested(spark, sf):
    """The read-out penalty chosen on inner folds, on vectors divided by the root of their dimension."""
    rows = encoded(spark, sf, 256).withColumn("x", F.transform("hv", lambda v: v / F.lit(16.0))).withColumn("outer_fold", (F.col("subject") % 5 + 1).cast("int"))
    search = gram.nested_search(rows, "x", "target_score", "subject", "outer_fold", tops=("all",), standardize=False)
    return _cells(search).drop("l1_ratio")


# Two features of all line items: moments of every training set give the standardised 2 x 2 system, which has a closed form.
_PAIRS = """d AS (
  SELECT l_suppkey, l_suppkey % 5 + 1 AS fold, (l_suppkey // 5) % 3 + 1 AS inner_fold, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b,
    1 + CAST(l_extendedprice AS DOUBLE) / 35000 AS y FROM lineitem)"""


def pairs(spark, sf):
    d = lambda c: F.col(c).cast("double")
    return table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_suppkey") % 5 + 1).cast("int").alias("fold"), (F.expr("l_suppkey div 5") % 3 + 1).cast("int").alias("inner_fold"),
        F.array(d("l_quantity"), d("l_discount")).alias("vec"), (1 + d("l_extendedprice") / 35000).alias("y"),
    )


_NESTED = f"""{_PAIRS}, o AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS outer_fold), i AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS cell),
m AS (SELECT outer_fold, cell, count(*) AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my, corr(a, b) AS rab,
  corr(a, y) AS ra, corr(b, y) AS rb, stddev_pop(y) AS sy FROM d, o, i WHERE fold <> outer_fold AND inner_fold <> cell GROUP BY outer_fold, cell),
grid AS (SELECT unnest([0.01::DOUBLE, 0.1, 1, 10, 100]) AS alpha), ks AS (SELECT unnest([1, 2]) AS k),
w AS (SELECT *, 1 + alpha / n AS p,
  CASE WHEN k = 2 THEN sy * ((1 + alpha / n) * ra - rab * rb) / ((1 + alpha / n) ** 2 - rab * rab) WHEN ra * ra > rb * rb THEN sy * ra / (1 + alpha / n) ELSE 0 END AS wa,
  CASE WHEN k = 2 THEN sy * ((1 + alpha / n) * rb - rab * ra) / ((1 + alpha / n) ** 2 - rab * rab) WHEN ra * ra > rb * rb THEN 0 ELSE sy * rb / (1 + alpha / n) END AS wb FROM m, grid, ks),
e AS (SELECT outer_fold, cell, alpha, k, avg(abs(greatest(1, least(4, my + wa * (a - ma) / sa + wb * (b - mb) / sb)) - y)) AS error
  FROM w JOIN d ON d.fold <> w.outer_fold AND d.inner_fold = w.cell GROUP BY outer_fold, cell, alpha, k),
g AS (SELECT outer_fold, alpha, k, avg(error) AS mean_error, stddev_pop(error) AS sd_error FROM e GROUP BY outer_fold, alpha, k),
chosen AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY mean_error, alpha DESC, k) = 1)"""


def _searched(spark, sf):
    rows = pairs(spark, sf)
    groups = rows.select("l_suppkey", "fold", "inner_fold").distinct().withColumn("outer_fold", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("outer_fold <> fold")
    return rows, gram.nested_search(rows, "vec", "y", "l_suppkey", "fold", tops=(1, 2), inner=groups.select("l_suppkey", "outer_fold", "inner_fold"))


@query("m07_nested_ridge_low_dimension", f"""
WITH {_NESTED} SELECT g.outer_fold, g.alpha, CAST(g.k AS VARCHAR) AS k, CAST(g.k AS INTEGER) AS effective_k, round(g.mean_error, 7) AS mean_error, round(g.sd_error, 7) AS sd_error,
  0.0::DOUBLE AS violation, c.outer_fold IS NOT NULL AS selected FROM g LEFT JOIN chosen c ON g.outer_fold = c.outer_fold AND g.alpha = c.alpha AND g.k = c.k""")
def m07_nested_low(spark, sf):
    return _cells(_searched(spark, sf)[1]).drop("l1_ratio")


@query("m12_nested_ridge_oof", f"""
WITH {_NESTED} SELECT c.outer_fold, c.alpha, CAST(c.k AS VARCHAR) AS k, count(*) AS test_rows,
  round(avg(abs(greatest(1, least(4, my + wa * (a - ma) / sa + wb * (b - mb) / sb)) - y)), 7) AS mae_bounded, round(avg(abs(my + wa * (a - ma) / sa + wb * (b - mb) / sb - y)), 7) AS mae_raw
FROM chosen c JOIN w ON w.outer_fold = c.outer_fold AND w.alpha = c.alpha AND w.k = c.k AND w.cell = 0 JOIN d ON d.fold = c.outer_fold GROUP BY c.outer_fold, c.alpha, c.k""")
def m12_oof(spark, sf):
    """The chosen cell of every outer fold, refitted on its training set and measured on the rows it did not see."""
    rows, search = _searched(spark, sf)
    error = lambda c: r(F.avg(F.abs(F.col(c) - F.col("y"))), 7)
    out = search.predict(rows, "fold").groupBy(F.col("fold").alias("outer_fold")).agg(
        F.count(F.lit(1)).alias("test_rows"), error("prediction_bounded").alias("mae_bounded"), error("prediction_raw").alias("mae_raw")
    )
    return search.table.where("selected").select("outer_fold", "alpha", "k").join(out, "outer_fold")


# Orthogonal columns: quantity, and what is left of the discount after its regression on quantity.
@query("m08_elastic_net_orthogonal", f"""
WITH {_PAIRS}, s AS (SELECT regr_slope(b, a) AS slope, regr_intercept(b, a) AS level FROM d), q AS (SELECT a, b - level - slope * a AS b, y FROM d, s),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, stddev_pop(b) AS sb, avg(b) AS mb, avg(y) AS my, covar_pop(a, y) / stddev_pop(a) AS ca, covar_pop(b, y) / stddev_pop(b) AS cb FROM q),
w AS (SELECT *, sign(ca) * greatest(abs(ca) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) / sa AS wa, sign(cb) * greatest(abs(cb) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) / sb AS wb
  FROM m, (SELECT unnest([0.001::DOUBLE, 0.01, 0.1, 1]) AS alpha), (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS l1_ratio))
SELECT alpha, l1_ratio, round(my - wa * ma - wb * mb, 7) + 0.0 AS intercept, round(wa, 8) + 0.0 AS quantity, round(wb, 7) + 0.0 AS discount, 0.0::DOUBLE AS violation FROM w""")
def m08_orthogonal(spark, sf):
    a, b = F.get("vec", F.lit(0)), F.get("vec", F.lit(1))
    rows = pairs(spark, sf)
    line = rows.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("level")).first()
    rest = rows.withColumn("vec", F.array(a, b - F.lit(line["level"]) - F.lit(line["slope"]) * a))
    fitted = gram.fit(rest, "vec", "y", gram.NET_ALPHAS, ratios=gram.NET_RATIOS)
    return fitted.select(
        "alpha", "l1_ratio", r("intercept", 7).alias("intercept"), r(F.get("weights", F.lit(0)), 8).alias("quantity"), r(F.get("weights", F.lit(1)), 7).alias("discount"), r("violation", 7).alias("violation")
    )
