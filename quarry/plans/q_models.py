"""Modelling queries (M1–M28, E6, O3, O8): split, polynomial terms, fits, metrics, kNN, scoring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.functions.columns import hash_bucket
from quarry.models import pipeline as MP
from quarry.models import prep
from quarry.models.metrics import evaluate, overfit_flags
from quarry.plans.q_profile import lineitem_n
from quarry.plans.registry import query, rounded, table
from quarry.plans.sqlgen import LINEITEM_N_SQL

# A label with signal, identical in both engines (l_extendedprice is unrelated to the other columns).
LABEL_SPARK = ("3*l_quantity - 200*l_discount + 50*l_tax + "
               "(cast(conv(substr(md5(concat_ws('-',l_orderkey,l_linenumber)),1,8),16,10) as bigint) % 100)/100.0")
LABEL_SQL = ("3*l_quantity - 200*l_discount + 50*l_tax + "
             "(('0x'||substr(md5(concat_ws('-',l_orderkey,l_linenumber)),1,8))::UBIGINT % 100)/100.0")
# split on the reversed key so the split hash is independent of the label's noise hash
TEST_SQL = "(('0x'||substr(md5(concat_ws('-',l_linenumber,l_orderkey)),1,8))::UBIGINT % 100) < 20"
LI_Y_SQL = (f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {LABEL_SQL} AS y, "
            f"{TEST_SQL} AS is_test FROM lineitem")
SPLIT_CTE = f"WITH src AS ({LI_Y_SQL}), tr AS (SELECT * FROM src WHERE NOT is_test), te AS (SELECT * FROM src WHERE is_test) "


def _fold_sql(k: int) -> str:
    """The CV fold of a lineitem row (same md5 rule as prep.fold_column)."""
    return f"((('0x'||substr(md5(concat_ws('-',l_orderkey,l_linenumber)),1,8))::UBIGINT % 1000003) % {k})::INTEGER"


_FOLD_SQL = _fold_sql(5)


def li_y(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                                               F.expr(LABEL_SPARK).alias("y"))


def li_split(spark, sf):
    return prep.split(li_y(spark, sf), ["l_linenumber", "l_orderkey"], 0.2, 42)


@query(
    "hash_split",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS part FROM lineitem",
    ops="M1",
)
def hash_split(spark, sf):
    tr, te = li_split(spark, sf)
    return tr.select("l_orderkey", "l_linenumber", F.lit("train").alias("part")).unionByName(
        te.select("l_orderkey", "l_linenumber", F.lit("test").alias("part")))


_P = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql():
    terms = prep.poly_terms(_P, 2)
    sel = ", ".join(" * ".join(f"{_P[i]}::DOUBLE" for i in combo) + f" AS \"{label}\"" for label, combo in terms)
    return f"SELECT l_orderkey, l_linenumber, {sel} FROM lineitem"


@query("poly_expand_2", _poly_sql(), ops="M2")
def poly_expand_2(spark, sf):
    return rounded(prep.poly_expand(table(spark, sf, "lineitem"), _P, 2, keep=["l_orderkey", "l_linenumber"]), 6)


def _fit_1f(spark, sf, model, **params):
    tr, te = li_split(spark, sf)
    fm = MP.fit(tr, ["l_quantity"], "y", model, **params)
    return fm, tr, te


def _pred_out(fm, te):
    return rounded(fm.transform(te).select("l_orderkey", "l_linenumber", "prediction"))


def _lin1_sql(slope_s: str) -> str:
    """Predictions on the test part for a 1-feature model fitted in standardised space
    (x_s = (x − mean)/pop-std on the training part): ŷ = mean(y) + w·x_s."""
    return (SPLIT_CTE + ", st AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(y) AS my, count(*) AS n, "
            "covar_pop(l_quantity, y) AS cxy FROM tr), "
            f"w AS (SELECT *, {slope_s} AS ws FROM st) "
            "SELECT l_orderkey, l_linenumber, round(my + ws * ((l_quantity - mx) / sx), 4) AS prediction FROM te, w")


# in standardised space: Σ x_s (y − ȳ) / n = cov_pop(x, y) / σx
_C = "(cxy / sx)"


@query("linreg_1f", _lin1_sql(_C), ops="M4 M27")
def linreg_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "linear")
    return _pred_out(fm, te)


@query("ridge_1f", _lin1_sql(f"({_C} * n) / (n + 10.0)"), ops="M5")
def ridge_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "ridge", alpha=10.0)
    return _pred_out(fm, te)


@query("lasso_1f", _lin1_sql(f"sign({_C}) * greatest(abs({_C}) - 1.0, 0)"), ops="M6")
def lasso_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "lasso", alpha=1.0)
    return _pred_out(fm, te)


@query("enet_1f", _lin1_sql(f"sign({_C}) * greatest(abs({_C}) - 0.5, 0) / (1 + 0.5)"), ops="M7")
def enet_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "elasticnet", alpha=1.0, l1_ratio=0.5)
    return _pred_out(fm, te)


@query(
    "eval_metrics",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr), "
    "p AS (SELECT y, a + b * l_quantity AS pr FROM te, c) "
    "SELECT count(*) AS n, round(1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)), 4) AS r2, "
    "round(avg((y - pr) ^ 2), 4) AS mse, round(sqrt(avg((y - pr) ^ 2)), 4) AS rmse, round(avg(abs(y - pr)), 4) AS mae FROM p",
    ops="M16",
)
def eval_metrics(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "linear")
    return rounded(evaluate(fm.transform(te), "y"))


@query(
    "overfit_flags",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr), "
    "m AS (SELECT is_test, 1 - sum((y - (a + b * l_quantity)) ^ 2) / (count(*) * var_pop(y)) AS r2, "
    "avg((y - (a + b * l_quantity)) ^ 2) AS mse FROM src, c GROUP BY is_test), "
    "r AS (SELECT max(CASE WHEN NOT is_test THEN r2 END) AS train_r2, max(CASE WHEN is_test THEN r2 END) AS test_r2, "
    "max(CASE WHEN NOT is_test THEN mse END) AS train_mse, max(CASE WHEN is_test THEN mse END) AS test_mse FROM m) "
    "SELECT round(train_r2, 4) AS train_r2, round(test_r2, 4) AS test_r2, round(train_mse, 4) AS train_mse, "
    "round(test_mse, 4) AS test_mse, (test_r2 - train_r2) < -0.05 AS r2_overfit, "
    "CASE WHEN train_mse > 1e-9 THEN (test_mse - train_mse) / train_mse > 0.2 ELSE false END AS mse_overfit FROM r",
    ops="M24 M16",
)
def overfit_flags_q(spark, sf):
    fm, tr, te = _fit_1f(spark, sf, "linear")
    a = evaluate(fm.transform(tr), "y").select(F.col("r2").alias("train_r2"), F.col("mse").alias("train_mse"))
    b = evaluate(fm.transform(te), "y").select(F.col("r2").alias("test_r2"), F.col("mse").alias("test_mse"))
    runs = a.join(b)  # two one-row summaries
    return rounded(overfit_flags(runs).select("train_r2", "test_r2", "train_mse", "test_mse", "r2_overfit",
                                              "mse_overfit"))


@query(
    "batch_score",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr) "
    "SELECT l_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, 4) AS \"Predicted_Value\" FROM lineitem, c",
    ops="M25 S7",
)
def batch_score(spark, sf):
    from quarry.models.scoring import score

    fm, _tr, _te = _fit_1f(spark, sf, "linear")
    new = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(score(fm, new))


@query(
    "score_defaults",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a, "
    "quantile_cont(l_quantity, 0.5) AS med FROM tr) "
    f"SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, med), 4) AS l_quantity, "
    f"round(a + b * coalesce(l_quantity, med), 4) AS \"Predicted_Value\" FROM ({LINEITEM_N_SQL}), c",
    ops="M26 I11",
)
def score_defaults(spark, sf):
    from quarry.models.scoring import fit_defaults, score

    fm, tr, _te = _fit_1f(spark, sf, "linear")
    fm.defaults = fit_defaults(tr, ["l_quantity"])
    new = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(score(fm, new, fill_defaults=True))


# ------------------------------------------------------------------ kNN on embeddings

_EMB_TEST = "(('0x'||substr(md5(CAST(vec_id AS VARCHAR)),1,8))::UBIGINT % 100) < 20"


def _knn_sql(weighted: bool) -> str:
    agg = ("round(CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(y) FILTER (WHERE dist = 0) "
           "ELSE sum(y / dist) / sum(1.0 / dist) END, 4)" if weighted else "round(avg(y), 4)")
    return (
        f"WITH e AS (SELECT vec_id, embedding, label::DOUBLE AS y, {_EMB_TEST} AS is_test FROM embeddings), "
        "d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.y, sqrt(list_sum([(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) ^ 2 "
        "FOR i IN range(1, len(q.embedding) + 1)])) AS dist FROM e q, e t WHERE q.is_test AND NOT t.is_test), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d) "
        f"SELECT qid AS vec_id, {agg} AS prediction FROM r WHERE rn <= 5 GROUP BY qid"
    )


def _knn(spark, sf, weights):
    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding")).alias("emb"),
                                               F.col("label").cast("double").alias("y"))
    test = hash_bucket("vec_id", buckets=100) < 20
    tr, te = e.filter(~test), e.filter(test)
    fm = MP.fit(tr.withColumnRenamed("emb", "embedding_vec"), ["embedding_vec"], "y", "knn", scale=False,
                n_neighbors=5, weights=weights, id_col="vec_id")
    return rounded(fm.transform(te.withColumnRenamed("emb", "embedding_vec")).select("vec_id", "prediction"))


@query("knn_exact", _knn_sql(False), ops="M14 (uniform)")
def knn_exact(spark, sf):
    return _knn(spark, sf, "uniform")


@query("knn_distance", _knn_sql(True), ops="M14 (distance weights)")
def knn_distance(spark, sf):
    return _knn(spark, sf, "distance")


@query(
    "knn_lsh_recall",
    f"SELECT count(*) FILTER (WHERE {_EMB_TEST}) AS n_queries, 5 * count(*) FILTER (WHERE {_EMB_TEST}) AS n_neighbours, true AS recall_reached FROM embeddings",
    ops="M14 (hash tables: at least 0.9 of the exact neighbours)",
)
def knn_lsh_recall(spark, sf):
    from quarry.models.knn import knn_candidates, lsh_candidates

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    test = hash_bucket("vec_id", buckets=100) < 20
    train = e.filter(~test).withColumnRenamed("vec_id", "tid")
    queries = e.filter(test).select(F.col("vec_id").alias("qid"), "x")
    exact, found = knn_candidates(queries, train, 5), lsh_candidates(queries, train, 5)
    hits = exact.select("qid", "tid").join(found.select("qid", "tid", F.lit(1).alias("hit")), ["qid", "tid"], "left")
    return hits.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


# ------------------------------------------------------------------ iterative / non-SQL models (rows-only checks)

_F3 = ["l_quantity", "l_discount", "l_tax"]


# ------------------------------------------------------------------ 3-feature OLS / ridge oracles
# In standardised space the fit solves (n·R + α·I) w = n·c (R: feature correlation matrix, c_i:
# cov(x_i, y)/σ_i); for three features Cramer's rule on covariance sums gives it in plain SQL.


def _sums_sql(src: str, group: str = "") -> str:
    xs = [f"{c}::DOUBLE" for c in _F3]
    cols = ["count(*)::DOUBLE AS n", "sum(y) AS sy"] + [f"sum({x}) AS s{i}" for i, x in enumerate(xs)]
    cols += [f"sum({xs[i]} * {xs[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3)]
    cols += [f"sum({x} * y) AS s{i}y" for i, x in enumerate(xs)]
    return f"SELECT {group + ', ' if group else ''}{', '.join(cols)} FROM {src}" + (f" GROUP BY {group}" if group else "")


def _solve3_cols(alpha: str = "0") -> str:
    """Select list: m_i, sd_i, my and weights w_i (standardised) from a row of sums."""
    m = [f"(s{i} / n)" for i in range(3)]
    cov = {(i, j): f"(s{min(i, j)}{max(i, j)} / n - {m[i]} * {m[j]})" for i in range(3) for j in range(3)}
    sd = [f"sqrt({cov[(i, i)]})" for i in range(3)]
    A = [[f"(n * {cov[(i, j)]} / ({sd[i]} * {sd[j]}){' + ' + alpha if i == j else ''})" for j in range(3)] for i in range(3)]
    b = [f"(n * (s{i}y / n - {m[i]} * (sy / n)) / {sd[i]})" for i in range(3)]

    def det(M):
        return (f"({M[0][0]} * ({M[1][1]} * {M[2][2]} - {M[1][2]} * {M[2][1]}) - "
                f"{M[0][1]} * ({M[1][0]} * {M[2][2]} - {M[1][2]} * {M[2][0]}) + "
                f"{M[0][2]} * ({M[1][0]} * {M[2][1]} - {M[1][1]} * {M[2][0]}))")

    D = det(A)
    out = [f"{m[i]} AS m{i}" for i in range(3)] + [f"{sd[i]} AS sd{i}" for i in range(3)] + ["sy / n AS my"]
    for k in range(3):
        Mk = [[b[i] if j == k else A[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{det(Mk)} / {D} AS w{k}")
    return ", ".join(out)


def _pred3(prefix: str = "") -> str:
    p = prefix
    return (f"{p}my + " + " + ".join(f"{p}w{i} * ({_F3[i]} - {p}m{i}) / {p}sd{i}" for i in range(3)))


_LIN3_TR = SPLIT_CTE + f", sums AS ({_sums_sql('tr')}), fitc AS (SELECT {{cols}} FROM sums) "

model_roundtrip_sql = (
    _LIN3_TR.format(cols=_solve3_cols("1.0"))
    + "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, "
    f"round({_pred3()}, 4) AS \"Predicted_Value\" FROM te, fitc"
)
score_stream_sql = (
    _LIN3_TR.format(cols=_solve3_cols("0"))
    + "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, "
    f"round({_pred3()}, 4) AS \"Predicted_Value\" FROM lineitem, fitc"
)

def _fold3(k: int) -> str:
    return (SPLIT_CTE + f", f AS (SELECT *, {_fold_sql(k)} AS fold FROM tr), "
            f"fs AS ({_sums_sql('f', 'fold')}), tot AS ({_sums_sql('f')}), "
            # training sums of fold i = totals − fold i
            "ks AS (SELECT fs.fold, " + ", ".join(
                f"tot.{c} - fs.{c} AS {c}" for c in ["n", "sy", "s0", "s1", "s2", "s00", "s01", "s02", "s11", "s12",
                                                     "s22", "s0y", "s1y", "s2y"]) + " FROM fs, tot) ")


cv5_sql = (
    _fold3(5) + f", kf AS (SELECT fold, {_solve3_cols('0')} FROM ks), "
    f"p AS (SELECT f.fold, f.y, {_pred3('kf.')} AS pr FROM f JOIN kf ON f.fold = kf.fold) "
    "SELECT fold, count(*) AS n, round(1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)), 4) AS r2, "
    "round(avg((y - pr) ^ 2), 4) AS mse FROM p GROUP BY fold"
)




def _grid3_sql(alphas: list[float], k: int) -> str:
    parts = []
    for a in alphas:
        parts.append(
            f"SELECT '{{\"alpha\": {a!r}}}' AS params, fold, 1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)) AS r2 "
            f"FROM (SELECT f.fold, f.y, {_pred3('kf.')} AS pr FROM f JOIN "
            f"(SELECT fold, {_solve3_cols(repr(float(a)))} FROM ks) kf ON f.fold = kf.fold) GROUP BY fold")
    return _fold3(k) + ", r AS (" + " UNION ALL ".join(parts) + ") SELECT params, round(avg(r2), 4) AS mean_score FROM r GROUP BY params"


grid_search_sql = _grid3_sql([0.1, 1.0, 10.0], 3)


def _bayes3_sql() -> str:
    """3-feature Bayesian ridge replayed in SQL: w = M⁻¹b and γ = tr(A·M⁻¹) with M = A + (λ/α)I,
    3×3 inverses by adjugates, iterations in a recursive CTE; returns the test-set metrics."""
    F3 = _F3
    m = [f"(s{i} / n)" for i in range(3)]
    cov = {(i, j): f"(s{min(i, j)}{max(i, j)} / n - {m[i]} * {m[j]})" for i in range(3) for j in range(3)}
    sd = [f"sqrt({cov[(i, i)]})" for i in range(3)]
    # constants: A = n·R, b = n·c, cc = Σ(y − ȳ)²
    kcols = [f"n AS n"] + [f"{m[i]} AS m{i}" for i in range(3)] + [f"{sd[i]} AS sd{i}" for i in range(3)]
    kcols += ["sy / n AS my", "(syy / n - (sy / n) * (sy / n)) * n AS cc", "syy / n - (sy / n) * (sy / n) AS vy"]
    kcols += [f"n * {cov[(i, j)]} / ({sd[i]} * {sd[j]}) AS a{i}{j}" for i in range(3) for j in range(3)]
    kcols += [f"n * (s{i}y / n - {m[i]} * (sy / n)) / {sd[i]} AS b{i}" for i in range(3)]
    A = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    Mm = [[f"(a{i}{j} + lam / alpha)" if i == j else f"a{i}{j}" for j in range(3)] for i in range(3)]

    def det(M):
        return (f"({M[0][0]} * ({M[1][1]} * {M[2][2]} - {M[1][2]} * {M[2][1]}) - "
                f"{M[0][1]} * ({M[1][0]} * {M[2][2]} - {M[1][2]} * {M[2][0]}) + "
                f"{M[0][2]} * ({M[1][0]} * {M[2][1]} - {M[1][1]} * {M[2][0]}))")

    def cof(M, i, j):
        r = [x for x in range(3) if x != i]
        c = [x for x in range(3) if x != j]
        s = "" if (i + j) % 2 == 0 else "-"
        return f"{s}({M[r[0]][c[0]]} * {M[r[1]][c[1]]} - {M[r[0]][c[1]]} * {M[r[1]][c[0]]})"

    D = det(Mm)
    w = [f"({det([[f'b{i}' if j == k else Mm[i][j] for j in range(3)] for i in range(3)])} / {D})" for k in range(3)]
    # (M⁻¹)_ji = cof(M, i, j) / det(M); γ = Σ_ij A_ij (M⁻¹)_ji
    gamma = "(" + " + ".join(f"a{i}{j} * {cof(Mm, i, j)}" for i in range(3) for j in range(3)) + f") / {D}"
    wb = " + ".join(f"{w[i]} * b{i}" for i in range(3))
    wAw = " + ".join(f"{w[i]} * a{i}{j} * {w[j]}" for i in range(3) for j in range(3))
    ww = " + ".join(f"{w[i]} * {w[i]}" for i in range(3))
    sums = _sums_sql("tr").replace("SELECT ", "SELECT sum(y * y) AS syy, ", 1)
    rec = (
        "it(i, alpha, lam, o0, o1, o2, done) AS ("
        "SELECT 0, 1.0 / (vy + 2.220446049250313e-16), 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false FROM k "
        "UNION ALL SELECT i + 1, "
        f"(n - ({gamma}) + 2e-6) / ((cc - 2 * ({wb}) + ({wAw})) + 2e-6), "
        f"(({gamma}) + 2e-6) / (({ww}) + 2e-6), "
        f"{w[0]}, {w[1]}, {w[2]}, "
        f"(i > 0 AND abs(o0 - {w[0]}) + abs(o1 - {w[1]}) + abs(o2 - {w[2]}) < 1e-3) "
        "FROM it, k WHERE NOT done AND i < 300)"
    )
    pred = "my + " + " + ".join(f"{w[i]} * ({F3[i]} - m{i}) / sd{i}" for i in range(3))
    return ("WITH RECURSIVE " + SPLIT_CTE[len("WITH "):] + f", sums AS ({sums}), k AS (SELECT {', '.join(kcols)} FROM sums), "
            + rec + f" SELECT round(1 - sum((y - ({pred})) ^ 2) / (count(*) * var_pop(y)), 4) AS r2, count(*) AS n, "
            f"round(avg((y - ({pred})) ^ 2), 4) AS mse, round(sqrt(avg((y - ({pred})) ^ 2)), 4) AS rmse, "
            f"round(avg(abs(y - ({pred}))), 4) AS mae, 'bayesian_ridge' AS model "
            "FROM te, k, (SELECT alpha, lam FROM it ORDER BY i DESC LIMIT 1)")


bayes3_sql = _bayes3_sql()




def _fit_metrics(spark, sf, model, features=_F3, **params):
    tr, te = li_split(spark, sf)
    fm = MP.fit(tr, features, "y", model, **params)
    return rounded(evaluate(fm.transform(te), "y").withColumn("model", F.lit(model)))


# ------------------------------------------------------------------ trees, replayed level by level in SQL
# Every feature here has fewer distinct values than bins, so a split lies between two neighbouring values of the training
# part; the best one lowers the squared error most (ties: first feature, then lowest value).


def _tree_levels(first: str, depth: int, tag: str, target: str) -> tuple[list[str], str]:
    """CTEs that send every row of ``first`` (is_test, x0…x2, ``target``, …) down one tree; the last adds ``fit``, the
    training mean of ``target`` in the row's leaf."""
    ctes, rows = [], first
    node = "0"
    for level in range(depth):
        src = f"{tag}r{level}"
        ctes.append(f"{src} AS MATERIALIZED (SELECT *, {node} AS node FROM {rows})" if level == 0 else
                    f"{src} AS MATERIALIZED (SELECT r.* EXCLUDE (node), 2 * r.node + coalesce(CASE b.f WHEN 0 THEN x0 > b.v WHEN 1 THEN x1 > b.v "
                    f"ELSE x2 > b.v END, false)::INT AS node FROM {rows} r LEFT JOIN {tag}b{level - 1} b ON r.node = b.node)")
        sums = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i} AS v, count(*)::DOUBLE AS n, sum({target}) AS s FROM {src} WHERE NOT is_test GROUP BY ALL"
                                  for i in range(3))
        ctes.append(f"{tag}s{level} AS MATERIALIZED (SELECT t.node, g.f, g.v, coalesce(u.n, 0) AS n, coalesce(u.s, 0) AS s FROM "
                    f"(SELECT DISTINCT node FROM {src} WHERE NOT is_test) t CROSS JOIN grid g LEFT JOIN ({sums}) u ON u.node = t.node AND u.f = g.f AND u.v = g.v)")
        ctes.append(f"{tag}c{level} AS (SELECT node, f, v, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY node, f) AS tn, "
                    f"sum(s) OVER (PARTITION BY node, f) AS ts FROM {tag}s{level} WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING))")
        ctes.append(f"{tag}b{level} AS MATERIALIZED (SELECT node, f, v FROM {tag}c{level} WHERE ln > 0 AND ln < tn "
                    "QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln), 7) DESC, f, v) = 1)")
        rows = src
    last = f"{tag}b{depth - 1}"
    ctes.append(f"{tag}leaf AS MATERIALIZED (SELECT r.* EXCLUDE (node), 2 * r.node + coalesce(CASE b.f WHEN 0 THEN x0 > b.v WHEN 1 THEN x1 > b.v "
                f"ELSE x2 > b.v END, false)::INT AS node FROM {rows} r LEFT JOIN {last} b ON r.node = b.node)")
    ctes.append(f"{tag}out AS MATERIALIZED (SELECT * EXCLUDE (node), avg({target}) FILTER (WHERE NOT is_test) OVER (PARTITION BY node) AS fit FROM {tag}leaf)")
    return ctes, f"{tag}out"


_TREE_SRC = (f"src AS ({LI_Y_SQL}), rows0 AS MATERIALIZED (SELECT is_test, l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2, y FROM src), "
             "grid AS MATERIALIZED (SELECT DISTINCT 0 AS f, x0 AS v FROM rows0 WHERE NOT is_test UNION ALL SELECT DISTINCT 1, x1 FROM rows0 WHERE NOT is_test "
             "UNION ALL SELECT DISTINCT 2, x2 FROM rows0 WHERE NOT is_test)")


def _metrics_sql(rows: str, pred: str, model: str) -> str:
    e = f"(y - {pred})"
    return (f"SELECT count(*) AS n, round(1 - sum({e} ^ 2) / (count(*) * var_pop(y)), 4) AS r2, round(avg({e} ^ 2), 4) AS mse, "
            f"round(sqrt(avg({e} ^ 2)), 4) AS rmse, round(avg(abs{e}), 4) AS mae, '{model}' AS model FROM {rows} WHERE is_test")


def _tree_sql(depth: int) -> str:
    ctes, out = _tree_levels("rows0", depth, "t", "y")
    return f"WITH {_TREE_SRC}, {', '.join(ctes)} {_metrics_sql(out, 'fit', 'tree')}"


def _boosted_sql(rounds: int, depth: int, rate: float, model: str) -> str:
    """The first tree is fitted to y; each later one to twice the residual and added at the learning rate."""
    ctes = ["f0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS pred, y AS goal FROM rows0)"]
    for m in range(rounds):
        tree, out = _tree_levels(f"f{m}", depth, f"m{m}", "goal")
        ctes += tree
        step = "fit" if m == 0 else f"{rate} * fit"
        ctes.append(f"f{m + 1} AS MATERIALIZED (SELECT is_test, x0, x1, x2, y, pred + {step} AS pred, 2 * (y - (pred + {step})) AS goal FROM {out})")
    return f"WITH {_TREE_SRC}, {', '.join(ctes)} {_metrics_sql(f'f{rounds}', 'pred', model)}"


@query("tree_fit", _tree_sql(5), ops="M9 (depth 5, three features)")
def tree_fit(spark, sf):
    return _fit_metrics(spark, sf, "tree", max_depth=5)


@query("forest_fit", None, ops="M10 M15 (bagging)")
def forest_fit(spark, sf):
    return _fit_metrics(spark, sf, "forest", n_estimators=20, max_depth=8)


@query("gbt_fit", _boosted_sql(30, 3, 0.1, "xgboost"), ops="M11 M15 (gradient boosting)")
def gbt_fit(spark, sf):
    return _fit_metrics(spark, sf, "xgboost", n_estimators=30, max_depth=3)


@query("lightgbm_fit", _boosted_sql(30, 4, 0.1, "lightgbm"), ops="M12")
def lightgbm_fit(spark, sf):
    return _fit_metrics(spark, sf, "lightgbm", n_estimators=30, num_leaves=15)


@query("bayes_ridge_fit", bayes3_sql, ops="M8 (3 features; evidence iterations replayed in SQL)")
def bayes_ridge_fit(spark, sf):
    return _fit_metrics(spark, sf, "bayesian_ridge")


@query("svr_linear_fit", None, ops="M13 (linear)")
def svr_linear_fit(spark, sf):
    return _fit_metrics(spark, sf, "svr", kernel="linear", C=1.0)


@query("svr_rbf_fit", None, ops="M13 (rbf, random Fourier features)")
def svr_rbf_fit(spark, sf):
    return _fit_metrics(spark, sf, "svr", kernel="rbf", C=1.0)


@query("huber_fit", None, ops="M15 (Huber)")
def huber_fit(spark, sf):
    return _fit_metrics(spark, sf, "huber")


# Isotonic regression, 1 feature: the fit is unique — at the i-th distinct x it equals
# max_{j<=i} min_{k>=i} (weighted mean of y over the distinct x values j..k).
_ISO_SQL = (
    SPLIT_CTE + ", g AS (SELECT l_quantity AS x, count(*)::DOUBLE AS w, sum(y) AS sy FROM tr GROUP BY 1), "
    "c AS (SELECT x, row_number() OVER (ORDER BY x) AS r, sum(w) OVER (ORDER BY x) AS cw, "
    "sum(sy) OVER (ORDER BY x) AS cs FROM g), "
    "seg AS (SELECT a.r AS j, b.r AS k, (b.cs - a.cs + ga.sy) / (b.cw - a.cw + ga.w) AS m "
    "FROM c a JOIN c b ON a.r <= b.r JOIN g ga ON ga.x = a.x), "
    "mn AS (SELECT i.r AS i, s.j, min(s.m) AS v FROM c i JOIN seg s ON s.j <= i.r AND s.k >= i.r GROUP BY i.r, s.j), "
    "fitv AS (SELECT c.x, max(v) AS fv FROM mn JOIN c ON c.r = mn.i GROUP BY c.x) "
    "SELECT l_orderkey, l_linenumber, round(fv, 4) AS prediction FROM te JOIN fitv ON te.l_quantity = fitv.x"
)


def _iso_metrics_sql() -> str:
    fit_part = _ISO_SQL[: _ISO_SQL.index(" SELECT l_orderkey, l_linenumber, round(fv, 4)")]
    return (fit_part + ", p AS (SELECT y, fv AS pr FROM te JOIN fitv ON te.l_quantity = fitv.x) "
            "SELECT count(*) AS n, round(1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)), 4) AS r2, "
            "round(avg((y - pr) ^ 2), 4) AS mse, round(sqrt(avg((y - pr) ^ 2)), 4) AS rmse, "
            "round(avg(abs(y - pr)), 4) AS mae, 'isotonic' AS model FROM p")


@query("isotonic_fit", _iso_metrics_sql(), ops="M15 (isotonic)")
def isotonic_fit(spark, sf):
    return _fit_metrics(spark, sf, "isotonic", features=["l_quantity"])


def _poly3_sql() -> str:
    """Nine terms of degree 1 and 2: each in turn is taken out of the later ones and of y (modified Gram–Schmidt, coefficients
    from the training part); what is left of y in the test part are the residuals."""
    terms = [" * ".join(f"{_F3[i]}::DOUBLE" for i in combo) for _label, combo in prep.poly_terms(_F3, 2)]
    k = len(terms)
    centre = ", ".join(f"t{j} - avg(t{j}) FILTER (WHERE NOT is_test) OVER () AS q{j}" for j in range(k))
    ctes = [f"src AS ({LI_Y_SQL})", f"tm AS (SELECT is_test, y, {', '.join(f'{t} AS t{j}' for j, t in enumerate(terms))} FROM src)",
            f"g0 AS MATERIALIZED (SELECT is_test, y, y - avg(y) FILTER (WHERE NOT is_test) OVER () AS e, {centre} FROM tm)"]
    for i in range(k):
        later = ["e"] + [f"q{j}" for j in range(i + 1, k)]
        share = ", ".join(f"sum({c} * q{i}) / sum(q{i} * q{i}) AS c_{c}" for c in later)
        ctes.append(f"s{i} AS MATERIALIZED (SELECT {share} FROM g{i} WHERE NOT is_test)")
        ctes.append(f"g{i + 1} AS MATERIALIZED (SELECT is_test, y, {', '.join(f'{c} - c_{c} * q{i} AS {c}' for c in later)} FROM g{i}, s{i})")
    return f"WITH {', '.join(ctes)} {_metrics_sql(f'g{k}', '(y - e)', 'polynomial')}"


@query("poly_fit", _poly3_sql(), ops="M2 M3 (polynomial regression, degree 2, three features)")
def poly_fit(spark, sf):
    return _fit_metrics(spark, sf, "polynomial", degree=2)


@query("topk_importance", None, ops="M20 O3 V14")
def topk_importance(spark, sf):
    from quarry.models.train import importance_table

    tr, _te = li_split(spark, sf)
    fm = MP.fit(tr, _F3, "y", "forest", n_estimators=20, max_depth=8)
    return importance_table(fm, spark, 12)


@query("cv5", cv5_sql, ops="M17 (3-feature linear, 5 folds)")
def cv5(spark, sf):
    from quarry.models.selection import cross_validate

    tr, _te = li_split(spark, sf)
    return rounded(cross_validate(tr, _F3, "y", "linear", ["l_orderkey", "l_linenumber"], 5))


@query("auto_select", None, ops="M18")
def auto_select_q(spark, sf):
    from quarry.models.selection import auto_select, rank_candidates

    tr, _te = li_split(spark, sf)
    _label, _model, _params, res = auto_select(tr, _F3, "y", ["l_orderkey", "l_linenumber"], 3, parallelism=4)
    return rounded(rank_candidates(res))


@query("grid_search", grid_search_sql, ops="M19 (3-feature ridge, 3 folds)")
def grid_search_q(spark, sf):
    from quarry.models.selection import grid_search

    tr, _te = li_split(spark, sf)
    _fm, _best, _score, res = grid_search(tr, _F3, "y", "ridge", {"alpha": [0.1, 1.0, 10.0]},
                                          ["l_orderkey", "l_linenumber"], 3)
    return rounded(res)


@query("model_roundtrip", model_roundtrip_sql, ops="M22 M23 S9 (3-feature ridge)")
def model_roundtrip(spark, sf):
    from quarry.models.registry import ModelRegistry
    from quarry.models.scoring import score
    from quarry.session import scratch_path

    tr, te = li_split(spark, sf)
    fm = MP.fit(tr, _F3, "y", "ridge", alpha=1.0)
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    reg.save(fm, "ridge_lineitem", {"note": "roundtrip"})
    back = reg.load("ridge_lineitem")
    return rounded(score(back, te.select("l_orderkey", "l_linenumber", *_F3)))


def _train_run_sql() -> str:
    """Split by key, one row of each set of duplicates in the training part (the smallest key), three-feature line, five folds."""
    h = "('0x'||substr(md5(concat_ws('-',l_orderkey,l_linenumber)),1,8))::UBIGINT"
    sums = ["n", "sy", "s0", "s1", "s2", "s00", "s01", "s02", "s11", "s12", "s22", "s0y", "s1y", "s2y"]

    def quality(rows: str, pr: str) -> str:
        return f"1 - sum((y - {pr}) ^ 2) / (count(*) * var_pop(y)) AS r2, avg((y - {pr}) ^ 2) AS mse, count(*)::DOUBLE AS n FROM {rows}"

    ctes = [
        f"src AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {LABEL_SQL} AS y, {h} % 100 < 20 AS is_test FROM lineitem)",
        "te AS (SELECT * FROM src WHERE is_test)",
        "one AS (SELECT l_quantity, l_discount, l_tax, y, unnest(min({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber})) FROM src WHERE NOT is_test "
        "GROUP BY l_quantity, l_discount, l_tax, y)",
        f"f AS (SELECT *, (({h} % 1000003) % 5)::INTEGER AS fold FROM one)",
        f"fs AS ({_sums_sql('f', 'fold')})", f"tot AS ({_sums_sql('f')})",
        "ks AS (SELECT fs.fold, " + ", ".join(f"tot.{c} - fs.{c} AS {c}" for c in sums) + " FROM fs, tot)",
        f"kf AS (SELECT fold, {_solve3_cols('0')} FROM ks)", f"k AS (SELECT {_solve3_cols('0')} FROM tot)",
        f"cv AS (SELECT f.fold, {quality('f JOIN kf ON f.fold = kf.fold', '(' + _pred3('kf.') + ')')} GROUP BY f.fold)",
        f"tr AS (SELECT {quality('f, k', '(' + _pred3('k.') + ')')})", f"tt AS (SELECT {quality('te, k', '(' + _pred3('k.') + ')')})",
    ]
    told = [("train_r2", "r2", "tr"), ("train_mse", "mse", "tr"), ("test_r2", "r2", "tt"), ("test_mse", "mse", "tt"), ("cv_r2_mean", "avg(r2)", "cv"),
            ("cv_r2_std", "stddev_pop(r2)", "cv"), ("cv_mse_mean", "avg(mse)", "cv"), ("cv_mse_std", "stddev_pop(mse)", "cv"), ("n_train", "n", "tr"),
            ("n_test", "n", "tt")]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({e}, 4) AS value FROM {t}" for m, e, t in told) \
        + " UNION ALL SELECT 'n_features', 3.0"


@query("train_run", _train_run_sql(), ops="M17 M20 M21 M27 M28")
def train_run(spark, sf):
    from quarry.models.registry import ModelRegistry
    from quarry.models.train import report_tables, train
    from quarry.session import scratch_path

    src = li_y(spark, sf)
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    res = train(src, _F3, "y", "linear", key_cols=["l_orderkey", "l_linenumber"], registry=reg)
    return rounded(report_tables(res, spark)["metrics"])


@query("score_stream", score_stream_sql, ops="M25 (Structured Streaming, 3-feature linear)")
def score_stream_q(spark, sf):
    from quarry.streaming.score import file_stream, run_to_completion, score_stream

    tr, _te = li_split(spark, sf)
    fm = MP.fit(tr, _F3, "y", "linear")
    sdf = file_stream(spark, f"{sf.rstrip('/')}/lineitem.parquet").select("l_orderkey", "l_linenumber", *_F3)
    return rounded(run_to_completion(score_stream(fm, sdf)))


@query(
    "decode_prediction",
    "WITH m AS (SELECT min(l_linestatus) AS m0, (SELECT min(l_linestatus) FROM lineitem WHERE l_linestatus > "
    "(SELECT min(l_linestatus) FROM lineitem)) AS m1 FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = m0 THEN 0.2 ELSE 0.9 END AS prediction, "
    "CASE WHEN l_linestatus = m0 THEN m0 ELSE m1 END AS label FROM lineitem, m",
    ops="E6",
)
def decode_prediction_q(spark, sf):
    from quarry.operators.encode import build_dictionary, decode
    from quarry.operators.quantiles import join_small

    li = table(spark, sf, "lineitem")
    d = build_dictionary(li, "l_linestatus")
    # a stand-in "prediction" near each row's class code (0.2 for code 0, 0.9 for code 1), decoded
    # back to the label by a join with the (distributed) dictionary
    coded = join_small(li, d.withColumnRenamed("value", "l_linestatus"), ["l_linestatus"]).select(
        "l_orderkey", "l_linenumber", F.when(F.col("code") == 0, 0.2).otherwise(0.9).alias("prediction"))
    return decode(coded, "prediction", d, "label")


@query(
    "actual_vs_predicted",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr), "
    "p AS (SELECT y, a + b * l_quantity AS pr FROM te, c) "
    "SELECT round(least(min(y), min(pr)), 4) AS lo, round(greatest(max(y), max(pr)), 4) AS hi FROM p",
    ops="V13",
)
def actual_vs_predicted_q(spark, sf):
    from quarry.models.train import actual_vs_predicted

    fm, _tr, te = _fit_1f(spark, sf, "linear")
    _pts, line = actual_vs_predicted(fm.transform(te), "y")
    return rounded(line)


@query(
    "importance_linear",
    SPLIT_CTE + "SELECT 'l_quantity' AS feature, round(covar_pop(l_quantity, y) / stddev_pop(l_quantity), 4) AS score "
    "FROM tr",
    ops="M20 O3 (coefficients in standardised space)",
)
def importance_linear(spark, sf):
    from quarry.models.train import importance_table

    fm, _tr, _te = _fit_1f(spark, sf, "linear")
    return rounded(importance_table(fm, spark, 12))


def _run_history_sql() -> str:
    def metrics(model: str, slope: str) -> str:
        return (f"SELECT '{model}_Run1' AS run_id, '{model}' AS model, "
                f"1 - sum(CASE WHEN NOT is_test THEN (y - pr) ^ 2 END) / (count(CASE WHEN NOT is_test THEN 1 END) * "
                f"var_pop(CASE WHEN NOT is_test THEN y END)) AS train_r2, "
                f"1 - sum(CASE WHEN is_test THEN (y - pr) ^ 2 END) / (count(CASE WHEN is_test THEN 1 END) * "
                f"var_pop(CASE WHEN is_test THEN y END)) AS test_r2, "
                f"avg(CASE WHEN NOT is_test THEN (y - pr) ^ 2 END) AS train_mse, "
                f"avg(CASE WHEN is_test THEN (y - pr) ^ 2 END) AS test_mse, "
                f"count(CASE WHEN NOT is_test THEN 1 END) AS n_train, count(CASE WHEN is_test THEN 1 END) AS n_test "
                f"FROM (SELECT y, is_test, my + ({slope}) * ((l_quantity - mx) / sx) AS pr FROM src, st)")
    st = ("st AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(y) AS my, count(*) AS n, "
          "covar_pop(l_quantity, y) AS cxy FROM tr)")
    runs = metrics("linear", "cxy / sx") + " UNION ALL " + metrics("ridge", "(cxy / sx) * n / (n + 1.0)")
    return (SPLIT_CTE + f", {st}, r AS ({runs}) SELECT run_id, model, round(train_r2, 4) AS train_r2, "
            "round(test_r2, 4) AS test_r2, round(train_mse, 4) AS train_mse, round(test_mse, 4) AS test_mse, "
            "1::BIGINT AS n_features, n_train, n_test, (test_r2 - train_r2) < -0.05 AS r2_overfit, "
            "CASE WHEN train_mse > 1e-9 THEN (test_mse - train_mse) / train_mse > 0.2 ELSE false END AS mse_overfit "
            "FROM r")


@query("run_history", _run_history_sql(), ops="M21 O8 M24")
def run_history(spark, sf):
    import datetime as dt

    from quarry.models.registry import ModelRegistry
    from quarry.session import scratch_path

    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    for model in ("linear", "ridge"):
        fm, tr, te = _fit_1f(spark, sf, model)
        a, b = evaluate(fm.transform(tr), "y").first(), evaluate(fm.transform(te), "y").first()
        reg.append_run({"run_id": reg.next_run_id(model), "model": model,
                        "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                        "train_r2": a["r2"], "test_r2": b["r2"], "train_mse": a["mse"], "test_mse": b["mse"],
                        "n_features": 1, "n_train": a["n"], "n_test": b["n"]})
    hist = overfit_flags(reg.history())  # newest first; created_at is not part of the checked output
    return rounded(hist.select("run_id", "model", "train_r2", "test_r2", "train_mse", "test_mse", "n_features",
                               "n_train", "n_test", "r2_overfit", "mse_overfit"))


# ------------------------------------------------------------------ 1-feature variants with closed-form oracles

_FOLD_CTE = (SPLIT_CTE + f", f AS (SELECT *, {_FOLD_SQL} AS fold FROM tr), "
             "s AS (SELECT fold, count(*) AS n, sum(l_quantity) AS sx, sum(y) AS sy, sum(l_quantity * y) AS sxy, "
             "sum(l_quantity * l_quantity) AS sxx FROM f GROUP BY fold), "
             "t AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(y) AS sy, sum(l_quantity * y) AS sxy, "
             "sum(l_quantity * l_quantity) AS sxx FROM f), "
             # training sums of fold i = totals − fold i; standardised-space slope from them
             "k AS (SELECT s.fold, t.n - s.n AS n, (t.sx - s.sx) / (t.n - s.n) AS mx, (t.sy - s.sy) / (t.n - s.n) AS my, "
             "(t.sxy - s.sxy) / (t.n - s.n) - ((t.sx - s.sx) / (t.n - s.n)) * ((t.sy - s.sy) / (t.n - s.n)) AS cxy, "
             "sqrt((t.sxx - s.sxx) / (t.n - s.n) - ((t.sx - s.sx) / (t.n - s.n)) ^ 2) AS sx FROM s, t) ")


def _cv_sql(slope: str, extra_cols: str = "", group: str = "") -> str:
    return (_FOLD_CTE + f", p AS (SELECT f.fold, f.y, k.my + ({slope}) * ((f.l_quantity - k.mx) / k.sx) AS pr{extra_cols} "
            "FROM f JOIN k ON f.fold = k.fold" + group + ") ")


@query(
    "cv5_1f",
    _cv_sql("cxy / sx") + "SELECT fold, count(*) AS n, round(1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)), 4) AS r2, "
    "round(avg((y - pr) ^ 2), 4) AS mse FROM p GROUP BY fold",
    ops="M17 (1 feature, closed form per fold)",
)
def cv5_1f(spark, sf):
    from quarry.models.selection import cross_validate

    tr, _te = li_split(spark, sf)
    return rounded(cross_validate(tr, ["l_quantity"], "y", "linear", ["l_orderkey", "l_linenumber"], 5))


@query(
    "grid_search_1f",
    _FOLD_CTE + ", a AS (SELECT unnest([0.1, 1000.0, 100000.0]) AS alpha), "
    "p AS (SELECT a.alpha, f.fold, f.y, k.my + ((cxy / k.sx) * k.n / (k.n + a.alpha)) * ((f.l_quantity - k.mx) / k.sx) AS pr "
    "FROM f JOIN k ON f.fold = k.fold, a), "
    "r AS (SELECT alpha, fold, 1 - sum((y - pr) ^ 2) / (count(*) * var_pop(y)) AS r2 FROM p GROUP BY alpha, fold) "
    "SELECT '{\"alpha\": ' || CASE WHEN alpha = 0.1 THEN '0.1' WHEN alpha = 1000.0 THEN '1000.0' ELSE '100000.0' END "
    "|| '}' AS params, round(avg(r2), 4) AS mean_score FROM r GROUP BY alpha",
    ops="M19 (1 feature, closed-form ridge per fold)",
)
def grid_search_1f(spark, sf):
    from quarry.models.selection import grid_search

    tr, _te = li_split(spark, sf)
    _fm, _best, _score, res = grid_search(tr, ["l_quantity"], "y", "ridge", {"alpha": [0.1, 1000.0, 100000.0]},
                                          ["l_orderkey", "l_linenumber"], 5)
    return rounded(res)


@query("model_roundtrip_1f", _lin1_sql(f"({_C} * n) / (n + 10.0)"), ops="M22 M23 S9 (ridge, closed form)")
def model_roundtrip_1f(spark, sf):
    from quarry.models.registry import ModelRegistry
    from quarry.session import scratch_path

    fm, _tr, te = _fit_1f(spark, sf, "ridge", alpha=10.0)
    reg = ModelRegistry(spark, scratch_path(spark, "registry"))
    reg.save(fm, "ridge_1f")
    return _pred_out(reg.load("ridge_1f"), te)


@query(
    "score_stream_1f",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr) "
    "SELECT l_orderkey, l_linenumber, l_quantity, round(a + b * l_quantity, 4) AS \"Predicted_Value\" FROM lineitem, c",
    ops="M25 (Structured Streaming = batch)",
)
def score_stream_1f(spark, sf):
    from quarry.streaming.score import file_stream, run_to_completion, score_stream

    fm, _tr, _te = _fit_1f(spark, sf, "linear")
    sdf = file_stream(spark, f"{sf.rstrip('/')}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(run_to_completion(score_stream(fm, sdf)))


# Bayesian ridge, 1 feature: the evidence iterations are scalar, so a recursive CTE replays them.
# In standardised space: e = Σx_s² = n, b = Σx_s(y − ȳ) = n·cov/σ, c = Σ(y − ȳ)² = n·var(y);
# w = b/(e + λ/α), γ = αe/(λ + αe), λ' = (γ + 2λ₁)/(w² + 2λ₂), α' = (n − γ + 2α₁)/(SSE + 2α₂).
_W = "(b / (e + lam / alpha))"
_BAYES_SQL = (
    "WITH RECURSIVE " + SPLIT_CTE[len("WITH "):]
    + ", st AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(y) AS my, "
    "covar_pop(l_quantity, y) AS cxy, var_pop(y) AS vy FROM tr), "
    "k AS (SELECT n, mx, sx, my, n AS e, n * cxy / sx AS b, n * vy AS c, vy FROM st), "
    "it(i, alpha, lam, w_old, done) AS ("
    "SELECT 0, 1.0 / (vy + 2.220446049250313e-16), 1.0::DOUBLE, NULL::DOUBLE, false FROM k "
    "UNION ALL SELECT i + 1, "
    f"(n - alpha * e / (lam + alpha * e) + 2e-6) / ((c - 2 * {_W} * b + {_W} ^ 2 * e) + 2e-6), "
    f"(alpha * e / (lam + alpha * e) + 2e-6) / ({_W} ^ 2 + 2e-6), "
    f"{_W}, (i > 0 AND abs(w_old - {_W}) < 1e-3) "
    "FROM it, k WHERE NOT done AND i < 300) "
    f"SELECT l_orderkey, l_linenumber, round(my + {_W} * ((l_quantity - mx) / sx), 4) AS prediction "
    "FROM te, k, (SELECT alpha, lam FROM it ORDER BY i DESC LIMIT 1)"
)


@query("bayes_ridge_1f", _BAYES_SQL, ops="M8 (1 feature, evidence iterations replayed in SQL)")
def bayes_ridge_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "bayesian_ridge")
    return _pred_out(fm, te)


@query(
    "poly_fit_1f",
    SPLIT_CTE + ", c AS (SELECT avg(l_quantity) AS m1, avg(l_quantity ^ 2) AS m2, avg(y) AS my, "
    "covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_quantity ^ 2) AS s12, "
    "covar_pop(l_quantity ^ 2, l_quantity ^ 2) AS s22, covar_pop(l_quantity, y) AS s1y, "
    "covar_pop(l_quantity ^ 2, y) AS s2y FROM tr), "
    # OLS on (x, x²) by Cramer's rule on the centred normal equations (scaling leaves OLS predictions unchanged)
    "w AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, "
    "(s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c) "
    "SELECT l_orderkey, l_linenumber, round(my + b1 * (l_quantity - m1) + b2 * (l_quantity ^ 2 - m2), 4) AS prediction "
    "FROM te, w",
    ops="M2 M3 (degree-2 polynomial regression, 1 feature)",
)
def poly_fit_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "polynomial", degree=2)
    return _pred_out(fm, te)


@query("isotonic_1f", _ISO_SQL, ops="M15 (isotonic, 1 feature, min-max closed form)")
def isotonic_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "isotonic")
    return _pred_out(fm, te)


# Decision stump, 1 feature: candidate thresholds are the midpoints between consecutive distinct
# values; the split minimises SSE(left) + SSE(right) (first threshold on ties); leaves predict means.
_STUMP_SQL = (
    SPLIT_CTE + ", g AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS ss FROM tr GROUP BY 1), "
    "c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER (ORDER BY x) AS ls, "
    "sum(ss) OVER (ORDER BY x) AS lss FROM g), "
    "t AS (SELECT sum(n) AS tn, sum(s) AS ts, sum(ss) AS tss FROM g), "
    "cand AS (SELECT (x + nx) / 2 AS thr, ls / ln AS lm, (ts - ls) / (tn - ln) AS rm, "
    "(lss - ls * ls / ln) + ((tss - lss) - (ts - ls) * (ts - ls) / (tn - ln)) AS sse FROM c, t WHERE nx IS NOT NULL), "
    "best AS (SELECT * FROM cand ORDER BY sse, thr LIMIT 1) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= thr THEN lm ELSE rm END, 4) AS prediction "
    "FROM te, best"
)


@query("tree_stump_1f", _STUMP_SQL, ops="M9 (depth-1 tree, 1 feature)")
def tree_stump_1f(spark, sf):
    fm, _tr, te = _fit_1f(spark, sf, "tree", max_depth=1)
    return _pred_out(fm, te)


@query(
    "label_features_fit",
    SPLIT_CTE.replace("SELECT l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_quantity")
    + ", d AS (SELECT l_returnflag AS v, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM tr)), "
    "c AS (SELECT regr_slope(y, code) AS b, regr_intercept(y, code) AS a FROM tr JOIN d ON l_returnflag = v) "
    "SELECT l_orderkey, l_linenumber, round(a + b * coalesce(code, 0), 4) AS prediction "
    "FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN 'unknown' WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS flag FROM te) "
    "LEFT JOIN d ON flag = v, c",
    ops="E4 E5 (a string feature in a pipeline; unknown and missing labels at scoring)",
)
def label_features_fit(spark, sf):
    src = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.expr(LABEL_SPARK).alias("y"))
    tr, te = prep.split(src, ["l_linenumber", "l_orderkey"], 0.2, 42)
    fm = MP.fit(tr, ["l_returnflag"], "y", "linear")
    flag = F.when(F.col("l_linenumber") == 7, "unknown").when(F.col("l_linenumber") == 6, None).otherwise(F.col("l_returnflag"))
    return _pred_out(fm, te.withColumn("l_returnflag", flag))


@query(
    "label_target_decode",
    "WITH d AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_name AS v FROM customer)), "
    "s AS (SELECT c_custkey, code FROM customer JOIN d ON c_name = v), "
    "c AS (SELECT regr_slope(code, c_custkey) AS b, regr_intercept(code, c_custkey) AS a FROM s) "
    "SELECT c_custkey, d.v AS \"Predicted_Value\" FROM customer CROSS JOIN c LEFT JOIN d ON d.code = round(a + b * c_custkey)::BIGINT",
    ops="E4 E6 M25 (a string target of as many labels as rows, decoded by its dictionary table)",
)
def label_target_decode(spark, sf):
    from quarry.models.scoring import score

    c = table(spark, sf, "customer")
    fm = MP.fit(c.select("c_custkey", "c_name"), ["c_custkey"], "c_name", "linear")
    return score(fm, c.select("c_custkey"))


@query(
    "report_predictions",
    SPLIT_CTE + ", c AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM tr) "
    "SELECT round(y, 4) AS actual, round(a + b * l_quantity, 4) AS predicted FROM te, c",
    ops="M28 V13 (the report's table of test predictions)",
)
def report_predictions(spark, sf):
    from quarry.models.train import actual_vs_predicted

    fm, _tr, te = _fit_1f(spark, sf, "linear")
    points, _line = actual_vs_predicted(fm.transform(te), "y")
    return rounded(points)


@query(
    "isotonic_continuous",
    "WITH g AS (SELECT o_totalprice AS x, count(*)::DOUBLE AS w, sum(date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + o_totalprice / 100) AS s "
    "FROM orders GROUP BY 1), tot AS (SELECT sum(w) AS n, sum(s) AS sy FROM g) SELECT round(n, 4) AS n, round(sy, 4) AS total, true AS rising, true AS balanced FROM tot",
    ops="M15 (isotonic on a continuous feature, cut into many runs: block sums, order and balance)",
)
def isotonic_continuous(spark, sf):
    from pyspark.sql import Window

    from quarry.models.isotonic import blocks

    o = table(spark, sf, "orders")
    y = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")) + F.col("o_totalprice") / 100
    found = blocks(o, F.col("o_totalprice"), y, run_size=100)
    # conditions that only the solution meets: means rise from block to block (inside the runs and from run to run), and
    # no beginning of a block has a lower mean than the block (else it would have been split there)
    mean = F.col("s") / F.col("w")
    told = found.select("run", "lo", mean.alias("m"), F.lag(mean).over(Window.partitionBy("run").orderBy("pos")).alias("b"))
    runs = told.groupBy("run").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.coalesce(F.bool_and(F.col("m") >= F.col("b")), F.lit(True)).alias("up"),
                                   F.min("lo").alias("lo"))
    steps = F.aggregate(F.array_sort(F.collect_list(F.struct("lo", "low", "high"))), F.struct(F.lit(True).alias("ok"), F.lit(float("-inf")).alias("at")),
                        lambda acc, r: F.struct((acc["ok"] & (r["low"] >= acc["at"])).alias("ok"), r["high"].alias("at")))
    up = runs.agg((F.bool_and("up") & steps["ok"]).alias("rising"))  # a row a run
    points = MP.fit(o.select("o_totalprice", y.alias("y")), ["o_totalprice"], "y", "isotonic", scale=False).transform(o.select("o_totalprice", y.alias("y")))
    begun = Window.partitionBy("prediction").orderBy("o_totalprice").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    least = points.select((F.avg("y").over(begun) - F.col("prediction")).alias("gap")).agg((F.min("gap") >= -1e-6).alias("balanced"))
    sums = found.agg(F.sum("w").alias("n"), F.sum("s").alias("total"))
    return rounded(sums.join(up).join(least))
