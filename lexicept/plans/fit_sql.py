"""DuckDB SQL that fits the models itself: Newton steps for logistic regression, Gram-Schmidt steps for least squares."""

from __future__ import annotations

from ..functions.hashing import stable_hash_sql
from ..sources import fixtures as fx
from .common import POINT_CATEGORIES, sql_centroid_lists, sql_r6
from .q_lexicon import EXPANDED_TOKENS, LEX_CATS, _counts_sql

SPLIT_SEED = 203948
STEPS = 9

STRATIFIED = (
    "cnt AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)",
    "cs AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS s FROM cnt)",
    "alloc AS (SELECT label, r.i, CAST(floor((s + n - 1 - r.i) / 5.0) - floor((s - 1 - r.i) / 5.0) AS BIGINT) AS a FROM cs, range(5) r(i))",
    "cum AS (SELECT label, i, sum(a) OVER (PARTITION BY label ORDER BY i) AS c FROM alloc)",
    "pos AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings)",
    "folds AS (SELECT pos.vec_id, CAST(pos.label AS BIGINT) AS label, CAST((SELECT count(*) FROM cum WHERE cum.label = pos.label "
    "AND cum.c <= pos.p) AS BIGINT) AS fold FROM pos)",
)


def logistic_sql(how: str) -> str:
    """Accuracy of ridge logistic fits (one class against the rest) on standardised concept scores, per held-out fold.

    Every Newton step builds the weighted normal equations of all (fold, class) problems as rows (i, j, value) and
    eliminates one column after the other.
    """
    d = len(POINT_CATEGORIES) + 1
    folds = list(STRATIFIED) if how == "cv" else [
        f"folds AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CASE WHEN ({stable_hash_sql('vec_id', SPLIT_SEED)}) % 100 < 75 THEN 0 ELSE 1 END AS fold FROM embeddings)"
    ]
    held = "(SELECT DISTINCT fold AS h FROM folds)" if how == "cv" else "(SELECT 1 AS h)"
    ctes = [
        fx.CENTROID_POINTS_SQL, fx.POINT_CATEGORIES_SQL, f"cent AS ({sql_centroid_lists()})", *folds,
        "sims AS (SELECT e.vec_id, k.ord, coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c), 0) AS x "
        "FROM embeddings e CROSS JOIN fx_point_categories k LEFT JOIN cent c ON c.category = k.category)",
        "rz AS (SELECT vec_id, ord, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS x FROM sims WINDOW w AS (PARTITION BY vec_id))",
        f"sc AS (SELECT h, ord, avg(x) AS m, coalesce(nullif(stddev_pop(x), 0), 1) AS sd FROM rz JOIN folds USING (vec_id) JOIN {held} ON fold <> h GROUP BY h, ord)",
        "data AS MATERIALIZED (SELECT h, vec_id, any_value(label) AS label, any_value(fold) AS fold, list_append(list((x - m) / sd ORDER BY ord), 1.0) AS v "
        "FROM rz JOIN folds USING (vec_id) JOIN sc USING (ord) GROUP BY h, vec_id)",
        f"w0 AS (SELECT h, c.label AS class, list_transform(range({d}), lambda q: 0.0) AS w FROM (SELECT DISTINCT h FROM data) CROSS JOIN (SELECT DISTINCT label FROM folds) c)",
    ]
    for t in range(STEPS):
        ctes += [
            f"p{t} AS (SELECT w.h, w.class, w.w, v, 1 / (1 + exp(-list_dot_product(v, w))) AS p, CAST(label = class AS INTEGER) AS y "
            f"FROM w{t} w JOIN data ON data.h = w.h AND fold <> w.h)",
            f"a{t}_0 AS MATERIALIZED (SELECT h, class, i, j, CASE WHEN j <= {d} THEN sum(p * (1 - p) * v[i] * v[least(j, {d})]) + CASE WHEN i = j AND i < {d} THEN 1 ELSE 0 END "
            f"ELSE sum((p - y) * v[i]) + CASE WHEN i < {d} THEN any_value(w[i]) ELSE 0 END END AS x "
            f"FROM p{t}, range(1, {d + 1}) r(i), range(1, {d + 2}) s(j) GROUP BY h, class, i, j)",
        ]
        for k in range(1, d + 1):
            ctes.append(
                f"a{t}_{k} AS MATERIALIZED (SELECT a.h, a.class, a.i, a.j, CASE WHEN a.i = {k} THEN a.x / pv.x ELSE a.x - c.x * r.x / pv.x END AS x FROM a{t}_{k - 1} a "
                f"JOIN a{t}_{k - 1} r ON r.h = a.h AND r.class = a.class AND r.i = {k} AND r.j = a.j "
                f"JOIN a{t}_{k - 1} c ON c.h = a.h AND c.class = a.class AND c.i = a.i AND c.j = {k} "
                f"JOIN a{t}_{k - 1} pv ON pv.h = a.h AND pv.class = a.class AND pv.i = {k} AND pv.j = {k} WHERE a.j > {k} OR a.j = {d + 1})"
            )
        ctes.append(
            f"w{t + 1} AS MATERIALIZED (SELECT h, class, list(w[i] - x ORDER BY i) AS w FROM a{t}_{d} JOIN w{t} USING (h, class) WHERE j = {d + 1} GROUP BY h, class)"
        )
    ctes += [
        f"pred AS (SELECT data.h, vec_id, label, class FROM data JOIN w{STEPS} w ON w.h = data.h AND data.fold = data.h "
        "QUALIFY row_number() OVER (PARTITION BY data.h, vec_id ORDER BY list_dot_product(v, w) DESC, class) = 1)",
        "acc AS (SELECT h, count(*) AS n_test, avg(CASE WHEN label = class THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY h)",
    ]
    if how == "cv":
        ctes.append("base AS (SELECT fold AS h, max(n) / sum(n) AS baseline FROM (SELECT fold, label, count(*) AS n FROM folds GROUP BY fold, label) GROUP BY fold)")
        return fx.with_ctes(*ctes) + f"SELECT CAST(h AS BIGINT) AS fold, n_test, {sql_r6('baseline')} AS baseline, {sql_r6('accuracy')} AS accuracy FROM acc JOIN base USING (h)"
    ctes += [
        "mode AS (SELECT label FROM folds WHERE fold = 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)",
        "base AS (SELECT avg(CASE WHEN label = (SELECT label FROM mode) THEN 1.0 ELSE 0.0 END) AS baseline FROM folds WHERE fold = 1)",
    ]
    return fx.with_ctes(*ctes) + f"SELECT n_test, {sql_r6('baseline')} AS baseline, {sql_r6('accuracy')} AS accuracy FROM acc, base"


def regression_sql(how: str) -> str:
    """R2 and RMSE of least squares on lexicon counts per held-out fold: features are made orthogonal one after the other on the training rows."""
    cols = [f"x{i}" for i in range(len(LEX_CATS))]
    fold = "CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS BIGINT)" if how == "cv" else f"CASE WHEN ({stable_hash_sql('doc_id', SPLIT_SEED)}) % 100 < 75 THEN 0 ELSE 1 END"
    held = "range(5)" if how == "cv" else "range(1, 2)"
    wide = ", ".join(f"coalesce(max(CASE WHEN category = '{c}' THEN n END), 0)::DOUBLE AS {x}" for c, x in zip(LEX_CATS, cols, strict=True))
    center = ", ".join(f"{x} - avg({x}) FILTER (WHERE fold <> h) OVER w AS {x}" for x in cols)
    ctes = [
        f"docs AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS y, {fold} AS fold FROM documents)",
        f"wide AS (SELECT doc_id, {wide} FROM ({_counts_sql(EXPANDED_TOKENS)}) GROUP BY doc_id)",
        f"g0 AS MATERIALIZED (SELECT h, doc_id, fold, y, y - avg(y) FILTER (WHERE fold <> h) OVER w AS r, {center} FROM docs JOIN wide USING (doc_id), {held} q(h) WINDOW w AS (PARTITION BY h))",
    ]
    for k, x in enumerate(cols):
        own = f"sum({x} * {x}) FILTER (WHERE fold <> h) OVER w"
        less = lambda c, x=x, own=own: (
            f"CASE WHEN {own} > 1e-9 THEN {c} - {x} * (sum({c} * {x}) FILTER (WHERE fold <> h) OVER w) / ({own}) ELSE {c} END AS {c}")
        ctes.append(f"g{k + 1} AS MATERIALIZED (SELECT h, doc_id, fold, y, {', '.join(less(c) for c in ['r', *cols[k + 1:]])} FROM g{k} WINDOW w AS (PARTITION BY h))")
    last = f"g{len(cols)}"
    ctes += [
        f"b AS (SELECT h, avg(y) AS m FROM {last} WHERE fold <> h GROUP BY h)",
        f"s AS (SELECT h, count(*) AS n_test, sqrt(avg((y - m) ^ 2)) AS baseline, 1 - sum(r * r) / (var_pop(y) * count(*)) AS r2, sqrt(avg(r * r)) AS rmse "
        f"FROM {last} JOIN b USING (h) WHERE fold = h GROUP BY h)",
    ]
    head = "CAST(h AS BIGINT) AS fold, " if how == "cv" else ""
    return fx.with_ctes(*ctes) + f"SELECT {head}n_test, {sql_r6('baseline')} AS baseline, {sql_r6('r2')} AS r2, {sql_r6('rmse')} AS rmse FROM s"
