"""Concept representation: similarity of every text vector to every category centroid.

Plan: the centroid model (C categories x K clusters x d doubles, bounded by
the lexicon, size-checked) is collected once and broadcast; texts are
scored in Arrow batches with one matrix product per batch. The result is
one ``array<double>`` per text in lexicon order, so the wide matrix is a
plain projection and the long form a ``posexplode``: no shuffle, no
per-pair rows, no join of texts with centroids.

A model above the bound is split into category blocks; every block is
broadcast on its own and adds one score array to the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import MODEL_MAX_ROWS, collect_bounded

# Largest centroid block broadcast at once (doubles); 16M doubles = 128 MB.
MAX_MODEL_CELLS = 16_000_000


def ordered_categories(categories: DataFrame) -> list[str]:
    """Category names in lexicon order (a small, bounded list, like pivot values)."""
    rows = collect_bounded(categories.select("category", "ord").distinct(), MODEL_MAX_ROWS, "category list")
    return [r["category"] for r in sorted(rows, key=lambda r: (r["ord"], r["category"]))]


def _model_blocks(centroids: DataFrame, cats: list[str], per_cluster: bool):
    """Collect the aligned centroid rows and split them into bounded blocks."""
    pos = {c: i for i, c in enumerate(cats)}
    rows = collect_bounded(centroids.select("category", "cluster", "centroid"), MODEL_MAX_ROWS, "centroid model")
    rows = [r for r in rows if r["category"] in pos]
    rows.sort(key=lambda r: (pos[r["category"]], r["cluster"]))
    dim = len(rows[0]["centroid"]) if rows else 0
    blocks, cur, cur_cats = [], [], set()
    budget = max(1, MAX_MODEL_CELLS // max(dim, 1))
    for r in rows:
        if len(cur) >= budget and r["category"] not in cur_cats:
            blocks.append(cur)
            cur, cur_cats = [], set()
        cur.append(r)
        cur_cats.add(r["category"])
    if cur or not blocks:
        blocks.append(cur)
    out = []
    for b in blocks:
        if per_cluster:
            names = [(r["category"], int(r["cluster"])) for r in b]
            col_of_row = np.arange(len(b))
        else:
            names_cat = [c for c in cats if c in {r["category"] for r in b}] if len(blocks) > 1 else cats
            npos = {c: i for i, c in enumerate(names_cat)}
            names = [(c, None) for c in names_cat]
            col_of_row = np.array([npos[r["category"]] for r in b], dtype=np.int64)
        mat = np.array([r["centroid"] for r in b], dtype=np.float64).reshape(len(b), dim)
        out.append((names, mat, col_of_row))
    return out


def _similarities(x: np.ndarray, mat: np.ndarray, metric: str) -> np.ndarray:
    """(n, d) x (m, d) -> (n, m) similarity matrix."""
    if metric == "cosine":
        xn = np.linalg.norm(x, axis=1)
        cn = np.linalg.norm(mat, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (x @ mat.T) / np.outer(xn, cn)
        s[~np.isfinite(s)] = 0.0
        return s
    if metric == "l2":
        d2 = (x * x).sum(1)[:, None] + (mat * mat).sum(1)[None, :] - 2.0 * (x @ mat.T)
        return np.exp(-np.sqrt(np.clip(d2, 0.0, None)) / x.shape[1])
    if metric == "l1":
        s = np.empty((x.shape[0], mat.shape[0]))
        for j in range(mat.shape[0]):
            s[:, j] = np.abs(x - mat[j]).sum(1)
        return np.exp(-s / x.shape[1])
    if metric == "dot":
        return x @ mat.T
    raise ValueError(metric)


def _reduce(s: np.ndarray, col_of_row: np.ndarray, n_out: int, reduce: str) -> np.ndarray:
    """Collapse centroid columns to output columns: max (or mean) over a category's clusters; none -> 0."""
    if reduce == "mean":
        sums = np.zeros((s.shape[0], n_out))
        np.add.at(sums.T, col_of_row, s.T)
        cnt = np.bincount(col_of_row, minlength=n_out).astype(np.float64)
        return np.where(cnt > 0, sums / np.maximum(cnt, 1.0), 0.0)
    best = np.full((s.shape[0], n_out), -np.inf)
    for j, c in enumerate(col_of_row):
        np.maximum(best[:, c], s[:, j], out=best[:, c])
    best[np.isneginf(best)] = 0.0
    return best


def _scorer(bc, n_out: int, metric: str, reduce: str = "max"):
    """Arrow-native scorer: a batch of vectors -> array of n_out scores per row.

    The list column's flat value buffer is viewed as an (n, d) matrix (no
    per-row conversion), scored with one matrix product against the
    broadcast model, and returned as one flat buffer plus offsets. A missing
    vector scores 0 everywhere, like a missing category.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vecs: pa.Array) -> pa.Array:
        mat, col_of_row = bc.value
        n = len(vecs)
        out = np.zeros((n, n_out), dtype=np.float64)
        valid = np.asarray(vecs.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
        if valid.any() and len(col_of_row):
            flat = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            x = flat.reshape(int(valid.sum()), mat.shape[1])
            out[valid] = _reduce(_similarities(x, mat, metric), col_of_row, n_out, reduce)
        offsets = pa.array(np.arange(0, (n + 1) * n_out, n_out, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), type=pa.float64()))

    return score


def score_blocks(docs: DataFrame, centroids: DataFrame, categories: DataFrame, vec_col: str = "embedding", metric: str = "cosine",
                 per_cluster: bool = False, reduce: str = "max", prefix: str = "_scores") -> tuple[DataFrame, dict]:
    """Append one score array per model block to every row: (frame, {output name: score column}).

    However many blocks the model has, rows are only widened: nothing is
    grouped or joined, so repeated and null ids keep their rows.
    """
    cats = ordered_categories(categories)
    sc = docs.sparkSession.sparkContext
    names: dict = {}
    for i, (outs, mat, col_of_row) in enumerate(_model_blocks(centroids, cats, per_cluster)):
        bc = sc.broadcast((mat, col_of_row))
        docs = docs.withColumn(f"{prefix}{i}", _scorer(bc, len(outs), metric, reduce)(F.col(vec_col)))
        for j, name in enumerate(outs):
            names[name] = F.col(f"{prefix}{i}")[j]
    if not per_cluster:  # categories without any centroid score 0
        names = {(c, None): names.get((c, None), F.lit(0.0)) for c in cats}
    return docs, names


def concept_similarity(docs: DataFrame, centroids: DataFrame, categories: DataFrame, id_col: str = "doc_id",
                       vec_col: str = "embedding", metric: str = "cosine", per_cluster: bool = False,
                       value_col: str = "similarity", reduce: str = "max") -> DataFrame:
    """Long form ``(id, category[, cluster], similarity)``.

    With ``per_cluster=False`` this is already the max over each category's
    clusters with missing categories filled by 0 (``concept_similarity_max``
    + ``zero_fill``).
    """
    scored, names = score_blocks(docs.select(id_col, vec_col), centroids, categories, vec_col, metric, per_cluster, reduce)
    entries = F.array(*[
        F.struct(F.lit(c).alias("category"), *([F.lit(int(k)).alias("cluster")] if per_cluster else []), v.alias(value_col))
        for (c, k), v in names.items()
    ])
    return scored.select(id_col, F.inline(entries))


def concept_matrix(docs: DataFrame, centroids: DataFrame, categories: DataFrame, id_col: str = "doc_id",
                   vec_col: str = "embedding", metric: str = "cosine", keep: list[str] | None = None,
                   reduce: str = "max") -> DataFrame:
    """Wide form: one row per text, one double column per category in lexicon order."""
    keep = keep or []
    scored, names = score_blocks(docs.select(id_col, vec_col, *keep), centroids, categories, vec_col, metric, reduce=reduce)
    return scored.select(id_col, *keep, *[v.alias(c) for (c, _), v in names.items()])


def attach_targets(rep: DataFrame, targets: DataFrame, id_col: str = "doc_id", how: str = "left") -> DataFrame:
    """Add label column(s) by key (never by row position)."""
    return rep.join(targets, id_col, how)
