"""Single linkage and its cuts, threshold sweeps, and the other linkages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import Rect
from foliant.operators.graph import page_components
from foliant.operators.rects import half_corner_pairs


def coefficients(first: float = 0.5, step: float = 0.1, last: float = 4.0) -> list[float]:
    """The sweep's 35 coefficients, by repeated addition as doubles."""
    out, x = [], first
    while x <= last:
        out.append(x)
        x += step
    return out


def points(rects: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    x, y = Rect().half_corner()
    return rects.select("page_id", F.col(id_col).cast("long").alias("id"), x.cast("double").alias("px"), y.cast("double").alias("py"))


def _by_page(pts: DataFrame, work, schema: str) -> DataFrame:
    def run(key, table):
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids = table.column("id").to_numpy()[order]
        xy = np.stack([table.column(c).to_numpy()[order] for c in ("px", "py")], 1)
        columns = work(ids, xy)
        n = len(next(iter(columns.values())))
        return pa.table({"page_id": pa.array([key[0].as_py()] * n, pa.int64()), **columns})

    return pts.groupBy("page_id").applyInArrow(run, f"page_id long, {schema}")


def mst(pts: DataFrame) -> DataFrame:
    """(page_id, u, v, dist): the edges of a minimum spanning tree of each page's points (page_id, id, px, py), by Prim's method.

    Memory is linear in a page: distances are made as they are needed, the condensed matrix never exists.
    """

    def work(ids: np.ndarray, xy: np.ndarray) -> dict:
        n = len(ids)
        best, by, seen = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
        at, u, v, d = 0, [], [], []
        for _ in range(n - 1):
            seen[at] = True
            away = np.sqrt(((xy - xy[at]) ** 2).sum(1))
            closer = ~seen & (away < best)
            best[closer], by[closer] = away[closer], at
            at = int(np.argmin(np.where(seen, np.inf, best)))
            u.append(ids[by[at]])
            v.append(ids[at])
            d.append(best[at])
        return {"u": np.array(u, np.int64), "v": np.array(v, np.int64), "dist": np.array(d, float)}

    return _by_page(pts, work, "u long, v long, dist double")


def cut_count(tree: DataFrame, sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """(page_id, step, clusters) for each limit (page_id, step, limit): the points less the tree's edges under the limit."""
    under = limits.join(tree, "page_id", "left").groupBy("page_id", "step").agg(F.sum(F.when(F.col("dist") < F.col("limit"), 1).otherwise(0)).alias("joined"))
    return under.join(sizes, "page_id").select("page_id", "step", (F.col("n") - F.col("joined")).alias("clusters"))


def cut_dist(rects: DataFrame, limit: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, id, component): single-linkage clusters at the page's ``limit`` (page_id, limit).

    These are the components of the pairs closer than the limit, so no tree is built.
    """
    near = half_corner_pairs(rects, id_col).join(limit, "page_id").where("dist < limit").select("page_id", "src", "dst")
    return page_components(rects, near, ["page_id"], id_col, "component")


def labelled(components: DataFrame, id_col: str) -> DataFrame:
    """Labels 0, 1, ... by first appearance, which is by least member."""
    return components.withColumn("label", F.dense_rank().over(Window.partitionBy("page_id").orderBy("component")) - 1)


def cut_k(tree: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """(page_id, id, label) of k clusters: the tree without its k-1 longest edges. With k below 2 or above the points, all labels are 0."""
    order = Window.partitionBy("page_id").orderBy(F.desc("dist"), F.desc("u"), F.desc("v"))
    n = pts.groupBy("page_id").agg(F.count("*").alias("n"))
    keep = tree.withColumn("_r", F.row_number().over(order)).join(n, "page_id").where((F.col("_r") > k - 1) | F.lit(k < 2) | (F.col("n") < k))
    return labelled(page_components(pts, keep.select("page_id", F.col("u").alias("src"), F.col("v").alias("dst")), ["page_id"], "id"), "id").select("page_id", "id", "label")


def sweep(tree: DataFrame, rects: DataFrame, *, lagged: bool = False, coefs: list[float] | None = None) -> DataFrame:
    """(page_id, coef, cut, found): where the number of clusters stops changing as the limit, coefficient times mean height, grows.

    The first step with as many clusters as the one before. ``lagged``: the step after two equal counts, and the last one if
    there are none; without ``lagged`` found is then false. One pass over the tree gives all counts.
    """
    coefs = coefs or coefficients()
    page = rects.groupBy("page_id").agg(F.count("*").alias("n"), F.avg("height").alias("mean"))
    limits = page.select("page_id", "mean", F.posexplode(F.array(*[F.lit(c) for c in coefs])).alias("step", "coef")).withColumn("limit", F.col("mean") * F.col("coef"))
    counts = cut_count(tree, page.select("page_id", "n"), limits.select("page_id", "step", "limit"))
    order = Window.partitionBy("page_id").orderBy("step")
    now, back = (F.lag("clusters").over(order), F.lag("clusters", 2).over(order)) if lagged else (F.col("clusters"), F.lag("clusters").over(order))
    stops = counts.withColumn("stop", F.coalesce(now == back, F.lit(False)))
    first = stops.groupBy("page_id").agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("step"))), F.lit(len(coefs) - 1)).alias("step"), F.max("stop").alias("found"))
    return limits.join(first, ["page_id", "step"]).select("page_id", "coef", F.col("limit").alias("cut"), F.lit(True).alias("found") if lagged else "found")


def linkage(pts: DataFrame, method: str = "single") -> DataFrame:
    """(page_id, step, a, b, dist): merges in order of distance; singletons are -1 - position, clusters the step that made them, from 1.

    ``method``: single, complete, average or median, by updating a page's distance matrix.
    """

    def work(ids: np.ndarray, xy: np.ndarray) -> dict:
        n = len(ids)
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        if method == "median":
            d = d * d
        name, size, alive = [-1 - i for i in range(n)], np.ones(n), np.ones(n, bool)
        a, b, dist = [], [], []
        for step in range(1, n):
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            h = d[i, j]
            first, second = sorted((name[i], name[j]), key=lambda x: (x > 0, abs(x)))
            a.append(first)
            b.append(second)
            dist.append(np.sqrt(h) if method == "median" else h)
            rest = alive.copy()
            rest[[i, j]] = False
            x, y = d[i, rest], d[j, rest]
            new = np.minimum(x, y) if method == "single" else np.maximum(x, y) if method == "complete" else (size[i] * x + size[j] * y) / (size[i] + size[j]) if method == "average" else x / 2 + y / 2 - h / 4
            d[i, rest] = d[rest, i] = new
            d[j], d[:, j] = np.inf, np.inf
            alive[j], size[i], name[i] = False, size[i] + size[j], step
        return {"step": np.arange(1, n, dtype=np.int64), "a": np.array(a, np.int64), "b": np.array(b, np.int64), "dist": np.array(dist, float)}

    if method not in ("single", "complete", "average", "median"):
        raise ValueError(method)
    return _by_page(pts, work, "step long, a long, b long, dist double")


def knn_graph_clusters(rects: DataFrame, near: DataFrame, limit: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, id, component): components of the pairs of nearest neighbours whose centres are closer than the page's limit."""
    a, b = Rect("a_"), Rect("b_")
    side = lambda p, n: rects.select("page_id", F.col(id_col).alias(n), *[F.col(c).alias(p + c) for c in ("x", "y", "width", "height")])
    pairs = near.join(side("a_", "id"), ["page_id", "id"]).join(side("b_", "nb_id"), ["page_id", "nb_id"]).join(limit, "page_id")
    d = F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))
    return page_components(rects, pairs.where(d < F.col("limit")).select("page_id", F.col("id").alias("src"), F.col("nb_id").alias("dst")), ["page_id"], id_col, "component")


