"""Rectangles: boxes round groups, intersection join, containment, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import Rect, dist, inside, rect_touch
from foliant.operators.graph import page_components

SIDES = ("x", "y", "width", "height")


def bounding(rects: DataFrame, keys: list[str]) -> DataFrame:
    """The box round each group: one partial aggregation."""
    r = Rect()
    box = rects.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(r.right).alias("_r"), F.max(r.bottom).alias("_b"))
    return box.select(*keys, "x", "y", (F.col("_r") - F.col("x")).alias("width"), (F.col("_b") - F.col("y")).alias("height"))


def prefixed(rects: DataFrame, prefix: str, keys: list[str], id_col: str) -> DataFrame:
    return rects.select(*keys, *[F.col(c).alias(prefix + c) for c in (id_col, *SIDES)])


def cells(rects: DataFrame, prefix: str, cell: int) -> DataFrame:
    """A row for each grid cell that a rectangle meets."""
    r = Rect(prefix)
    across = rects.withColumn("_cx", F.explode(F.sequence(F.floor(r.x / cell), F.floor(r.right / cell))))
    return across.withColumn("_cy", F.explode(F.sequence(F.floor(r.y / cell), F.floor(r.bottom / cell))))


def meeting_pairs(rects: DataFrame, keys: list[str], id_col: str = "glyph_id", cell: int = 64, also: Column | None = None) -> DataFrame:
    """Pairs (keys, a_*, b_*) of rectangles that meet, each once, a's id below b's: an equality join on grid cells, then the exact test.

    A pair is kept in the cell where its intersection begins, so no distinct is needed.
    """
    a, b = Rect("a_"), Rect("b_")
    left, right = cells(prefixed(rects, "a_", keys, id_col), "a_", cell), cells(prefixed(rects, "b_", keys, id_col), "b_", cell)
    pairs = left.join(right, [*keys, "_cx", "_cy"]).where((F.col(f"a_{id_col}") < F.col(f"b_{id_col}")) & rect_touch(a, b))
    pairs = pairs.where((F.col("_cx") == F.floor(F.greatest(a.x, b.x) / cell)) & (F.col("_cy") == F.floor(F.greatest(a.y, b.y) / cell))).drop("_cx", "_cy")
    return pairs if also is None else pairs.where(also)


def join_rects(rects: DataFrame, keys: list[str], id_col: str = "glyph_id") -> DataFrame:
    """(keys, component, x, y, width, height): boxes round rectangles that meet, directly or through others.

    One pass, so that the boxes may meet again. component numbers them by x, y, width, height, the component's least id.
    """
    edges = meeting_pairs(rects, keys, id_col).select(*keys, F.col(f"a_{id_col}").alias("src"), F.col(f"b_{id_col}").alias("dst"))
    groups = page_components(rects, edges, keys, id_col, "_root")
    boxes = bounding(rects.join(groups, [*keys, id_col]), [*keys, "_root"])
    return boxes.withColumn("component", F.row_number().over(Window.partitionBy(*keys).orderBy(*SIDES, "_root")) - 1).drop("_root").select(*keys, "component", *SIDES)


def enclosing(rects: DataFrame, keys: list[str], id_col: str = "glyph_id") -> DataFrame:
    """Rectangles that lie in no other one, numbered by x and y descending, then right and bottom edge; of equal ones the first stays."""
    a, b = Rect("a_"), Rect("b_")
    pairs = meeting_pairs(rects, keys, id_col, also=inside(a, b) | inside(b, a))
    gone = pairs.select(*keys, F.when(inside(b, a), F.col(f"b_{id_col}")).otherwise(F.col(f"a_{id_col}")).alias(id_col)).distinct()
    kept = rects.join(gone, [*keys, id_col], "left_anti")
    r = Rect()
    order = Window.partitionBy(*keys).orderBy(r.x.desc(), r.y.desc(), r.right, r.bottom)
    return kept.select(*keys, id_col, *SIDES, (F.row_number().over(order) - 1).alias("position"))


def knn(rects: DataFrame, k: int = 100, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, id, rank, nb_id): the k nearest centres of each rectangle's page, itself included, by distance, then id; exact.

    Pages are joined with themselves, which is what k of about a page's size needs; Spark keeps the k first before sorting all.
    """
    a, b = Rect("a_"), Rect("b_")
    pairs = prefixed(rects, "a_", ["page_id"], id_col).join(prefixed(rects, "b_", ["page_id"], id_col), "page_id")
    d = (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)
    order = Window.partitionBy("page_id", f"a_{id_col}").orderBy(d, f"b_{id_col}")
    ranked = pairs.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return ranked.select("page_id", F.col(f"a_{id_col}").alias("id"), "rank", F.col(f"b_{id_col}").alias("nb_id"))


def nearest_rows(v: np.ndarray, w: np.ndarray, k: int, cells: int = 1 << 22, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of v, row of w, squared distance): the k rows of w nearest to each row of v, the first on ties; exact.

    A product of matrices bounds all distances to within ``slack``, far over its rounding errors; the distances of what may be among
    the k nearest by these bounds are then summed in double, one dimension after the other. Rows that aren't finite have no bounds.
    """
    n, dims = w.shape
    k = min(k, n)
    finite = bool(np.isfinite(v).all() and np.isfinite(w).all() and max(np.abs(v).max(initial=0), np.abs(w).max(initial=0)) < 1e150)
    centre = w.mean(0) if finite else 0
    a, b = v - centre, w - centre
    bb = (b * b).sum(1)
    slack = (8 * (dims + 16) * np.finfo(float).eps) * ((a * a).sum(1) + bb.max())
    step, groups = max(1, cells // n), min(32, n // (4 * k)) or 1
    for i in range(0, len(v), step):
        if finite:
            d = (-2 * a[i : i + step]) @ b.T + bb
            part = n // groups
            least = d if groups == 1 else d[:, : part * groups].reshape(len(d), groups, part).min(1)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * slack[i : i + step]
            row, col = np.nonzero(d <= bound[:, None])
        else:
            row, col = np.indices((len(v[i : i + step]), n)).reshape(2, -1)
        ends = np.searchsorted(row, np.arange(len(v[i : i + step]) + 1))
        j = 0
        while j < len(ends) - 1:
            t = max(j + 1, int(np.searchsorted(ends, ends[j] + most, "right")) - 1)
            r, c = row[ends[j] : ends[t]], col[ends[j] : ends[t]]
            exact = np.zeros(len(r))
            for x, y in zip(v[i + r].T, w[c].T):
                exact += (x - y) ** 2
            order = np.lexsort((c, exact, r))
            near = order[np.arange(len(r)) - (ends[j:t] - ends[j])[r[order] - j] < k]
            yield i + r[near], c[near], exact[near]
            j = t


def vector_knn(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rows: int | None = None) -> DataFrame:
    """(id, rank, nb_id): the k nearest rows of each row by squared distance in double, then id; itself included.

    Blocks of ``rows`` rows meet pairwise, each pair of blocks once and in a task of its own, which keeps k a row before the final
    choice. All pairs of rows are met, so time is the square of the table; what is shuffled is the table times the number of blocks.
    Unless given, ``rows`` makes eight blocks, of 2,048 to 32,768 rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    sized = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    total = sized.count()
    rows = rows or min(32768, max(2048, -(-total // 8)))
    n = max(1, -(-total // rows))
    blocks = sized.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    met = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def near(table: pa.Table) -> pa.Table:
        block, ids = table.column("b").to_numpy(), table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        dims = set(pc.list_value_length(lists).to_pylist())
        if len(dims) != 1:
            raise ValueError(f"vectors of different lengths: {sorted(dims)}")
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), dims.pop())
        order = np.argsort(ids, kind="stable")
        sides = [order[block[order] == x] for x in np.unique(block)]
        out = []
        for mine, other in ((sides[0], sides[0]),) if table.column("p")[0] == table.column("q")[0] else zip(sides, sides[::-1]) if len(sides) == 2 else ():
            out += [(ids[mine[r]], ids[other[c]], d) for r, c, d in nearest_rows(v[mine], v[other], k)]
        columns = [np.concatenate([*c, np.zeros(0, t)]).astype(t) for c, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, float))]
        return pa.table(dict(zip(("id", "nb_id", "d"), columns)))

    some = met.groupBy("p", "q").applyInArrow(near, "id long, nb_id long, d double")
    order = Window.partitionBy("id").orderBy("d", "nb_id")
    return some.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("id", "rank", "nb_id")


def neighbors(rects: DataFrame, near: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, id, nb_id, ratio, source) for every rectangle: the neighbour that continues its line, null if there is none.

    Candidates come from the nearest ones in ``near`` (page_id, id, rank, nb_id). First those to the right with a common y-range,
    by x over the overlap's share of their height; failing these, those closely to the left; failing these, for marks, a wider
    box above which they lie. All three are one join and one aggregate: source says which it was.
    """
    a, b = Rect("a_"), Rect("b_")
    pairs = near.join(prefixed(rects, "a_", ["page_id"], id_col).withColumnRenamed(f"a_{id_col}", "id"), ["page_id", "id"]).join(prefixed(rects, "b_", ["page_id"], id_col).withColumnRenamed(f"b_{id_col}", "nb_id"), ["page_id", "nb_id"])
    mean = rects.groupBy("page_id").agg(F.avg("height").alias("mean"))
    pairs = pairs.join(mean, "page_id").where("id <> nb_id")
    top, low = F.greatest(a.y, b.y), F.least(a.bottom, b.bottom)
    low2 = F.least(a.y + 2 * a.height, b.bottom)
    right = (top < low) & (b.x > a.x)
    left = (top < low) & (b.x < a.x) & (a.x - b.x < F.col("mean"))
    mark = (top < low2) & (a.x > b.x) & (a.right < b.right) & (b.x - a.x < 0.5 * F.col("mean")) & (a.height < 0.4 * F.col("mean"))
    source = F.when(right, 1).when(left, 2).when(mark, 3)
    ratio = F.when(source == 3, low2 - top).otherwise(low - top) / b.height.cast("double")
    found = pairs.withColumn("source", source).where("source is not null").withColumn("ratio", ratio)
    best = found.groupBy("page_id", "id").agg(F.min_by(F.struct("nb_id", "ratio", "source"), F.struct("source", b.x / F.col("ratio"), "nb_id")).alias("m")).select("page_id", "id", "m.*")
    every = rects.select("page_id", F.col(id_col).alias("id"))
    return every.join(best, ["page_id", "id"], "left")


def nearest_right(rects: DataFrame, near: DataFrame, id_col: str = "glyph_id", height: str = "least_height") -> DataFrame:
    """(page_id, id, nb_id): the nearest box with its centre to the right that shares over half of the higher one's y-range; both must
    be higher than the column ``height`` of the page."""
    a, b = Rect("a_"), Rect("b_")
    sides = prefixed(rects, "a_", ["page_id", height], id_col).withColumnRenamed(f"a_{id_col}", "id")
    pairs = near.join(sides, ["page_id", "id"]).join(prefixed(rects, "b_", ["page_id"], id_col).withColumnRenamed(f"b_{id_col}", "nb_id"), ["page_id", "nb_id"])
    over = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    ok = (b.cx > a.cx) & (over >= 0) & (F.least(a.height, b.height) > F.col(height)) & (over > 0.5 * F.greatest(a.height, b.height))
    return pairs.where(ok).groupBy("page_id", "id").agg(F.min_by("nb_id", F.struct(dist(a.cx, a.cy, b.cx, b.cy), "nb_id")).alias("nb_id"))


def half_corner_pairs(rects: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, src, dst, dist) of all pairs of a page by half corner, src below dst."""
    x, y = Rect().half_corner()
    p = rects.select("page_id", F.col(id_col).alias("src"), x.alias("ax"), y.alias("ay"))
    q = rects.select("page_id", F.col(id_col).alias("dst"), x.alias("bx"), y.alias("by"))
    return p.join(q, "page_id").where("src < dst").select("page_id", "src", "dst", dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("dist"))
