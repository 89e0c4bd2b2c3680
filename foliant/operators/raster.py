"""Binary pages as runs of foreground pixels (page_id, y, x0, x1), ends inclusive; never a row a pixel but for column profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.graph import page_components, union_find
from foliant.operators.intervals import interval_join

ORDER, CELL = ("y", "x0", "x1"), 64


def merged(runs: DataFrame) -> DataFrame:
    """Maximal runs: those of a row that overlap or follow each other become one."""
    order = Window.partitionBy("page_id", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = runs.withColumn("_new", F.when(F.col("x0") <= reach + 1, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page_id", "y", "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def components(runs: DataFrame) -> DataFrame:
    """(page_id, comp_id, x, y, width, height, area) of the 8-connected components of maximal runs; comp_id counts from the top.

    Runs meet only those of the next row in the same cells, by an equality join, and the boxes are one aggregate.
    """
    ids = runs.withColumn("id", F.row_number().over(Window.partitionBy("page_id").orderBy(*ORDER)).cast("long"))
    a = ids.select("page_id", F.col("y").alias("ay"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("src"))
    b = ids.select("page_id", (F.col("y") - 1).alias("ay"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("dst"))
    near = a.withColumns({"a0": F.col("a0") - 1, "a1": F.col("a1") + 1})
    edges = interval_join(near, b, ["page_id", "ay"], ("a0", "a1"), ("b0", "b1"), CELL).select("page_id", "src", "dst")
    whole = ids.join(page_components(ids, edges, ["page_id"]), ["page_id", "id"])
    boxes = whole.groupBy("page_id", "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return boxes.withColumn("comp_id", F.row_number().over(Window.partitionBy("page_id").orderBy("component"))).drop("component").select("page_id", "comp_id", "x", "y", "width", "height", "area")


def row_profile(runs: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, y, v): foreground pixels of each row that has any."""
    return runs.groupBy(*keys, "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("v"))


def column_profile(runs: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys, x, v): foreground pixels of each column that has any, by adding up where runs begin and end."""
    ends = runs.select(*keys, F.col("x0").alias("x"), F.lit(1).alias("d")).union(runs.select(*keys, (F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "x").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("x")
    level = steps.withColumns({"v": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("x").over(order)})
    return level.where("v > 0").select(*keys, F.explode(F.sequence(F.col("x"), F.col("_next") - 1)).alias("x"), "v")


def one_runs(profile: DataFrame, keys: list[str], at: str, v: str = "v", zero: bool = False) -> DataFrame:
    """(keys, run, first, last): maximal runs of non-zero values of a profile, or of zero ones where it has these rows; both ends inclusive."""
    rows = profile.where(F.col(v) == 0 if zero else F.col(v) != 0)
    order = Window.partitionBy(*keys).orderBy(at)
    rows = rows.withColumn("_g", F.col(at) - F.row_number().over(order))
    found = rows.groupBy(*keys, "_g").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).select(*keys, "run", "first", "last")


def zero_runs(profile: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The gaps between the rows of a profile that has its non-zero values only: (keys, run, first, last)."""
    order = Window.partitionBy(*keys).orderBy(at)
    rows = profile.where("v <> 0").withColumn("_after", F.lead(at).over(order))
    found = rows.where(F.col("_after") > F.col(at) + 1).select(*keys, (F.col(at) + 1).alias("first"), (F.col("_after") - 1).alias("last"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).select(*keys, "run", "first", "last")


def widest(runs: DataFrame, keys: list[str], among: DataFrame | None = None) -> DataFrame:
    """(keys, widest): the number of the widest run, the first on ties; groups of ``among`` without runs have -1."""
    best = runs.groupBy(*keys).agg(F.max_by("run", F.struct((F.col("last") - F.col("first")).alias("n"), (-F.col("run")).alias("r"))).alias("widest"))
    return best if among is None else among.select(*keys).distinct().join(best, keys, "left").withColumn("widest", F.coalesce("widest", F.lit(-1)))


def trim(runs: DataFrame) -> DataFrame:
    """(page_id, x, y, width, height): the page without white borders; as in the original, width and height lack the last column and row."""
    return runs.groupBy("page_id").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("width"), (F.max("y") - F.min("y")).alias("height"))


def mask(runs: DataFrame, rects: DataFrame) -> DataFrame:
    """Runs without the pixels of rectangles (page_id, x, y, width, height): each run less the union of what covers it.

    Runs and the rows of rectangles meet in cells of a row, so a row never meets itself as a whole.
    """
    rows = rects.select("page_id", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"), F.col("x").alias("m0"), (F.col("x") + F.col("width") - 1).alias("m1"))
    over = interval_join(runs, rows, ["page_id", "y"], ("x0", "x1"), ("m0", "m1"), CELL)
    met = over.groupBy("page_id", *ORDER).agg(F.array_sort(F.collect_set(F.struct("m0", "m1"))).alias("ms"))
    grouped = runs.join(met, ["page_id", *ORDER], "left").withColumn("ms", F.coalesce("ms", F.array().cast("array<struct<m0:int,m1:int>>")))
    piece = "array<struct<a:int,b:int>>"

    def step(acc, m):
        inside = m["m0"].isNotNull() & (m["m0"] <= F.col("x1")) & (m["m1"] >= F.col("x0"))
        cut = F.array(F.struct(acc["at"].alias("a"), (m["m0"] - 1).cast("int").alias("b")))
        out = F.when(inside & (m["m0"] > acc["at"]), F.concat(acc["out"], cut)).otherwise(acc["out"])
        return F.struct(F.when(inside, F.greatest(acc["at"], m["m1"] + 1)).otherwise(acc["at"]).cast("int").alias("at"), out.cast(piece).alias("out"))

    done = F.aggregate("ms", F.struct(F.col("x0").cast("int").alias("at"), F.array().cast(piece).alias("out")), step)
    rest = F.when(done["at"] <= F.col("x1"), F.concat(done["out"], F.array(F.struct(done["at"].alias("a"), F.col("x1").cast("int").alias("b"))))).otherwise(done["out"])
    return grouped.select("page_id", "y", F.explode(rest).alias("p")).select("page_id", "y", F.col("p.a").alias("x0"), F.col("p.b").alias("x1"))


def dilate(runs: DataFrame, left: int, right: int, up: int, down: int) -> DataFrame:
    """Every run widened and copied to the rows around it, as maximal runs."""
    return merged(runs.select("page_id", F.explode(F.sequence(F.col("y") - up, F.col("y") + down)).alias("y"), (F.col("x0") - left).alias("x0"), (F.col("x1") + right).alias("x1")))


def erode(runs: DataFrame, left: int, right: int, up: int, down: int) -> DataFrame:
    """The pixels whose whole neighbourhood is foreground: runs shortened, then met over all the rows of the neighbourhood."""
    n = up + down + 1
    short = merged(runs).select("page_id", "y", (F.col("x0") + left).alias("x0"), (F.col("x1") - right).alias("x1")).where("x0 <= x1")
    ends = short.select("page_id", F.explode(F.sequence(F.col("y") - down, F.col("y") + up)).alias("y"), "x0", "x1")
    steps = ends.select("page_id", "y", F.col("x0").alias("x"), F.lit(1).alias("d")).union(ends.select("page_id", "y", (F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    steps = steps.groupBy("page_id", "y", "x").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("page_id", "y").orderBy("x")
    level = steps.withColumns({"_v": F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.lead("x").over(order)})
    return merged(level.where(F.col("_v") == n).select("page_id", "y", F.col("x").alias("x0"), (F.col("_n") - 1).alias("x1")))


def close(runs: DataFrame) -> DataFrame:
    """Dilation, then erosion, by three by three pixels."""
    return erode(dilate(runs, 1, 1, 1, 1), 1, 1, 1, 1)


def fill_ratio(runs: DataFrame, rects: DataFrame, id_col: str) -> DataFrame:
    """(page_id, id, ratio): the foreground's share of each rectangle."""
    rows = rects.select("page_id", id_col, F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"), F.col("x").alias("_m0"), (F.col("x") + F.col("width") - 1).alias("_m1"))
    part = F.least("x1", "_m1") - F.greatest("x0", "_m0") + 1
    held = interval_join(rows.select("page_id", id_col, "y", "_m0", "_m1"), runs, ["page_id", "y"], ("_m0", "_m1"), ("x0", "x1"), CELL).groupBy("page_id", id_col).agg(F.sum(part).alias("_held"))
    whole = rects.select("page_id", id_col, (F.col("width") * F.col("height")).cast("double").alias("_area"))
    return whole.join(held, ["page_id", id_col], "left").select("page_id", id_col, (F.coalesce("_held", F.lit(0)) / F.col("_area")).alias("ratio"))


def side_margin(rects: DataFrame, width: Column | str, share: float = 0.03) -> Column:
    """Whether over half of a rectangle lies in the bands at the sides of a page."""
    w = F.col(width) if isinstance(width, str) else width
    band = lambda low, high: F.greatest(F.lit(0), F.least(F.col("x") + F.col("width"), high) - F.greatest(F.col("x"), low)) * F.col("height")
    both = band(F.lit(0), F.floor(w * share)) + band(F.floor(w * (1 - share)), w)
    return both > 0.5 * (F.col("width") * F.col("height"))


def outer_boundaries(runs: DataFrame) -> DataFrame:
    """(page_id, comp, area, filled): for each component its pixels and those inside its outer boundary, holes included.

    Components are found on runs; holes by flooding each one's own box from outside.
    """

    def work(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ORDER)))
        by_row: dict[int, list[int]] = {}
        for i, (y, _, _) in enumerate(rows):
            by_row.setdefault(y, []).append(i)
        src, dst = list(range(len(rows))), list(range(len(rows)))
        for y, own in by_row.items():
            for i in own:
                for j in by_row.get(y + 1, ()):
                    if rows[j][1] <= rows[i][2] + 1 and rows[j][2] >= rows[i][1] - 1:
                        src.append(i)
                        dst.append(j)
        members: dict[int, list[int]] = {}
        for i, root in zip(*union_find(src, dst)):
            members.setdefault(root, []).append(i)
        out = []
        for n, root in enumerate(sorted(members), 1):
            own = [rows[i] for i in members[root]]
            top, left = min(r[0] for r in own) - 1, min(r[1] for r in own) - 1
            image = np.zeros((max(r[0] for r in own) - top + 2, max(r[2] for r in own) - left + 2), bool)
            for y, a, b in own:
                image[y - top, a - left : b - left + 1] = True
            outside, grown = np.zeros(image.shape, bool), np.ones(1, bool)
            outside[0, 0] = True
            while grown.any():
                near = outside.copy()
                near[1:] |= outside[:-1]
                near[:-1] |= outside[1:]
                near[:, 1:] |= outside[:, :-1]
                near[:, :-1] |= outside[:, 1:]
                grown = near & ~image & ~outside
                outside |= grown
            out.append((n, int(image.sum()), int((~outside).sum())))
        return pa.table({"page_id": [key[0].as_py()] * len(out), "comp": [o[0] for o in out], "area": [o[1] for o in out], "filled": [o[2] for o in out]}, schema=pa.schema([("page_id", pa.int64()), ("comp", pa.int64()), ("area", pa.int64()), ("filled", pa.int64())]))

    return runs.groupBy("page_id").applyInArrow(work, "page_id long, comp long, area long, filled long")
