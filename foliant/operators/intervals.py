"""Joins, unions and complements of numeric intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import touch
from foliant.operators.graph import page_components


def _cells(rows: DataFrame, low: str, high: str, cell: float) -> DataFrame:
    return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], cell: float, also: Column | None = None) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose closed intervals meet, each once. Columns besides the keys must differ.

    Intervals are cut at multiples of ``cell`` and joined by equality on the cell, so a group never meets itself as a whole; a pair
    is kept in the cell where its overlap begins. A ``cell`` of about twice the usual length keeps the copies few.
    """
    (a, b), (c, d) = left_ends, right_ends
    found = _cells(left, a, b, cell).join(_cells(right, c, d, cell), [*keys, "_cell"])
    found = found.where(touch(F.col(a), F.col(b), F.col(c), F.col(d)) & (F.col("_cell") == F.floor(F.greatest(F.col(a), F.col(c)) / cell))).drop("_cell")
    return found if also is None else found.where(also)


def join_intervals(ranges: DataFrame, keys: list[str], share: float = 0.1, cell: float = 32) -> DataFrame:
    """(keys, component, low, high): ranges (keys, id, low, high) joined where two overlap by over ``share`` of both lengths.

    Components are transitive; a range of length 0 joins nothing.
    """
    a = ranges.select(*keys, F.col("id").alias("src"), F.col("low").alias("a"), F.col("high").alias("b"))
    b = ranges.select(*keys, F.col("id").alias("dst"), F.col("low").alias("c"), F.col("high").alias("d"))
    over = (F.least("b", "d") - F.greatest("a", "c")).cast("double")
    enough = (F.col("src") < F.col("dst")) & (F.col("b") > F.col("a")) & (F.col("d") > F.col("c")) & (over / (F.col("b") - F.col("a")) > share) & (over / (F.col("d") - F.col("c")) > share)
    edges = interval_join(a, b, keys, ("a", "b"), ("c", "d"), cell, enough).select(*keys, "src", "dst")
    groups = page_components(ranges, edges, keys)
    return ranges.join(groups, [*keys, "id"]).groupBy(*keys, "component").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def stab(points: DataFrame, ranges: DataFrame, keys: list[str], value: str, cell: float = 64) -> DataFrame:
    """Every point with the first closed range (low, high) that holds it, by low, then high; points without one are left out."""
    ids = [c for c in points.columns if c not in keys]
    p = points.withColumns({"_v": F.col(value), "_w": F.col(value)})
    hits = interval_join(p, ranges.select(*keys, "low", "high"), keys, ("_v", "_w"), ("low", "high"), cell)
    first = hits.groupBy(*keys, *ids).agg(F.min(F.struct("low", "high")).alias("r"))
    return first.select(*points.columns, "r.low", "r.high")


def touching_groups(rects: DataFrame, ranges: DataFrame, keys: list[str], cell: float = 32) -> DataFrame:
    """Every rectangle with every range (component, low, high) that its closed x-range meets; it may be in several."""
    boxes = rects.withColumns({"_l": F.col("x"), "_r": F.col("x") + F.col("width")})
    return interval_join(boxes, ranges, keys, ("_l", "_r"), ("low", "high"), cell).drop("_l", "_r")


def union_all(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): the union of closed ranges as disjoint ones."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(F.col("low") <= reach, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_island")


def complement(ranges: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): what the disjoint ``ranges`` leave of each group's (first, last) in ``bounds``; empty pieces are left out."""
    order = Window.partitionBy(*keys).orderBy("low")
    rows = ranges.join(bounds, keys)
    after = rows.select(*keys, F.col("high").alias("low"), F.coalesce(F.lead("low").over(order), "last").alias("high"))
    before = rows.groupBy(*keys).agg(F.first("first").alias("low"), F.min("low").alias("high"))
    return after.union(before).where("low < high")


def drop_contained_lines(lines: DataFrame) -> DataFrame:
    """Line limits (page_id, line_id, upper, lower) that lie in no other line; of equal ones the first stays."""
    big = lines.select("page_id", F.col("line_id").alias("o"), F.col("upper").alias("ou"), F.col("lower").alias("ol"))
    covered = (F.col("ou") <= F.col("upper")) & (F.col("ol") >= F.col("lower")) & (F.col("o") != F.col("line_id"))
    same = (F.col("ou") == F.col("upper")) & (F.col("ol") == F.col("lower"))
    return lines.join(big.withColumnRenamed("page_id", "op"), (F.col("op") == F.col("page_id")) & covered & (~same | (F.col("o") < F.col("line_id"))), "left_anti")


def merge_adjacent_lines(lines: DataFrame) -> DataFrame:
    """Neighbouring lines, by lower_baseline, become one where they overlap by over half of the higher one's height.

    Each pair that overlaps gives a line, as it is from the first to the second; a line of no such pair stays as it is.
    """
    order = Window.partitionBy("page_id").orderBy("lower_baseline", "upper", "lower", "line_id")
    names = ("upper", "upper_baseline", "lower_baseline", "lower")
    rows = lines.select("page_id", "line_id", *names, *[F.lead(n).over(order).alias(f"n_{n}") for n in names])
    over = F.col("lower") - F.greatest("upper", "n_upper")
    joins = F.coalesce((F.col("lower") > F.col("n_upper")) & (over > 0.5 * F.greatest(F.col("n_lower") - F.col("n_upper"), F.col("lower") - F.col("upper"))), F.lit(False))
    rows = rows.withColumn("joins", joins)
    rows = rows.withColumn("joined", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    both = F.struct(F.least("upper", "n_upper").alias("upper"), F.col("upper_baseline"), F.col("n_lower_baseline").alias("lower_baseline"), F.col("n_lower").alias("lower"))
    own = F.struct(*names)
    return rows.where("joins or not joined").select("page_id", "line_id", F.when(F.col("joins"), both).otherwise(own).alias("l")).select("page_id", "line_id", "l.*")
