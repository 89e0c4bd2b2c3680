"""The whole pipelines: from boxes, runs or images to lines, captions, clusters and new layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import captions, clusters, histograms, intervals, layout, lines, raster, rects
from foliant.operators.graph import page_components
from foliant.operators.rects import SIDES
from foliant.shared import materialise


def joined_rects(components: DataFrame) -> DataFrame:
    """(page_id, glyph_id, x, y, width, height): components without rules and specks, joined where they meet, without contained ones."""
    kept = materialise(histograms.drop_specks(components).withColumnRenamed("comp_id", "glyph_id"), "components")
    joined = materialise(rects.join_rects(kept, ["page_id"]).withColumnRenamed("component", "glyph_id"), "joined")
    return rects.enclosing(joined, ["page_id"]).select("page_id", F.col("position").alias("glyph_id"), *SIDES)


def rects_with_captions(components: DataFrame) -> DataFrame:
    """``joined_rects`` with pictures grown by their captions: (page_id, component, x, y, width, height, is_picture)."""
    boxes = materialise(joined_rects(components), "rects")
    return captions.attach_captions(boxes, captions.detect_captions(boxes))


def text_rects(whole: DataFrame) -> DataFrame:
    return whole.where("not is_picture").select("page_id", F.col("component").alias("glyph_id"), *SIDES)


def ordered_glyphs(components: DataFrame, k: int = 100) -> DataFrame:
    """Lines, words and glyphs of pages given as components, pictures left out."""
    return lines.ordered_glyphs(text_rects(rects_with_captions(components)), k)


def reflow(components: DataFrame, widths: DataFrame, *, factor: float, zoom: float, k: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placements of a page's words and pictures at a new width; see ``layout.placements``."""
    whole = materialise(rects_with_captions(components), "whole")
    pictures = whole.where("is_picture").select("page_id", F.col("component").alias("picture"), *SIDES)
    glyphs = materialise(lines.ordered_glyphs(text_rects(whole), k), "ordered")
    return layout.placements(glyphs, pictures, widths, factor=factor, zoom=zoom)


def page_clusters(components: DataFrame) -> DataFrame:
    """(page_id, glyph_id, label): clusters of ``joined_rects`` where the sweep's count has stopped changing."""
    boxes = materialise(joined_rects(components), "rects")
    cut = clusters.sweep(clusters.mst(clusters.points(boxes)), boxes, lagged=True)
    return clusters.labelled(clusters.cut_dist(boxes, cut.select("page_id", F.col("cut").alias("limit"))), "glyph_id").select("page_id", "glyph_id", "label")


def line_limits(boxes: DataFrame, k: int = 100) -> DataFrame:
    """(page_id, line_id, upper, upper_baseline, lower_baseline, lower) by the older pipeline.

    Boxes lower than the modal height less the deviation are left out; a page of under 30 boxes is one line. Lines are chains of
    nearest boxes to the right; a baseline is the most frequent edge. Lines inside others go, overlapping neighbours become one.
    """
    modal = histograms.modal_height(boxes, ["page_id"])
    stats = boxes.groupBy("page_id").agg(F.stddev_pop("height").alias("dev")).join(modal, "page_id")
    tall = boxes.join(stats, "page_id").where("height > modal - dev").withColumn("least_height", F.col("modal"))
    tall = materialise(tall, "tall")
    counts = tall.groupBy("page_id").agg(F.count("*").alias("_n"))
    many = materialise(tall.join(counts.where("_n >= 30").select("page_id"), "page_id", "left_semi"), "centres")
    near = rects.nearest_right(many, rects.knn(many, k))
    chains = page_components(many, near.select("page_id", F.col("id").alias("src"), F.col("nb_id").alias("dst")), ["page_id"], "glyph_id", "line_id")
    members = materialise(many.join(chains, ["page_id", "glyph_id"]), "members")
    keys = ["page_id", "line_id"]
    tops = histograms.exact_mode(members, keys, "y", "upper_baseline")
    bottoms = histograms.exact_mode(members.withColumn("bottom", F.col("y") + F.col("height")), keys, "bottom", "lower_baseline")
    sides = members.groupBy(*keys).agg(F.min("y").alias("upper"), F.max(F.col("y") + F.col("height")).alias("lower"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    found = materialise(sides.join(tops, keys).join(bottoms, keys), "limits")
    return intervals.merge_adjacent_lines(intervals.drop_contained_lines(found))


def glyphs_by_projection(runs: DataFrame, limits: DataFrame, widths: DataFrame) -> DataFrame:
    """(page_id, line_id, pos, x, y, width, height, indented, is_last, is_space): letters and spaces of lines, by the column profile.

    ``limits``: lines (page_id, line_id, upper, lower); letters under two pixels are left out, spaces are given where they aren't ten
    times as high as wide.
    """
    keys = ["page_id", "line_id"]
    ends = limits.select("page_id", "line_id", "upper", "lower", F.explode(F.sequence(F.col("upper"), F.col("lower") - 1)).alias("y"))
    inside = runs.join(ends, ["page_id", "y"])
    letters = raster.one_runs(raster.column_profile(inside, ("page_id", "line_id")), keys, "x").withColumn("width", F.col("last") - F.col("first"))
    cut = letters.where("first < last").withColumn("_l", F.col("last") - 1)
    top = intervals.interval_join(inside, cut.drop("upper", "lower"), keys, ("x0", "x1"), ("first", "_l"), raster.CELL).groupBy(*keys, "run", "upper", "lower", "first", "last", "width").agg(F.min("y").alias("y"))
    page = letters.groupBy(*keys).agg(F.min("first").alias("left_x"))
    indents = lines.left_indents(page.join(widths, "page_id")).select("page_id", "line_id", "indent")
    rows = top.join(indents, keys).join(widths, "page_id").withColumnRenamed("first", "x")
    order = Window.partitionBy(*keys).orderBy("x")
    rows = rows.withColumns({"_next": F.lead("x").over(order), "_first": F.lag("x").over(order).isNull()})
    rows = rows.where("width >= 2 and lower - upper >= 2").withColumn("height", F.col("lower") - F.col("y"))
    letter = rows.select(*keys, F.col("run").alias("pos"), "x", "y", "width", "height", (F.col("_first") & (F.col("x") - F.col("indent") > 0.02 * F.col("page_width"))).alias("indented"), F.col("_next").isNull().alias("is_last"), F.lit(False).alias("is_space"))
    gap = F.col("_next") - F.col("last")
    space = rows.where(F.col("_next").isNotNull() & (F.col("height") / gap < 10)).select(*keys, F.col("run").alias("pos"), F.col("last").alias("x"), "y", gap.alias("width"), "height", F.lit(False).alias("indented"), F.lit(False).alias("is_last"), F.lit(True).alias("is_space"))
    return letter.union(space)
