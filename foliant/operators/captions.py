"""Pictures and the captions that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.geometry import UNKNOWN, Rect, position, rect_dist
from foliant.operators.clusters import cut_dist, mst, points, sweep
from foliant.operators.histograms import tall
from foliant.operators.rects import SIDES, bounding, join_rects
from foliant.shared import materialise

LEAST_RECTS = 10


def enough(rects: DataFrame, least: int = LEAST_RECTS) -> DataFrame:
    """The rectangles of pages that have at least ``least``."""
    pages = rects.groupBy("page_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rects.join(pages.select("page_id"), "page_id", "left_semi")


def small_components(clusters: DataFrame, pictures: DataFrame, id_col: str = "glyph_id", low: int = 1, high: int = 99) -> DataFrame:
    """Members (page_id, id, component) of clusters that have low to high members besides pictures; pictures are left out."""
    rest = clusters.join(pictures.select("page_id", id_col), ["page_id", id_col], "left_anti")
    sizes = rest.groupBy("page_id", "component").agg(F.count("*").alias("_n")).where(F.col("_n").between(low, high))
    return rest.join(sizes.select("page_id", "component"), ["page_id", "component"], "left_semi")


def isolated(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """Component boxes (with mean) that have no rectangle's centre within three mean heights to the left or right in their y-range.

    The strips end at the page's edge, the greatest right edge of its rectangles.
    """
    edge = rects.groupBy("page_id").agg(F.max(F.col("x") + F.col("width")).alias("_edge"))
    c = rects.select(F.col("page_id").alias("_p"), (F.col("x") + F.col("width") / 2.0).alias("_a"), (F.col("y") + F.col("height") / 2.0).alias("_b"))
    b, reach = Rect(), F.floor(3 * F.col("mean"))
    left = F.greatest(F.lit(0), b.x - reach)
    right = F.when(b.right + reach < F.col("_edge"), b.right + reach).otherwise(F.col("_edge") - 1)
    beside = ((F.col("_a") >= left) & (F.col("_a") <= b.x)) | ((F.col("_a") >= b.right) & (F.col("_a") <= right))
    level = (F.col("_b") >= b.y) & (F.col("_b") <= b.bottom)
    return boxes.join(edge, "page_id").join(c, (F.col("page_id") == F.col("_p")) & beside & level, "left_anti").drop("_edge")


def belonging(rects: DataFrame, members: DataFrame, pictures: DataFrame, cut: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, component, picture, distance, position): small components that are captions of a picture.

    A caption has a known position, lies within the picture's width (or the other way round, or nearly), isn't a rule, stands
    alone, is lower than the multiplier times the mean height and closer than that; the nearest picture takes it. The multiplier
    is six times the coefficient in ``cut`` (page_id, coef).
    """
    mean = rects.groupBy("page_id").agg(F.avg("height").alias("mean"))
    boxed = rects.join(members, ["page_id", id_col])
    boxes = bounding(boxed, ["page_id", "component"]).join(boxed.groupBy("page_id", "component").agg(F.count("*").alias("size")), ["page_id", "component"])
    boxes = isolated(boxes.join(mean, "page_id").join(cut.where("found").select("page_id", (F.col("coef") * 6).alias("times")), "page_id"), rects)
    pics = pictures.select("page_id", F.col(id_col).alias("picture"), *[F.col(c).alias("p_" + c) for c in SIDES])
    b, p = Rect(), Rect("p_")
    passes = (F.abs(b.x - p.x) + F.abs(b.right - p.right) < p.width) | ((b.x <= p.x) & (b.right >= p.right)) | ((b.x >= p.x) & (b.right <= p.right))
    rule = (F.col("size") < 5) & ((b.width / b.height.cast("double") > 25) | (b.height / b.width.cast("double") > 25))
    most = F.col("times") * F.col("mean")
    pairs = boxes.join(pics, "page_id").withColumns({"distance": rect_dist(b, p), "position": position(b, p)})
    pairs = pairs.where((F.col("position") != UNKNOWN) & passes & ~rule & (b.height < most))
    best = pairs.groupBy("page_id", "component").agg(F.min(F.struct("distance", "picture", "position")).alias("m"), F.first(most).alias("most"))
    return best.where("m.distance < most").select("page_id", "component", "m.picture", "m.distance", "m.position")


def detect_captions(rects: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, id, picture): the rectangles that belong to a picture as its captions."""
    rects = materialise(enough(rects).select("page_id", id_col, *SIDES), "rects")
    pictures = tall(rects)
    cut = materialise(sweep(mst(points(rects, id_col)), rects), "cuts")
    found = cut.where("found")
    clusters = cut_dist(rects, found.select("page_id", F.col("cut").alias("limit")), id_col)
    members = materialise(small_components(clusters, pictures, id_col), "members")
    owners = belonging(rects, members, pictures, cut, id_col)
    return members.join(owners, ["page_id", "component"]).select("page_id", id_col, "picture")


def attach_captions(rects: DataFrame, captions: DataFrame, id_col: str = "glyph_id") -> DataFrame:
    """(page_id, component, x, y, width, height, is_picture): pictures grown by their captions, with all other rectangles, joined again.

    is_picture: higher than seven and wider than three mean heights of the result.
    """
    captions = materialise(captions, "captions")
    owners = captions.select("page_id", "picture").distinct()
    parts = captions.select("page_id", F.col(id_col), "picture").union(owners.select("page_id", F.col("picture").alias(id_col), "picture"))
    grown = bounding(rects.join(parts, ["page_id", id_col]), ["page_id", "picture"]).withColumnRenamed("picture", id_col)
    rest = rects.join(parts, ["page_id", id_col], "left_anti").select("page_id", id_col, *SIDES)
    joined = materialise(join_rects(materialise(grown.select("page_id", id_col, *SIDES).union(rest), "grown"), ["page_id"], id_col), "joined")
    big = tall(joined, 7, 3).select("page_id", "component", F.lit(True).alias("_big"))
    return joined.join(big, ["page_id", "component"], "left").withColumn("is_picture", F.coalesce("_big", F.lit(False))).drop("_big")
