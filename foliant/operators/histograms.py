"""Histogram modes and filters against page-wide aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.geometry import elongated


def hist(values: DataFrame, keys: list[str], value: str, bins: int | Column) -> DataFrame:
    """Equal-width histogram of each group: (keys, bucket, cnt, left_edge), buckets that hold something only.

    Buckets are open on the left and closed on the right; the least value also lies in bucket 0, where it counts twice. A group
    of one value has bucket 0 only. Equal values are counted before anything is shuffled, and both reads of the counts share one
    exchange, so the source is read once.
    """
    bins = F.lit(bins) if isinstance(bins, int) else bins
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("c").alias("n")).withColumn("bins", bins.cast("int"))
    size = (F.col("hi") - F.col("lo")).cast("double") / F.col("bins")
    raw = F.ceil((F.col(value) - F.col("lo")) / size) - 1
    bucket = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("bins") - 1, raw))).cast("int")
    weight = F.col("c") * F.when((F.col(value) == F.col("lo")) & (F.col("bucket") == 0), 2).otherwise(1)
    rows = counts.join(ends, keys).select(*keys, value, "c", "lo", size.alias("size"), bucket.alias("bucket"))
    return rows.groupBy(*keys, "bucket").agg(F.sum(weight).alias("cnt"), F.first(F.col("lo") + F.col("bucket") * F.col("size")).alias("left_edge"))


def fullest_edge(values: DataFrame, keys: list[str], value: str, bins: int | Column, name: str) -> DataFrame:
    """The left edge of each group's fullest bucket, the first on ties."""
    h = hist(values, keys, value, bins)
    return h.groupBy(*keys).agg(F.max_by("left_edge", F.struct("cnt", -F.col("bucket"))).alias(name))


def baseline(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lower): where most boxes of a line end, by 50 buckets."""
    return fullest_edge(glyphs.withColumn("bottom", F.col("y") + F.col("height")), keys, "bottom", 50, "lower")


def exact_mode(values: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value, the least on ties."""
    return values.groupBy(*keys, value).count().groupBy(*keys).agg(F.max_by(value, F.struct("count", -F.col(value))).alias(name))


def modal_height(glyphs: DataFrame, keys: list[str], bins: int | None = None) -> DataFrame:
    """(keys, modal): by ``bins`` buckets, or by as many as there are values, five at most."""
    return fullest_edge(glyphs, keys, "height", bins or F.least(F.lit(5), F.col("n")), "modal")


def drop_specks(components: DataFrame) -> DataFrame:
    """Components that aren't elongated and hold at least a tenth of the mean area; the mean divides the kept areas by all components."""
    page = Window.partitionBy("page_id")
    kept = ~elongated()
    mean = F.sum(F.when(kept, F.col("area"))).over(page) / F.count("*").over(page)
    return components.withColumn("_least", mean / 10).where(kept & (F.col("area") >= F.col("_least"))).drop("_least")


def tall(rects: DataFrame, times: float = 7, wide: float | None = None) -> DataFrame:
    """Pictures: higher than ``times`` the page's mean height and, if ``wide`` is given, wider than that many mean heights."""
    mean = F.avg("height").over(Window.partitionBy("page_id"))
    rows = rects.withColumn("_mean", mean)
    rows = rows.where(F.col("height") > times * F.col("_mean"))
    return (rows if wide is None else rows.where(F.col("width") > wide * F.col("_mean"))).drop("_mean")


def picture_cut(rects: DataFrame) -> DataFrame:
    """(page_id, cut): the height from which the older pipeline takes rectangles for pictures.

    It is the left edge of the lowest filled bucket of 50 over five times the modal height, else that of the last bucket, so
    that without outliers the tallest boxes are taken.
    """
    ends = rects.groupBy("page_id").agg(F.min("height").alias("lo"), F.max("height").alias("hi"))
    h = hist(rects, ["page_id"], "height", 50).withColumn("edge", F.floor("left_edge"))
    modal = h.groupBy("page_id").agg(F.max_by("edge", F.struct("cnt", -F.col("bucket"))).alias("modal"))
    over = h.join(modal, "page_id").where("edge > 5 * modal").groupBy("page_id").agg(F.min_by("edge", "bucket").alias("cut"))
    last = F.floor(F.col("lo") + 49 * ((F.col("hi") - F.col("lo")).cast("double") / 50))
    return ends.join(over, "page_id", "left").select("page_id", F.coalesce("cut", last).alias("cut"))


def otsu(gray: DataFrame) -> DataFrame:
    """(page_id, threshold): the value that best parts dark from light pixels of (page_id, v, cnt), the least on ties.

    At most 256 rows a page meet in a window; pages never do.
    """
    page = Window.partitionBy("page_id")
    upto = page.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("v") * F.col("cnt")
    g = gray.select("page_id", "v", F.sum("cnt").over(upto).alias("w"), F.sum(mass).over(upto).alias("s"), F.sum("cnt").over(page).alias("n"), F.sum(mass).over(page).alias("t"))
    apart = (F.col("t") * F.col("w") - F.col("s") * F.col("n")).cast("double")
    between = F.when(F.col("w") == F.col("n"), F.lit(0.0)).otherwise(apart * apart / (F.col("w").cast("double") * (F.col("n") - F.col("w")).cast("double")))
    return g.withColumn("between", between).groupBy("page_id").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))
