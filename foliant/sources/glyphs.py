"""Glyph boxes from texts, and the ways into and out of nested and mapped forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = 80


def glyphs_of(texts: DataFrame, id_col: str, text_col: str = "text", *, widths: int = 4) -> DataFrame:
    """Every character but spaces as a box on a grid of 80 columns; longer lines wrap, so whole texts are laid out.

    (page_id, glyph_id, line_no, col_no, x, y, width, height); line_no and col_no are where the box was put. With ``widths`` over
    4 boxes may touch or overlap the next one. A null text is a page without boxes.
    """
    lines = texts.select(F.col(id_col).cast("long").alias("page_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("raw_no", "s"))
    rows = F.greatest(F.lit(1), F.ceil(F.length("s") / F.lit(float(COLUMNS)))).cast("int")
    before = Window.partitionBy("page_id").orderBy("raw_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("first", F.coalesce(F.sum(rows).over(before), F.lit(0)))
    chars = lines.select("page_id", "first", F.posexplode(F.split("s", "")).alias("p", "ch")).where("ch not in ('', ' ')")
    c = F.ascii("ch")
    at = chars.select("page_id", (F.col("first") + F.floor(F.col("p") / COLUMNS)).cast("int").alias("line_no"), (F.col("p") % COLUMNS).alias("col_no"), c.alias("c"), "ch")
    boxes = at.select(
        "page_id", "line_no", "col_no",
        (12 * F.col("col_no")).alias("x"),
        (24 * F.col("line_no") + 4 * (F.col("c") % 3)).alias("y"),
        (8 + F.col("c") % widths).alias("width"),
        (16 - 4 * (F.col("c") % 3) + F.when(F.col("ch").isin("g", "j", "p", "q", "y"), 4).otherwise(0)).alias("height"),
    )
    return boxes.withColumn("glyph_id", F.row_number().over(Window.partitionBy("page_id").orderBy("line_no", "col_no")) - 1)


def with_frames(glyphs: DataFrame) -> DataFrame:
    """Also a box two pixels larger round every tenth box of a page."""
    size = glyphs.groupBy("page_id").agg(F.count("*").cast("int").alias("n"))
    frames = glyphs.where("glyph_id % 10 = 0").join(size, "page_id").select("page_id", (F.col("n") + F.floor(F.col("glyph_id") / 10)).cast("int").alias("glyph_id"), (F.col("x") - 2).alias("x"), (F.col("y") - 2).alias("y"), (F.col("width") + 4).alias("width"), (F.col("height") + 4).alias("height"))
    return glyphs.select(*frames.columns).union(frames)


def with_picture(glyphs: DataFrame, below: int = 2) -> DataFrame:
    """Also a picture ``below`` so many lines after the last one and a caption of ten boxes close under it."""
    ends = glyphs.groupBy("page_id").agg(F.count("*").cast("int").alias("n"), F.max("line_no").alias("last"))
    top = 24 * (F.col("last") + below)
    picture = ends.select("page_id", F.col("n").alias("glyph_id"), F.lit(0).alias("x"), top.alias("y"), F.lit(480).alias("width"), F.lit(240).alias("height"))
    caption = ends.select("page_id", "n", top.alias("y"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("page_id", (F.col("n") + 1 + F.col("i")).alias("glyph_id"), (12 * F.col("i")).alias("x"), (F.col("y") + 246).alias("y"), F.lit(8).alias("width"), F.lit(12).alias("height"))
    return glyphs.select(*picture.columns).union(picture).union(caption)


def indented(glyphs: DataFrame) -> DataFrame:
    """Every fifth line moved right by three columns."""
    return glyphs.withColumn("x", F.col("x") + F.when(F.col("line_no") % 5 == 0, 36).otherwise(0))


def spaced(glyphs: DataFrame) -> DataFrame:
    """The right half of the columns moved right by 200 pixels, and space of 40 pixels after every fifth line."""
    right = F.when(F.col("col_no") >= COLUMNS // 2, 200).otherwise(0)
    return glyphs.withColumns({"x": F.col("x") + right, "y": F.col("y") + 40 * F.floor(F.col("line_no") / 5).cast("int")})


def runs_of(glyphs: DataFrame) -> DataFrame:
    """The rows of pixels of every box: (page_id, y, x0, x1), both ends inclusive."""
    return glyphs.select("page_id", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"), F.col("x").alias("x0"), (F.col("x") + F.col("width") - 1).alias("x1"))


def nested_lines(words: DataFrame) -> DataFrame:
    """One row a page: lines, each its words, each its glyphs, all in order."""
    glyph = F.struct("x", "y", "width", "height", F.coalesce(F.col("shift"), F.lit(0)).alias("shift"))
    by_word = words.groupBy("page_id", "line_id", "word_id").agg(F.array_sort(F.collect_list(F.struct("glyph_id", glyph.alias("g")))).alias("gs"))
    by_line = by_word.groupBy("page_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("word_id", F.transform("gs", lambda g: g["g"]).alias("w")))).alias("ws"))
    return by_line.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", F.transform("ws", lambda w: w["w"]).alias("l")))), lambda x: x["l"]).alias("lines"))


def from_nested(nested: DataFrame) -> DataFrame:
    """The rows of ``nested_lines`` again, with positions as ids."""
    lines = nested.select("page_id", F.posexplode("lines").alias("line_id", "l"))
    words = lines.select("page_id", "line_id", F.posexplode("l").alias("word_id", "w"))
    return words.select("page_id", "line_id", "word_id", F.posexplode("w").alias("pos", "g")).select("page_id", "line_id", "word_id", "pos", "g.*")


def knn_rows(matrices: DataFrame) -> DataFrame:
    """Rows (page_id, id, rank, nb_id) of index matrices given as arrays of arrays, whatever their integer type."""
    rows = matrices.select("page_id", F.posexplode("matrix").alias("id", "row"))
    return rows.select("page_id", "id", F.posexplode("row").alias("rank", "nb_id")).withColumn("nb_id", F.col("nb_id").cast("int"))


def as_map(rows: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """One map a group; ``from_map`` gives the rows back."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"))


def from_map(maps: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    return maps.select(*keys, F.explode("map").alias(key, value))
