"""Page images: portable graymaps in, runs and grey histograms out, and pages back to images."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """A binary graymap as rows of bytes; anything else has no rows."""
    head = _HEAD.match(data or b"")
    if not head:
        return np.zeros((0, 0), np.uint8)
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(data, np.uint8, width * height, head.end()).reshape(height, width)


def encode(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all graymaps under ``path``; one row a file, read in parallel."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").option("recursiveFileLookup", "true").load(path).select("path", "content")


def gray_histogram(images: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, v, cnt) of images in the column content."""

    def run(batches):
        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.bincount(decode(data).ravel(), minlength=256)
                v = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(v), batch.column(0).type), pa.array(v.astype(np.int32)), pa.array(counts[v])], ["page_id", "v", "cnt"])

    return images.select(id_col, "content").mapInArrow(run, f"page_id {images.schema[id_col].dataType.simpleString()}, v int, cnt long")


def foreground_runs(images: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, y, x0, x1) of the maximal runs of dark pixels; the column threshold says up to which value a pixel is dark.

    The images themselves aren't changed.
    """

    def run(batches):
        for batch in batches:
            for page, data, most in zip(*(c.to_pylist() for c in batch.columns)):
                dark = decode(data) <= most
                edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                y, x0 = np.nonzero(edge == 1)
                x1 = np.nonzero(edge == -1)[1] - 1
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(y), batch.column(0).type), *(pa.array(c.astype(np.int32)) for c in (y, x0, x1))], ["page_id", "y", "x0", "x1"])

    return images.select(id_col, "content", "threshold").mapInArrow(run, f"page_id {images.schema[id_col].dataType.simpleString()}, y int, x0 int, x1 int")


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    if not image.size or not width or not height:
        return np.zeros((height, width), np.uint8)

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    rows = image[y0].astype(float) * (1 - fy[:, None]) + image[y1] * fy[:, None]
    return np.rint(rows[:, x0] * (1 - fx) + rows[:, x1] * fx).astype(np.uint8)


def render(canvas: tuple[int, int], source: np.ndarray, placements: list[tuple[int, int, int, int, int, int]]) -> np.ndarray:
    """A white page of (height, width) with crops (x, y, width, height) of ``source`` copied to (left, top), cut at its edges."""
    page = np.full(canvas, 255, np.uint8)
    for x, y, w, h, left, top in placements:
        part = source[max(y, 0) : y + h, max(x, 0) : x + w]
        top, left, skip_y, skip_x = max(top, 0), max(left, 0), max(-top, 0), max(-left, 0)
        part = part[skip_y:, skip_x:][: max(0, canvas[0] - top), : max(0, canvas[1] - left)]
        page[top : top + part.shape[0], left : left + part.shape[1]] = part
    return page
