"""Best-fit packing of tokenised documents into sequences of one length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.batches import by_text
from foliant.llm.packing_plan import plan
from foliant.llm.tokens import byte_bpe_ids
from foliant.shared import materialise

CAPACITY, GROUPS, BLOCK_BITS = 2048, 400, 17


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of each document's ids followed by ``end_id``; also ``ids`` if asked.

    A document over ``capacity`` is cut; its first piece is the shorter one, so all others are full.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        at, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, text in enumerate(texts):
            ids = np.array([*byte_bpe_ids(text, path), end_id], "<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                at.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[a:b]))
                if with_ids:
                    kept.append(ids[a:b].tobytes())
        columns = [part.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return by_text(docs, {"id": id_col}, text_col, work, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def assign_slots(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a unique ``uid`` and a ``length`` of 1 to ``capacity``.

    Only the histogram of lengths (at most ``capacity`` rows) goes to the driver. A row's rank among those of its length is
    the count in the blocks before its own plus its rank in the block; blocks are bounded, so a length that a third of the
    rows share is spread over many tasks. The counts by block meet the rows as these are parted already. The placements are runs whose number is bounded by the number of lengths (see ``packing_plan``), so they are broadcast.
    """
    spark = pieces.sparkSession
    blocked = pieces.withColumn("block", F.shiftright("uid", BLOCK_BITS))
    counts = materialise(blocked.groupBy("length", "block").agg(F.count("*").alias("n")), "blocks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity, groups=groups)
    placed = spark.createDataFrame(runs, "at_length long, lo long, hi long, base long, first long, each long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = blocked.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("uid")) - 1).join(counts.hint("merge"), ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))
    hit = ranked.join(F.broadcast(placed), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return hit.select(*pieces.columns, (F.col("base") + F.expr("cast((rank - lo) div each as long)")).alias("sequence_id"), (F.col("first") + nth % F.col("each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Pack every document into as few sequences of ``capacity`` tokens as the scheme finds.

    Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset; see ``token_pieces``. A null or empty text is
    the single token ``end_id``. Repeated rows are packed each; a null id stays null; an empty table gives no rows; columns
    besides the two named aren't read. Ties between equal lengths fall by position in the written table of pieces.
    """
    pieces = materialise(token_pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, path=path).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return assign_slots(pieces, capacity=capacity, groups=groups).drop("uid")
