"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``max_bits`` agree up to a small radius in at least one of
them, so each fingerprint is stored in one table per segment and looks up the small Hamming ball round its own segment;
what the tables return is checked by the complete distance.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from foliant.llm.batches import by_text, give_back
from foliant.operators.graph import star_components
from foliant.shared import materialise, merging, release, remove

SEED, RECALL, BROADCAST_ROWS, PASS_SEGMENTS = 42, 0.98, 1_000_000, 4
_ODD = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle; words are parted by ASCII white space, A-Z lower-cased; fewer words are one shingle."""
    parts = text.encode().lower().split()
    if not parts:
        return []
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: max(0, len(parts) - words)])]
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :])]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits of the same shingle."""
    if not k:
        return h
    x = h + np.uint64(k * _ODD % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of ``sizes`` hashes: the 64 bits set in over half of each run. Bits are counted in byte lanes of 255 rows."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    begin = np.cumsum(sizes)[some] - sizes[some]
    parts = -(-sizes[some] // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    half = sizes[some] // 2
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lane, at)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, lanes: int = 1) -> DataFrame:
    """(id, fp: array of ``lanes`` longs) for every row; a text without words has the fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        each = [np.array(shingle_hashes(t, shingle_words), np.uint64) for t in texts]
        sizes, flat = np.array([len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.uint64)])
        prints = np.stack([majorities(_mixed(flat, k), sizes) for k in range(lanes)], 1).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * lanes), pa.array(prints.ravel()))], [id_col, "fp"])

    return by_text(docs, {"id": id_col}, text_col, work, f"`{id_col}` {kind}, fp array<long>")


def distance(a: str, b: str, lanes: int) -> Column:
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(lanes)), F.lit(0))


def segments(bits: int, width: int, count: int) -> list[np.ndarray]:
    """``count`` segments of ``width`` bit positions: consecutive ones first, then those of fixed random orders of all bits."""
    out: list[np.ndarray] = []
    while len(out) < count:
        turn = len(out) // (bits // width)
        order = np.random.default_rng([5, turn]).permutation(bits) if turn else np.arange(bits)
        out += [order[i * width : (i + 1) * width] for i in range(bits // width)]
    return out[:count]


def differing(similarity: float) -> float:
    """Share of the bits that differ, on average, between fingerprints of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def search_plan(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(width, count) of segments looked up at radius 1 so that a pair of this similarity meets with probability ``recall``.

    The width follows the number of rows, so that the strangers met by a lookup stay as few whatever the size, one or two
    a bucket on average, which are told by ``peek`` where they meet; what a wider segment loses is made up by more of them.
    """
    p = differing(similarity)
    width = min(38, max(10, math.ceil(math.log2(max(2, rows))) - 1))
    hit = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _bits(fp: pa.ListArray, lanes: int) -> np.ndarray:
    flat = fp.flatten().to_numpy(zero_copy_only=False).astype("<i8")
    return np.unpackbits(flat.view(np.uint8).reshape(-1, 8 * lanes), axis=1, bitorder="little")


def keys_of(prints: DataFrame, lanes: int, cuts: list[np.ndarray], radius: list[int] | None, peek: np.ndarray) -> DataFrame:
    """(key, node, comp, peek): each fingerprint (node, fp, comp) under the value of each of its segments.

    With ``radius`` also under what it looks up: at radius 1 its segment with one of its set bits cleared. Of two segments that
    differ in one bit, one has that bit set and finds the other. ``peek``: positions of 64 bits that go along, so
    that most strangers in a bucket are told before anything of them is shuffled.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                bits = _bits(part.column("fp"), lanes)
                node, comp = (part.column(c).to_numpy() for c in ("node", "comp"))
                some = np.ascontiguousarray(np.packbits(bits[:, peek], axis=1, bitorder="little")).view(np.int64).ravel()
                keys, at = [], []
                for i, cut in enumerate(cuts):
                    power = np.int64(1) << np.arange(len(cut), dtype=np.int64)
                    own = bits[:, cut].astype(np.int64) @ power + (np.int64(i) << np.int64(40))
                    keys.append(own)
                    at.append(np.arange(len(own)))
                    if radius and radius[i]:
                        row, bit = np.nonzero(bits[:, cut])
                        keys.append(own[row] - power[bit])
                        at.append(row)
                # a fingerprint's rows follow each other, which compresses what they share
                order = np.argsort(at := np.concatenate(at), kind="stable")
                at = at[order]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)[order]), pa.array(node[at]), pa.array(comp[at]), pa.array(some[at])], ["key", "node", "comp", "peek"])
        give_back()

    return prints.select("node", "fp", "comp").mapInArrow(run, "key long, node long, comp long, peek long")


def verified(pairs: DataFrame, prints: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """The pairs (u, v) whose complete fingerprints differ in at most ``max_bits`` bits."""
    left = prints.select(F.col("node").alias("u"), F.col("fp").alias("a"))
    right = prints.select(F.col("node").alias("v"), F.col("fp").alias("b"))
    return pairs.distinct().join(merging(left), "u").join(merging(right), "v").where(distance("a", "b", lanes) <= max_bits).select("u", "v")


def linked(prints: DataFrame, *, lanes: int, cuts: list[np.ndarray], radius: list[int], max_bits: int, peek_bits: int = 64, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(vertex, component) of distinct fingerprints (node long, fp) that have a link, in two rounds.

    First every fingerprint is compared with the least one of each of its buckets, which costs a row a segment and joins dense
    families. Then all lookups are made, but only across the components found: links inside a component change nothing. So
    a bucket that a third of all rows share costs a row each if they are alike. Either round takes ``PASS_SEGMENTS`` segments at a
    time, so that what lies on disk at once grows with the rows and not with the number of segments. Rows carry numbers and 64 of the bits, of which
    ``peek_bits`` at most may differ (64: any); fingerprints are joined to the candidates. ``check`` leaves of the pairs (u, v)
    within ``max_bits`` those that are links.
    """
    check = check or (lambda pairs: pairs)
    spark, peek = prints.sparkSession, np.arange(64) * lanes
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= peek_bits

    def each_pass(candidates: Callable[[list[np.ndarray], list[int]], DataFrame]) -> list[DataFrame]:
        """The candidates (u, v) of all segments, written pass by pass; nothing that a pass shuffled is left for the next one."""
        out = []
        for at in np.array_split(np.arange(len(cuts)), -(-len(cuts) // PASS_SEGMENTS)):
            out.append(candidates([cuts[i] for i in at], [radius[i] for i in at]))
            release(spark)
        return out

    def leaders(some: list[np.ndarray], _: list[int]) -> DataFrame:
        table = keys_of(prints.withColumn("comp", F.col("node")), lanes, some, None, peek)
        least = table.groupBy("key").agg(F.min(F.struct("node", "peek")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.node").alias("v"), F.col("m.peek").alias("p"))
        return materialise(table.join(merging(least), "key").where("node <> v").where(close("peek", "p")).select(F.col("node").alias("u"), "v"), "leaders")

    def links(known: DataFrame, parts: list[DataFrame]) -> DataFrame:
        found = materialise(check(verified(functools.reduce(DataFrame.union, parts), known, lanes, max_bits)), "links")
        for done in parts:
            remove(done)
        release(spark)
        return found

    edges = links(prints, each_pass(leaders))
    first = star_components(edges).select(F.col("vertex").alias("node"), F.col("component").alias("comp"))
    known = materialise(prints.join(merging(first), "node", "left").select("node", "fp", F.coalesce("comp", "node").alias("comp")), "prints")

    def strangers(some: list[np.ndarray], radii: list[int]) -> DataFrame:
        side = keys_of(known, lanes, some, None, peek).select("key", F.col("node").alias("v"), F.col("comp").alias("other"), F.col("peek").alias("p"))
        met = side.groupBy("key", "other").agg(F.min("v").alias("v"), F.min("p").alias("p"), F.count("*").alias("n"))
        across = keys_of(known, lanes, some, radii, peek).join(merging(met), "key").where("comp <> other").where((F.col("n") > 1) | close("peek", "p"))
        across = materialise(across.select("key", "node", "peek", "other", "v", "n"), "across")
        release(spark)
        single = across.where("n = 1").select(F.col("node").alias("u"), "v")
        several = across.where("n > 1").drop("v", "n").join(merging(side), ["key", "other"]).where(close("peek", "p")).select(F.col("node").alias("u"), "v")
        pairs = materialise(single.union(several), "across")
        remove(across)
        return pairs

    found = links(known, each_pass(strangers))
    remove(known)
    return star_components(edges.union(found))


def _matched(rows: DataFrame, few: DataFrame, condition: Column, how: str) -> DataFrame:
    """A join of wide rows with the materialised ``few``: broadcast if they are few indeed, else by a shuffle of both."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, condition, how)


def similar(pairs: DataFrame, texts: DataFrame, names: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles have at least this Jaccard similarity.

    ``names``: (key, least), the id of the text that stands for a node; ``texts``: (id, text). Only the texts asked for move; shingles
    are compared by 32 bits of their hashes.
    """
    pairs = materialise(pairs, "candidates")
    asked = materialise(names.join(merging(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()), "key"), "asked")

    def work(part: pa.RecordBatch, each: list[str]) -> pa.RecordBatch:
        sets = [np.unique(np.array(shingle_hashes(t, shingle_words), np.uint64).astype(np.uint32)) for t in each]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.zeros(0, np.uint32)]).view(np.int32)
        return pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "shingles"])

    wanted = _matched(texts, asked, texts["id"].eqNullSafe(asked["least"]), "inner")
    sets = materialise(by_text(wanted, {"key": "key"}, "text", work, "key long, shingles array<int>"), "shingles")
    written, sets = sets, sets.groupBy("key").agg(F.min("shingles").alias("s"))
    both = pairs.join(merging(sets.toDF("u", "a")), "u").join(merging(sets.toDF("v", "b")), "v").withColumn("n", F.size(F.array_intersect("a", "b")))
    found = materialise(both.where(F.col("n") >= F.lit(similarity) * (F.size("a") + F.size("b") - F.col("n"))).where("n > 0").select("u", "v"), "similar")
    for done in (pairs, asked, written):
        remove(done)
    release(pairs.sparkSession)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, lanes: int = 1, max_bits: int = 2, similarity: float | None = None, recall: float = RECALL) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and the least id of its component: (id, fp, component_id).

    Without ``similarity`` there is one lane and ``max_bits`` is 2 at most: of two segments of 32 bits, radius 1 in the first and 0 in
    the second find every pair. Rows with equal fingerprints are one node, so thousands of copies cost nothing in the search. A
    null or empty text has the fingerprint zero and links like any other. Repeated rows come out each. Ids must be integers or
    structs of them; rows with a null id get a null component_id unless their fingerprint's component has an id. An empty table
    gives no rows; further columns aren't read.

    With ``similarity``, pairs of texts are linked if the Jaccard similarity of their shingles is as high and their fingerprints are
    not further apart than four deviations over what is expected then; ``search_plan`` finds them with ``recall``. Rows of equal fingerprints
    are one node without that test, and the text of their least id stands for them.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, lanes=lanes), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    if similarity is None:
        if lanes != 1 or max_bits > 2:
            raise ValueError("two segments of one lane are complete up to 2 bits only")
        groups = linked(nodes.select("node", "fp"), lanes=1, cuts=segments(64, 32, 2), radius=[1, 0], max_bits=max_bits)
    else:
        width, count = search_plan(nodes.count(), similarity, recall)
        p, texts = differing(similarity), docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        most = lambda bits: math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))
        names = nodes.select(F.col("node").alias("key"), "least")
        check = lambda pairs: similar(pairs, texts, names, shingle_words, similarity)
        groups = linked(nodes.select("node", "fp"), lanes=lanes, cuts=segments(64 * lanes, width, count), radius=[1] * count, max_bits=most(64 * lanes), peek_bits=most(64), check=check)
    named = nodes.join(merging(groups.withColumnRenamed("vertex", "node")), "node", "left").select("fp", "least", "copies", F.coalesce("component", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialise(named.select("fp", "copies", "comp").join(merging(least), "comp").drop("comp"), "named")
    # fingerprints that a thousandth of all rows share are a thousand at most, whatever the table
    hot = named.where(F.col("copies") * 1000 > prints.count()).drop("copies")
    rare = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(merging(named.drop("copies")), "fp")
    return rare.union(prints.join(F.broadcast(hot), "fp"))


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Five-word shingles on 512 bits, of which 78 differ on average (spread 8) at a similarity of 0.8.
SIMILAR = {"shingle_words": 5, "lanes": 8, "similarity": 0.8}


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their near-duplicate group: least id, then hash of the text.

    ``search``: the parameters of ``near_duplicates``, by default ``SIMILAR``. Of rows repeated with id and text, one stays; a null id
    comes before all others, so of a group with one such row that row stays. Null and empty texts are copies of each
    other. An empty table stays empty; columns may have any names. Texts aren't shuffled: what goes is told by keys.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("t"))
    groups = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", **(search or SIMILAR))
    seen = groups.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("key") == F.col("component_id")).alias("first"))
    marked = materialise(seen.where("not first or n > 1").select(F.col("key.id").alias("_id"), F.col("key.t").alias("_t"), "first"), "marked")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), key.alias("key"))
    flagged = _matched(rows, marked, rows["key.id"].eqNullSafe(marked["_id"]) & (rows["key.t"] == marked["_t"]), "left")
    once = flagged.where("first is null").select("row.*")
    return once.union(flagged.where("first").dropDuplicates(["key"]).select("row.*"))
