"""Passages of a benchmark in documents, with edits: grams shared on a band of diagonals, exact edit distance.

A passage with few edits shares grams with its item, nearly all on neighbouring diagonals (place in the document less place in
the item). How many it surely shares at the greatest number of edits follows from the item's length, by drawing random
edits; bands of diagonals with that many are verified by the edit distance of the whole item, bit-parallel. Long items
are searched in pieces, one of which has no more than its share of the edits; short ones in pieces of which one has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.llm.batches import by_text, whole_rows

MAX_EDITS, TARGET_RECALL, BAND, PIECE, LEAST_CHARS, BLOCK_CHARS = 0.2, 0.95, 16, 512, 15, 250_000
#: Length of grams for items of at least so many characters.
GRAMS = {24: 4, 80: 5, 128: 7}


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def symbols(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 0xFF).astype(np.uint8)


def grams(text: np.ndarray, gram: int) -> np.ndarray:
    out = np.zeros(max(0, len(text) - gram + 1), np.uint64)
    for i in range(gram):
        out = (out << np.uint64(8)) + text[i : i + len(out)]
    return out


def needed(length: int, gram: int, max_edits: float, target_recall: float, draws: int = 1000) -> int:
    """Grams that two neighbouring bands of diagonals share with an item in which as many random edits as are allowed were made.

    A quantile of the draws that leaves half of what ``target_recall`` lets go; kinds of edits are equally likely.
    """
    k, rng = math.ceil(max_edits * length), np.random.default_rng([9, length, gram])
    kinds = rng.integers(1, 4, (draws, length))
    kinds[np.argsort(np.argsort(rng.random((draws, length)), axis=1), axis=1) >= k] = 0
    edits = np.concatenate([np.zeros((draws, 1), np.int64), np.cumsum(kinds != 0, axis=1)], axis=1)
    row, at = np.nonzero(edits[:, gram:] == edits[:, :-gram])
    drift = np.cumsum((kinds == 2).astype(np.int64) - (kinds == 3), axis=1) + rng.integers(0, BAND, (draws, 1)) + length
    counts = np.zeros((draws, 2 * length // BAND + 3), np.int64)
    np.add.at(counts, (row, drift[row, at] // BAND), 1)
    return int(np.quantile((counts[:, 1:] + counts[:, :-1]).max(axis=1), (1 - target_recall) / 2, method="lower"))


def edit_match(item: str, region: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of ``item`` to a substring of ``region``, end of the first such substring), bit-parallel."""
    m = len(item)
    masks = masks if masks is not None else pattern_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(region, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def gram_for(length: int) -> int:
    return GRAMS[max(n for n in GRAMS if n <= length)]


def shares(text: str, count: int) -> list[str]:
    """``text`` in ``count`` parts whose lengths differ by one at most."""
    return [text[len(text) * i // count : len(text) * (i + 1) // count] for i in range(count)]


def quick_key(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def needed_for(known: dict[tuple[int, int], int], length: int, gram: int, max_edits: float, target_recall: float) -> int:
    """``needed`` for the length rounded down, so that few lengths are drawn for; kept in ``known``."""
    rounded = length - length % 16 if length >= 112 else length - length % 4
    if (rounded, gram) not in known:
        known[rounded, gram] = needed(rounded, gram, max_edits, target_recall)
    return known[rounded, gram]


class Index:
    """Grams of the items, for each length of grams in use."""

    def __init__(self, items: list[tuple[object, str]], max_edits: float, target_recall: float, known: dict[tuple[int, int], int], least_chars: int = LEAST_CHARS):
        self.items, self.max_edits = items, max_edits
        self.by_gram: dict[int, tuple] = {}
        #: Short items: pieces of which one at least is free of edits.
        self.short: dict[int, list[str]] = {}
        #: Items too short for edits, which are looked for as they are, between ends of words.
        self.exact = ahocorasick.Automaton()
        pieces: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        exact: dict[str, list[int]] = {}
        for i, (_, text) in enumerate(items):
            if len(text) < least_chars:
                exact.setdefault(text, []).append(i)
                continue
            if len(text) < min(GRAMS):
                self.short[i] = shares(text, int(max_edits * len(text)) + 1)
                continue
            gram, base = gram_for(len(text)), 0
            for part in shares(text, math.ceil(len(text) / PIECE)):
                pieces.setdefault(gram, []).append((i, base, symbols(part)))
                base += len(part)
        for text, own in exact.items():
            self.exact.add_word(text, own)
        self.exact.make_automaton()
        for gram, some in pieces.items():
            each = [grams(x, gram) for _, _, x in some]
            sizes = np.array([len(x) for x in each])
            keys, piece = np.concatenate(each), np.repeat(np.arange(len(some)), sizes)
            order = np.argsort(keys, kind="stable")
            offset = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            least = np.array([max(1, needed_for(known, len(x), gram, max_edits, target_recall)) for _, _, x in some])
            quick = np.zeros(1 << 22, bool)
            quick[quick_key(keys)] = True
            distinct, times = np.unique(keys, return_counts=True)
            self.by_gram[gram] = (distinct, np.cumsum(times) - times, times, piece[order], offset[order], least, np.array([i for i, _, _ in some]), np.array([b for _, b, _ in some]), quick)
        self.masks: dict[int, dict[str, int]] = {}

    def candidates(self, texts: list[str]) -> set[tuple[int, int, int]]:
        """(text, item, where the item would start in it)."""
        out: set[tuple[int, int, int]] = set()
        for i, pieces in self.short.items():
            for d, text in enumerate(texts):
                for n, piece in enumerate(pieces):
                    base, at = sum(map(len, pieces[:n])), text.find(piece)
                    while at >= 0:
                        out.add((d, i, at - base))
                        at = text.find(piece, at + 1)
        sizes = np.array([len(t) for t in texts], np.int64)
        flat, ends = symbols("".join(texts)), np.cumsum(sizes)
        for gram, (keys, begin, times, piece, offset, least, item, base, quick) in self.by_gram.items():
            step = min(1 << 17, max(1 << 12, BAND * (6_000_000 // len(least)) // BAND * BAND))
            for start in range(-PIECE, len(flat), step):
                low = max(0, start)
                codes = grams(flat[low : start + step + BAND + PIECE + gram], gram)
                some = np.flatnonzero(quick[quick_key(codes)])
                at = np.minimum(np.searchsorted(keys, codes[some]), len(keys) - 1)
                same = keys[at] == codes[some]
                some, first, count = some[same], begin[at[same]], times[at[same]]
                upto = np.cumsum(count)
                bands = step // BAND + 1
                shared = np.zeros(bands * len(least), np.int32)
                cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 1_000_000), "left").tolist()
                for a, b in zip(cuts, [*cuts[1:], len(some)]):
                    n = count[a:b]
                    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)
                    band = (np.repeat(some[a:b], n) + (low - start) - offset[k]) // BAND
                    held = (band >= 0) & (band < bands)
                    np.add.at(shared, band[held] * len(least) + piece[k[held]], np.int32(1))
                grid = shared.reshape(bands, len(least))
                for band, p in zip(*np.divmod(np.flatnonzero((grid[:-1] + grid[1:] >= least).ravel()), len(least))):
                    # a band at a border of documents may belong to either
                    at = start + int(band) * BAND
                    for d in range(np.searchsorted(ends, at, "right"), min(len(texts), np.searchsorted(ends, at + 2 * BAND + PIECE, "right") + 1)):
                        out.add((int(d), int(item[p]), int(at + BAND - base[p] - (ends[d] - sizes[d]))))
        return out

    def matches(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(text, item): (distance, start, end)}, the least of the verified candidates."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, text in enumerate(texts if len(self.exact) else ()):
            for last, own in self.exact.iter(text):
                for i in own:
                    start, end = last + 1 - len(self.items[i][1]), last + 1
                    if (d, i) not in best and not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum():
                        best[d, i] = 0, start, end
        places: list[list[int]] = []
        for d, i, start in sorted(self.candidates(texts)):
            # overlapping regions are searched as one
            if places and places[-1][:2] == [d, i] and start - places[-1][3] <= len(self.items[i][1]):
                places[-1][3] = start
            else:
                places.append([d, i, start, start])
        for d, i, start, last in places:
            item = self.items[i][1]
            allowed = int(self.max_edits * len(item))
            low, high = max(0, start - allowed - 32), last + len(item) + allowed + 32
            if (now := best.get((d, i))) and now[0] == 0:
                continue
            region = texts[d][low:high]
            if i not in self.masks:
                self.masks[i] = pattern_masks(item)
            distance, end = edit_match(item, region, self.masks[i])
            if distance <= allowed:
                back, length = edit_match(item[::-1], region[:end][::-1])
                if now is None or (distance, low + end - length) < now[:2]:
                    best[d, i] = distance, low + end - length, low + end
        return best


def item_blocks(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The normalised items in blocks of about half of ``block_chars``, one at a time on the driver."""
    asked = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * chars / block_chars))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        items = sorted(((r["item"], t) for r in rows if (t := normalised(r["text"]))), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))
        if items:
            yield items


def needs(items: list[tuple[int, str]], max_edits: float, target_recall: float) -> dict[tuple[int, int], int]:
    """What the pieces of ``items`` need, drawn once on the driver."""
    known: dict[tuple[int, int], int] = {}
    for _, text in items:
        if len(text) >= min(GRAMS):
            for part in shares(text, math.ceil(len(text) / PIECE)):
                needed_for(known, len(part), gram_for(len(text)), max_edits, target_recall)
    return known


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, target_recall: float = TARGET_RECALL, least_chars: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs (id, item id, distance, item_chars, match_start, match_end) where an item lies in a document with few edits.

    An item matches where its edit distance to a passage is at most ``max_edits`` of its length; both are lower-cased and white
    space becomes one space, and match_start and match_end count in that form. Leaks with as many
    random edits as are allowed are found with ``target_recall`` at least, those with fewer more often; unedited ones always.
    Null and empty texts match nothing; items under ``least_chars`` characters match where they stand unedited between ends of words. Repeated documents or items give one row a
    pair of ids; ids of both kinds may be of any type that can be sorted, and null ones are kept as ids. Columns may have any names. The items go out in blocks of at most ``block_chars`` characters (a longer
    item is a block), one pass over the documents each, so nothing that is broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out_names = [id_col, item_col, "distance", "item_chars", "match_start", "match_end"]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, distance int, item_chars int, match_start long, match_end long"
    found, item_type = None, to_arrow_type(benchmark.schema[item_col].dataType)
    for items in item_blocks(benchmark, item_col=item_col, item_text_col=item_text_col, block_chars=block_chars):
        shared = spark.sparkContext.broadcast((items, needs(items, max_edits, target_recall)))
        cache: dict[int, Index] = {}

        def work(part: pa.RecordBatch, texts: list[str], shared=shared, cache=cache) -> pa.RecordBatch | None:
            if 0 not in cache:
                cache[0] = Index(shared.value[0], max_edits, target_recall, shared.value[1], least_chars)
            index = cache[0]
            got = index.matches([normalised(t) for t in texts])
            if not got:
                return None
            pairs = sorted(got)
            ids = part.column("id").take(pa.array([d for d, _ in pairs]))
            spans = [got[p] for p in pairs]
            columns = [ids, pa.array([index.items[i][0] for _, i in pairs], item_type), pa.array([s[0] for s in spans], pa.int32()), pa.array([len(index.items[i][1]) for _, i in pairs], pa.int32()), pa.array([s[1] for s in spans], pa.int64()), pa.array([s[2] for s in spans], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, out_names)

        hits = by_text(docs, {"id": id_col}, text_col, work, schema, most=2_000_000)
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], schema)
    best = found.groupBy(id_col, item_col).agg(F.min(F.struct("distance", "item_chars", "match_start", "match_end")).alias("best"))
    return best.select(id_col, item_col, "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = MAX_EDITS, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item lies; see ``find_leaks``. Rows are filtered where they are read.

    Null and empty texts stay, repeated rows stay or go together, an empty table or benchmark changes nothing, columns may have any names.
    """
    spark = docs.sparkSession
    for items in item_blocks(benchmark, item_col=item_col, item_text_col=item_text_col):
        shared = spark.sparkContext.broadcast((items, needs(items, max_edits, target_recall)))

        cache: dict[int, Index] = {}

        def work(part: pa.RecordBatch, texts: list[str], shared=shared, cache=cache) -> pa.RecordBatch:
            if 0 not in cache:
                cache[0] = Index(shared.value[0], max_edits, target_recall, shared.value[1])
            dirty = {d for d, _ in cache[0].matches([normalised(x) for x in texts])}
            return part.filter(pa.array([i not in dirty for i in range(len(part))]))

        docs = whole_rows(docs, text_col, work, most=2_000_000)
    return docs
