"""Token counts of whole texts; huge ones by overlapping chunks that are resynchronised at proven boundaries.

No vocabulary piece holds the space mark after another character, so no merge can cross a place where a space follows
a character that isn't white space: the pieces left and right of it don't depend on each other. Such a place is a stable
boundary. Chunk k+1 starts inside chunk k; where both have a piece boundary at the same stable place of the overlap,
the counts are spliced there. If there is none, the overlap is widened, in the end to the whole text.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.batches import by_text
from foliant.llm.tokens import pieces

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES, OVERLAP_BYTES = 48_000, 512


@functools.cache
def _separable(path: str) -> bool:
    """Whether the vocabulary keeps the promise that stable boundaries rest on."""
    model = pieces(path)
    words = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(a != "▁" and b == "▁" for w in words for a, b in zip(w, w[1:]))


def _starts(model, raw: bytes) -> np.ndarray:
    return np.fromiter((p.begin for p in model.encode(raw.decode(), return_type="proto").pieces), np.int64)


def _whole(raw: bytes, at: int) -> int:
    """The first character boundary at or after ``at``."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def spliced_count(text: str, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of ``text``; the same number as from encoding it at once."""
    model, raw = pieces(path), text.encode()
    if len(raw) <= chunk or not _separable(path):
        return len(model.encode(text))
    total, cut, start, stop = 0, 0, 0, _whole(raw, chunk)
    left = _starts(model, raw[start:stop]) + start
    while stop < len(raw):
        wide, joint = overlap, None
        while joint is None and stop - wide > cut:
            begin = _whole(raw, stop - wide)
            end = _whole(raw, min(len(raw), begin + max(chunk, 2 * wide)))
            right = _starts(model, raw[begin:end]) + begin
            common = np.intersect1d(left[left > cut], right[right > begin])
            stable = [p for p in common.tolist() if raw[p] == 0x20 and raw[p - 1] > 0x20]
            joint = stable[len(stable) // 2] if stable else None
            wide *= 2
        if joint is None:
            stop = _whole(raw, min(len(raw), stop + chunk))
            left = _starts(model, raw[start:stop]) + start
            continue
        total += int(((left >= cut) & (left < joint)).sum())
        cut, start, stop, left = joint, begin, end, right
    return total + int((left >= cut).sum())


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, n_tokens, over_limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are counted as they come; an empty table
    gives an empty table; further columns aren't read. Very long texts take one chunk's memory at a time.
    """
    path = path or public_tokenizers.path(MODEL)

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        sizes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
        tokens = np.zeros(len(texts), np.int64)
        short = np.flatnonzero(sizes <= chunk)
        for i in range(0, len(short), 64):
            some = short[i : i + 64]
            tokens[some] = [len(x) for x in pieces(path).encode([texts[j] for j in some], num_threads=1)]
        for j in np.flatnonzero(sizes > chunk):
            tokens[j] = spliced_count(texts[j], path, chunk, overlap)
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_text(docs, {"id": id_col}, text_col, work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
