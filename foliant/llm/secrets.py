"""Secrets in texts: three fixed kinds, and strings that a byte-pair vocabulary can't shorten."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.batches import by_text, whole_rows
from foliant.llm.tokens import ranks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "dense")
#: What the efficiency test looks at: runs of key characters, cut at separators into parts.
RUN, PART = re.compile(r"[A-Za-z0-9+/_=-]{12,}"), re.compile(r"[A-Za-z0-9]+")
#: Known digests and identifiers, as a run or as a part of one: MD5 to SHA-512 in either case, UUIDs, plain numbers.
KNOWN = re.compile(r"(?:(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|[0-9]+)", re.I)
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![A-Za-z0-9])", re.I)
#: Characters per token under which a part may belong to a key, and under which a key of at least so many characters is taken for
#: random: with letters and digits, with letters of both cases, with letters of one case.
PART_RATIO, RATIOS = 2.2, {"mixed": {12: 1.9, 16: 2.0}, "cases": {12: 1.8, 16: 1.9}, "letters": {24: 1.75}}

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the three fixed kinds; matches are leftmost and don't overlap within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def _limit(key: str) -> float:
    """Characters per token that ``key`` must stay under, by its kind and length; 0 if it is never taken for random."""
    kind = "mixed" if any(c.isdigit() for c in key) else "letters" if key.islower() or key.isupper() or key[1:].islower() else "cases"
    return max((r for n, r in RATIOS[kind].items() if n <= len(key)), default=0.0) if any(c.isalpha() for c in key) else 0.0


def dense_spans(text: str, path: str, scale: float = 1.0) -> list[Span]:
    """Keys that the vocabulary can't shorten; known digests and identifiers are left out.

    A run is cut at ``+ / _ = -`` into parts. Parts that tokenise like words, known digests and numbers aren't random;
    the longest stretches of other parts, with what stands between them, are keys, judged by their own characters per token. So a
    key is found behind a path or a name, and one that holds separators itself is found whole. ``scale`` moves all limits.
    """
    encode, out = ranks(path).encode_ordinary, []
    for m in RUN.finditer(text):
        run = m[0]
        if run.isalpha() and len(run) < 24 and (run.islower() or run.isupper() or run[1:].islower()) or KNOWN.fullmatch(run):
            continue
        stretch: list[tuple[int, int]] = []
        ids = [u.span() for u in UUID.finditer(run)] if "-" in run else []
        for part in [*PART.finditer(run), None]:
            if part:
                word = part[0]
                tokens = len(encode(word))
                if not (KNOWN.fullmatch(word) or len(word) >= PART_RATIO * tokens or (len(word) < 4 and tokens == 1) or any(a <= part.start() < b for a, b in ids)):
                    stretch.append(part.span())
                    continue
            if stretch:
                a, b = stretch[0][0], stretch[-1][1]
                key = run[a:b]
                if len(key) >= 12 and len(key) < scale * _limit(key) * len(encode(key)):
                    out.append((m.start() + a, 3, m.start() + b))
                stretch = []
    return out


def line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, scale: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    A span is kind:start:end in code points, end exclusive, of the whole match; spans are ordered by start, then kind.
    ``dense`` spans are added by the efficiency test. A null or empty text has no spans, and base_sha256 is then that of the
    empty string. Repeated rows and null ids are kept; further columns aren't read; texts are searched whole, of any length.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in texts:
            base = base_spans(text)
            counts.append([sum(k == n for _, k, _ in base) for n in range(3)])
            digests.append(hashlib.sha256(line(base).encode()).hexdigest())
            spans.append(line(sorted(base + dense_spans(text, path, scale))))
        columns = [part.column("id"), *(pa.array([c[n] for c in counts], pa.int64()) for n in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return by_text(docs, {"id": id_col}, text_col, work, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, path: str, scale: float = 1.0, mark: str = "[secret]") -> str:
    """``text`` with each maximal run of overlapping spans replaced by ``mark``."""
    spans, out, at = sorted(base_spans(text) + dense_spans(text, path, scale)), [], 0
    stop = -1
    for a, _, b in spans:
        if a >= stop:
            if stop >= 0:
                at = stop
            out += [text[at:a], mark]
            stop = b
        else:
            stop = max(stop, b)
    return "".join(out) + text[max(stop, 0) :]


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, path: str | None = None, scale: float = 1.0) -> DataFrame:
    """``docs`` with secrets replaced in ``text_col`` and, if named, the length in ``chars_col`` set anew where one was replaced.

    All rows and columns stay, repeated rows too; a null text stays null, an empty table empty; columns may have any names.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    at = docs.columns.index(text_col)
    size = docs.columns.index(chars_col) if chars_col else None

    def work(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        new = [redacted(x, path, scale) for x in texts]
        null = part.column(at).is_null().to_pylist()
        columns = list(part.columns)
        columns[at] = pa.array([None if z else n for n, z in zip(new, null)], columns[at].type)
        if size is not None:
            columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(part.column(size).to_pylist(), texts, new)], columns[size].type)
        return pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return whole_rows(docs, text_col, work)
