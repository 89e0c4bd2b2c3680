"""Public tokenizers inside executors: loaded once in each Python worker, never trained, never copied."""

from __future__ import annotations

import base64
import functools
import os
import re

import public_tokenizers

BYTE_BPE = "byte_bpe_50k.json"
#: Latin text: what the two libraries' pattern engines class alike whatever Unicode version they were built with.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")
_SPECIAL = "<|endoftext|>"


@functools.cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def ranks(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def byte_bpe_ids(text: str, path: str | None = None) -> list[int]:
    """Ids as the library for ``byte_bpe_50k.json`` gives them, without added special tokens.

    The same merges ranked for the faster library give the same ids for Latin text without special strings (tested);
    all other texts go to the library of the file itself.
    """
    path = path or public_tokenizers.path(BYTE_BPE)
    quick = path.replace(".json", ".tiktoken")
    if os.path.exists(quick) and _SPECIAL not in text and _PLAIN.fullmatch(text):
        return ranks(quick).encode_ordinary(text)
    return _library(path).encode(text, add_special_tokens=False).ids


@functools.cache
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
