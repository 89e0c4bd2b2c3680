import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm.packing import pack
from foliant.llm.packing_plan import plan
from foliant.llm.token_counts import count_tokens, spliced_count
from foliant.llm.token_shards import ShardReader, feistel, write_shards
from foliant.shared import new_path

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_counts(docs, rows, none, unordered):
    want = [(i, len((t or "").encode()), len(PIECES.encode(t or "")), len(PIECES.encode(t or "")) > 4096) for i, t, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, count_tokens(docs).collect()), key=key) == sorted(want, key=key)
    small = count_tokens(docs, chunk=300, overlap=4)
    assert sorted(map(tuple, small.collect()), key=key) == sorted(want, key=key)
    assert count_tokens(none).count() == 0


@pytest.mark.parametrize("text", ["é" * 5000, "a b" * 3000, " " * 4000, "ab\n\n" * 900, "word " * 2000 + "x" * 3000 + " end" * 500, "日本語 テキスト" * 400])
@pytest.mark.parametrize("overlap", [3, 64])
def test_splice_of_hard_texts(text, overlap):
    assert spliced_count(text, public_tokenizers.path("piece_bpe_32k.model"), 500, overlap) == len(PIECES.encode(text))


def test_packing(docs, rows, none):
    got = pack(docs).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append([*library_ids(t), 0])
    pieces = {}
    for r in got:
        assert 1 <= r["length"] <= 2048 and r["offset"] >= 0 and r["offset"] + r["length"] <= 2048
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in pieces.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
    want = []
    for i, all_ids in ids.items():
        for one in all_ids:
            first = len(one) % 2048 or 2048
            cuts = [0, *range(first, len(one) + 1, 2048)]
            want += [(i, k, a, b - a, zlib.crc32(np.array(one[a:b], "<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert len(pieces) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert pack(none).count() == 0


def test_plan_is_whole_and_near_the_bound():
    rng = np.random.default_rng(1)
    for spread in (40, 700, 2047, 0):
        sizes = rng.integers(1, spread + 1, 4000) if spread else np.minimum(2047, 1 + rng.lognormal(6.3, 0.8, 10_000)).astype(int)
        h = {int(n): int(c) for n, c in zip(*np.unique(sizes, return_counts=True))}
        runs, bins = plan(h, 2048)
        placed, used = {}, {}
        assert len(runs) < 70_000
        for n, lo, hi, base, offset, each in runs:
            placed[n] = placed.get(n, 0) + hi - lo
            for r in range(hi - lo):
                used.setdefault(base + r // each, []).append((offset + r % each * n, n))
        assert placed == h and len(used) == bins
        for places in used.values():
            at = 0
            for a, n in sorted(places):
                assert a == at
                at += n
            assert at <= 2048
        assert bins <= 1.02 * sum(n * c for n, c in h.items()) / 2048 + 1
        if not spread:  # like documents: each cut for itself is near the bound
            for cut in (2048 // 3, 2048 // 2):
                assert plan(h, 2048, cuts=(cut,))[1] <= 1.002 * sum(n * c for n, c in h.items()) / 2048 + 1
    assert plan({}, 2048) == ([], 0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = feistel(np.arange(n), n, 9)
    assert sorted(slots.tolist()) == list(range(n))
    assert (feistel(slots, n, 9, inverse=True) == np.arange(n)).all()
    assert n < 10 or (feistel(np.arange(n), n, 8) != slots).any()


def test_shards_round_trip(spark, docs, rows, none):
    root = new_path(spark, "shards")
    out = write_shards(docs, root, length=256, shard_sequences=16).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    read = dict(ShardReader(root, total=len(out), length=256, shard_sequences=16).read())
    assert all(zlib.crc32(read[r["slot"]].tobytes()) == r["ids_crc32"] for r in out)
    tail = list(ShardReader(root, total=len(out), length=256, shard_sequences=16).read(37))
    assert [s for s, _ in tail] == list(range(37, len(out))) and (tail[0][1] == read[37]).all()
    ids = [x for _, t, *_ in rows for x in [*library_ids(t), 50256]]
    kept = [x for r in out for x in read[r["slot"]][: r["n_tokens"]].tolist()]
    assert sorted(kept) == sorted(ids) and sum(r["n_tokens"] for r in out) == len(ids)
    assert write_shards(none, new_path(spark, "shards")).count() == 0
