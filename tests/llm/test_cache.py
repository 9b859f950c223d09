"""What a tokenizer's worker keeps between tasks is bounded, and a cache that starts anew changes no ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skeinwork.llm import bpe, queries, ragged


def encoded(encoder: bpe.Encoder, texts: list[str]) -> list[list[int]]:
    out = []
    for _, _, data, at in ragged.slices(pa.array(texts)):
        ids, start = encoder.encode(data, at)
        out += [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)]
    return out


def held(encoder: bpe.Encoder) -> int:
    return sum(x.nbytes for x in vars(encoder).values() if isinstance(x, np.ndarray))


def test_the_cache_is_bounded(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary(queries.vocabulary_path()))
    most = 0
    for k in range(16):
        encoded(encoder, [" ".join(f"w{n:07d}" for n in range(50_000 * k, 50_000 * (k + 1)))])
        most = max(most, held(encoder))
    assert most < 32 << 20
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    texts = [f"{k} some words Again {k * k} it's \u00e9t\u00e9-{k % 7}" for k in range(400)]
    small = bpe.Encoder(encoder.v)
    assert [encoded(small, [t])[0] for t in texts] == encoded(encoder, texts)
